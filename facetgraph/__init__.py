"""Multi-view graph analytics as PySpark DataFrame operators."""
