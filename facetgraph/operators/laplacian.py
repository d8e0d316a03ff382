"""Degrees and the normalised Laplacian as long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import views


def symmetrise_mean(view: DataFrame) -> DataFrame:
    """``(W + W') / 2``."""
    both = views.both_directions(view, "i", "j", (F.col("w") / 2).alias("w"))
    return both.groupBy("i", "j").agg(F.sum("w").alias("w"))


def degrees(view: DataFrame, keep_diagonal: bool = False) -> DataFrame:
    """Row sums; the diagonal is left out by default. Mirrored views need no symmetrising first."""
    rows = view if keep_diagonal else view.filter(F.col("i") != F.col("j"))
    return rows.groupBy("i").agg(F.sum("w").alias("degree"))


def normalized_laplacian(view: DataFrame, entities: DataFrame, keep_diagonal: bool = False) -> DataFrame:
    """``I - D^-1/2 W D^-1/2`` as rows (i, j, w) with every diagonal cell.

    By default the diagonal of W is dropped and entities without positive degree get factor 0.
    With ``keep_diagonal`` the diagonal stays and a degree of exactly 0 counts as 1e-10.
    """
    sym = symmetrise_mean(view)
    sym = cut(sym if keep_diagonal else sym.filter(F.col("i") != F.col("j")))
    everyone = entities.select("i").distinct()
    d = everyone.join(degrees(sym, keep_diagonal=True), "i", "left").select("i", F.coalesce("degree", F.lit(0.0)).alias("d"))
    if keep_diagonal:
        factor = 1 / F.sqrt(F.when(F.col("d") == 0, 1e-10).otherwise(F.col("d")))
    else:
        factor = F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0)
    s = d.select("i", factor.alias("s"))
    scaled = (
        sym.join(s, "i")
        .join(s.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
        .select("i", "j", (-F.col("w") * F.col("s") * F.col("t")).alias("w"))
    )
    diagonal = everyone.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    if not keep_diagonal:
        return scaled.filter("w <> 0").unionByName(diagonal)
    return scaled.unionByName(diagonal).groupBy("i", "j").agg(F.sum("w").alias("w"))
