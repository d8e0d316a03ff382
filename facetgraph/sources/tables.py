"""Interchange tables: CSV scans, map literals, wide matrices and partition documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header line, quoted fields may span lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def key_column(df: DataFrame, candidates: Sequence[str] = ("class", "class_name"), to: str = "class") -> DataFrame:
    """Rename whichever key column is present; the first candidate wins."""
    for name in candidates:
        if name in df.columns:
            return df.withColumnRenamed(name, to)
    raise ValueError(f"none of {list(candidates)} among {df.columns}")


def parse_map(literal: Column, bad: str = "empty") -> Column:
    """``{'T': 15}`` as MAP<STRING,BIGINT>; a bad literal gives an empty map or an error."""
    mode = {"empty": "PERMISSIVE", "raise": "FAILFAST"}[bad]
    parsed = F.from_json(F.translate(literal, "'", '"'), "map<string,bigint>", {"mode": mode})
    return F.coalesce(parsed, F.create_map().cast("map<string,bigint>"))


def relation_rows(df: DataFrame, key: str = "class", literal: str = "relations", bad: str = "empty") -> DataFrame:
    """Map literals to edge rows (src, dst, score)."""
    return df.select(
        F.col(key).alias("src"), F.explode(parse_map(F.col(literal), bad)).alias("dst", "score")
    )


def wide_matrix(df: DataFrame, label: str | None = None) -> DataFrame:
    """A labelled wide matrix as rows (i, j, w)."""
    label = label or df.columns[0]
    cells = [c for c in df.columns if c != label]
    typed = df.select(F.col(f"`{label}`").alias("i"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cells])
    return typed.unpivot(["i"], [F.col(f"`{c}`") for c in cells], "j", "w")


def read_wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    return wide_matrix(csv_table(spark, path))


def partition_rows(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """Partition documents ``{"cluster_0": [...], ...}`` as (assignment, cluster_dim).

    Empty clusters stay in ``cluster_dim``. The other columns of ``documents`` are kept as keys.
    """
    keys = [c for c in documents.columns if c != column]
    parsed = documents.select(
        *keys, F.explode(F.from_json(column, "map<string,array<string>>")).alias("cluster", "members")
    )
    dim = parsed.select(*keys, "cluster")
    return parsed.select(*keys, F.explode("members").alias("entity"), "cluster"), dim


def read_partition(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return partition_rows(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "document"))
