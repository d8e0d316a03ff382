"""Source trees: whole-file text, decoding, and lookup of files by class name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def decode(content: Column, policy: str = "ignore") -> Column:
    """Bytes to text. ``ignore`` drops undecodable bytes, ``strict`` raises on them."""
    if policy == "ignore":
        valid = F.make_valid_utf8(content.cast("string"))
        return F.replace(valid, F.lit("�"), F.lit(""))
    if policy == "strict":
        return F.decode(content, "utf-8")
    raise ValueError(f"unknown decoding policy {policy!r}")


def source_files(
    spark: SparkSession, root: str, pattern: str = "*.java", policy: str = "ignore"
) -> DataFrame:
    """All files below ``root`` as (path, content)."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return raw.select("path", decode(F.col("content"), policy).alias("content"))


def attach_content(entities: DataFrame, files: DataFrame, missing: str = "empty") -> DataFrame:
    """Entity rows plus ``content`` of their file; a missing file gives ``''`` or drops the row."""
    right = files.select(F.col("path").alias("filename"), "content")
    if missing == "empty":
        joined = entities.join(right, "filename", "left")
        return joined.withColumn("content", F.coalesce("content", F.lit("")))
    if missing == "drop":
        return entities.join(right, "filename")
    raise ValueError(f"unknown policy {missing!r}")


def files_by_class(entities: DataFrame, files: DataFrame, key: str = "class") -> DataFrame:
    """(key, path, content) of ``<Class>.java``; first path wins, entities without one are skipped.

    The first path is an aggregate with partial sums on the map side, so a name that occurs in
    a third of all files needs no big window.
    """
    named = files.select("path", text.file_basename(F.col("path")).alias(key)).filter(F.col(key) != "")
    wanted = named.join(entities.select(key).distinct(), key, "left_semi")
    first = wanted.groupBy(key).agg(F.min("path").alias("path"))
    return first.join(files, "path").select(key, "path", "content")
