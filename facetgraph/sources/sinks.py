"""Outputs. The canonical form of every result is a long table; wide forms are exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_LIMIT = 5000


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A CSV folder with headers; ``order`` gives a globally sorted (range-partitioned) output."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def relation_summary(entities: DataFrame, relation: DataFrame, key: str = "class") -> DataFrame:
    """Edge count and score sum per entity, isolated entities included."""
    agg = relation.groupBy(F.col("src").alias(key)).agg(
        F.count("*").alias("n_edges"), F.sum("score").alias("total_score")
    )
    return (
        entities.select(key).distinct().join(agg, key, "left").select(
            key,
            F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
            F.coalesce("total_score", F.lit(0)).alias("total_score"),
        )
    )


def relation_maps(entities: DataFrame, relation: DataFrame, key: str = "class", to: str = "relations", per_row: int | None = None) -> DataFrame:
    """Map literals per entity, ``{}`` for isolated ones. Interchange only: the long relation table is the canonical form.

    By default a row holds all targets of its entity. With ``per_row`` an entity of many targets gets
    several rows, told apart by ``part``, of about half as many targets each; whoever reads the maps
    back as rows sees no difference.
    """
    item = F.concat(F.lit("'"), F.col("dst"), F.lit("': "), F.col("score").cast("string"))
    edges, keys = relation.withColumn("part", F.lit(0)), [F.col("src").alias(key), "part"]
    if per_row:
        parts = relation.groupBy("src").agg(F.ceil(2 * F.count("*") / F.lit(per_row)).alias("parts"))
        edges = relation.join(parts, "src").withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"))
    maps = edges.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", item.alias("item")))), lambda x: x["item"]), ", ").alias("items")
    )
    literal = F.concat(F.lit("{"), F.coalesce("items", F.lit("")), F.lit("}"))
    out = entities.select(key).distinct().join(maps, key, "left")
    return out.select(key, *([F.coalesce("part", F.lit(0)).alias("part")] if per_row else []), literal.alias(to))


def in_parts(assignment: DataFrame, cluster_dim: DataFrame, per_row: int) -> tuple[DataFrame, DataFrame]:
    """Assignment and clusters with a key column ``part``, so that a partition document holds about ``per_row`` entities.

    ``partition_documents(*in_parts(..), ["part"])`` writes a partition of any size; read back, the
    parts of a cluster are its members again.
    """
    parts = max(1, -(-assignment.count() // per_row))
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    return assignment.withColumn("part", F.pmod(F.xxhash64("entity"), F.lit(parts)).cast("int")), cluster_dim.select("*", all_parts)


def pivot_matrix(view: DataFrame, order: Sequence[str], default: float = 0.0) -> DataFrame:
    """Wide labelled matrix for export; refuses more columns than a table should have."""
    if len(order) > EXPORT_LIMIT:
        raise ValueError(f"{len(order)} columns; write the long view instead")
    wide = view.groupBy("i").pivot("j", list(order)).agg(F.first("w"))
    return wide.na.fill(default).orderBy("i")


def partition_documents(assignment: DataFrame, cluster_dim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON document per key (one in all without keys), with empty clusters.

    An export for partitions that fit a document; ``assignment`` itself is the canonical table.
    """
    keys = list(keys)
    members = assignment.groupBy(*keys, "cluster").agg(F.sort_array(F.collect_list("entity")).alias("members"))
    full = cluster_dim.join(members, [*keys, "cluster"], "left").withColumn(
        "members", F.coalesce("members", F.array().cast("array<string>"))
    )
    entries = F.sort_array(F.collect_list(F.struct(F.col("cluster").cast("string"), "members")))
    return full.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def write_partitions(documents: DataFrame, path: str, keys: Sequence[str] = ("k",)) -> None:
    documents.write.mode("overwrite").partitionBy(*keys).text(path)


def ranked_scores(scores: DataFrame, by: str = "silhouette_score", limit: int | None = None) -> DataFrame:
    """Score table, best first; ``limit`` gives the top-k report."""
    out = scores.orderBy(F.desc(by), "k")
    return out.limit(limit) if limit else out
