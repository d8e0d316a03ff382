"""Quality of a partition against the directed relation graph.

``relation`` has rows (src, dst, score), ``assignment`` has (entity, cluster) and ``cluster_dim``
lists all clusters, empty ones too; without it the clusters are those that have members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _dim(assignment: DataFrame, cluster_dim: DataFrame | None) -> DataFrame:
    return (cluster_dim if cluster_dim is not None else assignment).select("cluster").distinct()


def _sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("cluster").agg(F.count("*").alias("m"))


def located_edges(relation: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges with both ends assigned: (src, dst, score, cs, ct)."""
    one = assignment.select(F.col("entity").alias("src"), F.col("cluster").alias("cs"))
    two = assignment.select(F.col("entity").alias("dst"), F.col("cluster").alias("ct"))
    return relation.join(one, "src").join(two, "dst").select("src", "dst", "score", "cs", "ct")


def _links(located: DataFrame) -> DataFrame:
    return located.groupBy("cs", "ct").agg(F.count("*").alias("edges"), F.sum("score").alias("weight"))


def cluster_links(relation: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edge count and weight per (source cluster, target cluster)."""
    return _links(located_edges(relation, assignment))


def _modularity(links: DataFrame, assignment: DataFrame, cluster_dim: DataFrame | None, variant: str) -> DataFrame:
    measure = {"counts": "edges", "weights": "weight"}[variant]
    k = _dim(assignment, cluster_dim).agg(F.count("*").alias("k")).scalar()
    sizes = _sizes(assignment)
    sized = links.join(sizes.select(F.col("cluster").alias("cs"), F.col("m").alias("ms")), "cs").join(
        sizes.select(F.col("cluster").alias("ct"), F.col("m").alias("mt")), "ct"
    )
    inside = F.col("cs") == F.col("ct")
    parts = sized.agg(
        F.coalesce(F.sum(F.when(inside, F.col(measure) / (F.col("ms") * F.col("ms")))), F.lit(0.0)).alias("cohesion"),
        F.coalesce(F.sum(F.when(~inside, F.col(measure) / (2 * F.col("ms") * F.col("mt")))), F.lit(0.0)).alias("coupling"),
    ).withColumn("k", k)
    full = F.col("cohesion") / F.col("k") - F.col("coupling") / (F.col("k") * (F.col("k") - 1) / 2)
    single = F.lit(0.0) if variant == "counts" else F.col("cohesion")
    value = F.when(F.col("k") >= 2, full).when(F.col("k") == 1, single).otherwise(0.0)
    return parts.select(value.alias("sm"))


def structural_modularity(
    relation: DataFrame, assignment: DataFrame, cluster_dim: DataFrame | None = None, variant: str = "counts"
) -> DataFrame:
    """Mean cohesion minus mean coupling; ``counts`` uses edges, ``weights`` their scores."""
    return _modularity(cluster_links(relation, assignment), assignment, cluster_dim, variant)


def _inter_share(links: DataFrame) -> DataFrame:
    total = F.sum("weight")
    across = F.sum(F.when(F.col("cs") != F.col("ct"), F.col("weight")).otherwise(0))
    return links.agg(F.when(total > 0, across / total).otherwise(0.0).alias("icp"))


def inter_call_share(relation: DataFrame, assignment: DataFrame) -> DataFrame:
    """Weight of edges across clusters over the weight of all assigned edges; 0 without edges."""
    return _inter_share(cluster_links(relation, assignment))


def _interfaces(located: DataFrame) -> DataFrame:
    crossing = located.filter(F.col("cs") != F.col("ct"))
    return crossing.select(F.col("dst").alias("entity"), F.col("ct").alias("cluster")).distinct()


def interface_entities(relation: DataFrame, assignment: DataFrame) -> DataFrame:
    """Entities with an incoming edge from another cluster."""
    return _interfaces(located_edges(relation, assignment))


def _per_cluster(total: DataFrame, assignment: DataFrame, cluster_dim: DataFrame | None, value: Column, name: str) -> DataFrame:
    k = _dim(assignment, cluster_dim).agg(F.count("*").alias("k")).scalar()
    return total.withColumn("k", k).select(F.when(F.col("k") > 0, value / F.col("k")).otherwise(0.0).alias(name))


def interface_number(relation: DataFrame, assignment: DataFrame, cluster_dim: DataFrame | None = None) -> DataFrame:
    """Mean number of interface entities per cluster."""
    return _mean_interfaces(located_edges(relation, assignment), assignment, cluster_dim)


def _mean_interfaces(located: DataFrame, assignment: DataFrame, cluster_dim: DataFrame | None) -> DataFrame:
    total = _interfaces(located).agg(F.count("*").alias("n"))
    return _per_cluster(total, assignment, cluster_dim, F.col("n"), "ifn")


def size_imbalance(assignment: DataFrame, cluster_dim: DataFrame | None = None, low: int = 5, high: int = 20) -> DataFrame:
    """Share of clusters whose size is outside [low, high]; 1 without clusters."""
    sized = _dim(assignment, cluster_dim).join(_sizes(assignment), "cluster", "left")
    fits = F.coalesce(F.col("m"), F.lit(0)).between(low, high)
    return sized.agg(F.coalesce(1 - F.avg(F.when(fits, 1.0).otherwise(0.0)), F.lit(1.0)).alias("ned"))


def quality(
    relation: DataFrame, assignment: DataFrame, cluster_dim: DataFrame | None = None, variant: str = "counts"
) -> DataFrame:
    """The four metrics as rows (metric, value); the joined edges are computed once."""
    located = cut(located_edges(relation, assignment))
    links = _links(located)

    def row(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))

    return (
        row("SM", _modularity(links, assignment, cluster_dim, variant), "sm")
        .unionByName(row("ICP", _inter_share(links), "icp"))
        .unionByName(row("IFN", _mean_interfaces(located, assignment, cluster_dim), "ifn"))
        .unionByName(row("NED", size_imbalance(assignment, cluster_dim), "ned"))
    )
