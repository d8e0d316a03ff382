"""The star-schema tables seen as graphs, views, partitions and source texts.

Two graphs: nations (small) and suppliers (grows with the data). Every function takes the session
and the folder of the parquet tables and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import views


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(flag: Column) -> Column:
    """Relation type by return flag: R scores as inheritance, A as instantiation, the rest as signature."""
    return F.when(flag == "R", 15).when(flag == "A", 8).otherwise(3).cast("bigint")


# --- nations ---------------------------------------------------------------------------------


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("class"))


def nation_assignment(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("entity"), F.col("r_name").alias("cluster")
    )


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_name").alias("cluster"))


def _named(spark: SparkSession, sf: str, df: DataFrame, **columns: str) -> DataFrame:
    """Replace nation keys by nation names."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    for key, name in columns.items():
        df = df.join(nation.withColumnsRenamed({"n_nationkey": key, "n_name": name}), key).drop(key)
    return df


def nation_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Customer nation to supplier nation, one scored relation per line item, accumulated."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", points(F.col("l_returnflag")).alias("p"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("t"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # suppliers per order collapse to nations before the join with the orders
    sold = line.join(supplier, "l_suppkey").groupBy("l_orderkey", "t").agg(F.sum("p").alias("p"))
    bought = orders.join(customer, "o_custkey").select("l_orderkey", "s")
    edges = sold.join(bought, "l_orderkey").groupBy("s", "t").agg(F.sum("p").alias("score"))
    return _named(spark, sf, edges, s="src", t="dst").select("src", "dst", "score")


def nation_members(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier nations of an order as (grp, member)."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("t"))
    pairs = line.join(supplier, "l_suppkey").select(F.col("l_orderkey").alias("grp"), "t")
    return _named(spark, sf, pairs, t="member").select("grp", "member")


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per (supplier, brand and type)."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", "p_type").alias("f")
    )
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    per_part = line.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return per_part.join(part, "l_partkey").groupBy("l_suppkey", "f").agg(F.sum("n").alias("n"))


def nation_features(spark: SparkSession, sf: str) -> DataFrame:
    """Brand and type counts per supplier nation as sparse features (i, f, v)."""
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("t"))
    per = _profiles(spark, sf).join(supplier, "l_suppkey").groupBy("t", "f").agg(F.sum("n").cast("double").alias("v"))
    return _named(spark, sf, per, t="i").select("i", "f", "v")


# --- suppliers -------------------------------------------------------------------------------


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_name").alias("class"))


def supplier_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _named(
        spark, sf, table(spark, sf, "supplier").select(F.col("s_name").alias("entity"), F.col("s_nationkey").alias("k")), k="cluster"
    ).select("entity", "cluster")


def supplier_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("cluster"))


def _supplier_names(spark: SparkSession, sf: str, df: DataFrame, **columns: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    for key, name in columns.items():
        df = df.join(supplier.withColumnsRenamed({"s_suppkey": key, "s_name": name}), key).drop(key)
    return df


def supplier_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier of a line to the suppliers of the next line of the same order.

    Line numbers repeat within an order, so both sides are summed per (order, line, supplier)
    first: equal lines meet once, with their counts, and not copy by copy.
    """
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", points(F.col("l_returnflag")).alias("p"))
    line = line.filter("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").repartition("l_orderkey")  # once, for the sums and the next lines
    per = line.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    following = Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber").cast("bigint")).rangeBetween(1, 1)
    head = per.withColumn("next", F.collect_list(F.struct(F.col("l_suppkey").alias("t"), "n")).over(following))
    pairs = head.select(F.col("l_suppkey").alias("s"), "p", F.inline("next"))
    edges = pairs.groupBy("s", "t").agg(F.sum(F.col("p") * F.col("n")).alias("score"))
    return _supplier_names(spark, sf, edges, s="src", t="dst").select("src", "dst", "score")


def supplier_members(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of an order as (grp, member)."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("t"))
    return _supplier_names(spark, sf, pairs, t="member").select("grp", "member")


def supplier_features(spark: SparkSession, sf: str) -> DataFrame:
    per = _profiles(spark, sf).select(F.col("l_suppkey").alias("t"), "f", F.col("n").cast("double").alias("v"))
    return _supplier_names(spark, sf, per, t="i").select("i", "f", "v")


# --- suppliers by region: views whose cells all lie within a region, and connect all of it ----------


def supplier_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and their region as (entity, cluster)."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("entity"), F.col("r_name").alias("cluster")
    )


def _hubs(regions: DataFrame) -> DataFrame:
    """(hub, member): the first supplier of a region beside each other one of it."""
    first = regions.groupBy("cluster").agg(F.min("entity").alias("hub"))
    return regions.join(first, "cluster").filter("entity <> hub").select("hub", F.col("entity").alias("member"))


def regional_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier relations within a region, and one of the least score from its first supplier to each other."""
    regions = supplier_regions(spark, sf)
    ends = regions.select(F.col("entity").alias("src"), F.col("cluster").alias("a")), regions.select(F.col("entity").alias("dst"), F.col("cluster").alias("b"))
    inside = supplier_relation(spark, sf).join(ends[0], "src").join(ends[1], "dst").filter("a = b").select("src", "dst", "score")
    return inside.unionByName(_hubs(regions).select(F.col("hub").alias("src"), F.col("member").alias("dst"), F.lit(3).cast("bigint").alias("score")))


def regional_members(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one region in an order, and every supplier beside the first of its region."""
    regions = supplier_regions(spark, sf)
    orders = supplier_members(spark, sf).join(regions, F.col("member") == F.col("entity"))
    orders = orders.select(F.concat_ws("|", F.col("grp").cast("string"), "cluster").alias("grp"), "member")
    pairs = _hubs(regions).select(F.concat(F.lit("hub|"), "member").alias("grp"), F.explode(F.array("hub", "member")).alias("member"))
    return orders.unionByName(pairs)


def regional_features(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles whose features are told apart by region, and one feature for the region itself."""
    regions = supplier_regions(spark, sf).withColumnRenamed("entity", "i")
    own = supplier_features(spark, sf).join(regions, "i").select("i", F.concat_ws("|", "cluster", "f").alias("f"), "v")
    return own.unionByName(regions.select("i", F.col("cluster").alias("f"), F.lit(1.0).alias("v")))


def regional_views(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "str": views.structural_view(regional_relation(spark, sf)),
        "sem": views.unit_factors(regional_features(spark, sf)),
        "fun": views.cooccurrence_view(regional_members(spark, sf)),
    }


def hub_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers beside the first supplier of their region, as affinity rows (i, j, w)."""
    regions = supplier_regions(spark, sf)
    first = regions.groupBy("cluster").agg(F.min("entity").alias("j"))
    return regions.join(first, "cluster").select(F.col("entity").alias("i"), "j", F.lit(1.0).alias("w"))


def brand_members(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that sold parts of a brand as (grp, member): few groups, each with most suppliers in it."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("grp"))
    sold = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("t")).distinct()
    return _supplier_names(spark, sf, sold.join(part, "l_partkey").select("grp", "t").distinct(), t="member").select("grp", "member")


# --- vectors ---------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))


def vector_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity"), F.col("label").alias("cluster"))


# --- source texts ----------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts; a missing text counts as empty."""
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as source files of classes (filename, class, attributes, methods, content).

    A document is named after its first capitalised word, or ``Doc<id>`` where it has none, extends
    the second and third if there are such, constructs every later one that is followed by a blank,
    holds its first line as attributes and the rest as methods.
    """
    docs = documents(spark, sf).withColumn("words", text.capitalised_words(F.col("text")))
    name = F.coalesce(F.get("words", F.lit(0)), F.concat(F.lit("Doc"), F.col("doc_id").cast("string")))
    parents = F.slice("words", 2, 2)
    clause = F.when(F.size(parents) > 0, F.concat(F.lit(" extends "), F.array_join(parents, ", "))).otherwise(F.lit(""))
    body = F.regexp_replace("text", r"([A-Z][a-z]+) ", "new $1( ")
    return docs.select(
        F.format_string("%s/%s/%d.java", F.col("source"), F.when(F.col("lang") == "en", "jpa").when(F.col("lang") == "fr", "src/main").otherwise("morphia"), F.col("doc_id")).alias("filename"),
        name.alias("class"),
        F.regexp_extract("text", r"^([^\n]*)", 1).alias("attributes"),
        F.regexp_replace("text", r"^[^\n]*", "").alias("methods"),
        F.concat(F.lit("class "), name, clause, F.lit(" {\n"), body, F.lit("\n}")).alias("content"),
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages keyed by host."""
    return table(spark, sf, "pages").select(
        "page_id", "url", "html", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host")
    )


def nation_views(spark: SparkSession, sf: str, names: Sequence[str] = ("str", "sem", "fun")) -> dict[str, DataFrame]:
    """The structural, semantic and functional view of the nations as cells; only those asked for are built."""
    made = {
        "str": lambda: views.structural_view(nation_relation(spark, sf)),
        "sem": lambda: views.cosine_cells(nation_features(spark, sf)),
        "fun": lambda: views.cooccurrence_view(nation_members(spark, sf)),
    }
    return {name: made[name]() for name in names}
