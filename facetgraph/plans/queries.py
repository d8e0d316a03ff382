"""The registered queries: each takes (spark, folder of the parquet tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import cluster, entities, fusion, laplacian, matching, quality, relations, scores, source_scan, spectral, text_vectors as tv, threshold_join, views
from ..session import cut, ensure_checkpoint_dir
from ..sources import files, sinks, tables
from . import pipeline, workload as w

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Float sums depend on their order in the last bits; compare rounded values."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- partition quality, relations, views: nations and suppliers -------------------------------

GRAPHS = {
    "": (w.nation_relation, w.nation_assignment, w.regions, w.nations, w.nation_members),
    "_suppliers": (w.supplier_relation, w.supplier_assignment, w.supplier_clusters, w.suppliers, w.supplier_members),
}


def _graph_queries(tag: str) -> None:
    relation, assignment, dim, everyone, members = GRAPHS[tag]

    def on_partition(fn: Callable[..., DataFrame], column: str) -> Query:
        return lambda spark, sf: rounded(fn(relation(spark, sf), assignment(spark, sf), dim(spark, sf)), column)

    QUERIES["icp_by_region" if not tag else f"icp{tag}"] = lambda spark, sf: rounded(
        quality.inter_call_share(relation(spark, sf), assignment(spark, sf)), "icp"
    )
    QUERIES[f"sm_counts{tag}"] = on_partition(quality.structural_modularity, "sm")
    QUERIES[f"sm_weighted{tag}"] = on_partition(lambda r, a, d: quality.structural_modularity(r, a, d, "weights"), "sm")
    QUERIES[f"ifn{tag}"] = on_partition(quality.interface_number, "ifn")
    QUERIES[f"ned{tag}"] = lambda spark, sf: rounded(quality.size_imbalance(assignment(spark, sf), dim(spark, sf)), "ned")
    QUERIES[f"quality_all{tag}"] = on_partition(quality.quality, "value")
    QUERIES[f"relation_scores{tag}"] = relation
    QUERIES[f"relation_map_isolated{tag}"] = lambda spark, sf: sinks.relation_summary(everyone(spark, sf), relation(spark, sf))
    QUERIES[f"structural_view{tag}"] = lambda spark, sf: rounded(views.structural_view(relation(spark, sf)), "w")
    QUERIES[f"structural_view_diag_first{tag}"] = lambda spark, sf: rounded(
        views.structural_view(relation(spark, sf), "zero_before"), "w"
    )
    QUERIES[f"cooccurrence_view{tag}"] = lambda spark, sf: rounded(views.cooccurrence_view(members(spark, sf)), "w")
    QUERIES[f"view_degrees{tag}"] = lambda spark, sf: rounded(laplacian.degrees(views.structural_view(relation(spark, sf))), "degree")


for _tag in GRAPHS:
    _graph_queries(_tag)


@register("relation_map_roundtrip")
def relation_map_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Relations to map literals and back to rows."""
    maps = sinks.relation_maps(w.nations(spark, sf), w.nation_relation(spark, sf))
    return tables.relation_rows(tables.key_column(maps))


@register("cooccurrence_large_groups")
def cooccurrence_large_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of suppliers by the brands both have sold: groups too large to emit their pairs."""
    return views.cooccurrence_counts(cut(w.brand_members(spark, sf)))  # read twice; the lines are joined once


@register("restricted_relation")
def restricted_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the nations of two regions only."""
    core = w.nations(spark, sf).join(
        w.nation_assignment(spark, sf).filter(F.col("cluster").isin("ASIA", "EUROPE")).select(F.col("entity").alias("class")), "class", "left_semi"
    )
    return entities.restrict_targets(w.nation_relation(spark, sf), core)


# --- vectors ------------------------------------------------------------------------------------


@register("cosine_pairs_over_threshold")
def cosine_pairs_over_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.cosine_pairs(w.vectors(spark, sf), threshold=0.3), "w")


@register("cosine_row_sums")
def cosine_row_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Row sums of the whole cosine matrix, from its factors."""
    return rounded(views.cosine_row_sums(views.unit_factors(views.vector_features(w.vectors(spark, sf)))), "degree")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The vectors as two sets, by label; together they are all vectors."""
    both = w.table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"), "label")
    return both.filter("label < 5").drop("label"), both.filter("label >= 5").drop("label")


@register("cosine_rectangular_best")
def cosine_rectangular_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.cosine_rectangle(*_halves(spark, sf), best=1), "w")


@register("cosine_rectangular_over_threshold")
def cosine_rectangular_over_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.cosine_rectangle(*_halves(spark, sf), threshold=0.3), "w")


@register("mutual_best_match")
def mutual_best_match(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.mutual_best(*_halves(spark, sf)), "w")


@register("mean_pool_vectors")
def mean_pool_vectors(spark: SparkSession, sf: str) -> DataFrame:
    pooled = views.mean_pool(w.table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@register("silhouette_precomputed")
def silhouette_precomputed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores.silhouette_vectors(w.vectors(spark, sf), w.vector_assignment(spark, sf)), "silhouette_score")


@register("silhouette_unclipped")
def silhouette_unclipped(spark: SparkSession, sf: str) -> DataFrame:
    factors = views.unit_factors(views.vector_features(w.vectors(spark, sf)))
    return rounded(scores.silhouette_factors(factors, w.vector_assignment(spark, sf)), "silhouette_score")


@register("silhouette_suppliers")
def silhouette_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    view = views.cooccurrence_view(w.supplier_members(spark, sf))
    return rounded(scores.silhouette(view, w.supplier_assignment(spark, sf)), "silhouette_score")


@register("calinski_harabasz_suppliers")
def calinski_harabasz_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    view = views.cooccurrence_view(w.supplier_members(spark, sf))
    return rounded(scores.calinski_harabasz(view, w.supplier_assignment(spark, sf)), "calinski_harabasz_score")


@register("distance_view")
def distance_view(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.distance_view(w.nation_views(spark, sf, ["sem"])["sem"]), "d")


# --- texts as vectors ------------------------------------------------------------------------------

TEXT_BUCKETS = 1 << 16


def _text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.clean_tokens(F.lower("text"))
    return tv.text_vectors(w.documents(spark, sf), "doc_id", tokens, TEXT_BUCKETS, tv.portable_hash)


@register("text_vectors")
def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_text_vectors(spark, sf), "v")


@register("text_cosine_row_sums")
def text_cosine_row_sums(spark: SparkSession, sf: str) -> DataFrame:
    """How similar each document is to all others together, from the factors."""
    return rounded(views.cosine_row_sums(views.unit_factors(_text_vectors(spark, sf))), "degree")


@register("text_pairs_over_threshold")
def text_pairs_over_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose term vectors have a cosine of at least 0.8."""
    return rounded(threshold_join.similar_rows(views.unit_factors(_text_vectors(spark, sf)), 0.8), "w")


# --- fusion ---------------------------------------------------------------------------------------

FIXED_WEIGHTS = {"str": 0.5, "sem": 0.3, "fun": 0.2}


@register("semantic_view")
def semantic_view(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(w.nation_views(spark, sf, ["sem"])["sem"], "w")


@register("semantic_view_sparse")
def semantic_view_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.sparsify(views.cosine_cells(w.supplier_features(spark, sf)), 0.1), "w")


@register("semantic_view_top5")
def semantic_view_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five closest partners of each supplier; rounded first, so that ties are ties in every engine."""
    return views.strongest(rounded(views.cosine_cells(w.supplier_features(spark, sf), best=5, digits=6), "w"), 5)


@register("semantic_view_mutual5")
def semantic_view_mutual5(spark: SparkSession, sf: str) -> DataFrame:
    return views.strongest(rounded(views.cosine_cells(w.supplier_features(spark, sf), best=5, digits=6), "w"), 5, rule="mutual")


@register("fixed_weight_fusion")
def fixed_weight_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.combine(w.nation_views(spark, sf), FIXED_WEIGHTS), "w")


@register("fixed_weight_fusion_suppliers")
def fixed_weight_fusion_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    both = {
        "str": views.structural_view(w.supplier_relation(spark, sf)),
        "fun": views.cooccurrence_view(w.supplier_members(spark, sf)),
    }
    return rounded(views.combine(both, {"str": 0.7, "fun": 0.3}), "w")


def _member_lists(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Entities by role: suppliers' nations, customers' nations, all nations."""
    nation = w.table(spark, sf, "nation")
    one = w.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).filter("s_acctbal > 9000")
    two = w.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("c_acctbal > 0")
    return {"sup": one.select(F.col("n_name").alias("i")), "cus": two.select(F.col("n_name").alias("i")), "all": nation.select(F.col("n_name").alias("i"))}


@register("aligned_keys")
def aligned_keys(spark: SparkSession, sf: str) -> DataFrame:
    return views.common_entities(*_member_lists(spark, sf).values())


@register("alignment_check")
def alignment_check(spark: SparkSession, sf: str) -> DataFrame:
    return views.misaligned(_member_lists(spark, sf))


@register("aligned_view")
def aligned_view(spark: SparkSession, sf: str) -> DataFrame:
    keys = views.common_entities(*_member_lists(spark, sf).values())
    return rounded(views.restrict(views.structural_view(w.nation_relation(spark, sf)), keys), "w")


@register("normalized_laplacian")
def normalized_laplacian(spark: SparkSession, sf: str) -> DataFrame:
    everyone = w.nations(spark, sf).select(F.col("class").alias("i"))
    return rounded(laplacian.normalized_laplacian(views.structural_view(w.nation_relation(spark, sf)), everyone), "w")


@register("normalized_laplacian_with_diagonal")
def normalized_laplacian_with_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    everyone = w.nations(spark, sf).select(F.col("class").alias("i"))
    return rounded(laplacian.normalized_laplacian(w.nation_views(spark, sf, ["sem"])["sem"], everyone, keep_diagonal=True), "w")


@register("normalized_laplacian_suppliers")
def normalized_laplacian_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    everyone = w.suppliers(spark, sf).select(F.col("class").alias("i"))
    return rounded(laplacian.normalized_laplacian(views.structural_view(w.supplier_relation(spark, sf)), everyone), "w")


@register("matrix_norms")
def matrix_norms(spark: SparkSession, sf: str) -> DataFrame:
    order = w.nations(spark, sf).agg(F.count("*").alias("n"))
    return rounded(fusion.matrix_norms(w.nation_views(spark, sf, ["sem"])["sem"], order), "l1", "frobenius", "mean")


@register("matrix_expand")
def matrix_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Nations placed at their keys shifted by five, in a space of thirty positions."""
    mapping = w.table(spark, sf, "nation").select(F.col("n_name").alias("i"), (F.col("n_nationkey") + 5).cast("bigint").alias("position"))
    out = fusion.expand(w.nation_views(spark, sf, ["str"])["str"], mapping, size=30, known=25, original=25)
    return rounded(out, "w")


def _placed_suppliers(spark: SparkSession, sf: str) -> fusion.Placed:
    """Suppliers placed at their keys plus five in a space with ten places more."""
    n = w.table(spark, sf, "supplier").count()
    mapping = w.table(spark, sf, "supplier").select(F.col("s_name").alias("i"), (F.col("s_suppkey") + 5).alias("position"))
    return fusion.place(views.structural_view(w.supplier_relation(spark, sf)), mapping, size=n + 10, known=n, original=n)


@register("expanded_degrees")
def expanded_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_placed_suppliers(spark, sf).degrees(), "degree")


@register("expanded_norms")
def expanded_norms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_placed_suppliers(spark, sf).norms(), "l1", "frobenius", "mean")


@register("symmetric_unit_range")
def symmetric_unit_range(spark: SparkSession, sf: str) -> DataFrame:
    raw = w.nation_relation(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("score") / 1000).alias("w"))
    return rounded(fusion.unit_range(raw, w.nations(spark, sf).select(F.col("class").alias("i"))), "w")


@register("l1_fusion_3iter")
def l1_fusion_3iter(spark: SparkSession, sf: str) -> DataFrame:
    everyone = w.nations(spark, sf).select(F.col("class").alias("i"))
    fused, _, _ = fusion.l1_fusion(w.nation_views(spark, sf, ["str", "sem"]), everyone, max_iter=3)
    return rounded(fused, "w")


@register("l1_fusion")
def l1_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """The same two views, until the cells stand still."""
    fused, _, _ = fusion.l1_fusion(w.nation_views(spark, sf, ["str", "sem"]), w.nations(spark, sf).select(F.col("class").alias("i")))
    return rounded(fused, "w")


# --- names, texts and source relations ---------------------------------------------------------------


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Class-like names: each capitalised word of a text joined to the one after it."""
    caps = w.documents(spark, sf).select(text.capitalised_words(F.col("text")).alias("c"))
    rest = F.greatest(F.size("c") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("c", 1, rest), F.slice("c", 2, rest), lambda a, b: F.concat(a, b))
    return caps.select(F.explode(F.concat("c", pairs)).alias("class"))


# affixes that occur in the documents
TEXT_RULES = {"suffix": ["Ion", "ing", "ent", "Th"], "prefix": ["The", "An", "Re"]}


@register("extraction_counts_written")
def extraction_counts_written(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, taken while the core names are written."""
    counts = entities.write_core(_technical_names(spark, sf), f"{ensure_checkpoint_dir(spark)}/core-{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(counts[c] for c in ("rows", "filtered", "core_names", "collisions"))], "rows bigint, filtered bigint, core_names bigint, collisions bigint")


@register("core_filter")
def core_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Name filter with the standing rules over document words and their endings."""
    return entities.core_entities(_technical_names(spark, sf).distinct())


@register("core_filter_v4")
def core_filter_v4(spark: SparkSession, sf: str) -> DataFrame:
    return entities.core_entities(
        _technical_names(spark, sf).distinct(), suffixes=fixed.CORE_SUFFIXES_V4, prefixes=fixed.CORE_PREFIXES_V4
    )


def _technical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Document words with the technical endings and beginnings their source calls for."""
    words = w.documents(spark, sf).select("lang", F.explode(text.capitalised_words(F.col("text"))).alias("word"))
    name = (
        F.when(F.length("word") > 7, F.concat("word", F.lit("Controller")))
        .when(F.length("word") > 6, F.concat(F.lit("Rest"), "word"))
        .when(F.length("word") > 5, F.concat("word", F.lit("Utils")))
        .when(F.length("word") > 4, F.concat("word", F.lit("Dao")))
        .otherwise(F.col("word"))
    )
    return words.select(name.alias("class"))


@register("rule_anti_join")
def rule_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([(k, t) for k, ts in TEXT_RULES.items() for t in ts], "kind string, token string")
    return entities.rule_anti_join(_words(spark, sf).distinct(), rules)


@register("extraction_counts")
def extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extraction_counts(_technical_names(spark, sf))


@register("collision_dedupe")
def collision_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.classes(spark, sf).select("class", "filename")
    return entities.resolve_collisions(rows, "class", "filename", entities.implementation_priority(F.col("filename")))


@register("collision_dedupe_main")
def collision_dedupe_main(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.classes(spark, sf).select("class", "filename")
    return entities.resolve_collisions(rows, "class", "filename", entities.main_tree_priority(F.col("filename")))


@register("collision_dedupe_hosts")
def collision_dedupe_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """One page per host: secure pages first, then the first page."""
    rows = w.pages(spark, sf).select("host", "url", "page_id")
    secure = F.when(F.col("url").startswith("https"), 0).otherwise(1)
    return entities.resolve_collisions(rows, "host", "url", secure, tie="page_id")


@register("identifier_split")
def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    return w.pages(spark, sf).select("page_id", text.split_identifier(F.col("url")).alias("words"))


@register("lexical_documents")
def lexical_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a class split into words: package, class, attribute and method names."""
    rows = w.classes(spark, sf).select(
        "filename",
        "class",
        text.capitalised_words(F.col("attributes")).alias("a"),
        text.capitalised_words(F.col("methods")).alias("m"),
    )
    package = F.concat(F.lit("org."), F.regexp_extract("filename", r"^([^/]+)", 1))
    return rows.select("filename", text.lexical_document(package, F.col("class"), F.col("a"), F.col("m")).alias("document"))


@register("token_clean")
def token_clean(spark: SparkSession, sf: str) -> DataFrame:
    return w.documents(spark, sf).select("doc_id", F.array_join(text.clean_tokens(F.lower("text")), " ").alias("cleaned_text"))


@register("lemma_join")
def lemma_join(spark: SparkSession, sf: str) -> DataFrame:
    """Plural tokens replaced by the singular where the documents know both."""
    docs = w.documents(spark, sf).select("doc_id", text.tokens(F.lower("text")).alias("words"))
    seen = cut(docs.select("doc_id", F.explode(F.array_distinct("words")).alias("token")))
    # a token stands for itself and, if it ends in s, for the plural of the rest
    forms = F.array_compact(F.array(F.struct(F.col("token").alias("base"), F.lit(0).alias("plural")), F.when(F.col("token").endswith("s"), F.struct(F.expr("left(token, length(token) - 1)").alias("base"), F.lit(1).alias("plural")))))
    known = seen.select("token").distinct().select(F.inline(forms)).groupBy("base").agg(F.count_distinct("plural").alias("n"))
    lemmas = known.filter("n = 2 AND base <> ''").select(F.concat("base", F.lit("s")).alias("token"), F.col("base").alias("lemma"))
    return entities.lemmatize(docs, lemmas, "doc_id", "words", seen).select("doc_id", F.array_join("words", " ").alias("cleaned_text"))


@register("term_removal")
def term_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Standing terms plus words that do occur in the documents."""
    terms = [*fixed.TECHNICAL_TERMS, "the", "and", "le"]
    return w.documents(spark, sf).select("doc_id", text.remove_terms(F.col("text"), terms).alias("cleaned"))


@register("comment_strip")
def comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    return w.pages(spark, sf).select("page_id", text.strip_comments(F.col("html")).alias("code"))


def _core_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One source per class; the texts are fetched after the names are settled."""
    rows = w.classes(spark, sf)
    priority = entities.implementation_priority(F.col("filename"))
    chosen = entities.resolve_collisions(rows.select("class", "filename"), "class", "filename", priority)
    return rows.join(chosen.select("filename"), "filename", "left_semi")


@register("inheritance_edges")
def inheritance_edges(spark: SparkSession, sf: str) -> DataFrame:
    return relations.inheritance_edges(_core_classes(spark, sf))


@register("signature_types")
def signature_types(spark: SparkSession, sf: str) -> DataFrame:
    return relations.signature_edges(_core_classes(spark, sf))


def _accumulated(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("score").alias("score"))


@register("instantiation_counts")
def instantiation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _accumulated(relations.instantiation_edges(_core_classes(spark, sf)))


@register("instantiation_closed")
def instantiation_closed(spark: SparkSession, sf: str) -> DataFrame:
    closing = _core_classes(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit(" )\n")))
    return _accumulated(relations.instantiation_edges(closing, closed=True))


@register("instantiation_open_calls")
def instantiation_open_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that close on their line in the sources of one tree, and mostly never in the others."""
    closing = F.when(F.col("filename").contains("/jpa/"), F.replace("content", F.lit("\n"), F.lit(" )\n"))).otherwise(F.col("content"))
    return _accumulated(relations.instantiation_edges(_core_classes(spark, sf).withColumn("content", closing), closed=True))


@register("class_relation_scores")
def class_relation_scores(spark: SparkSession, sf: str) -> DataFrame:
    return relations.relation_scores(_core_classes(spark, sf))


@register("mention_pairs")
def mention_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as controllers: entities are the class names, controllers are named after the host."""
    controllers = w.pages(spark, sf).select(
        F.format_string("web/spring/%d/%s.java", "page_id", "host").alias("path"), F.col("html").alias("content")
    )
    return relations.mention_pairs(controllers, _core_classes(spark, sf))


@register("declarations")
def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Java-like sources generated from the documents, read back as attributes and methods."""
    return entities.declarations(_java_files(spark, sf))


def _java_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.classes(spark, sf).select(
        "filename", "class", text.capitalised_words(F.col("attributes")).alias("a"), text.capitalised_words(F.col("methods")).alias("m")
    )
    fields = F.transform("a", lambda t, n: F.format_string("  private %s[] f%d;", t, n))
    methods = F.transform("m", lambda t, n: F.format_string("  public %s m%d(%s p, int... q) { }", t, n, t))
    body = F.array_join(F.concat(fields, methods), "\n")
    return rows.select(
        F.concat(F.regexp_extract("filename", r"^(.*)\.java$", 1), F.lit("/"), F.col("class"), F.lit(".java")).alias("path"),
        F.concat(F.lit("package x;\npublic class "), F.col("class"), F.lit(" {\n"), body, F.lit("\n}\n")).alias("content"),
    )


def _scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with two top-level types, members without modifiers, and braces where they don't count."""
    rows = w.classes(spark, sf).select(
        "filename", "class", F.regexp_extract("filename", r"/([a-z]+)[^/]*/\d+\.java$", 1).alias("pack"),
        text.capitalised_words(F.col("attributes")).alias("a"), text.capitalised_words(F.col("methods")).alias("m"),
    )
    plain = F.array_join(F.transform("m", lambda t, n: F.format_string("  List<%s> m%d(final %s p, int... q);\n", t, n, t)), "")
    fields = F.array_join(F.transform("a", lambda t, n: F.format_string("  @Column(name = \"{\") %s[] f%d = {null}, g%d;\n", t, n, n)), "")
    bodies = F.array_join(F.transform("m", lambda t, n: F.format_string("  %s m%d() { if (x) { y('}'); } }\n", t, n)), "")
    return rows.select(
        F.col("filename").alias("path"),
        F.concat(
            F.lit("/* class Hidden { int a; } */\npackage org."), "pack", F.lit(";\nimport java.util.List;\n@Named({\"x\"})\npublic interface "), "class", F.lit("Api {\n"), plain,
            F.lit("}\n// class Gone {\nclass "), "class", F.lit(" extends Base {\n"), fields, F.lit("  "), "class", F.lit("(int size) { super(\"{\"); }\n"), bodies, F.lit("}\n"),
        ).alias("content"),
    )


@register("declared_types")
def declared_types(spark: SparkSession, sf: str) -> DataFrame:
    """All top-level types of generated sources, with their package and members."""
    types = source_scan.declared_types(_scanned_files(spark, sf))
    return types.select(
        "filename", "package", "class", "kind",
        text.bracketed(F.transform("fields", text.attribute_text)).alias("attributes"),
        text.bracketed(F.transform("methods", text.method_signature)).alias("methods"),
    )


@register("lexical_documents_declared")
def lexical_documents_declared(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical documents of the types that are declared under an allowed name."""
    return source_scan.lexical_documents(_scanned_files(spark, sf), w.classes(spark, sf).select("class"))


@register("find_files")
def find_files(spark: SparkSession, sf: str) -> DataFrame:
    found = files.files_by_class(w.classes(spark, sf).select("class"), _java_files(spark, sf))
    return found.select("class", "path", F.length("content").alias("n_chars"))


@register("text_fallback_join")
def text_fallback_join(spark: SparkSession, sf: str) -> DataFrame:
    """Label of every document as text, with a fallback for unlabelled ones."""
    docs = w.table(spark, sf, "documents").select("doc_id")
    texts = w.table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    return entities.text_with_fallback(docs, texts, F.format_string(fixed.FUNCTIONAL_TEXT_FALLBACK, F.col("doc_id").cast("string")), key="doc_id")


@register("semantic_text_view")
def semantic_text_view(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier summaries; suppliers with a small balance have none and get the fallback."""
    summary = w.table(spark, sf, "supplier").select(
        F.col("s_name").alias("class"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("The SQL map of supplier balance "), F.col("s_suppkey").cast("string"))).alias("summary")
    )
    return entities.enrich_semantic(w.suppliers(spark, sf), summary)


@register("functional_text_view")
def functional_text_view(spark: SparkSession, sf: str) -> DataFrame:
    scenario = w.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(
        F.col("s_name").alias("class"), F.concat(F.lit("Order Entry "), F.col("s_nationkey").cast("string")).alias("scenario")
    )
    return entities.enrich_functional(w.suppliers(spark, sf), scenario)


@register("attached_content")
def attached_content(spark: SparkSession, sf: str) -> DataFrame:
    """Texts fetched by path, cut to the limit of the enrichment service; those in German are missing."""
    rows = w.classes(spark, sf)
    found = files.attach_content(rows.select("filename", "class"), rows.filter(~F.col("filename").contains("/morphia/")).select(F.col("filename").alias("path"), "content"))
    return found.select("filename", "class", F.length("content").alias("n_chars"), text.truncate(F.col("content"), 7000).alias("content"))


# --- interchange forms ---


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("source_tree_roundtrip")
def source_tree_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files in a folder per source, and found again by a recursive scan of the tree."""
    path = _scratch(spark, "tree")
    w.documents(spark, sf).select("source", "text").write.partitionBy("source").text(path)
    tree = files.source_files(spark, path, "*.txt")
    own = tree.select(F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source"), F.length("content").alias("n"))
    return own.groupBy("source").agg(F.sum("n").alias("n_chars"))


@register("text_view_roundtrip")
def text_view_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts to CSV and back, with their line ends and quotes."""
    path = _scratch(spark, "texts")
    sinks.write_csv(w.documents(spark, sf).select("doc_id", "text"), path)
    back = tables.csv_table(spark, path, "doc_id bigint, text string")
    return back.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@register("table_roundtrip")
def table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Text views written by language and read back."""
    path = _scratch(spark, "table")
    sinks.write_table(w.documents(spark, sf).select("doc_id", "lang", "text"), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# ------------------------------------------------------------------------------


@register("partition_document")
def partition_document(spark: SparkSession, sf: str) -> DataFrame:
    """Partition documents and back to rows, with empty clusters."""
    docs = sinks.partition_documents(w.supplier_assignment(spark, sf), w.supplier_clusters(spark, sf))
    assignment, dim = tables.partition_rows(docs)
    return dim.join(assignment.groupBy("cluster").agg(F.count("*").alias("n"), F.min("entity").alias("first")), "cluster", "left").select(
        "cluster", F.coalesce("n", F.lit(0)).alias("n"), "first"
    )


@register("partition_document_parts")
def partition_document_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The same in documents of about a hundred entities."""
    docs = sinks.partition_documents(*sinks.in_parts(w.supplier_assignment(spark, sf), w.supplier_clusters(spark, sf), 100), ["part"])
    assignment, dim = tables.partition_rows(docs)
    return dim.select("cluster").distinct().join(assignment.groupBy("cluster").agg(F.count("*").alias("n"), F.min("entity").alias("first")), "cluster", "left").select(
        "cluster", F.coalesce("n", F.lit(0)).alias("n"), "first"
    )


@register("relation_map_parts")
def relation_map_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of suppliers to map literals of about ten targets each, and back to rows."""
    maps = sinks.relation_maps(w.suppliers(spark, sf), w.supplier_relation(spark, sf), per_row=20)
    return tables.relation_rows(maps)


@register("wide_matrix_roundtrip")
def wide_matrix_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Long view to a wide labelled matrix and back."""
    regions = [r[0] for r in w.regions(spark, sf).orderBy("cluster").limit(sinks.EXPORT_LIMIT + 1).collect()]  # one more, so that the export can refuse
    links = quality.cluster_links(w.nation_relation(spark, sf), w.nation_assignment(spark, sf))
    view = links.select(F.col("cs").alias("i"), F.col("ct").alias("j"), F.col("weight").cast("double").alias("w"))
    return tables.wide_matrix(sinks.pivot_matrix(view, regions), "i")


# --- iterative operators: rows-only in the SQL check, compared with numpy in the tests ---------------


def _nation_stack(spark: SparkSession, sf: str, keep_diagonal: bool = False):
    everyone = w.nations(spark, sf).select(F.col("class").alias("i"))
    three = {
        "str": views.structural_view(w.nation_relation(spark, sf)),
        "sem": views.unit_factors(w.nation_features(spark, sf)),
        "fun": views.cooccurrence_view(w.nation_members(spark, sf)),
    }
    return three, everyone


def _supplier_stack(spark: SparkSession, sf: str):
    everyone = w.suppliers(spark, sf).select(F.col("class").alias("i"))
    three = {
        "str": views.structural_view(w.supplier_relation(spark, sf)),
        "sem": views.unit_factors(w.supplier_features(spark, sf)),
        "fun": views.cooccurrence_view(w.supplier_members(spark, sf)),
    }
    return three, everyone


@register("consensus_basis")
def consensus_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Eigenvalues of the uniformly weighted supplier views."""
    three, everyone = _supplier_stack(spark, sf)
    stack = spectral.stack_views(three, everyone)
    basis = spectral.smallest_eigenvectors(stack, [1 / 3] * 3, 5)
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in enumerate(basis.values[:5])], "n int, eigenvalue double")


@register("self_weighted_fusion")
def self_weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.self_weighted(*_nation_stack(spark, sf), k=5).history_table(spark)


@register("self_weighted_fusion_v4")
def self_weighted_fusion_v4(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.self_weighted(*_nation_stack(spark, sf), k=5, variant="v4").history_table(spark)


@register("self_weighted_fusion_suppliers")
def self_weighted_fusion_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.self_weighted(*_supplier_stack(spark, sf), k=5).history_table(spark)


@register("spectral_partition")
def spectral_partition(spark: SparkSession, sf: str) -> DataFrame:
    stack = spectral.stack_views(*_supplier_stack(spark, sf))
    return cluster.spectral_sweep(stack, [1 / 3] * 3, [5])


@register("kmeans_rows")
def kmeans_rows(spark: SparkSession, sf: str) -> DataFrame:
    view = views.combine(w.nation_views(spark, sf), FIXED_WEIGHTS)
    return cluster.kmeans_rows(view, w.nations(spark, sf).select(F.col("class").alias("i")), 5)


@register("k_sweep")
def k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the spectral partitions of the fused nation views, best first."""
    swept = pipeline.sweep(w.nation_views(spark, sf), w.nations(spark, sf).select(F.col("class").alias("i")), FIXED_WEIGHTS)
    return sinks.ranked_scores(swept.scores)


@register("best_k")
def best_k(spark: SparkSession, sf: str) -> DataFrame:
    swept = pipeline.sweep(w.nation_views(spark, sf), w.nations(spark, sf).select(F.col("class").alias("i")), FIXED_WEIGHTS)
    return scores.best_k(swept.scores)


def _pipeline(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return pipeline.run(
            w.nation_views(spark, sf), w.nations(spark, sf).select(F.col("class").alias("i")), w.nation_relation(spark, sf), k=5, view=kind
        ).quality

    return run


for _kind in ("str", "sem", "fun", None):
    QUERIES[f"pipeline_{_kind or 'full'}"] = _pipeline(_kind)


# --- iterative operators on views that fall into regions: their results are known in closed form ------

REGION_WEIGHTS = [1 / 3] * 3


def _regional(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], DataFrame, int]:
    """Views, entities and number of regions that have suppliers."""
    regions = w.supplier_regions(spark, sf)
    return w.regional_views(spark, sf), regions.select(F.col("entity").alias("i")), regions.select("cluster").distinct().count()


def _regional_basis(spark: SparkSession, sf: str) -> tuple[spectral.Basis, int]:
    three, everyone, k = _regional(spark, sf)
    return spectral.smallest_eigenvectors(spectral.stack_views(three, everyone), REGION_WEIGHTS, k, tol=1e-6), k


@register("consensus_basis_regions")
def consensus_basis_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest eigenvalues of views that fall into regions: one zero for each of them."""
    basis, k = _regional_basis(spark, sf)
    return spark.createDataFrame([(n, abs(round(float(v), 6))) for n, v in enumerate(basis.values[:k])], "n int, eigenvalue double")


@register("consensus_leverage_regions")
def consensus_leverage_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Squared length of every entity's row of the basis, which no rotation of the basis changes."""
    basis, k = _regional_basis(spark, sf)
    length = sum((F.col(f"y{c}") * F.col(f"y{c}") for c in range(k)), F.lit(0.0))
    return basis.rows.select("i", F.round(length, 6).alias("leverage"))


def _regional_fusion(variant: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fused = fusion.self_weighted(*_regional(spark, sf), variant=variant, tol=1e-6)
        return rounded(fused.history_table(spark), "weight_before", "weight", "loss", "step")

    return run


QUERIES["self_weighted_fusion_regions"] = _regional_fusion("current")
QUERIES["self_weighted_fusion_v4_regions"] = _regional_fusion("v4")


@register("spectral_partition_regions")
def spectral_partition_regions(spark: SparkSession, sf: str) -> DataFrame:
    three, everyone, k = _regional(spark, sf)
    return cluster.spectral_sweep(spectral.stack_views(three, everyone), REGION_WEIGHTS, [k])


@register("kmeans_rows_regions")
def kmeans_rows_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are alike within a region and apart across regions."""
    regions = w.supplier_regions(spark, sf)
    k = regions.select("cluster").distinct().count()
    return cluster.kmeans_rows(w.hub_rows(spark, sf), regions.select(F.col("entity").alias("i")), k)


def _regional_pipeline(kind: str | None, variant: str = "current") -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        three, everyone, k = _regional(spark, sf)
        out = pipeline.run(three, everyone, w.supplier_relation(spark, sf), k=k, view=kind, variant=variant)
        return rounded(out.quality, "value")

    return run


for _kind in ("str", "sem", "fun", None):
    QUERIES[f"pipeline_{_kind or 'full'}_regions"] = _regional_pipeline(_kind)
QUERIES["pipeline_v4_regions"] = _regional_pipeline(None, "v4")


def _given_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by nation and by region as two partitions (k, entity, cluster), named by their number of clusters."""
    parts = []
    for given in (w.supplier_assignment(spark, sf), w.supplier_regions(spark, sf)):
        k = given.agg(F.count_distinct("cluster").cast("int").alias("k")).scalar()
        parts.append(given.select("entity", "cluster").withColumn("k", k))
    return parts[0].unionByName(parts[1]).select("k", "entity", "cluster")


@register("partition_scores")
def partition_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both scores of the given partitions over the co-occurrence view."""
    scored = scores.sweep_scores(views.cooccurrence_view(w.supplier_members(spark, sf)), _given_partitions(spark, sf))
    return rounded(sinks.ranked_scores(scored), "silhouette_score", "calinski_harabasz_score")


@register("best_partition")
def best_partition(spark: SparkSession, sf: str) -> DataFrame:
    scored = scores.sweep_scores(views.cooccurrence_view(w.supplier_members(spark, sf)), _given_partitions(spark, sf))
    return rounded(scores.best_k(scored), "silhouette_score")


@register("k_sweep_factors")
def k_sweep_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Both scores of the given partitions over the semantic view, from its factors."""
    factors = views.unit_factors(w.supplier_features(spark, sf))
    return rounded(scores.sweep_scores_factors(factors, _given_partitions(spark, sf)), "silhouette_score", "calinski_harabasz_score")
