"""Entities: declarations, core filters, name collisions, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed, text

_MODIFIER = r"(?:public|protected|private|static|final|abstract|synchronized|native|transient|volatile|default)"
_TYPE = r"([A-Za-z_][\w.]*)(?:\s*<[^;={}()]*>)?\s*((?:\[\s*\]\s*)*)"
_NAME = r"\w+(?:\s*\[\s*\])*"
_FIELD = rf"(?m)^[ \t]*+(?:{_MODIFIER}\s+)++{_TYPE}\s+({_NAME}(?:\s*,\s*{_NAME})*)\s*(?:=[^;]*)?;"
_METHOD = rf"(?m)^[ \t]*+(?:{_MODIFIER}\s+)++(?:<[^(){{}};]*>\s*)?{_TYPE}\s+(\w+)\s*\(([^)]*)\)"
_PARAM = r"^(?:final\s+|@\w+\s+)*" + _TYPE + r"\s*(\.\.\.)?\s*(\w+)$"


def _groups(c: Column, pattern: str, names: Sequence[str]) -> Column:
    """Every match of ``pattern`` as a struct of its groups, in text order."""
    return F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(n + 1)).alias(name) for n, name in enumerate(names)])


def _dims(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\["))


def _params(c: Column) -> Column:
    """Parameter list text as structs; commas inside type arguments are dropped first."""
    bare = F.regexp_replace(c, r"<[^()]*?>", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, _PARAM, 1).alias("type"),
            _dims(F.regexp_extract(p, _PARAM, 2)).alias("dims"),
            (F.regexp_extract(p, _PARAM, 3) == "...").alias("varargs"),
            F.regexp_extract(p, _PARAM, 4).alias("name"),
        ),
    )


def declarations(files: DataFrame) -> DataFrame:
    """Source files to entity rows (filename, class, attributes, methods).

    The declared type is the one the file is named after; files that declare no such type give
    no row. Members are recognised by their modifiers: this reads declarations from text and is
    no grammar, so of several names with initial values in one field only the first is seen.
    Fields are taken from classes only, methods from classes and interfaces; brackets count where
    they follow the type.
    """
    named = files.withColumn("class", text.file_basename(F.col("path"))).filter(F.col("class") != "")
    bare = named.withColumn("bare", text.strip_comments(F.col("content")))
    head = F.concat(F.lit(r"\b(?:class|interface|enum)\s+"), F.col("class"), F.lit(r"\b"))
    kind = F.split(F.regexp_substr("bare", head), r"\s+")[0]
    typed = bare.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    fields = F.flatten(
        F.transform(
            _groups(F.col("bare"), _FIELD, ["type", "dims", "names"]),
            lambda f: F.transform(
                F.split(F.regexp_replace(f["names"], r"[\s\[\]]", ""), ","),
                lambda n: F.struct(f["type"].alias("type"), _dims(f["dims"]).alias("dims"), n.alias("name")),
            ),
        )
    )
    methods = F.transform(
        _groups(F.col("bare"), _METHOD, ["ret", "dims", "name", "params"]),
        lambda m: F.struct(
            m["ret"].alias("ret"), _dims(m["dims"]).alias("dims"), m["name"].alias("name"), _params(m["params"]).alias("params")
        ),
    )
    none = F.array().cast("array<string>")
    return typed.select(
        F.col("path").alias("filename"),
        "class",
        text.bracketed(F.when(F.col("kind") == "class", F.transform(fields, text.attribute_text)).otherwise(none)).alias("attributes"),
        text.bracketed(F.transform(methods, text.method_signature)).alias("methods"),
    )


def core_entities(
    entities: DataFrame,
    key: str = "class",
    suffixes: Sequence[str] = tuple(fixed.CORE_SUFFIXES),
    prefixes: Sequence[str] = tuple(fixed.CORE_PREFIXES),
) -> DataFrame:
    """Entities that no name rule filters out."""
    return entities.filter(text.is_core_name(F.col(key), suffixes, prefixes))


def rule_anti_join(entities: DataFrame, rules: DataFrame, key: str = "class") -> DataFrame:
    """The same filter with the rules in a table (kind, token), kind ``suffix`` or ``prefix``.

    An affix that hits a name is one of the name's own endings or beginnings, so the lookup is an
    equi-join of (kind, affix) and needs no comparison of every name with every rule.
    """
    lengths = F.sequence(F.lit(1), F.length(key))
    affixes = F.concat(
        F.transform(lengths, lambda n: F.struct(F.lit("prefix").alias("kind"), F.left(F.col(key), n).alias("token"))),
        F.transform(lengths, lambda n: F.struct(F.lit("suffix").alias("kind"), F.right(F.col(key), n).alias("token"))),
    )
    names = entities.filter(F.length(key) > 0).select(key).distinct()
    exploded = names.select(key, F.inline(affixes))
    filtered = exploded.join(rules.select("kind", "token").distinct(), ["kind", "token"], "left_semi").select(key).distinct()
    return entities.join(filtered, key, "left_anti")


def restrict_targets(relation: DataFrame, core: DataFrame, key: str = "class") -> DataFrame:
    """Edges between core entities only."""
    keep = core.select(key).distinct()
    return relation.join(keep.select(F.col(key).alias("src")), "src", "left_semi").join(
        keep.select(F.col(key).alias("dst")), "dst", "left_semi"
    ).select("src", "dst", "score")


def implementation_priority(path: Column) -> Column:
    """0 for a ``morphia`` path, 1 for ``jpa``, 2 for the rest."""
    p = text.normal_path(path)
    return F.when(p.contains("morphia"), 0).when(p.contains("jpa"), 1).otherwise(2)


def main_tree_priority(path: Column) -> Column:
    """0 below ``src/main``, 1 elsewhere."""
    return F.when(F.translate(path, "\\", "/").contains("src/main"), 0).otherwise(1)


def resolve_collisions(rows: DataFrame, key: str, path: str, priority: Column, tie: str | None = None) -> DataFrame:
    """One row per key: best priority, then the smallest ``tie`` (the path by default).

    Written as an aggregate with partial minima instead of a ranked window, so one key may hold
    any share of the rows.
    """
    rest = [c for c in rows.columns if c != key]
    rank = F.struct(priority.alias("p"), F.col(tie or path).alias("t"), F.col(path).alias("s"))
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in rest])


def extraction_counts(rows: DataFrame, key: str = "class") -> DataFrame:
    """Rows read, core rows, unique core names, collisions among core rows and filtered rows."""
    core = text.is_core_name(F.col(key))
    per_name = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("core", core)
    return per_name.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~F.col("core"), F.col("n"))), F.lit(0)).alias("filtered"),
        F.count_if("core").alias("core_names"),
        F.coalesce(F.sum(F.when(F.col("core"), F.col("n") - 1)), F.lit(0)).alias("collisions"),
    )


def write_core(rows: DataFrame, path: str, key: str = "class") -> dict[str, int]:
    """Write the unique core names and count while doing so: rows, filtered, core_names, collisions.

    The counts ride on the pass that writes, as observed metrics; nothing is scanned a second time.
    """
    read, kept = Observation("read"), Observation("kept")
    core = text.is_core_name(F.col(key))
    seen = rows.observe(read, F.count("*").alias("rows"), F.count_if(~core).alias("filtered"))
    names = seen.filter(core).groupBy(key).agg(F.count("*").alias("n"))
    names = names.observe(kept, F.count("*").alias("core_names"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"))
    names.select(key).write.mode("overwrite").parquet(path)
    counts = dict.fromkeys(("rows", "filtered", "core_names", "collisions"), 0)
    for observed in (read, kept):
        try:
            counts |= observed.get
        except Py4JJavaError:  # rows that are known to be none are planned away together with their observer
            pass
    return counts


def text_with_fallback(
    core: DataFrame, texts: DataFrame, fallback: Column, key: str = "class", value: str = "text", order: str | None = None
) -> DataFrame:
    """Core list with its text, or ``fallback``. Of several texts per key the last by ``order`` wins.

    Rows of a table have no last one by themselves: without ``order`` the greatest text wins.
    """
    pick = F.max_by(value, order) if order else F.max(value)
    one = texts.groupBy(key).agg(pick.alias("found"))
    return core.join(one, key, "left").select(*core.columns, F.coalesce("found", fallback).alias(value))


def _one_each(texts: DataFrame, key: str, value: str, order: str | None) -> DataFrame:
    return texts.groupBy(key).agg((F.max_by(value, order) if order else F.max(value)).alias(value))


def enrich_semantic(core: DataFrame, summaries: DataFrame, key: str = "class", order: str | None = None) -> DataFrame:
    """Semantic text view from stored summaries (key, summary), one per class: the last by ``order``, else the greatest."""
    joined = core.select(key).distinct().join(_one_each(summaries, key, "summary", order), key, "left")
    summary = text.remove_terms(text.summary_or_fallback(F.col("summary"), F.col(key)))
    return joined.select(F.col(key).alias("class_name"), text.semantic_text(F.col(key), summary).alias("concatenated_text"))


def enrich_functional(
    core: DataFrame, scenarios: DataFrame, key: str = "class", frame: str = fixed.FUNCTIONAL_FRAME, order: str | None = None
) -> DataFrame:
    """Functional text view from stored scenarios (key, scenario), one per class: the last by ``order``, else the greatest."""
    joined = core.select(key).distinct().join(_one_each(scenarios, key, "scenario", order), key, "left")
    scenario = text.scenario_or_fallback(F.col("scenario"))
    return joined.select(F.col(key).alias("class_name"), text.functional_text(F.col(key), scenario, frame).alias("concatenated_text"))


def lemmatize(docs: DataFrame, lemmas: DataFrame, key: str, words: str, distinct: DataFrame | None = None) -> DataFrame:
    """Replace tokens of the array column ``words`` by the lemma table (token, lemma).

    Only the distinct tokens that have a lemma travel back to their document, as a small map;
    the order of the text is never shuffled. ``distinct`` (key, token) saves a pass over the texts
    where the distinct tokens of the documents are there already.
    """
    if distinct is None:
        distinct = docs.select(key, F.explode(F.array_distinct(words)).alias("token"))
    one = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    found = distinct.join(one, "token").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("lemma_of")
    )
    joined = docs.join(found, key, "left")
    replaced = F.when(F.col("lemma_of").isNull(), F.col(words)).otherwise(
        F.transform(words, lambda t: F.coalesce(F.element_at(F.col("lemma_of"), t), t))
    )
    return joined.withColumn(words, replaced).drop("lemma_of")
