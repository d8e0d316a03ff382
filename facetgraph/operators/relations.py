"""Typed relation edges from source text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import entities as ent


def _scored(names: Column, score: int) -> Column:
    return F.transform(names, lambda t: F.struct(t.alias("dst"), F.lit(score).cast("bigint").alias("points")))


def _parents(content: str) -> Column:
    return _scored(F.filter(text.parent_names(F.col(content)), lambda t: t != ""), fixed.INHERITANCE_SCORE)


def _types(attributes: str, methods: str) -> Column:
    """The attribute score where the attributes mention the type, else the signature score."""
    held = F.array_distinct(text.capitalised_words(F.col(attributes)))
    called = F.array_except(text.capitalised_words(F.col(methods)), held)
    return F.concat(_scored(held, fixed.ATTRIBUTE_SCORE), _scored(called, fixed.METHOD_SIGNATURE_SCORE))


def _constructed(content: str, closed: bool) -> Column:
    names = text.constructed_names(F.col(content))
    if not closed:
        return _scored(names, fixed.INSTANTIATION_SCORE)
    return F.transform(
        F.array_distinct(names),
        lambda t: F.struct(
            t.alias("dst"),
            (
                F.regexp_count(F.col(content), F.concat(F.lit(r"(?Ud)\bnew\s+"), t, F.lit(r"\s*\(.*?\)")))
                * F.lit(fixed.INSTANTIATION_SCORE).cast("bigint")
            ).alias("points"),
        ),
    )


def _others(candidates: Column, key: str) -> Column:
    return F.filter(candidates, lambda c: (c["dst"] != F.col(key)) & (c["points"] > 0))


def _edges(entities: DataFrame, key: str, candidates: Column) -> DataFrame:
    """One edge row per candidate whose target is an entity; nothing is grouped yet."""
    rows = entities.select(F.col(key).alias("src"), F.inline(candidates))
    names = entities.select(F.col(key).alias("dst")).distinct()
    return rows.join(names, "dst", "left_semi").select("src", "dst", F.col("points").alias("score"))


def inheritance_edges(entities: DataFrame, key: str = "class", content: str = "content") -> DataFrame:
    """Parents named by the first clause; an entity that names itself is kept."""
    return _edges(entities, key, _parents(content))


def signature_edges(
    entities: DataFrame, key: str = "class", attributes: str = "attributes", methods: str = "methods"
) -> DataFrame:
    """Types of attributes and signatures, once each; the attribute score wins over the other."""
    return _edges(entities, key, _others(_types(attributes, methods), key))


def instantiation_edges(
    entities: DataFrame, key: str = "class", content: str = "content", closed: bool = False
) -> DataFrame:
    """``new T(`` of other entities; one edge row per occurrence.

    One pass collects the constructed names of a text, and an equi-join keeps the entities. With
    ``closed`` the call must close on its line and swallows what is inside, so nested calls of
    one type count once.
    """
    return _edges(entities, key, _others(_constructed(content, closed), key))


def relation_scores(
    entities: DataFrame,
    key: str = "class",
    content: str = "content",
    attributes: str = "attributes",
    methods: str = "methods",
    closed: bool = False,
) -> DataFrame:
    """All three analyses, accumulated per (src, dst): one scan of the texts, one shuffle of partial sums."""
    candidates = F.concat(
        _parents(content), _others(_types(attributes, methods), key), _others(_constructed(content, closed), key)
    )
    return _edges(entities, key, candidates).groupBy("src", "dst").agg(F.sum("score").alias("score"))


def mention_pairs(controllers: DataFrame, core: DataFrame, key: str = "class") -> DataFrame:
    """Core entities mentioned in each controller text (path, content) as (grp, member).

    Of several controllers with one name the last path with a mention wins.
    """
    named = controllers.filter(text.is_controller(F.col("path"))).select(
        F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.java", "").alias("grp"),
        "path",
        F.explode(F.array_distinct(text.capitalised_words(text.strip_comments(F.col("content"))))).alias("member"),
    )
    hits = named.filter(F.col("grp") != F.col("member")).join(
        core.select(F.col(key).alias("member")).distinct(), "member", "left_semi"
    )
    last = hits.groupBy("grp").agg(F.max("path").alias("path"))
    return hits.join(last, ["grp", "path"]).select("grp", "member").distinct()


def find_and_score(files: DataFrame, closed: bool = False, scan: Callable[[DataFrame], DataFrame] = ent.declarations) -> tuple[DataFrame, DataFrame]:
    """Source files to (core entities with content, relation); ``scan`` reads the declarations."""
    core = ent.core_entities(scan(files))
    unique = ent.resolve_collisions(core, "class", "filename", ent.implementation_priority(F.col("filename")))
    full = unique.join(files.select(F.col("path").alias("filename"), "content"), "filename")
    return full, relation_scores(full, closed=closed)
