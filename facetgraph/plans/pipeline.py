"""Whole runs: views to fused affinity, partitions over a sweep of k, scores and quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cluster, fusion, quality, relations, scores, source_scan, spectral, text_vectors, views
from ..session import cut
from ..sources import files as source


@dataclass
class Sweep:
    assignment: DataFrame
    dim: DataFrame
    scores: DataFrame


@dataclass
class Result:
    weights: dict[str, float]
    assignment: DataFrame
    quality: DataFrame
    history: DataFrame | None


def sweep(
    parts: dict[str, DataFrame],
    entities: DataFrame,
    weights: dict[str, float],
    ks: Sequence[int] | None = None,
    n_init: int = 50,
    clip: bool = True,
) -> Sweep:
    """Spectral partitions and their scores for every k; views as cells (i, j, w)."""
    stack = spectral.stack_views(parts, entities)
    ks = list(ks if ks is not None else cluster.default_ks(stack.n))
    assignment = cluster.spectral_sweep(stack, [weights[n] for n in stack.names], ks, n_init)
    fused = cut(views.combine(parts, weights))
    scored = scores.sweep_scores(fused, assignment, clip)
    return Sweep(assignment, cluster.cluster_dim(entities.sparkSession, ks), scored)


def run(
    parts: dict[str, DataFrame],
    entities: DataFrame,
    relation: DataFrame,
    k: int,
    view: str | None = None,
    variant: str = "current",
    n_init: int = 50,
    members: dict[str, DataFrame] | None = None,
) -> Result:
    """Fuse (or take one view as the fused one), partition into k and measure on the relations.

    Views may be cells (i, j, w) or factors (i, f, v); an entity without a cell is isolated in that
    view, and no less there. ``members`` lists the entities (i) that each view was built over, where
    they differ: the older variant goes on with those that all views share, the current one refuses
    views that are not aligned. Without ``members`` all views are over ``entities``.
    """
    history, basis, stack = None, None, None
    if view is not None:
        weights = {view: 1.0}
        parts = {view: parts[view]}
    else:
        if members and variant == "v4":
            entities = views.common_entities(entities, *members.values()).distinct()
        elif members:
            views.require_aligned({"entities": entities, **members})
        fused = fusion.self_weighted(parts, entities, k, variant)
        weights, history = fused.weights, fused.history_table(entities.sparkSession)
        if fused.stack.keep_diagonal:
            spectral.unstack(fused.stack)
        else:
            stack, basis = fused.stack, fused.basis
    # the partition drops the diagonal in both variants
    stack = stack or spectral.stack_views(parts, entities)
    order = [weights[n] for n in stack.names]
    basis = spectral.smallest_eigenvectors(stack, order, k, start=basis)
    assignment = cluster.spectral_sweep(stack, order, [k], n_init, basis=basis)
    spectral.unstack(stack)
    chosen = assignment.select("entity", F.col("cluster").cast("string").alias("cluster"))
    dim = cluster.cluster_dim(entities.sparkSession, [k]).select(F.col("cluster").cast("string").alias("cluster"))
    measured = quality.quality(relation, chosen, dim, "counts" if variant == "current" else "weights")
    return Result(weights, assignment, measured, history)


def source_views(files: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Source files (path, content) to all three views, the core entities (i) and their relation.

    Declared types that no name rule filters out are the entities. Structural: their relations.
    Semantic: names of package, class and members, split into words and cleaned, as weighted term
    vectors. Functional: types that one controller mentions together.
    """
    core, relation = relations.find_and_score(files, scan=source_scan.entities)
    core, relation = cut(core), cut(relation)
    documents = source_scan.lexical_documents(files, core.select("class")).join(core.select("filename", "class"), ["filename", "class"])
    terms = text_vectors.text_vectors(documents, "class", text.clean_tokens(F.lower("document")))
    parts = {
        "str": views.structural_view(relation),
        "sem": views.unit_factors(terms),
        "fun": views.cooccurrence_view(relations.mention_pairs(files, core)),
    }
    return parts, core.select(F.col("class").alias("i")), relation


def source_run(spark, root: str, k: int, view: str | None = None, variant: str = "current", n_init: int = 50) -> Result:
    """Source tree to fused and measured partition; ``view`` takes one view alone."""
    parts, entities, relation = source_views(source.source_files(spark, root))
    return run(parts, entities, relation, k, view, variant, n_init)


def structural_run(spark, root: str, k: int, n_init: int = 50) -> Result:
    """Source tree to partition by its relations alone."""
    entities, relation = relations.find_and_score(source.source_files(spark, root))
    keys = entities.select(F.col("class").alias("i"))
    return run({"str": views.structural_view(relation)}, keys, relation, k, view="str", n_init=n_init)
