"""Partitions of a fused view: spectral, k-means on affinity rows, and the sweep over k."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .spectral import SLICE_ROWS, Basis, Stack, Walk, smallest_eigenvectors

SEED = 42
SEED_ROUNDS = 2


def relabel(assignment: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Number the clusters 0.. by their smallest member, so that labels are reproducible."""
    keys = list(keys)
    first = assignment.groupBy(*keys, "cluster").agg(F.min("entity").alias("first"))
    # a row per cluster, not per entity: the ranked groups hold k rows
    order = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "cluster"))).alias("o"))
    number = order.select(*keys, F.posexplode("o").alias("number", "c")).select(*keys, "number", F.col("c.cluster").alias("cluster"))
    return assignment.join(number, [*keys, "cluster"]).select(*keys, "entity", F.col("number").cast("int").alias("cluster"))


def cluster_dim(spark, ks: Sequence[int]) -> DataFrame:
    """All clusters (k, cluster) of the partitions, empty ones too."""
    return spark.createDataFrame([(int(k),) for k in ks], "k int").select(
        "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cluster")
    )


# --- many k-means runs in one pass ---------------------------------------------------------------


def _plus_plus(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates by squared distance."""
    weights = np.maximum(weights, 1e-12)
    centers = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    d = ((candidates - centers[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        mass = d * weights
        pick = rng.choice(len(candidates), p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(len(candidates))
        centers.append(candidates[pick])
        d = np.minimum(d, ((candidates - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)


def _uniform(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes, different ones for each n."""
    x = h + np.uint64(((n + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _drawn(points: DataFrame, columns: list[str], candidates: dict, wanted: dict[tuple[int, int], int], seed: int) -> dict:
    """``wanted`` more candidates per run, out of all points, in proportion to the squared distance.

    A point draws the key log(u) / d**2 with u from a hash of its name, and the largest keys win:
    that is sampling without replacement by weight, so a task need keep its largest keys only and
    no total has to be known before.
    """
    index = {r: n for n, r in enumerate(candidates)}

    def draw(batches):
        held = {r: (np.zeros(0), np.zeros((0, c.shape[1]))) for r, c in candidates.items()}
        for pdf in batches:
            x, h = _points(pdf[columns]), pdf["h"].to_numpy().view(np.uint64)
            for r, c in candidates.items():
                xr = x[:, : c.shape[1]]
                d = _assign(xr, c)[1] if len(c) else np.ones(len(x))
                open_ = d > 1e-18
                key = np.log(_uniform(h[open_], index[r])) / d[open_]
                keys, rows = np.concatenate((held[r][0], key)), np.concatenate((held[r][1], xr[open_]))
                best = np.argsort(-keys, kind="stable")[: wanted[r]]
                held[r] = keys[best], rows[best]
        for r, (keys, rows) in held.items():
            if len(keys):
                yield pd.DataFrame({"run": index[r], "key": keys, "x": list(rows)})

    rows = points.select(F.xxhash64("i", F.lit(seed)).alias("h"), *columns).mapInPandas(draw, "run int, key double, x array<double>")
    per_run = max(wanted.values())
    last = Window.partitionBy("run").orderBy(F.desc("key"), "x")
    found = rows.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= per_run).collect()
    names = list(candidates)
    out = {r: [] for r in names}
    for row in sorted(found, key=lambda r: (r.run, r.n)):
        if row.n <= wanted[names[row.run]]:
            out[names[row.run]].append(row.x)
    return out


def _seeds(points: DataFrame, columns: list[str], runs: dict[int, int], n_init: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """k-means||: candidates drawn from all points in rounds, weighed by the points nearest to them."""
    names = [(k, s) for k in runs for s in range(n_init)]
    candidates = {r: np.zeros((0, runs[r[0]])) for r in names}
    for turn in range(1 + SEED_ROUNDS):
        wanted = {r: 1 if turn == 0 else 2 * r[0] for r in names}
        for r, rows in _drawn(points, columns, candidates, wanted, seed + turn).items():
            if rows:
                candidates[r] = np.concatenate((candidates[r], np.array(rows)))
    if any(not len(c) for c in candidates.values()):
        raise ValueError("k-means needs at least one point")
    weights = _lloyd(points, columns, candidates, runs)
    rng = np.random.default_rng(seed)
    return {r: _plus_plus(candidates[r], weights[r][0], r[0], rng) for r in names}


def _assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]
    label = d.argmin(axis=1)
    return label, np.maximum(d[np.arange(len(x)), label], 0)


def kmeans_runs(
    points: DataFrame, columns: Sequence[str], runs: dict[int, int], n_init: int, seed: int = SEED, max_iter: int = 100, tol: float = 1e-4
) -> dict[int, np.ndarray]:
    """Best centers per k for ``runs`` {k: number of leading columns}, ``n_init`` starts each.

    All starts of all k move together: an iteration reads the points once, sums per (run, cluster)
    inside the tasks and lets Spark add the partial sums. Only centers, k x d numbers per run,
    pass through the driver. Seeds, iterations and the final assignment use all points. A run that
    still moves after ``max_iter`` iterations is warned of.
    """
    columns = list(columns)
    centers = _seeds(points, columns, runs, n_init, seed)
    active = set(centers)
    cost = dict.fromkeys(centers, np.inf)
    for _ in range(max_iter):
        moved = _lloyd(points, columns, {r: centers[r] for r in active}, runs)
        for run, (counts, sums, total) in moved.items():
            old = centers[run]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)
            shift = ((new - old) ** 2).sum()
            centers[run], cost[run] = new, total
            if shift <= tol * max(1e-12, (old * old).mean()):
                active.discard(run)
        if not active:
            break
    if active:
        warnings.warn(f"{len(active)} of {len(centers)} k-means starts still moved after {max_iter} iterations", stacklevel=2)
    return {k: centers[min(((k, s) for s in range(n_init)), key=lambda r: cost[r])] for k in runs}


def _points(pdf: pd.DataFrame) -> np.ndarray:
    x = pdf.to_numpy(dtype=float)
    if not np.isfinite(x).all():
        raise ValueError("coordinates must be finite numbers")
    return x


def _lloyd(points: DataFrame, columns: list[str], centers: dict, runs: dict[int, int]) -> dict:
    """Counts, coordinate sums and cost per run for one iteration."""
    index = {r: n for n, r in enumerate(centers)}

    def partial(batches):
        totals = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in centers.items()}
        for pdf in batches:
            x = _points(pdf[columns])
            for r, c in centers.items():
                xr = x[:, : runs[r[0]]]
                label, d = _assign(xr, c)
                t = totals[r]
                np.add.at(t[:, 2:], label, xr)
                t[:, 0] += np.bincount(label, minlength=len(c))
                t[:, 1] += np.bincount(label, weights=d, minlength=len(c))
        yield pd.DataFrame({"run": [index[r] for r in totals], "t": [m.ravel() for m in totals.values()]})

    parts = points.select(*columns).mapInPandas(partial, "run int, t array<double>").select("run", F.posexplode("t").alias("pos", "x"))
    summed = parts.groupBy("run", "pos").agg(F.sum("x").alias("x")).toPandas().sort_values(["run", "pos"])
    out = {}
    for n, r in enumerate(centers):
        t = summed.x[summed.run == n].to_numpy().reshape(centers[r].shape[0], -1)
        out[r] = (t[:, 0], t[:, 2:], float(t[:, 1].sum()))
    return out


def assign_runs(points: DataFrame, columns: Sequence[str], centers: dict[int, np.ndarray]) -> DataFrame:
    """Nearest center of every point for every k: (k, entity, cluster)."""
    columns = list(columns)
    kind = points.schema["i"].dataType.simpleString()

    def label(batches):
        for pdf in batches:
            x = _points(pdf[columns])
            for k, c in centers.items():
                yield pd.DataFrame({"k": k, "entity": pdf["i"].to_numpy(), "cluster": _assign(x[:, : c.shape[1]], c)[0]})

    return points.select("i", *columns).mapInPandas(label, f"k int, entity {kind}, cluster int")


# --- spectral ------------------------------------------------------------------------------------


def embedding(stack: Stack, weights: Sequence[float], basis: Basis) -> DataFrame:
    """Spectral coordinates: eigenvector entries over the square root of the degree."""
    d = sum((F.lit(float(w)) * F.col(f"d{v}") for v, w in enumerate(weights)), F.lit(0.0))
    scale = F.when(d > 0, 1 / F.sqrt(d)).otherwise(1.0)
    ys = [f"y{c}" for c in range(basis.width)]
    return basis.rows.join(stack.nodes, "i").select("i", *[(F.col(y) * scale).alias(y) for y in ys])


def spectral_sweep(
    stack: Stack, weights: Sequence[float], ks: Sequence[int], n_init: int = 50, tol: float = 1e-5, basis: Basis | None = None
) -> DataFrame:
    """Spectral partitions (k, entity, cluster) for all ``ks`` from one eigenbasis.

    The vectors for k are the first k columns of the basis for the largest k.
    """
    top = max(ks)
    if basis is None or basis.width < top:
        basis = smallest_eigenvectors(stack, weights, top, tol=tol)
    points = cut(embedding(stack, weights, basis))
    columns = [f"y{c}" for c in range(top)]
    best = kmeans_runs(points, columns, {int(k): int(k) for k in ks}, n_init)
    return relabel(cut(assign_runs(points, columns, best)))


def default_ks(n: int, limit: int | None = 20) -> range:
    """2 .. n-1, below ``limit`` (20 by default, None for the older full range)."""
    return range(2, n if limit is None else min(n, limit))


# --- k-means on affinity rows ---------------------------------------------------------------------


@dataclass
class _Rows:
    """Affinity rows kept twice, by column to meet the centres and by row to meet the labels; hot keys are cut into slices."""

    by_column: Walk
    by_row: Walk
    everyone: DataFrame  # (i, x2, h): all entities with their squared length

    @classmethod
    def build(cls, view: DataFrame, entities: DataFrame, seed: int, slice_rows: int) -> _Rows:
        rows = cut(view.select("i", "j", F.col("w").cast("double").alias("w")).filter("w <> 0"))
        squared = rows.groupBy("i").agg(F.sum(F.col("w") * F.col("w")).alias("x2"))
        everyone = entities.select("i").distinct().join(squared, "i", "left")
        everyone = cut(everyone.select("i", F.coalesce("x2", F.lit(0.0)).alias("x2"), F.xxhash64("i", F.lit(seed)).alias("h")))
        return cls(Walk.build(rows, ["j"], "i", slice_rows), Walk.build(rows, ["i"], "j", slice_rows), everyone)

    def products(self, centers: DataFrame, n: int, active: DataFrame | None = None) -> DataFrame:
        """(i, p0..): products of rows with the centres (j, c0..); a cell meets one row that holds all of them.

        With ``active`` only the cells of those rows travel to the centres.
        """
        if active is None:
            met = self.by_column.meet(["i", "w"], centers)
        else:
            met = self.by_row.rows.select("i", "j", "w").join(active.select("i"), "i", "left_semi").join(centers, "j")
        return met.groupBy("i").agg(*[F.sum(F.col("w") * F.col(f"c{c}")).alias(f"p{c}") for c in range(n)])

    def sums(self, labels: DataFrame, picks: Sequence[Column]) -> DataFrame:
        """(j, c0..): for each condition on the label columns the column sums of the rows that meet it."""
        met = self.by_row.meet(["j", "w"], labels)
        return met.groupBy("j").agg(*[F.sum(F.when(p, F.col("w")).otherwise(0.0)).alias(f"c{n}") for n, p in enumerate(picks)])

    def release(self) -> None:
        self.by_column.rows.unpersist()
        self.by_row.rows.unpersist()


def _spread_starts(rows: _Rows, k: int, n_init: int) -> DataFrame:
    """k entities for each start, each drawn by its squared distance to those before it: (i, start, cluster)."""
    chosen, near = [], rows.everyone.select("i", "x2", "h", *[F.lit(1.0).alias(f"d{s}") for s in range(n_init)])
    for c in range(k):
        # the largest log(u) / d wins: a draw by weight that needs no total; rows at a centre come last
        u = [(F.shiftrightunsigned(F.xxhash64("h", F.lit(s), F.lit(c)), 11) + 0.5) / float(1 << 53) for s in range(n_init)]
        keys = [F.when(F.col(f"d{s}") > 1e-12, F.log(u[s]) / F.col(f"d{s}")).otherwise(F.lit(-1e300) * u[s]) for s in range(n_init)]
        first = near.agg(*[F.max_by(F.struct("i", "x2"), F.struct(keys[s], "h")).alias(f"s{s}") for s in range(n_init)]).first()
        picks = [(first[f"s{s}"]["i"], s, c, first[f"s{s}"]["x2"]) for s in range(n_init)]
        chosen += [p[:3] for p in picks]
        if c + 1 == k:
            break
        kind = near.schema["i"].dataType.simpleString()
        here = near.sparkSession.createDataFrame([p[:2] for p in picks], f"i {kind}, start int")
        at = rows.by_row.rows.select("i", "j", "w").join(here, "i").groupBy("j").agg(*[F.sum(F.when(F.col("start") == s, F.col("w")).otherwise(0.0)).alias(f"c{s}") for s in range(n_init)])
        apart = [F.greatest(F.col("x2") - 2 * F.coalesce(f"p{s}", F.lit(0.0)) + F.lit(float(picks[s][3])), F.lit(0.0)) for s in range(n_init)]
        nearer = [(F.least(F.col(f"d{s}"), apart[s]) if c else apart[s]).alias(f"d{s}") for s in range(n_init)]
        near = cut(near.join(rows.products(at, n_init), "i", "left").select("i", "x2", "h", *nearer))
    kind = near.schema["i"].dataType.simpleString()
    return near.sparkSession.createDataFrame(chosen, f"i {kind}, start int, cluster int")


def kmeans_rows(
    view: DataFrame, entities: DataFrame, k: int, n_init: int = 10, seed: int = SEED, max_iter: int = 300, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """K-means with the affinity rows as features, on sparse cells: (k, entity, cluster).

    A row's distance to a centre is ``|x|^2 - 2 <x, c> + |c|^2``. Centres are one row per column that
    holds the coordinates of all centres of all starts, so a cell meets one row a round. Each row
    keeps an upper bound of the distance to its centre and a lower bound to any other, loosened by
    how far the centres moved; while the bounds hold, it is not compared again. Starts are drawn by
    squared distance; a start that still moves after ``max_iter`` rounds is warned of.
    """
    n = n_init * k
    rows = _Rows.build(view, entities, seed, slice_rows)
    chosen = _spread_starts(rows, k, n_init)
    here = [(F.col("start") == s) & (F.col("cluster") == c) for s in range(n_init) for c in range(k)]
    centers = cut(rows.by_row.rows.select("i", "j", "w").join(chosen, "i").groupBy("j").agg(*[F.sum(F.when(p, F.col("w")).otherwise(0.0)).alias(f"c{m}") for m, p in enumerate(here)]))
    total = rows.everyone.agg(F.count("*"), F.sum("x2")).first()
    state, active, share = None, None, 1.0
    cost = np.full(n_init, np.inf)
    for round_ in range(max_iter + 1):
        c2 = [float(x or 0.0) for x in centers.agg(*[F.sum(F.col(f"c{m}") * F.col(f"c{m}")) for m in range(n)]).first()]
        near = rows.products(centers, n, active if share < 0.5 else None)
        base = rows.everyone.select("i", "x2") if active is None else active
        far = [F.sqrt(F.greatest(F.col("x2") - 2 * F.coalesce(f"p{m}", F.lit(0.0)) + F.lit(c2[m]), F.lit(0.0))) for m in range(n)]
        ranked = [F.array_sort(F.array(*[F.struct(far[s * k + c].alias("d"), F.lit(c).alias("c")) for c in range(k)])).alias(f"r{s}") for s in range(n_init)]
        olds = [F.col(f"a{s}").alias(f"o{s}") if state is not None else F.lit(-1).alias(f"o{s}") for s in range(n_init)]
        fresh = base.join(near, "i", "left").select("i", "x2", *olds, *ranked).select(
            "i", "x2", *[f"o{s}" for s in range(n_init)],
            *[F.col(f"r{s}")[0]["c"].alias(f"a{s}") for s in range(n_init)],
            *[F.col(f"r{s}")[0]["d"].alias(f"u{s}") for s in range(n_init)],
            *[F.coalesce(F.get(f"r{s}", F.lit(1))["d"], F.lit(float("inf"))).alias(f"l{s}") for s in range(n_init)],
        )
        keep = ["i", "x2", *[f"{x}{s}" for x in "aul" for s in range(n_init)]]
        fresh = cut(fresh)
        changed = fresh.agg(*[F.count_if(F.col(f"o{s}") != F.col(f"a{s}")).alias(f"n{s}") for s in range(n_init)]).first()
        settled = state.join(active.select("i"), "i", "left_anti").select(*keep) if state is not None else None
        state = cut(fresh.select(*keep) if settled is None else fresh.select(*keep).unionByName(settled))
        if not any(changed):
            break
        if round_ == max_iter:
            warnings.warn(f"{sum(x > 0 for x in changed)} of {n_init} k-means starts still moved after {max_iter} rounds", stacklevel=2)
            break
        sizes = state.agg(*[F.count_if(F.col(f"a{s}") == c) for s in range(n_init) for c in range(k)]).first()
        sums = rows.sums(state.select("i", *[f"a{s}" for s in range(n_init)]), [F.col(f"a{s}") == c for s in range(n_init) for c in range(k)])
        # a cluster that lost all its rows keeps its centre
        old = centers.select("j", *[F.col(f"c{m}").alias(f"o{m}") for m in range(n)])
        both = sums.join(old, "j", "full").select(
            "j",
            *[(F.coalesce(f"c{m}", F.lit(0.0)) / float(sizes[m]) if sizes[m] else F.coalesce(f"o{m}", F.lit(0.0))).alias(f"c{m}") for m in range(n)],
            *[F.coalesce(f"o{m}", F.lit(0.0)).alias(f"o{m}") for m in range(n)],
        )
        both = cut(both)
        drift = [float(x or 0.0) ** 0.5 for x in both.agg(*[F.sum((F.col(f"c{m}") - F.col(f"o{m}")) ** 2) for m in range(n)]).first()]
        centers = both.select("j", *[f"c{m}" for m in range(n)])
        loose = []
        for s in range(n_init):
            own = F.element_at(F.array(*[F.lit(drift[s * k + c]) for c in range(k)]), F.col(f"a{s}") + 1)
            loose += [(F.col(f"u{s}") + own).alias(f"u{s}"), (F.col(f"l{s}") - max(drift[s * k : s * k + k])).alias(f"l{s}")]
        state = cut(state.select("i", "x2", *[f"a{s}" for s in range(n_init)], *loose))
        slack = 1e-7 * (1 + F.sqrt("x2"))  # rounding of the distances
        active = state.filter(reduce(lambda x, y: x | y, [F.col(f"u{s}") + slack > F.col(f"l{s}") for s in range(n_init)]))
        share = active.count() / max(1, total[0])
    sums = rows.sums(state.select("i", *[f"a{s}" for s in range(n_init)]), [F.col(f"a{s}") == c for s in range(n_init) for c in range(k)])
    sizes = state.agg(*[F.count_if(F.col(f"a{s}") == c) for s in range(n_init) for c in range(k)]).first()
    squares = sums.agg(*[F.sum(F.col(f"c{m}") * F.col(f"c{m}")) for m in range(n)]).first()
    for s in range(n_init):  # squared distances to the means: all squares less those of the means
        cost[s] = float(total[1] or 0.0) - sum(float(squares[m] or 0.0) / sizes[m] for m in range(s * k, s * k + k) if sizes[m])
    rows.release()
    best = min(range(n_init), key=lambda s: (round(cost[s], 9), s))
    return relabel(state.select(F.lit(k).alias("k"), F.col("i").alias("entity"), F.col(f"a{best}").alias("cluster")))
