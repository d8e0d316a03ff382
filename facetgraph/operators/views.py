"""Similarity views as long rows (i, j, w); absent cells are zero."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, kept, spread
from . import blocks, threshold_join


def both_directions(rows: DataFrame, a: str, b: str, *values: Column) -> DataFrame:
    """Each row as (a, b) and (b, a), in one scan."""
    one = F.struct(F.col(a).alias("i"), F.col(b).alias("j"), *values)
    two = F.struct(F.col(b).alias("i"), F.col(a).alias("j"), *values)
    return rows.select(F.inline(F.array(one, two)))


def _halves(relation: DataFrame) -> DataFrame:
    """``A + A'`` as rows (a, b, w), one for each unordered pair; a self-loop counts twice."""
    ordered = F.col("src").isNull() | (F.col("dst").isNotNull() & (F.col("src") <= F.col("dst")))
    a, b = F.when(ordered, F.col("src")).otherwise(F.col("dst")), F.when(ordered, F.col("dst")).otherwise(F.col("src"))
    sums = relation.select(a.alias("a"), b.alias("b"), "score").groupBy("a", "b").agg(F.sum("score").alias("w"))
    twice = F.when(F.col("a").eqNullSafe(F.col("b")), 2 * F.col("w")).otherwise(F.col("w"))
    return sums.select("a", "b", twice.cast("double").alias("w"))


def _mirrored(halves: DataFrame) -> DataFrame:
    """Rows (a, b, w) of unordered pairs as cells (i, j, w) of both directions; a diagonal cell comes once."""
    one = F.struct(F.col("a").alias("i"), F.col("b").alias("j"), "w")
    two = F.struct(F.col("b").alias("i"), F.col("a").alias("j"), "w")
    return halves.select(F.inline(F.when(F.col("a").eqNullSafe(F.col("b")), F.array(one)).otherwise(F.array(one, two))))


def symmetric_scores(relation: DataFrame) -> DataFrame:
    """``A + A'``: both directions summed, a self-loop counts twice."""
    return _mirrored(_halves(relation))


def scale_by_max(view: DataFrame) -> DataFrame:
    """Divide by the largest cell; an all-zero view stays as it is.

    The cells are read twice, for the maximum and for the division; they are far fewer than the
    rows they were summed from and are written once in between.
    """
    view = kept(view)
    top = view.agg(F.max("w").alias("m")).scalar()
    return view.withColumn("w", F.when(top > 0, F.col("w") / top).otherwise(F.col("w")))


def structural_view(relation: DataFrame, diagonal: str = "zero_after") -> DataFrame:
    """Symmetric scores in [0, 1] with an empty diagonal.

    ``zero_after`` takes the maximum with self-loops, ``zero_before`` without them.
    """
    halves = _halves(relation)
    off = F.col("a") != F.col("b")
    if diagonal == "zero_before":
        return _mirrored(scale_by_max(halves.filter(off)))
    if diagonal == "zero_after":
        return _mirrored(scale_by_max(halves).filter(off))
    raise ValueError(f"unknown diagonal rule {diagonal!r}")


STRIP = 256  # rows of a block that are worked on at once
SENT = 8  # rows of a block whose cells leave a task as one row


def _spread_rows(factors: DataFrame, per_block: int, features_per_chunk: int) -> DataFrame:
    """Rows (pair, chunk, side, i, h, v) of both blocks of each pair, ordered by pair and chunk.

    An entity's features within a chunk are one row; chunk -1 names the entities of the blocks.
    """
    n = factors.select("i").distinct().count()
    n_blocks = max(blocks.block_count(n, per_block), min(blocks.block_count(n, max(1, per_block // 8)), 8))  # a few pairs for small sets too
    n_chunks = blocks.block_count(factors.select("f").distinct().count(), features_per_chunk)
    cells = factors.select("i", F.xxhash64("f").alias("h"), "v").withColumn("chunk", F.pmod("h", F.lit(n_chunks)).cast("int"))
    packed = cells.groupBy("i", "chunk").agg(F.sort_array(F.collect_list(F.struct("h", "v"))).alias("x"))
    packed = packed.select("i", "chunk", F.col("x.h").alias("h"), F.col("x.v").alias("v"))
    names = factors.select("i").distinct().select("i", F.lit(-1).alias("chunk"), F.lit([]).cast("array<bigint>").alias("h"), F.lit([]).cast("array<double>").alias("v"))
    spread = blocks.self_block_pairs(packed.unionByName(names), "i", n_blocks)
    pair = (F.col("br") * (F.col("br") + 1) / 2 + F.col("bl")).cast("int")
    side = F.when(F.col("bl") == F.col("br"), 2).when(F.col("b") == F.col("bl"), 0).otherwise(1)
    n_pairs = n_blocks * (n_blocks + 1) // 2
    rows = spread.select(pair.alias("pair"), "chunk", side.alias("side"), "i", "h", "v").repartitionById(n_pairs, "pair")
    return rows.sortWithinPartitions("pair", "chunk")


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as Spark's round does; what lies next to a half is decided by its decimal digits."""
    scaled = np.abs(x) * 10.0**digits
    down = np.floor(scaled)
    out = np.copysign((down + (scaled - down >= 0.5)) / 10.0**digits, x)
    for k in np.flatnonzero(np.abs(scaled - down - 0.5).ravel() < 1e-6):
        out.flat[k] = float(Decimal(repr(float(x.flat[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _largest(w: np.ndarray, m: int) -> np.ndarray:
    """Where the ``m`` largest cells of each row are, earlier columns first among equal ones; ``-inf`` is no cell."""
    if w.shape[1] <= m:
        return w > -np.inf
    least = np.partition(w, w.shape[1] - m, axis=1)[:, w.shape[1] - m, None]
    more, same = w > least, (w == least) & (w > -np.inf)
    return more | (same & (np.cumsum(same, axis=1) <= m - more.sum(axis=1, keepdims=True)))


class _Pair:
    """The cells of two blocks of entities, summed chunk by chunk of their features."""

    def __init__(self) -> None:
        self.names: list[list] = [[], []]
        self.kind: pa.DataType | None = None
        self.chunk = -1
        self.waiting: tuple[list, list] = ([], [])
        self.cells: np.ndarray | None = None

    def take(self, chunk: int, side: np.ndarray, keys: pa.Array, h: pa.Array, v: pa.Array) -> None:
        if chunk != self.chunk:
            self.settle()
            self.chunk = chunk
        for k in (0, 1):
            mine = pa.array(np.flatnonzero((side == k) | (side == 2)))
            if not len(mine):
                continue
            if chunk == -1:
                self.kind = keys.type
                self.names[k] += keys.take(mine).to_pylist()
            else:
                own, values = h.take(mine), v.take(mine)
                at = np.repeat(np.array([self.place[k][x] for x in keys.take(mine).to_pylist()], np.int64), pc.list_value_length(own).to_numpy())
                self.waiting[k].append((at, own.flatten().to_numpy(), values.flatten().to_numpy()))

    def settle(self) -> None:
        """Add the product over the chunk that has been read."""
        if self.cells is None:
            self.names = [sorted(x) for x in self.names]
            self.place = [{x: n for n, x in enumerate(side)} for side in self.names]
            self.cells = np.zeros((len(self.names[0]), len(self.names[1])))
        if all(self.waiting):
            sides = [[np.concatenate(x) for x in zip(*w)] for w in self.waiting]
            features = np.unique(sides[0][1])
            dense = []
            for (at, h, v), names in zip(sides, self.names):
                f = np.minimum(np.searchsorted(features, h), len(features) - 1)
                known = features[f] == h
                m = np.zeros((len(names), len(features)))
                m[at[known], f[known]] = v[known]
                dense.append(m)
            for a in range(0, len(self.cells), STRIP):
                self.cells[a : a + STRIP] += dense[0][a : a + STRIP] @ dense[1].T
        self.waiting = ([], [])

    def rows(self, same: bool, best: int, digits: int | None) -> Iterator[pa.RecordBatch]:
        self.settle()
        left, right = (pa.array(x, self.kind) for x in self.names)
        rank = {x: n for n, x in enumerate(sorted(set(self.names[0]) | set(self.names[1])))}
        ln, rn = (np.array([rank[x] for x in side], np.int64) for side in self.names)
        if not best:
            for a in range(0, len(self.cells), SENT):
                w = self.cells[a : a + SENT]
                x, y = np.nonzero((w != 0) & (ln[a : a + SENT, None] < rn[None, :]) if same else w != 0)
                if len(x):
                    names, swap, y_at = pa.concat_arrays([left.slice(a, len(w)), right]), ln[a + x] > rn[y], y + len(w)
                    one, two = (np.where(swap, *ends).astype(np.int32) for ends in ((y_at, x), (x, y_at)))
                    packed = [names, pa.array(one), pa.array(two), pa.array(w[x, y])]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) for v in packed], ["names", "one", "two", "w"])
            return
        for cells, rows, columns, a, b in ((self.cells, left, right, ln, rn), (self.cells.T, right, left, rn, ln))[: 1 if same else 2]:
            for s in range(0, len(cells), STRIP):
                w = cells[s : s + STRIP]
                w = np.where((w != 0) & (a[s : s + STRIP, None] != b[None, :]), w if digits is None else _half_up(w, digits), -np.inf)
                x, y = np.nonzero(_largest(w, best))
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(s + x)), columns.take(pa.array(y)), pa.array(w[x, y])], ["i", "j", "w"])


def gram_cells(factors: DataFrame, per_block: int = 4096, features_per_chunk: int = 512, best: int = 0, digits: int | None = None) -> DataFrame:
    """Off-diagonal cells of ``F F'`` as (i, j, w) with i < j, from unique rows (i, f, v).

    Entities are cut into blocks; a task holds the cells of two blocks as one dense matrix and adds
    products of small dense matrices while the features stream past chunk by chunk. A cell is
    complete in its task, so no cell is ever shuffled, only rows of the factors, once per block.
    Cells leave Python as numbers beside one list of names for each strip of a block.

    ``best`` leaves of each entity's cells in a task only that many largest (smaller j of equals,
    compared after rounding to ``digits``), as rows (i, j, w) of that entity: the largest of all
    blocks are among them.
    """
    factors = kept(factors.filter("i IS NOT NULL").select("i", "f", F.col("v").cast("double").alias("v")))  # counted twice and multiplied once
    rows = _spread_rows(factors, per_block, features_per_chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pair, same = None, _Pair(), False
        for batch in batches:
            number, chunk, side = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.append(np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(chunk, prepend=-2) != 0)), len(number))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if number[a] != at:
                    if at is not None:
                        yield from pair.rows(same, best, digits)
                    at, pair, same = number[a], _Pair(), side[a] == 2
                pair.take(int(chunk[a]), side[a:b], *(batch.column(k).slice(a, b - a) for k in (3, 4, 5)))
        if at is not None:
            yield from pair.rows(same, best, digits)

    kind = factors.schema["i"].dataType.simpleString()
    if best:
        return rows.mapInArrow(run, f"i {kind}, j {kind}, w double")
    strips = rows.mapInArrow(run, f"names array<{kind}>, one array<int>, two array<int>, w array<double>")
    cells = strips.select("names", "two", "w", F.posexplode("one").alias("at", "i"))
    return cells.select(F.get("names", F.col("i")).alias("i"), F.get("names", F.get("two", F.col("at"))).alias("j"), F.get("w", F.col("at")).alias("w"))


def cooccurrence_counts(members: DataFrame, large: int = 64) -> DataFrame:
    """How many groups hold both entities: (a, b, n) with a < b, from rows (grp, member).

    Where no group has more than ``large`` rows, which one cheap count proves, a group is a short
    array and its pairs are made in place. Otherwise bigger groups, which would emit a row per
    pair, are counted as a product of incidence blocks. The count also bounds the number of pairs,
    and with it what one task makes and sums.
    """
    size = F.col("size")
    per_group = members.groupBy("grp").agg(F.count("*").alias("size"))
    top, pairs = per_group.agg(F.max("size"), F.sum(F.when(size <= large, size * (size - 1)).otherwise(large * size))).first()
    if top is None or top <= large:
        return _short_group_pairs(members, (pairs or 0) // 2)
    distinct = cut(members.select("grp", "member").distinct())
    big = cut(distinct.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > large).select("grp"))
    direct = _short_group_pairs(distinct.join(big, "grp", "left_anti"), pairs // 2)
    rows = distinct.join(big, "grp", "left_semi").select(F.col("member").alias("i"), F.col("grp").alias("f"), F.lit(1.0).alias("v"))
    counted = gram_cells(rows).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round("w").cast("bigint").alias("n"))
    if direct.isEmpty():
        return counted  # each pair is one row already
    return direct.unionByName(counted).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _short_group_pairs(members: DataFrame, most: int) -> DataFrame:
    """Pair counts of groups known to be short, which have ``most`` pairs or fewer.

    Pairs are counted in the task that makes them, then over all tasks; neither gets more of them as
    the data grow.
    """
    sets = spread(members, most, "grp").groupBy("grp").agg(F.sort_array(F.collect_set("member")).alias("s")).filter(F.size("s") > 1)
    firsts = sets.select("s", F.posexplode("s").alias("p", "a"))
    pairs = firsts.select("a", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("b"))
    counted = pairs.withColumn("n", F.lit(1).cast("bigint"))
    return spread(counted, most, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def cooccurrence_view(members: DataFrame) -> DataFrame:
    """Mirrored co-occurrence counts in [0, 1]; the diagonal is empty."""
    return _mirrored(scale_by_max(cooccurrence_counts(members).select("a", "b", F.col("n").cast("double").alias("w"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 for a zero vector. May be negative."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def cosine_pairs(vectors: DataFrame, threshold: float | None = None, mirror: bool = False, diagonal: bool = False) -> DataFrame:
    """Cosine of all vector pairs (i, v) as rows i < j, optionally mirrored and with a unit diagonal.

    ``threshold`` keeps similarities of at least that value; without one the result is the full
    matrix, which grows with the square of the rows and suits an export of a small set. The
    fusion works on :func:`unit_factors` instead and never forms the pairs. Over a positive
    threshold most pairs are ruled out unseen (:mod:`threshold_join`).
    """
    if threshold is not None and threshold > 0:
        return _dressed(threshold_join.similar_vectors(vectors.select("i", "v"), threshold), vectors, mirror, diagonal)
    n = blocks.block_count(vectors.count())
    kind = vectors.schema["i"].dataType.simpleString()

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        sims = blocks.unit_rows(left.v) @ blocks.unit_rows(right.v).T if len(left) and len(right) else np.zeros((len(left), len(right)))
        li, ri = left.i.to_numpy(), right.i.to_numpy()
        keep = np.ones_like(sims, dtype=bool) if threshold is None else sims >= threshold
        if same:
            keep &= li[:, None] < ri[None, :]
        x, y = np.nonzero(keep)
        a, b = li[x], ri[y]
        swap = a > b
        return pd.DataFrame({"i": np.where(swap, b, a), "j": np.where(swap, a, b), "w": sims[x, y]})

    out = blocks.over_block_pairs(
        blocks.self_block_pairs(vectors.select("i", "v"), "i", n), kernel, f"i {kind}, j {kind}, w double", n
    )
    return _dressed(out, vectors, mirror, diagonal)


def _dressed(pairs: DataFrame, vectors: DataFrame, mirror: bool, diagonal: bool) -> DataFrame:
    if mirror:
        pairs = both_directions(pairs, "i", "j", F.col("w"))
    if diagonal:
        pairs = pairs.unionByName(vectors.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))
    return pairs


def cosine_rectangle(left: DataFrame, right: DataFrame, threshold: float | None = None, best: int = 0) -> DataFrame:
    """Cosine between two sets of vectors (i, v) as rows (i, j, w).

    ``best`` keeps that many most similar right rows of every left row (smaller j of equals). Over a
    positive threshold most pairs are ruled out unseen (:mod:`threshold_join`).
    """
    if threshold is not None and threshold > 0 and not best:
        return threshold_join.similar_between(left.select("i", "v"), right.select("i", "v"), threshold)
    size = blocks.vector_blocks if best else blocks.block_count  # without best whole blocks of pairs leave a task
    n_left, n_right = size(left.count()), size(right.count())
    kl, kr = left.schema["i"].dataType.simpleString(), right.schema["i"].dataType.simpleString()
    if kl != kr:
        raise ValueError("both sides need keys of one type")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("i")
        if a.empty or b.empty:
            return pd.DataFrame({"i": a.i[:0], "j": b.i[:0], "w": np.zeros(0)})
        u, v = blocks.unit_rows(a.v), blocks.unit_rows(b.v)
        xs, ys, ws = [], [], []
        for at in range(0, len(u), blocks.STRIP):
            sims = u[at : at + blocks.STRIP] @ v.T
            if best == 1:
                x, y = np.arange(len(sims)), sims.argmax(axis=1)
            elif best and not np.isnan(sims).any():
                x, y = np.nonzero(_largest(sims, best))
            elif best:
                y = np.argsort(-sims, axis=1, kind="stable")[:, :best]
                x, y = np.repeat(np.arange(len(sims)), y.shape[1]), y.ravel()
            else:
                x, y = np.nonzero(np.ones_like(sims, dtype=bool) if threshold is None else sims >= threshold)
            xs.append(x + at)
            ys.append(y)
            ws.append(sims[x, y])
        return pd.DataFrame({"i": a.i.to_numpy()[np.concatenate(xs)], "j": b.i.to_numpy()[np.concatenate(ys)], "w": np.concatenate(ws)})

    spread = blocks.rectangle_blocks(left.select("i", "v"), right.select("i", "v"), "i", n_left, n_right)
    out = spread.groupBy("bl", "br").applyInPandas(run, f"i {kl}, j {kr}, w double")
    if not best:
        return out
    if best > 1:
        place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))
        return out.withColumn("n", place).filter(F.col("n") <= best).select("i", "j", "w")
    top = out.groupBy("i").agg(F.min(F.struct((-F.col("w")).alias("w"), "j")).alias("t"))
    return top.select("i", F.col("t.j").alias("j"), (-F.col("t.w")).alias("w"))


def unit_factors(features: DataFrame) -> DataFrame:
    """Sparse features (i, f, v) scaled to unit rows, so that the cosine view is F F'."""
    norms = features.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).filter("norm > 0")
    return features.join(norms, "i").select("i", "f", (F.col("v") / F.col("norm")).alias("v"))


def vector_features(vectors: DataFrame) -> DataFrame:
    """Array vectors (i, v) as sparse features (i, f, v)."""
    return vectors.select("i", F.posexplode("v").alias("f", "v")).select(
        "i", F.col("f").cast("string").alias("f"), F.col("v").cast("double").alias("v")
    ).filter("v <> 0")


def cosine_cells(features: DataFrame, best: int = 0, digits: int | None = None) -> DataFrame:
    """Mirrored cosine view with unit diagonal from sparse features (i, f, v).

    ``best`` leaves out cells that are not among the ``best`` largest of their row, most of them before
    they leave a task (ties as in :func:`strongest`, after rounding to ``digits``).
    """
    features = kept(features)
    cells = gram_cells(unit_factors(features), best=best, digits=digits)
    diagonal = features.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    return (cells if best else both_directions(cells, "i", "j", F.col("w"))).unionByName(diagonal)


def cosine_row_sums(factors: DataFrame) -> DataFrame:
    """Row sums of the cosine view without its diagonal, from the factors alone.

    ``sum_j <f_i, f_j> = <f_i, sum_j f_j>``: linear in the rows where the pairs are quadratic.
    """
    totals = factors.groupBy("f").agg(F.sum("v").alias("t"))
    return factors.join(totals, "f").groupBy("i").agg(
        (F.sum(F.col("v") * F.col("t")) - F.sum(F.col("v") * F.col("v"))).alias("degree")
    )


def mean_pool(rows: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """Mean of the vectors with mask 1 per key; the denominator is at least 1e-9.

    Positions are summed as rows, so one key may hold any number of vectors.
    """
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    long = rows.select(key, weight.alias("m"), F.posexplode(vector).alias("p", "x"))
    pooled = long.groupBy(key, "p").agg(
        (F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x")
    )
    return pooled.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias(vector)
    )


def sparsify(view: DataFrame, threshold: float) -> DataFrame:
    """Drop similarities below ``threshold`` (0.1 semantic and 0.3 functional are the usual ones)."""
    return view.filter(F.col("w") >= threshold)


def strongest(view: DataFrame, m: int, rule: str = "union") -> DataFrame:
    """The ``m`` largest off-diagonal cells of every entity (ties by the smaller partner), made symmetric.

    ``union`` keeps a pair that either end has chosen, ``mutual`` one that both have. The view is
    mirrored. The rank filter is applied in every task before rows are sent, so an entity with very
    many cells sends ``m`` from each task and no task ever holds all of them.
    """
    if rule not in ("union", "mutual"):
        raise ValueError(f"unknown rule {rule!r}")
    best = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    chosen = view.filter(F.col("i") != F.col("j")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= m)
    ends = both_directions(chosen, "i", "j", F.col("w"))
    votes = ends.groupBy("i", "j").agg(F.max("w").alias("w"), F.count("*").alias("votes"))
    return votes.filter(F.col("votes") >= (1 if rule == "union" else 2)).select("i", "j", "w")


def distance_view(view: DataFrame, clip: bool = True) -> DataFrame:
    """``1 - w`` of the stored cells with a zero diagonal; absent cells stand for distance 1."""
    d = 1 - F.col("w")
    if clip:
        d = F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))
    return view.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(d).alias("d"))


def with_diagonal(view: DataFrame, entities: DataFrame, value: float, key: str = "i") -> DataFrame:
    """Override the diagonal of ``view`` by ``value`` for every entity."""
    off = view.filter(F.col("i") != F.col("j"))
    if value == 0:
        return off
    diag = entities.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(float(value)).alias("w"))
    return off.unionByName(diag)


def combine(views: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """``U = sum of weight * view``."""
    scaled = [v.select("i", "j", (F.col("w") * F.lit(float(weights[name]))).alias("w")) for name, v in views.items()]
    return reduce(DataFrame.unionByName, scaled).groupBy("i", "j").agg(F.sum("w").alias("w"))


def common_entities(*views: DataFrame) -> DataFrame:
    """Entities every view knows (a view's entity list or its rows, column ``i``)."""
    return reduce(DataFrame.intersect, [v.select("i") for v in views])


def restrict(view: DataFrame, entities: DataFrame) -> DataFrame:
    keep = entities.select("i")
    return view.join(keep, "i", "left_semi").join(keep.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "w")


def misaligned(views: dict[str, DataFrame]) -> DataFrame:
    """Entities that some view has and another lacks, as (i, present_in); empty if aligned."""
    tagged = [v.select("i").distinct().withColumn("view", F.lit(name)) for name, v in views.items()]
    seen = reduce(DataFrame.unionByName, tagged).groupBy("i").agg(F.sort_array(F.collect_set("view")).alias("views"))
    return seen.filter(F.size("views") < len(views)).select("i", F.array_join("views", ",").alias("present_in"))


def require_aligned(views: dict[str, DataFrame]) -> None:
    if misaligned(views).limit(1).count():
        raise ValueError("the views do not cover the same entities")
