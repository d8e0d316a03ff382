"""Smallest eigenvectors of a normalised Laplacian over distributed rows.

The basis is a table of blocks (the ids and rows of some entities as one matrix) and never leaves the executors;
only m x m projections reach the driver. The matrix is a grid: a task holds the rows from one block of keys to one
block of targets, packed as compressed arrays, once for all weights. A step sends each basis block to the tasks of
its line of the grid and adds the sums of a column, so that what travels grows with the width of the grid and not
with its tasks. Views given as factors (``A = F F'``) are walked in two such half steps, entity to feature and
feature to entity, so their pairs are never formed. What a step or a round has used up is removed at its end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cleaned, cut, kept, release

SLICE_ROWS = 2_000_000
PARTITION_ROWS = 500_000
PACK_ROWS = 500_000  # matrix rows that a task packs at once before they are dealt to the grid
BLOCK_IDS = 16_384  # entities in one row of a basis block, at most
BUCKET_ROWS = 50_000  # a bucket gets as many rows at least, and SLICE_ROWS on average at most


@dataclass
class Walk:
    """Matrix rows, partitioned and kept by their source columns, ready to meet a basis.

    ``hot`` lists sources with very many rows; their rows are cut into slices and their basis row
    is copied per slice, so that no task gets more than ``SLICE_ROWS`` rows of one source.
    """

    rows: DataFrame
    source: list[str]
    hot: DataFrame | None = None

    @classmethod
    def build(cls, rows: DataFrame, source: list[str], spread: str, slice_rows: int) -> Walk:
        counts = rows.groupBy(*source).agg(F.count("*").alias("c"))
        total, most = counts.agg(F.sum("c"), F.max("c")).first()
        hot = None
        if most and most > slice_rows:
            heavy = counts.filter(F.col("c") > slice_rows)
            hot = cut(heavy.select(*source, F.ceil(F.col("c") / slice_rows).cast("int").alias("slices")))
            rows = rows.join(hot, source, "left").withColumn(
                "slice", F.pmod(F.xxhash64(spread), F.coalesce("slices", F.lit(1))).cast("int")
            ).drop("slices")
        keys = [*source, "slice"] if hot is not None else source
        configured = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = max(configured, (total or 0) // PARTITION_ROWS)
        return cls(rows.repartition(n, *keys).sortWithinPartitions(*keys).withColumn("zero", F.lit(0)).persist(), source, hot)

    def meet(self, columns: Sequence, basis: DataFrame) -> DataFrame:
        """``columns`` of the matrix rows beside the basis row of their source."""
        if self.hot is None:
            return self.rows.select(*self.source, *columns).join(basis, self.source)
        copied = basis.join(self.hot, self.source, "left").withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
        ).drop("slices")
        keys = [*self.source, "slice"]
        return self.rows.select(*keys, *columns).join(copied, keys)


# --- basis blocks ----------------------------------------------------------------------------------

#: Rows of some ids. ``t`` is their block, or the task that they are sent to; ``copy`` marks what is not a whole row
#: of the basis: rows on their way to a task, and partial sums. A whole row ends with the scale of its entity, ``d^-1/2``, and what
#: its own cell loses.
BLOCK = "t int, copy boolean, ids array<string>, m binary"
SCALES = 2


def _block_rows(t: int, copy: bool, ids: pa.Array, m: np.ndarray) -> list[tuple]:
    return [(t, copy, ids.slice(n, BLOCK_IDS), np.ascontiguousarray(m[n : n + BLOCK_IDS]).tobytes()) for n in range(0, len(ids), BLOCK_IDS)]


def _block_table(rows: list[tuple]) -> pa.Table:
    ts, copies, ids, m = zip(*rows, strict=True) if rows else ((), (), (), ())
    offsets = np.cumsum([0, *map(len, ids)])
    held = pa.concat_arrays([x.cast(pa.string()) for x in ids]) if rows else pa.array([], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held)
    return pa.Table.from_arrays([pa.array(ts, pa.int32()), pa.array(copies, pa.bool_()), lists, pa.array(m, pa.binary())], ["t", "copy", "ids", "m"])


def _block_parts(table: pa.Table | pa.RecordBatch) -> list[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of each row."""
    ids, m = table["ids"], table["m"]
    out = []
    for n in range(table.num_rows):
        names = ids[n].values
        out.append((names, np.frombuffer(m[n].as_buffer(), np.float64).reshape(len(names), -1)))
    return out


def _added(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Different ids and the sums of their rows."""
    names = pa.concat_arrays([ids for ids, _ in parts]).dictionary_encode()
    codes, total, begin = names.indices.to_numpy(zero_copy_only=False), np.zeros((len(names.dictionary), parts[0][1].shape[1])), 0
    for ids, values in parts:
        total[codes[begin : begin + len(ids)]] += values  # an id comes once in a part
        begin += len(ids)
    return names.dictionary, total


def _whole_blocks(table: pa.Table) -> pa.Table:
    """The whole rows of a block with the partial sums of their first columns added, ids in order."""
    parts, partial = _block_parts(table), table["copy"].to_pylist()
    whole = [p for p, copy in zip(parts, partial, strict=True) if not copy]
    sums = [p for p, copy in zip(parts, partial, strict=True) if copy]
    if not whole:
        return _block_table([])  # sums of ids that are no entities
    ids, rows = pa.concat_arrays([x for x, _ in whole]), np.concatenate([m for _, m in whole])
    order = pc.array_sort_indices(ids)
    ids, rows = ids.take(order), rows[order.to_numpy()]
    if sums:
        names, total = _added(sums)
        at = pc.index_in(names, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False)
        known = at >= 0
        rows[at[known], : total.shape[1]] += rows[at[known], -SCALES, None] * total[known]
    return _block_table(_block_rows(table["t"][0].as_py(), False, ids, rows))


def _merged(blocks: DataFrame) -> DataFrame:
    return cut(blocks.groupBy("t").applyInArrow(_whole_blocks, BLOCK))


def _block(name: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")


def _blocks(rows: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Blocks of rows (i, columns..), the last two columns being the scales."""

    def run(batches):
        for batch in batches:
            t, out = batch["t"].to_numpy(), []
            values = np.column_stack([batch[c].to_numpy() for c in columns])
            for b in np.unique(t):
                chosen = np.flatnonzero(t == b)
                out += _block_rows(int(b), False, batch["i"].take(pa.array(chosen)), values[chosen])
            yield from _block_table(out).to_batches()

    return rows.select("i", *[F.col(c).cast("double").alias(c) for c in columns], _block("i", n).alias("t")).mapInArrow(run, BLOCK)


# --- the grid of the matrix ------------------------------------------------------------------------

#: Products of columns of the basis with weighted views: the columns, and the weight of every view.
Groups = list[tuple[list[int], list[float]]]

PACK = "t int, keys array<string>, tos array<string>, n bigint, at binary, `on` binary, c array<binary>"


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if x.any() else b""


def _opened(x: pa.BinaryScalar, n: int, kind: type) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(x.as_buffer(), size, codec="zstd"), kind) if x.as_buffer().size else np.zeros(n, kind)


def _pack(t: int, keys: pa.Array, tos: pa.Array, at: np.ndarray, on: np.ndarray, c: list[np.ndarray]) -> pa.RecordBatch:
    """Matrix rows as one row of arrays."""
    row = {
        "t": pa.array([t], pa.int32()), "keys": _listed(keys), "tos": _listed(tos), "n": pa.array([len(at)], pa.int64()),
        "at": pa.array([_squeezed(at.astype(np.int32))], pa.binary()), "on": pa.array([_squeezed(on.astype(np.int32))], pa.binary()),
        "c": pa.array([[_squeezed(x) for x in c]], pa.list_(pa.binary())),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


def _cells(t: np.ndarray, at: np.ndarray, on: np.ndarray, n_keys: int, n_tos: int, values: list[tuple]) -> tuple[np.ndarray, ...]:
    """Different cells (t, at, on) in the order of t and on, and for each view the sums of its values (rows, w)."""
    code = (t.astype(np.int64) * n_tos + on) * n_keys + at
    order = np.argsort(code, kind="stable")
    code = code[order]
    fresh = np.diff(code, prepend=-1) != 0
    place = np.empty(len(code), np.int64)
    place[order] = np.cumsum(fresh) - 1
    code = code[fresh]
    sums = [np.bincount(place[rows], w, len(code)) for rows, w in values]
    return code // n_keys // n_tos, code % n_keys, code // n_keys % n_tos, sums


def _listed(names: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string()))


def _dealt(n_views: int):
    """Matrix rows (t, key, to, view, w) as packs of the tasks that they go to."""

    def packed(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        keys, tos = (rows[x].combine_chunks().dictionary_encode() for x in ("key", "to"))
        at, on = (x.indices.to_numpy(zero_copy_only=False) for x in (keys, tos))
        view, w = rows["view"].to_numpy(), rows["w"].to_numpy()
        values = [(chosen, w[chosen]) for chosen in (np.flatnonzero(view == v) for v in range(n_views))]
        tasks, t = np.unique(rows["t"].to_numpy(), return_inverse=True)
        t, at, on, sums = _cells(t, at, on, len(keys.dictionary), len(tos.dictionary), values)
        starts = np.flatnonzero(np.diff(t, prepend=-1))
        for b, e in zip(starts, [*starts[1:], len(t)], strict=True):
            (own, here), (met, there) = (np.unique(x[b:e], return_inverse=True) for x in (at, on))
            yield _pack(int(tasks[t[b]]), keys.dictionary.take(pa.array(own)), tos.dictionary.take(pa.array(met)), here, there, [x[b:e] for x in sums])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return run


def _joined(n_views: int):
    """The packs of a task as one."""

    def run(packs: pa.Table) -> pa.Table:
        names, codes = [], []
        for kind, place in (("keys", "at"), ("tos", "on")):
            parts = [x.values for x in packs[kind]]
            encoded = pa.concat_arrays(parts).dictionary_encode()
            base, begin, own = encoded.indices.to_numpy(zero_copy_only=False), 0, []
            for part, x, n in zip(parts, packs[place], packs["n"].to_pylist(), strict=True):
                own.append(base[begin : begin + len(part)][_opened(x, n, np.int32)])
                begin += len(part)
            names.append(encoded.dictionary)
            codes.append(np.concatenate(own))
        sizes, values = packs["n"].to_numpy(), []
        starts = np.cumsum(sizes) - sizes
        for v in range(n_views):
            held = [(b, _opened(c.values[v], n, np.float64)) for c, b, n in zip(packs["c"], starts, sizes, strict=True) if c.values[v].as_buffer().size]
            rows = [b + np.flatnonzero(x) for b, x in held]
            values.append((np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate([x[x != 0] for _, x in held]) if held else np.zeros(0)))
        _, at, on, sums = _cells(np.zeros(len(codes[0]), np.int8), *codes, *map(len, names), values)
        return pa.Table.from_batches([_pack(packs["t"][0].as_py(), *names, at, on, sums)])

    return run


def _multiplied(groups: Groups, beta: float, ways: Sequence[bool], size: bool, goals: dict[int, tuple[int, int]]):
    """Partial sums of a task: for each group of columns ``beta`` times the products with the weighted views, ``size`` with their size.

    ``goals`` has the blocks of the keys and targets of a task; the ways lead from keys to targets (true) and back.
    Both ways, a cell of an entity and itself counts once.
    """

    def run(packs: pa.Table, sent: pa.Table) -> pa.Table:
        if not sent.num_rows or not packs.num_rows:
            return _block_table([])
        parts, out = _block_parts(sent), []
        ids, columns = pa.concat_arrays([x for x, _ in parts]), np.ascontiguousarray(np.concatenate([m for _, m in parts]).T)
        width = sum(len(cs) for cs, _ in groups)
        for p in range(packs.num_rows):
            t, n = packs["t"][p].as_py(), packs["n"][p].as_py()
            names = packs["keys"][p].values, packs["tos"][p].values
            ends = tuple(_opened(packs[x][p], n, np.int32) for x in ("at", "on"))
            spots = [pc.index_in(x, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False) for x in names]
            sums, begin, weighted = {way: np.zeros((width, len(names[way]))) for way in ways}, 0, None
            for cs, weights in groups:
                if weighted != weights:
                    weighted, c = weights, np.zeros(n)
                    for v, weight in enumerate(weights):
                        if weight and packs["c"][p].values[v].as_buffer().size:
                            c += weight * _opened(packs["c"][p].values[v], n, np.float64)
                    c = np.abs(c) if size else c
                    met = {}
                    for way in ways:
                        here, to = spots[not way][ends[not way]], ends[way]
                        there = (c != 0) & (here >= 0)
                        if not way and len(ways) == 2 and len(set(goals[t])) == 1:
                            there &= here != spots[way][to]
                        met[way] = (c, here, to) if there.all() else (c[there], here[there], to[there])
                for way, (values, here, to) in met.items():
                    starts = np.flatnonzero(np.diff(to, prepend=-1)) if way else ()
                    for k, column in enumerate(cs, begin):
                        terms = values * columns[column][here]
                        if not way:
                            sums[way][k] = np.bincount(to, terms, len(names[way]))
                        elif len(starts):
                            sums[way][k, to[starts]] = np.add.reduceat(terms, starts)
                begin += len(cs)
            for way, total in sums.items():
                reached = np.flatnonzero(total.any(axis=0))
                out += _block_rows(goals[t][way], True, names[way].take(pa.array(reached)), beta * total[:, reached].T)
        return _block_table(out)

    return run


@dataclass
class Buckets:
    """Matrix rows (key, to, view, w) in a grid of blocks of keys and of targets.

    A task of the grid holds the rows from one block of keys to one of targets, so the rows of a key lie in as
    many tasks as there are blocks of targets. ``hot`` is the number of rows of the heaviest key, if it is over
    ``slice_rows``: the grid is wide enough then to cut them into slices of that size. Ids are dealt to blocks by their hash.
    """

    packs: DataFrame
    blocks: tuple[int, int]  # of keys, of targets
    tasks: dict[int, tuple[int, int]]  # tasks are numbered so that each is a partition
    n_views: int
    symmetric: bool = False
    hot: int | None = None

    @classmethod
    def build(cls, rows: DataFrame, n_views: int, blocks: tuple[int, int], symmetric: bool = False, hot: int | None = None) -> Buckets:
        """From rows (key, to, view, w); those of a symmetric matrix may name either end first, and are added."""
        pairs = [(a, b) for b in range(blocks[1]) for a in range(b + 1 if symmetric else blocks[0])]
        n, spark = len(pairs), rows.sparkSession
        ids = spark.range(64 * n).select(F.col("id").cast("int").alias("l"))
        found = ids.groupBy(F.pmod(F.hash("l"), F.lit(n)).alias("p")).agg(F.min("l").alias("l")).collect()
        labels = [r["l"] for r in sorted(found)]
        rows = rows.select("key", "to", F.col("view").cast("int").alias("view"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"), _block("key", blocks[0]).alias("a"), _block("to", blocks[1]).alias("b"))
        task = F.col("b") * blocks[0] + F.col("a")
        if symmetric:
            swap = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("key") > F.col("to")))
            ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("key", "to"), ("to", "key"), ("a", "b"), ("b", "a"))]
            rows, task = rows.select(*ends, "view", "w"), (F.col("b") * (F.col("b") + 1) / 2).cast("int") + F.col("a")
        t = F.element_at(F.array(*[F.lit(x) for x in labels]), task + 1)
        dealt = rows.select(t.alias("t"), "key", "to", "view", "w").mapInArrow(_dealt(n_views), PACK)
        joined = dealt.repartition(n, "t").groupBy("t").applyInArrow(_joined(n_views), PACK)
        packs = joined.repartition(n, "t").sortWithinPartitions("t").persist()
        with cleaned(spark):
            packs.select("t", "n").count()
        return cls(packs, blocks, dict(zip(labels, pairs)), n_views, symmetric, hot)

    @property
    def rows(self) -> DataFrame:
        """The matrix rows one by one: (t, key, to, a0..), keys as ``-1|key``."""
        n_views, symmetric = self.n_views, self.symmetric

        def run(batches):
            for batch in batches:
                for p in range(batch.num_rows):
                    n = batch["n"][p].as_py()
                    keys, tos = (batch[x][p].values.take(pa.array(_opened(batch[y][p], n, np.int32))) for x, y in (("keys", "at"), ("tos", "on")))
                    values = [pa.array(_opened(batch["c"][p].values[v], n, np.float64)) for v in range(n_views)]
                    rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, batch["t"][p].as_py(), np.int32)), keys, tos, *values], names)
                    yield rows
                    if symmetric:
                        back = rows.filter(pc.not_equal(keys, tos))
                        yield pa.RecordBatch.from_arrays([back[x] for x in ("t", "to", "key", *names[3:])], names)

        names = ["t", "key", "to", *[f"a{v}" for v in range(n_views)]]
        out = self.packs.mapInArrow(run, "t int, key string, to string, " + ", ".join(f"a{v} double" for v in range(n_views)))
        return out.withColumn("key", F.concat(F.lit("-1|"), "key"))

    def times(self, coefficients: dict[str, Column], basis: DataFrame, ys: list[str]) -> DataFrame:
        """(to, prefix0..): for each coefficient the sums of its products with the basis (key, y0..)."""
        sums = [F.sum(c * F.col(y)).alias(f"{p}{n}") for p, c in coefficients.items() for n, y in enumerate(ys)]
        return self.rows.join(basis, "key").groupBy("to").agg(*sums)

    def product(self, blocks: DataFrame, groups: Groups, beta: float = 1.0, ways: Sequence[bool] = (True,), size: bool = False) -> DataFrame:
        """Partial sums of the products of ``groups``: of targets (a true way), and of keys (a false one).

        A symmetric matrix is walked both ways. Whole rows are scaled before they are sent.
        """
        goals, width = self.tasks, 1 + max(max(cs) for cs, _ in groups)
        ways = (True, False) if self.symmetric else ways
        to = {}
        for task, ends in goals.items():
            for b in {ends[not way] for way in ways}:
                to.setdefault(b, []).append(task)

        def send(batches):
            for batch in batches:
                for t, copy, (ids, m) in zip(batch["t"].to_pylist(), batch["copy"].to_pylist(), _block_parts(batch), strict=True):
                    values = m[:, :width] if copy else m[:, :width] * m[:, -SCALES, None]
                    for task in to.get(t, ()):
                        yield from _block_table(_block_rows(task, True, ids, values)).to_batches()

        sent = blocks.mapInArrow(send, BLOCK).repartition(len(goals), "t")
        return self.packs.groupBy("t").cogroup(sent.groupBy("t")).applyInArrow(_multiplied(groups, beta, ways, size, goals), BLOCK)


def _total(table: pa.Table) -> pa.Table:
    """The partial sums of a block, added."""
    ids, total = _added(_block_parts(table))
    return _block_table(_block_rows(table["t"][0].as_py(), True, ids, total))


@dataclass
class Stack:
    """Aligned views in the form the matrix steps need.

    ``cells`` leads from j to i through the cells of the sparse views (and a diagonal cell of each entity),
    ``reach`` from the features of the factor views, named by view and feature, to i; it is there only with factor views.
    ``nodes`` has (i, d0.., q0..): degrees, and squared row norms of the factor views.
    """

    names: list[str]
    cells: Buckets
    nodes: DataFrame
    n: int
    keep_diagonal: bool = False
    reach: Buckets | None = None
    factor_views: list[int] = field(default_factory=list)

    def products(self, blocks: DataFrame, groups: Groups, beta: float = 1.0) -> DataFrame:
        """Partial sums of the products of ``groups``, of all views."""
        out = self.cells.product(blocks, groups, beta)
        if self.reach is None:
            return out
        # a feature is of one view: the weights come in on the way back
        width = 1 + max(max(cs) for cs, _ in groups)
        there = self.reach.product(blocks, [(list(range(width)), [1.0] * len(self.names))], ways=(False,))
        return out.unionByName(self.reach.product(there.groupBy("t").applyInArrow(_total, BLOCK), groups, beta))


def _name(g, key: str) -> Column:
    """A feature of the factor view ``g`` as one key."""
    return F.concat_ws("|", (g if isinstance(g, Column) else F.lit(g)).cast("string"), F.col(key))


def _gather_factors(views: dict[str, DataFrame], grams: list[str], everyone: DataFrame) -> DataFrame:
    """Rows (i, g, f, v) of all factor views, ``g`` the index of the view."""
    names = list(views)
    parts = [
        views[n].join(everyone, "i", "left_semi").select(F.col("i").cast("string").alias("i"), F.lit(names.index(n)).alias("g"), F.col("f").cast("string").alias("f"), "v")
        for n in grams
    ]
    return kept(reduce(DataFrame.unionByName, parts))


def _gather_cells(views: dict[str, DataFrame], sparse: list[str], everyone: DataFrame, keep_diagonal: bool) -> DataFrame:
    """Rows (key, to, view, w) of all views: what both orders of a pair add up to is its mean-symmetrised cell."""
    names = list(views)
    rows = everyone.select(F.col("i").alias("key"), F.col("i").alias("to"), F.lit(0).alias("view"), F.lit(0.0).alias("w"))
    for name in sparse:
        held = views[name] if keep_diagonal else views[name].filter(F.col("i") != F.col("j"))
        half = F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(F.col("w") / 2)
        own = held.select(F.col("i").cast("string").alias("key"), F.col("j").cast("string").alias("to"), F.lit(names.index(name)).alias("view"), half.cast("double").alias("w"))
        rows = rows.unionByName(own.filter("key IS NOT NULL AND to IS NOT NULL"))
    return rows


def _heaviest(rows: DataFrame, slice_rows: int) -> tuple[int, int | None]:
    """Number of rows, and the most rows of one id if they are more than ``slice_rows``."""
    total = rows.count()
    if total <= slice_rows:
        return total, None
    ends = rows.select(F.explode(F.array("key", "to")).alias("i"))
    counted = ends.groupBy(F.pmod(F.xxhash64("i"), F.lit(1024))).agg(F.count("*").alias("c"))  # a bound that is cheap
    if counted.agg(F.max("c")).first()[0] > slice_rows:
        most = ends.groupBy("i").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        return total, most if most > slice_rows else None
    return total, None


def _tasks(spark, rows: int) -> int:
    """Tasks of a grid: as many as the rows need, a few for each core if there are so many rows."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(configured, 2 * spark.sparkContext.defaultParallelism, rows // BUCKET_ROWS), -(-rows // SLICE_ROWS))


def stack_views(
    views: dict[str, DataFrame], entities: DataFrame, keep_diagonal: bool = False, slice_rows: int = SLICE_ROWS
) -> Stack:
    """Build the stack from named views: cells (i, j, w) or factors (i, f, v), and the entities (i).

    Entities are keyed as strings. Degrees are linear in the view weights, so they are taken once
    per view; the ones of a factor view come from its feature sums.
    """
    names = list(views)
    count = range(len(names))
    spark = entities.sparkSession
    everyone = cut(entities.select(F.col("i").cast("string").alias("i")).filter("i IS NOT NULL").distinct())
    grams = [n for n in names if "j" not in views[n].columns]
    rows = _gather_cells(views, [n for n in names if n not in grams], everyone, keep_diagonal)
    with cleaned(spark):
        total, hot = _heaviest(rows, slice_rows)
    n = math.ceil((math.sqrt(8 * _tasks(spark, total // 2) + 1) - 1) / 2)  # mirrored views have two rows of a pair
    n = max(n, -(-(hot or 0) // slice_rows))
    cells, reach = Buckets.build(rows, len(names), (n, n), True, hot), None
    norms = everyone.select("i", *[F.lit(0.0).alias(f"q{v}") for v in count])
    if grams:
        factors = _gather_factors(views, grams, everyone)
        n_rows = factors.count()
        led = factors.select(_name(F.col("g"), "f").alias("key"), F.col("i").alias("to"), F.col("g").alias("view"), F.col("v").alias("w"))
        reach = Buckets.build(led, len(names), (-(-_tasks(spark, n_rows) // n), n))
        q = factors.groupBy("i").agg(*[F.sum(F.when(F.col("g") == v, F.col("v") * F.col("v")).otherwise(0.0)).alias(f"q{v}") for v in count])
        norms = everyone.join(q, "i", "left").select("i", *[F.coalesce(f"q{v}", F.lit(0.0)).alias(f"q{v}") for v in count])
    stack = Stack(names, cells, everyone, 0, keep_diagonal, reach, [names.index(g) for g in grams])
    degrees = _plain(_merged(_with_sums(_ones(stack), stack.products(_ones(stack), [([0], _alone(stack, v)) for v in count]), len(names))), len(names))
    own = [F.lit(0.0) if keep_diagonal else F.col(f"q{v}") for v in count]
    stack.nodes = cut(degrees.join(norms, "i").select("i", *[(F.col(f"y{v}") - own[v]).alias(f"d{v}") for v in count], *[f"q{v}" for v in count]))
    stack.n = stack.nodes.count()
    return stack


def _alone(stack: Stack, v: int) -> list[float]:
    return [1.0 if u == v else 0.0 for u in range(len(stack.names))]


def _ones(stack: Stack) -> DataFrame:
    """Blocks with 1 for every entity, not scaled."""
    return _blocks(stack.nodes.select("i", *[F.lit(x).alias(c) for x, c in ((1.0, "one"), (1.0, "s"), (0.0, "q"))]), stack.cells.blocks[0], ["one", "s", "q"])


def _with_sums(blocks: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """Blocks with ``width`` columns of zero before the others, and the partial sums that belong there."""

    def run(batches):
        for batch in batches:
            out = [_block_rows(t, False, ids, np.pad(m, ((0, 0), (width, 0)))) for t, (ids, m) in zip(batch["t"].to_pylist(), _block_parts(batch), strict=True)]
            yield from _block_table(sum(out, [])).to_batches()

    return blocks.mapInArrow(run, BLOCK).unionByName(sums)


def unstack(stack: Stack) -> None:
    """Release the kept matrix rows."""
    stack.cells.packs.unpersist()
    if stack.reach is not None:
        stack.reach.packs.unpersist()


def _parameters(values: Sequence[float]) -> list[Column]:
    """Numbers that change from step to step, looked up by the ``zero`` column of the matrix rows.

    As plain literals they would be part of the generated code, and every step would be compiled
    anew.
    """
    held = F.array(*[F.lit(float(v)) for v in values])
    return [F.get(held, F.col("zero") + n) for n in range(len(values))]


def _factor(weights: Sequence[Column], prefix: str, keep_diagonal: bool) -> Column:
    """``d^-1/2`` of the combined degree."""
    d = _sum_of(weights, prefix)
    if keep_diagonal:
        return 1 / F.sqrt(F.when(d == 0, 1e-10).otherwise(d))
    return F.when(d > 0, 1 / F.sqrt(d)).otherwise(0.0)


def _sum_of(weights: Sequence[Column], prefix: str, only: Sequence[int] | None = None) -> Column:
    chosen = range(len(weights)) if only is None else only
    return sum((weights[v] * F.col(f"{prefix}{v}") for v in chosen), F.lit(0.0))


def _columns(m: int, name: str = "y") -> list[str]:
    return [f"{name}{c}" for c in range(m)]


def _scales(stack: Stack, weights: Sequence[float]) -> DataFrame:
    """(i, s, q) for one set of weights: ``d^-1/2``, and what the own cell loses of the factor views."""
    ws = _parameters(weights)
    q = F.lit(0.0) if stack.keep_diagonal else _sum_of(ws, "q", stack.factor_views)
    return stack.nodes.withColumn("zero", F.lit(0)).select("i", _factor(ws, "d", stack.keep_diagonal).cast("double").alias("s"), q.cast("double").alias("q"))


@dataclass
class Affinity:
    """The combined normalised affinity N of a stack for one set of weights.

    A basis lies in blocks of whole rows, each ending with the scales of its entity. A step makes whole rows and the partial
    sums that belong to their first columns; :func:`_merged` adds them.
    """

    stack: Stack
    weights: list[float]
    scales: DataFrame

    @classmethod
    def build(cls, stack: Stack, weights: Sequence[float]) -> Affinity:
        return cls(stack, [float(w) for w in weights], cut(_scales(stack, weights)))

    @property
    def cells(self) -> DataFrame:
        return self.stack.cells.packs

    def release(self) -> None:
        release(self.scales)

    def blocks(self, basis: DataFrame, ys: list[str]) -> DataFrame:
        """Blocks of a basis (i, ys..)."""
        return _blocks(basis.join(self.scales, "i"), self.stack.cells.blocks[0], [*ys, "s", "q"])

    def step(self, blocks: DataFrame, m: int, alpha: float, beta: float) -> DataFrame:
        """Parts with ``alpha * y + beta * N y`` before all columns that are there, y being the first ``m`` of them."""

        def own(batches):
            for batch in batches:
                out = []
                for t, (ids, rows) in zip(batch["t"].to_pylist(), _block_parts(batch), strict=True):
                    s, q = rows[:, -2, None], rows[:, -1, None]
                    out += _block_rows(t, False, ids, np.hstack([(alpha - beta * s * s * q) * rows[:, :m], rows]))
                yield from _block_table(out).to_batches()

        return blocks.mapInArrow(own, BLOCK).unionByName(self.stack.products(blocks, [(list(range(m)), self.weights)], beta))


def _gram(blocks: DataFrame, width: int) -> np.ndarray:
    """Inner products of all columns: sums in the tasks, added by Spark; small on the driver."""
    a, b = np.triu_indices(width)

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for _, m in _block_parts(batch):
                total += m[:, :width].T @ m[:, :width]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "g"])

    sums = blocks.mapInArrow(products, "a bigint, b bigint, g double").groupBy("a", "b").agg(F.sum("g").alias("g"))
    out = np.zeros((width, width))
    cells = sums.toArrow()
    at = cells["a"].to_numpy(), cells["b"].to_numpy()
    out[at] = out[at[::-1]] = cells["g"].to_numpy()
    return out


def _rotate(blocks: DataFrame, rotation: np.ndarray) -> DataFrame:
    """New columns as linear combinations of the old ones, before the scales."""

    def apply(batches):
        for batch in batches:
            turned = [np.hstack([m[:, : len(rotation)] @ rotation, m[:, -SCALES:]]).tobytes() for _, m in _block_parts(batch)]
            yield pa.RecordBatch.from_arrays([batch["t"], batch["copy"], batch["ids"], pa.array(turned, pa.binary())], ["t", "copy", "ids", "m"])

    return blocks.mapInArrow(apply, BLOCK)


def _plain(blocks: DataFrame, width: int) -> DataFrame:
    """(i, y0..), a row per entity."""
    names = _columns(width)

    def run(batches):
        for batch in batches:
            for ids, m in _block_parts(batch):
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(m[:, n])) for n in range(width)]], ["i", *names])

    return blocks.mapInArrow(run, "i string, " + ", ".join(f"{n} double" for n in names))


def _start(stack: Stack, m: int) -> DataFrame:
    """A reproducible start: every entry is a hash of (entity, column) in [-1, 1]."""
    return stack.nodes.select("i", *[(F.xxhash64("i", F.lit(c)) / F.lit(float(2**63))).alias(f"y{c}") for c in range(m)])


def upper_bound(stack: Stack, weights: Sequence[float]) -> float:
    """A bound on the largest eigenvalue of the Laplacian.

    Row sums of absolute values of ``D^-1 W``, which has the spectrum of the symmetric form, bound
    the sparse part; factor views are positive semidefinite, so only their removed diagonal can
    push an eigenvalue up.
    """
    sums = _merged(_with_sums(_ones(stack), stack.cells.product(_ones(stack), [([0], [float(w) for w in weights])], size=True), 1))
    s, q = F.col("s"), F.abs("q")  # the own cells of the sparse views are empty where something is taken from them
    per = _plain(sums, 1).join(_scales(stack, weights), "i")
    top = per.agg(F.max((F.col("y0") + q) * s * s)).first()[0]
    release(sums)
    return 1.0 + float(top or 0.0)


def _shifts(degree: int) -> list[float]:
    """Chebyshev points of [-1, 1], ordered so that products of distances to them stay tame."""
    points = list(np.cos((2 * np.arange(degree) + 1) / (2 * degree) * np.pi))
    ordered = [points.pop(int(np.argmax(np.abs(points))))]
    while points:
        far = [np.sum(np.log(np.abs(p - np.array(ordered)) + 1e-300)) for p in points]
        ordered.append(points.pop(int(np.argmax(far))))
    return ordered


@dataclass
class Basis:
    """Eigenvalues (ascending, on the driver) and the table (i, y0..ym-1) of their vectors."""

    values: np.ndarray
    rows: DataFrame
    k: int
    width: int
    rounds: int = 0

    def gap(self) -> float:
        """Distance to the next eigenvalue; 0 means the wanted space is not unique."""
        return float(self.values[self.k] - self.values[self.k - 1]) if len(self.values) > self.k else float("inf")


def _ritz(gram: np.ndarray, image: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, rotation and residual norms of a space.

    ``gram`` holds the inner products of all columns, the space being the first of them; ``image``
    writes the operator's image of the space in terms of all columns.
    """
    n = image.shape[1]
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram = gram * np.outer(scale, scale)
    image = image * scale[None, :n] / scale[:, None]
    g, h, hh = gram[:n, :n], gram[:n] @ image, image.T @ gram @ image
    s, q = np.linalg.eigh((g + g.T) / 2)
    kept = s > cutoff * s[-1]
    white = q[:, kept] / np.sqrt(s[kept])
    values, turn = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
    rotation = white @ turn
    residual = np.sqrt(np.maximum(np.diag(rotation.T @ hh @ rotation) - values**2, 0))
    return values, scale[:n, None] * rotation, residual


def smallest_eigenvectors(
    stack: Stack,
    weights: Sequence[float],
    k: int,
    start: Basis | None = None,
    width: int = 32,
    depth: int = 4,
    max_rounds: int = 100,
    tol: float = 1e-5,
) -> Basis:
    """The k smallest eigenpairs of the combined normalised Laplacian, at every size by the same steps.

    Block Krylov iteration with thick restarts: from ``width`` current vectors (more for a large k), take the residuals
    of those that have not converged, apply the operator to them ``depth - 1`` more times (all as
    joins and grouped sums), and restart from the best vectors of the whole space. Converged vectors
    are locked: they stay in the space and are multiplied no more than once a round. Ends when the
    residual norm of each wanted vector is below ``tol``; an eigenvalue is then off by the square of
    that over its gap. A basis that is not there after ``max_rounds`` is an error.
    """
    if k > stack.n:
        raise ValueError(f"{k} eigenvectors of {stack.n} entities")
    m = min(stack.n, max(width, k + 3))
    limit = upper_bound(stack, weights)
    shifts = _shifts(max(1, depth - 1))
    rows = start.rows.select("i", *_columns(min(m, start.width))) if start is not None else _start(stack, m)
    width = min(m, start.width) if start is not None else m
    residual = np.full(k, np.inf)
    affinity = Affinity.build(stack, weights)
    blocks, made = affinity.blocks(rows, _columns(width)), []
    try:
        for round_ in range(max_rounds):
            # columns L x = x - N x, then x
            applied = _merged(affinity.step(blocks, width, alpha=1.0, beta=-1.0))
            release(*made)
            made = [applied]
            order = np.r_[width : 2 * width, :width]
            gram = _gram(applied, 2 * width)[np.ix_(order, order)]
            values, turn, residual = _ritz(gram, np.eye(2 * width)[:, width:], 1e-12)
            rank = len(values)
            if rank >= k and residual[:k].max() < tol:
                return Basis(values, cut(_plain(_rotate(applied, np.vstack([np.zeros((width, rank)), turn])), rank)), k, rank, round_ + 1)
            active = np.flatnonzero(residual >= tol / 10)
            a = len(active)
            # the residuals of the active Ritz vectors at length 1, and all Ritz vectors
            left = np.vstack([turn[:, active], -turn[:, active] * values[active]]) / residual[active]
            right = np.vstack([np.zeros((width, rank)), turn])
            chain = _rotate(applied, np.hstack([left, right]))
            for shift in shifts:
                chain = _merged(affinity.step(chain, a, alpha=2 / limit - 1 - shift, beta=-2 / limit))
                release(*made)
                made = [chain]
            wide, d = chain, len(shifts)
            # columns b_d, .., b_0, x in order x, b_0, .., b_d
            order = np.r_[(d + 1) * a : (d + 1) * a + rank, *[np.arange((d - j) * a, (d - j + 1) * a) for j in range(d + 1)]]
            gram = _gram(wide, len(order))[np.ix_(order, order)]
            # L x = value * x + |residual| * b0 and L b_j = limit / 2 * (b_j+1 + (1 + shift) * b_j)
            space = rank + d * a
            image = np.zeros((space + a, space))
            image[np.arange(rank), np.arange(rank)] = values
            image[rank + np.arange(a), active] = residual[active]
            for j, shift in enumerate(shifts):
                at = rank + j * a + np.arange(a)
                image[at, at] = limit / 2 * (1 + shift)
                image[at + a, at] = limit / 2
            _, turn, _ = _ritz(gram, image, 1e-11)
            width = min(m, turn.shape[1])
            rotation = np.zeros((space + a, width))
            rotation[order[:space]] = turn[:, :width]
            blocks = _rotate(wide, rotation)
    finally:
        affinity.release()
        release(*made)
    raise RuntimeError(f"eigenvectors not converged after {max_rounds} rounds: largest residual {residual[:k].max():.1e}")


def trace_losses(stack: Stack, basis: Basis) -> np.ndarray:
    """``Tr(H' L_v H)`` of every single view for the k wanted vectors.

    The Laplacians are not formed: ``sum |h_i|^2 - sum n_ij <h_i, h_j>``, the second sum of all views in one pass
    over the scaled vectors of each.
    """
    n_views, k, kd = len(stack.names), basis.k, stack.keep_diagonal
    ys, views = _columns(k), range(n_views)
    scale = {v: _factor([F.lit(x) for x in _alone(stack, v)], "d", kd) for v in views}
    scaled = [(F.col(y) * scale[v]).alias(f"x{v}_{n}") for v in views for n, y in enumerate(ys)]
    rows = basis.rows.select("i", *ys).join(stack.nodes, "i").select("i", *scaled, *ys, *[f"q{v}" for v in views], F.lit(1.0).alias("s"), F.lit(0.0).alias("q"))
    blocks = cut(_blocks(rows, stack.cells.blocks[0], rows.columns[1:]))
    sums = stack.products(blocks, [(list(range(v * k, (v + 1) * k)), _alone(stack, v)) for v in views])
    met = _merged(_with_sums(blocks, sums, n_views * k))

    def parts(batches):
        total = np.zeros(n_views)
        for batch in batches:
            for _, m in _block_parts(batch):
                y, x, h, q = np.split(m[:, :-SCALES], np.cumsum([n_views * k, n_views * k, k]), axis=1)
                for v in views:
                    own = slice(v * k, (v + 1) * k)
                    lost = 0.0 if kd else (q[:, v, None] * x[:, own] ** 2).sum()
                    total[v] += (h**2).sum() - (x[:, own] * y[:, own]).sum() + lost
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_views)), pa.array(total)], ["v", "x"])

    found = met.mapInArrow(parts, "v bigint, x double").groupBy("v").agg(F.sum("x").alias("x")).collect()
    release(blocks, met)
    losses = np.zeros(n_views)
    for row in found:
        losses[row.v] = row.x
    return losses
