"""Short codes of vectors by Lloyd rounds over members that stay with the entry they belong to.

A vector is cut into equal parts; each part position has a codebook of a few entries. A part lives
with its home (position, entry, salt), and homes are dealt to partitions. In a round every partition
assigns its residents anew, those that keep their entry stay where they are, only the others travel
to their new home, and entries are averaged from the members that live with them. Partitions are
numpy blocks of an RDD, because no DataFrame keeps its partitioning through a Python step: zipped
with the arrivals, the residents of a partition never move.

The salt of a part is fixed at the scan, so that a repeated task sends it to the same home, and an
entry that holds most parts is spread over all partitions. The driver sees codebooks and counters.
All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrow import mix
from .shared import mapped

SCALE = 4096
#: Integers up to EXACT are compared in doubles without rounding, up to WIDEST in 64 bits; beyond is an error.
EXACT, WIDEST = 1 << 21, 1 << 27
#: Vectors that a task gathers before it sends blocks.
GATHERED = 1 << 15


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors of ``size`` components, and these as floored integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(lengths == size)
    x = flat[begin[rows, None] + np.arange(size)]
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(x[fine] * SCALE)
    if len(x) and np.abs(x).max() > WIDEST:
        raise ValueError(f"components beyond {WIDEST // SCALE} are too large for exact codes")
    return rows[fine], x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equals, and its squared distance."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= EXACT else np.int64
    x, book = x.astype(kind), book.astype(kind)
    apart = (book * book).sum(axis=1) - 2 * (x @ book.T)
    entry = apart.argmin(axis=1)
    return entry, (apart[np.arange(len(x)), entry] + (x * x).sum(axis=1)).astype(np.int64)


def _assigned(x: np.ndarray, position: np.ndarray, books: np.ndarray) -> np.ndarray:
    entry = np.zeros(len(x), np.int64)
    for p in range(len(books)):
        at = np.flatnonzero(position == p)
        entry[at] = nearest(x[at], books[p])[0]
    return entry


def _block(width: int) -> np.dtype:
    return np.dtype([("position", "<u2"), ("entry", "<u2"), ("salt", "<u4"), ("x", "<i4", (width,))])


def _dealt(block: np.ndarray, homes: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a block by the partition of their home."""
    key = block["position"].astype(np.uint64) << np.uint64(48) | block["entry"].astype(np.uint64) << np.uint64(32) | block["salt"].astype(np.uint64)
    to = (mix(key + np.uint64(1)) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(to[rows[0]]), block[rows].tobytes()


def _merged(rows: Iterator[tuple[int, bytes]], kind: np.dtype) -> Iterator[np.ndarray]:
    """One block for each partition, also for one that nothing reached."""
    yield np.frombuffer(b"".join(data for _, data in rows), kind)


def _scan(books: np.ndarray, homes: int):
    """Parts of the vectors of a task, already assigned for the first round, as blocks for their homes."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.uint64(TaskContext.get().partitionId() << 40)
        held: list[np.ndarray] = []
        seen = waiting = 0

        def send() -> pa.RecordBatch:
            x = np.concatenate(held).reshape(-1, width)
            block = np.zeros(len(x), _block(width))
            block["position"] = np.arange(len(x)) % parts
            block["x"] = x
            block["entry"] = _assigned(x, block["position"], books)
            block["salt"] = mix(first + np.uint64((seen - waiting) * parts) + np.arange(len(x), dtype=np.uint64)) % np.uint64(max(8, homes))
            sent = list(_dealt(block, homes))
            return pa.RecordBatch.from_pydict({"home": pa.array([t for t, _ in sent], pa.int32()), "block": pa.array([b for _, b in sent], pa.binary())})

        for batch in batches:
            _, x = integers(batch.column("vector"), parts * width)
            held.append(x)
            seen, waiting = seen + len(x), waiting + len(x)
            if waiting >= GATHERED:
                yield send()
                held, waiting = [], 0
        if waiting:
            yield send()

    return run


def _leaving(books: np.ndarray, homes: int):
    def run(block: np.ndarray) -> Iterator[tuple[int, bytes]]:
        entry = _assigned(block["x"], block["position"], books)
        gone = block[entry != block["entry"]]
        gone["entry"] = entry[entry != block["entry"]]
        return _dealt(gone, homes)

    return run


def _settled(books: np.ndarray):
    def run(pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        block, arrived = pair
        entry = _assigned(block["x"], block["position"], books)
        return np.concatenate([block[entry == block["entry"]], arrived])

    return run


def _sums(shape: tuple[int, int, int]):
    """For each position and entry the sums of its members' components, and their number."""
    parts, entries, width = shape

    def run(block: np.ndarray) -> np.ndarray:
        out = np.zeros((parts * entries, width + 1), np.int64)
        cell = block["position"].astype(np.int64) * entries + block["entry"]
        order = np.argsort(cell, kind="stable")
        cells, begin = np.unique(cell[order], return_index=True)
        if len(cells):
            out[cells, :width] = np.add.reduceat(block["x"][order].astype(np.int64), begin, axis=0)
            out[cells, width] = np.diff(np.append(begin, len(order)))
        return out

    return run


def codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """Codebooks as integers [position, entry, component], or None without a usable vector.

    They start as the parts of the ``entries`` vectors with the smallest ids (null ids last, equal
    ids by vector), of which there may be fewer, and go through ``rounds`` rounds of assignment and
    floored averages; rounds end early when no part moves, since nothing can change after that.
    The size of a vector is that of the first of them and must be a multiple of ``parts``.
    """
    spark = vectors.sparkSession
    used = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = used.filter(usable("vector") & (F.size("vector") > 0))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["vector"])
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    _, start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), size)
    books = np.ascontiguousarray(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2))
    width, kind = size // parts, _block(size // parts)
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_home(rows: RDD) -> RDD:
        return rows.partitionBy(homes, lambda home: home).mapPartitions(lambda it: _merged(it, kind))

    sent = mapped(used.select("vector"), _scan(books, homes), "home int, block binary")
    residents = by_home(sent.rdd.map(lambda r: (r[0], bytes(r[1])))).persist(StorageLevel.MEMORY_AND_DISK)
    for left in range(rounds - 1, -1, -1):
        sums = residents.map(_sums(books.shape)).treeReduce(np.add)
        count = sums[:, width :]
        means = (sums[:, :width] // np.maximum(count, 1)).reshape(books.shape)
        new = np.where(count.reshape(*books.shape[:2], 1) > 0, means, books)
        if not left or (new == books).all():
            books = new
            break
        books = new
        arrived = by_home(residents.flatMap(_leaving(books, homes)))
        before, residents = residents, residents.zip(arrived).map(_settled(books)).persist(StorageLevel.MEMORY_AND_DISK)
        residents.count()
        before.unpersist()
    residents.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers, in decimal, by position, entry and component, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """(row, code, error) for each usable vector: two hex digits for each part, and the sum of squared distances.

    A null vector, one with a null or non-finite component and one of another size than the codebooks
    give no row; repeated rows stay repeated; other columns stay in ``row``, whatever their names.
    """
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column("vector"), parts * width)
            digits, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                entry, apart = nearest(x[:, p * width : (p + 1) * width], books[p])
                digits[:, p] = entry
                error += apart
            codes = pa.array([d.tobytes().hex() for d in digits], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), codes, pa.array(error)], ["row", "code", "error"])

    rows = vectors.select(F.struct("*").alias("row"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = StructType([rows.schema["row"], StructField("code", StringType(), False), StructField("error", LongType(), False)])
    return mapped(rows, run, schema)
