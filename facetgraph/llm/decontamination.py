"""Benchmark passages in documents, also with other numbers, names and units.

Texts become words in two streams. In the plain stream a word is its lower-case form. In the template
stream numbers, names (capitalised words that do not begin a sentence) and units after numbers are
typed placeholders, runs of them taken once. Windows of five words of documents meet those of
benchmark items in a hash join. A document holds an item if at least ``similarity`` of the item's
different plain windows are in it, or of its template windows, and then only if the slots agree: an
item's slot value must stand for the same document value wherever it returns.

Documents send only windows that a bitmap of fixed size cannot rule out; it is built from all
benchmark windows, and the join decides.

Defined results: a null or empty text and one with fewer words than a window match nothing, items as
well; template windows with fewer than two ordinary words are left out; repeated rows of an id count
once; a document without doc_id is found under a null; empty tables give no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import categories, code_points, lower_points, mix, span_hashes, text_runs
from .shared import mapped, own_id, stash

WINDOW = 5
RUN_BYTES = 1 << 19
BITS = 24
PLAIN, TEMPLATE = 0, 1
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
    "week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent km2 m2 m3 mph kmh w kw kwh v hz khz mhz ghz "
    "kb mb gb tb meter meters metre metres mile miles inch inches foot feet pound pounds gram grams liter liters litre litres degree degrees"
).split()


@functools.cache
def unit_hashes() -> np.ndarray:
    joined = np.array([ord(c) for c in "".join(UNITS)], np.uint32)
    ends = np.cumsum([len(u) for u in UNITS])
    begins = np.concatenate(([0], ends[:-1]))
    return np.sort(span_hashes(joined, begins, ends))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, hash of the lower-case form, type, joined to the word before) of each word."""
    points, begins = code_points(data, starts)
    n = len(points)
    kind = categories()[points]
    inside = (kind == 1) | (kind == 2)
    head = np.zeros(n + 1, bool)
    head[begins] = True
    turn = np.ones(n, bool)
    turn[1:] = (kind[1:] != kind[:-1]) | head[1:n]
    b = np.flatnonzero(inside & turn)
    closes = np.ones(n, bool)
    closes[:-1] = turn[1:]
    e = np.flatnonzero(inside & closes) + 1
    low = lower_points()[points]
    row = np.searchsorted(begins, b, "right") - 1
    h = span_hashes(low, b, e)
    number = kind[b] == 2
    stops = np.zeros(n + 1, np.int64)
    np.cumsum((points == 46) | (points == 33) | (points == 63) | (points == 58) | (points == 10) | (points == 124), out=stops[1:])
    first = np.ones(len(b), bool)
    first[1:] = (row[1:] != row[:-1]) | (stops[b[1:]] > stops[e[:-1]])
    name = ~number & (low[b] != points[b]) & ~first
    after_number = np.zeros(len(b), bool)
    after_number[1:] = number[:-1] & (row[1:] == row[:-1])
    known = unit_hashes()
    unit = after_number & ~number & (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
    kinds = np.select([number, unit, name], [NUMBER, UNIT, NAME], LITERAL)
    joined = np.zeros(len(b), bool)
    if len(b) > 1:
        gap = b[1:] - e[:-1]
        mark = points[np.minimum(e[:-1], n - 1)]
        same = (kinds[1:] == kinds[:-1]) & (row[1:] == row[:-1]) & (gap == 1)
        joined[1:] = same & (((kinds[1:] == NUMBER) & ((mark == 46) | (mark == 44))) | ((kinds[1:] == NAME) & (mark == 32)))
    return row, h, kinds, joined


def windows(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(stream, row, window hash, slot values by place in the window, 0 for an ordinary word)."""
    row, h, kinds, joined = words(data, starts)
    for stream in (PLAIN, TEMPLATE):
        if stream == TEMPLATE and len(h):
            begin = np.flatnonzero(~joined)
            value = np.add.reduceat(mix(h + kinds.astype(np.uint64)), begin) | np.uint64(1)
            row, kinds = row[begin], kinds[begin]
            value[kinds == LITERAL] = 0
            token = np.where(kinds == LITERAL, h[begin], kinds.astype(np.uint64))
        else:
            token, value = h, np.zeros(len(h), np.uint64)
        m = len(token) - WINDOW + 1
        if m <= 0:
            continue
        total = np.full(m, np.uint64(stream), np.uint64)
        for k in range(WINDOW):
            total = total * np.uint64(0x9E3779B97F4A7C15) + token[k : k + m]
        ok = row[:m] == row[WINDOW - 1 :]
        if stream == TEMPLATE:
            ordinary = sum((kinds[k : k + m] == LITERAL).astype(np.int8) for k in range(WINDOW))
            ok &= ordinary >= 2
        at = np.flatnonzero(ok)
        yield stream, row[at], mix(total[at]), value[at[:, None] + np.arange(WINDOW)] if stream == TEMPLATE else np.zeros((len(at), 0), np.uint64)


def _window_rows(texts: DataFrame, bitmap=None) -> DataFrame:
    """texts(id, text) to (id, stream, h, slots), only windows in the bitmap if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, starts in text_runs(batch, "text", RUN_BYTES):
                for stream, row, h, slots in windows(data, starts):
                    if bits is not None:
                        slot = h >> np.uint64(64 - BITS)
                        keep = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                        row, h, slots = row[keep], h[keep], slots[keep]
                    if len(row):
                        places = np.arange(len(row) + 1, dtype=np.int32) * slots.shape[1]
                        lists = pa.ListArray.from_arrays(pa.array(places), pa.array(slots.ravel().view(np.int64)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[i + row]), pa.array(np.full(len(row), stream, np.int8)), pa.array(h.view(np.int64)), lists],
                            ["id", "stream", "h", "slots"],
                        )

    return mapped(texts, run, "id bigint, stream tinyint, h bigint, slots array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, consistency: float = 0.9) -> DataFrame:
    """Pairs (id, item_id, overlap, template_overlap, agreement, reparameterised) of documents and items.

    id is doc_id or the number that stands for a missing one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    asked = stash(_window_rows(items).dropDuplicates(["id", "stream", "h"]), "items")
    slots = asked.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("slot")).distinct().toArrow()  # 2**BITS at most
    bits = np.zeros(1 << BITS, np.uint8)
    bits[slots.column(0).to_numpy()] = 1
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    total = asked.groupBy("id", "stream").agg(F.count("*").alias("windows"))

    texts = docs.select(own_id().alias("id"), "text")
    found = _window_rows(texts, bitmap).dropDuplicates(["id", "stream", "h"])
    met = found.join(asked.select(F.col("id").alias("item_id"), "stream", "h", F.col("slots").alias("item_slots")), ["stream", "h"])
    hits = stash(met, "hits")

    shares = hits.groupBy("id", "item_id", "stream").agg(F.count("*").alias("n"))
    shares = shares.join(total.withColumnRenamed("id", "item_id"), ["item_id", "stream"]).withColumn("share", F.col("n") / F.col("windows"))
    per = shares.groupBy("id", "item_id").agg(
        F.coalesce(F.max(F.when(F.col("stream") == PLAIN, F.col("share"))), F.lit(0.0)).alias("overlap"),
        F.coalesce(F.max(F.when(F.col("stream") == TEMPLATE, F.col("share"))), F.lit(0.0)).alias("template_overlap"),
    ).filter((F.col("overlap") >= similarity) | (F.col("template_overlap") >= similarity))

    zipped = F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0)
    slot = hits.filter(F.col("stream") == TEMPLATE).join(per.select("id", "item_id"), ["id", "item_id"], "left_semi")
    slot = slot.select("id", "item_id", F.explode(zipped).alias("s")).groupBy("id", "item_id", "s").agg(F.count("*").alias("n"))
    agreed = slot.groupBy("id", "item_id", F.col("s.item_slots").alias("a")).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    agreed = agreed.groupBy("id", "item_id").agg((F.sum("most") / F.sum("n")).alias("agreement"))
    out = per.join(agreed, ["id", "item_id"], "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
    plain = F.col("overlap") >= similarity
    return out.filter(plain | (F.col("agreement") >= consistency)).withColumn("reparameterised", ~plain)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = contaminated(docs, benchmark, **settings).select(F.col("id").alias("_id")).distinct()
    return docs.withColumn("_id", own_id()).join(bad, "_id", "left_anti").drop("_id").select(*docs.columns)
