"""SimHash near-duplicates: fingerprints of word shingles, exact comparison in tiles.

Defined results: a null or empty text, or one without a word, has fingerprint zero; a text of fewer
words than the shingle length is one shingle; equal fingerprints are always linked; a null doc_id is
kept, its component is the smallest doc_id that it reaches, null if there is none. Repeated rows have
equal results. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import text_runs
from .graph import components
from .shared import mapped, own_id, stash

RUN_BYTES = 1 << 20
TILE = 1024
SEED = 42


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of lower-cased words, repeats included."""
    tokens = text.lower().split()  # bytes: A-Z only, and exactly the ASCII blanks
    if not tokens:
        return []
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = list(accumulate(len(t) + 1 for t in tokens))
    begins = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(line[b : e - 1], SEED) for b, e in zip(begins, ends[words - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: a bit is set if over half the hashes have it."""
    each = [shingle_hashes(t, words) for t in texts]
    sizes = np.array([len(h) for h in each], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        hashes = np.fromiter((h for one in each for h in one), np.uint64, int(sizes.sum()))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(sizes) - sizes)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in text_runs(batch, "text", RUN_BYTES):
                blob = data.tobytes()
                fp = fingerprints_of([blob[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return mapped(source, run, "id bigint, fp bigint")


def _star(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each element's component under the links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tile_links(key: np.ndarray, fp: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one key, as stars within each pair of tiles.

    Rows come sorted by key. Two tiles are compared only if they share a key and their population
    counts do not differ beyond the radius; guests are compared with residents alone.
    """
    pop = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((pop, key))
    key, fp, guest, pop = key[order], fp[order], guest[order], pop[order]
    left, right = [], []
    for a in range(0, len(fp), TILE):
        ka, fa, ga, pa_ = key[a : a + TILE], fp[a : a + TILE], guest[a : a + TILE], pop[a : a + TILE]
        for b in range(a, len(fp), TILE):
            kb = key[b : b + TILE]
            if kb[0] > ka[-1]:
                break
            pb = pop[b : b + TILE]
            if ka[0] == ka[-1] == kb[0] == kb[-1] and pb[0] - pa_[-1] > radius:
                break
            fb, gb = fp[b : b + TILE], guest[b : b + TILE]
            first = int(np.searchsorted(ka, kb[0])) if b > a else 0  # earlier keys do not reach the second tile
            near = np.bitwise_count(fa[first:, None] ^ fb[None, :]) <= radius
            i, j = np.nonzero(near)
            i += first
            ok = (ka[i] == kb[j]) & ~(ga[i] & gb[j])
            if a == b:
                ok &= i < j
            i, j = i[ok], j[ok]
            if len(i):
                label = _star(i, j + len(fa), len(fa) + len(fb))
                both = np.concatenate((fa, fb))
                moved = np.flatnonzero(label != np.arange(len(label)))
                left.append(both[moved])
                right.append(both[label[moved]])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int) -> DataFrame:
    """fps(fp), all different, to (a, b): fingerprints whose components are those at the radius.

    Two fingerprints within the radius agree on one of radius + 1 bands of bits, and their
    population counts lie in one or two neighbouring stripes. A row is a resident of its stripe and a
    guest of the next, so every near pair meets in a partition key (band, value, stripe); tiles of
    rows are compared there exactly.
    """
    bands, step = radius + 1, radius + 1
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    pop = F.bit_count("fp").cast("int")
    stripe = F.floor(pop / F.lit(step)).cast("int")
    values = [F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - hi), 64 - hi + lo) if hi - lo < 64 else F.col("fp") for lo, hi in zip(edges, edges[1:], strict=False)]
    places = F.array(*[
        F.struct(F.lit(k).alias("band"), v.alias("value"), (stripe + g).alias("stripe"), F.lit(bool(g)).alias("guest"))
        for k, v in enumerate(values) for g in (0, 1)
    ])
    rows = fps.select("fp", F.explode(places).alias("p")).select(F.xxhash64("p.band", "p.value", "p.stripe").alias("key"), "fp", "p.guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a key are neighbours; keys are cut between runs of some tiles' size
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def done(parts):
            key, fp, guest = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = tile_links(key, fp, guest, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            guest = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut == 0 and held and held[-1][0][-1] != key[0]:
                yield done(held)
                held, size = [], 0
            if cut:
                held.append((key[:cut], fp[:cut], guest[:cut]))
                yield done(held)
                held, size = [], 0
            held.append((key[cut:], fp[cut:], guest[cut:]))
        if held:
            yield done(held)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(rows.repartition(n, "key").sortWithinPartitions("key"), run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (id, fp, component): component is the smallest id that links lead to."""
    marks = stash(fingerprint_table(docs, words, id_col, text_col), "fingerprints")
    least = stash(marks.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    found = components(links(least.select("fp"), radius))
    joined = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = joined.groupBy("component").agg(F.min("low").alias("low"))
    named = joined.select("fp", "component").join(lows, "component").select("fp", F.col("low").alias("component"))
    return marks.join(named, "fp").select("id", "fp", "component")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The documents without near copies: of each component the document of the smallest doc_id stays.

    Exactly repeated rows of the survivor are given once. A document without an id counts as one
    with a very large id of its own.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.withColumn("_id", own_id()).withColumn("_mark", mark)
    marks = near_duplicates(docs, words, radius, id_col="_id")
    keep = marks.filter("id = component").select(F.col("id").alias("_id")).distinct()
    return docs.join(keep, "_id", "left_semi").dropDuplicates(["_id", "_mark"]).drop("_id", "_mark")
