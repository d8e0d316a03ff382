"""Quartile bucket digests of documents and their comparison.

Hashed byte triplets of every window of five bytes are counted in 128 buckets; the digest holds, for
each bucket, which quartile of the counts it lies in, the logarithm of the length, the ratios of the
quartiles and a checksum. Two digests differ by a score with an upper bound; likeness is one less the
score over the bound.

The next document of each, by ascending doc_id, is found without a global order in one task:
quantiles of the ids cut the table into ranges of even size, each range is sorted by itself, and the
first row of a range is sent to the range before as well (the very first to the last one).

Defined results: a null text is empty; texts of less than three bytes have a digest of zero counts;
rows of one doc_id are ordered by a hash of their text; missing ids come first; a single row is its
own next; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

BUCKETS = 128
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
SALTS = (0x3B, 0x9D, 0xE5)
RUN_BYTES = 1 << 20
LENGTH_CAP, RATIO_CAP, CHECK_COST = 32, 12, 1
BOUND = LENGTH_CAP + 2 * RATIO_CAP + CHECK_COST + 6 * BUCKETS


def bucket_counts(text: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for (i, j, k), salt in zip(TRIPLETS, SALTS, strict=True):
        n = len(b) - k
        if n > 0:
            h = (b[i : i + n] * np.uint32(0x9E3779B1) ^ b[j : j + n] * np.uint32(0x85EBCA77) ^ b[k : k + n] * np.uint32(0xC2B2AE3D)) + np.uint32(salt)
            h *= np.uint32(0x27D4EB2F)
            total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def digest(text: bytes) -> np.ndarray:
    """Header (checksum, length, two ratios) and one quartile code per bucket."""
    counts = bucket_counts(text)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = int(round(8 * np.log2(len(text) + 1)))
    ratio = [16 * q // q3 % 16 if q3 else 0 for q in (q1, q2)]
    check = int(np.dot(counts % 251, np.arange(1, BUCKETS + 1)) % 256)
    return np.concatenate((np.array([check, length % 256, *ratio], np.uint8), code.astype(np.uint8)))


def encode(parts: np.ndarray) -> str:
    """The digest as hexadecimal digits: four bytes of header, two bits per bucket."""
    codes = parts[4:].reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return bytes([*parts[:2], int(parts[2]) << 4 | int(parts[3]), 0]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """Bounded difference score of two digests; 0 for equal ones."""
    step = np.abs(a[4:].astype(np.int16) - b[4:])
    body = int(np.where(step == 3, 6, step).sum())
    length = min(LENGTH_CAP, abs(int(a[1]) - int(b[1])))
    ratio = sum(min(RATIO_CAP, abs(int(a[k]) - int(b[k]))) for k in (2, 3))
    return body + length + ratio + CHECK_COST * (a[0] != b[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def ranged(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """rows(key, ..) with the number of the range that key lies in, and the number of ranges."""
    cuts = rows.approxQuantile("key", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = sorted({c for c in cuts})
    if not cuts:
        return rows.withColumn("part", F.lit(0)), 1
    splits = [-float("inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_part").transform(rows.withColumn("_key", F.col("key").cast("double")))
    return placed.withColumn("part", F.col("_part").cast("int")).drop("_key", "_part"), len(cuts) + 1


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs in ordered ranges; a guest row at the end of each is the next range's first row."""
    spark = docs.sparkSession
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    placed, count = ranged(docs.select(key.alias("key"), mark.alias("mark"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    first = placed.groupBy("part").agg(F.min(F.struct("key", "mark")).alias("h")).collect()  # one row per range
    heads = sorted((r["part"], r["h"]["key"], r["h"]["mark"]) for r in first)
    before = [(key, mark, heads[k - 1][0]) for k, (_, key, mark) in enumerate(heads)]
    guests = F.broadcast(spark.createDataFrame(before, "key bigint, mark bigint, before int"))
    one = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    home = one(F.col("part"), False)
    to = F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, one(F.col("before"), True)))
    sent = placed.join(guests, ["key", "mark"], "left").withColumn("to", F.explode(to))
    sent = sent.select(F.col("to.part").alias("part"), F.col("to.guest").alias("guest"), "key", "mark", "doc_id", "text")
    return sent.repartitionById(count, "part").sortWithinPartitions("guest", "key", "mark")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out, size = [], 0
            types = [batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for guest, doc, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                now = (doc.as_py(), text.as_py())
                own = digest(now[1].encode())
                if last is not None:
                    doc0, text0, own0 = last
                    changed = edited(text0, now[1])
                    its = digest(changed.encode())
                    out.append((doc0, len(text0), changed, encode(own0), encode(its), likeness(own0, its), likeness(own0, own)))
                    size += len(changed)
                last = (*now, own)
                if guest.as_py():
                    last = None
                    break
                if size > RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            if len(batch) and guest.as_py():
                for _ in batches:  # further rows equal to the guest
                    pass
                return

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(with_next(docs, parts).select("guest", "doc_id", "text"), run, schema)
