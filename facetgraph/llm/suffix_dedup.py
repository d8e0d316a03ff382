"""Removal of repeated passages by a sparse suffix array in range-partitioned buckets.

A byte goes if a string of ``length`` bytes that covers it also starts in a document of a smaller
doc_id. Not all suffixes are shuffled but those that begin at anchors: of the short grams in each
window of ``length`` bytes the one of the smallest hash. Equal windows choose equal anchors, so a
repeat is never missed, and one suffix in about fourteen travels.

1. Suffixes are tokens: the hash of the anchor's gram leads, the hash of all bytes of the windows that
   chose the anchor follows. Splitters of a sample of leading tokens range-partition the suffixes;
   each bucket sorts them by token after token and compares neighbours. A leading token lies in one
   bucket, so no comparison crosses a boundary. Equal in both tokens: the windows repeat as a whole.
2. Suffixes that agree in the leading token alone differ somewhere in their windows: at the edges of
   a passage. Their windows are compared one by one in a second round of the same kind.

Before each shuffle a task settles what repeats within its own rows and sends a token once with its
smallest doc_id, so a passage of very many documents sends one row per task.

Defined results: a null or empty text loses nothing; rows of one doc_id never remove from each other,
whether they repeat one text or have several, and each loses what smaller doc_ids have of its own text;
a null doc_id is larger than all others; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mix, span_hashes, text_runs, utf8
from .shared import mapped, stash

GRAM = 24
RUN_BYTES = 1 << 18
BLOCK_ROWS = 1_500_000
SAMPLE = 64
LEAD_BYTES = 5  # of the leading token; the following one has six
NO_ROWS = np.zeros(0, np.int64)
LAST = (1 << 63) - 1  # stands for a null doc_id


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on (three words of eight bytes)."""
    blob = data.tobytes()
    word = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        part = np.frombuffer(blob, "<u8", (len(data) - k) // 8, k)
        word[k::8] = part
    h = word[:-16] * np.uint64(0x9E3779B97F4A7C15)
    h += word[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += word[16:] * np.uint64(0x165667B19E3779F9)
    return mix(h)


def _chunk(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, leading token, place) of each anchor among the valid windows of a chunk."""
    h = gram_hashes(data)
    where = np.uint64((1 << 24) - 1)
    low = (h & ~where) | np.arange(len(h), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    at = (low & where).astype(np.int64)
    at[~valid[: len(at)]] = -1
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], turn))
    last = np.concatenate((turn, [len(at)])) - 1
    ok = at[first] >= 0
    first, last = first[ok], last[ok]
    return first, last, h[at[first]], at[first]


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, leading token and tags of each anchor, in text order.

    A window holds its anchor and half of what remains of its length before it, or half behind it;
    the two tags are one byte each of a hash of these halves.

    Chunks of a long text begin at multiples from the text's own start, so a text always has the same anchors.
    """
    ends = starts[1:]
    if len(data) < length:
        return NO_ROWS, NO_ROWS, NO_ROWS, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    valid = np.ones(len(data), bool)
    for back in range(1, length):
        spot = ends - back
        valid[spot[spot >= starts[:-1]]] = False
    parts = []
    for c in range(0, len(data) - length + 1, RUN_BYTES):
        piece = data[c : c + RUN_BYTES + length - 1]
        first, last, token, at = _chunk(piece, valid[c : c + RUN_BYTES], length)
        parts.append((first + c, last + c, token, at + c))
    first, last, token, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    half = (length - GRAM) // 2
    before = span_hashes(data, np.maximum(at - half, 0), at)
    behind = span_hashes(data, at + GRAM, np.minimum(at + GRAM + half, len(data)))
    tags = (before & np.uint64(255)) | ((behind & np.uint64(255)) << np.uint64(8))
    return np.searchsorted(starts, first, "right") - 1, first, last, token, tags


def ordinals(row: np.ndarray, rows: int) -> np.ndarray:
    """Number of each element within its row (rows ascending)."""
    count = np.bincount(row, minlength=rows)
    return np.arange(len(row)) - (np.cumsum(count) - count)[row]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _multikey_order(lead: np.ndarray, follow: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sort by the leading token; only runs of equal tokens go on to the next tokens."""
    order = np.argsort(lead)
    key = lead[order]
    new = _groups(key)
    tied = np.flatnonzero(~new)
    if len(tied):
        inside = np.zeros(len(key), bool)
        inside[tied] = True
        inside[tied - 1] = True
        spot = np.flatnonzero(inside)
        sub = order[spot]
        order[spot] = sub[np.lexsort((doc[sub], follow[sub], lead[sub]))]
    return order


def _shared(key: np.ndarray, tag: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for elements whose key and tag another doc has as well."""
    order = np.lexsort((tag, key))
    begins = np.flatnonzero(_groups(key[order], tag[order]))
    out = np.zeros(len(key), bool)
    if len(begins):
        d = doc[order]
        mixed = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
        out[order] = np.repeat(mixed, np.diff(np.append(begins, len(d))))
    return out


def settle(lead: np.ndarray, follow: np.ndarray, doc: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, open) for each suffix: repeated if a smaller doc has both tokens; open if not, but
    a suffix of another doc has the leading token and the same tag on one side."""
    order = _multikey_order(lead, follow, doc)
    a, b, d = lead[order], follow[order], doc[order]
    pair, one = _groups(a, b), _groups(a)
    rank_pair, rank_one = np.cumsum(pair) - 1, np.cumsum(one) - 1
    repeated = d > d[pair][rank_pair]
    begins = np.flatnonzero(one)
    if len(begins):
        mixed = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
    else:
        mixed = np.zeros(0, bool)
    open_ = ~repeated & mixed[rank_one]
    out = np.zeros((2, len(order)), bool)
    out[0, order], out[1, order] = repeated, open_
    spot = np.flatnonzero(out[1])
    some = lead[spot], tags[spot], doc[spot]
    out[1, spot] = _shared(some[0], some[1] & np.uint64(255), some[2]) | _shared(some[0], some[1] >> np.uint64(8), some[2])
    return out[0], out[1]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, which block codecs shorten well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(blob: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


WIDTHS = (LEAD_BYTES, 6, 8, 8, 4, 2)  # leading token, following token, steps of doc_id and of text key, number within the text, tags


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.int64(0)).view(np.uint64)


def _pack(lead, follow, doc, key, number, tags) -> bytes:
    columns = lead, follow, _steps(doc), _steps(key), number, tags
    return len(lead).to_bytes(8, "little") + b"".join(_planes(v, w) for v, w in zip(columns, WIDTHS, strict=True))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for w in WIDTHS:
        out.append(_unplanes(blob[at : at + n * w], n, w))
        at += n * w
    return out[0], out[1], np.cumsum(out[2].view(np.int64)), np.cumsum(out[3].view(np.int64)), out[4].astype(np.int64), out[5]


class Block:
    """Suffixes of a task's rows until they are settled among themselves and sent to buckets."""

    def __init__(self, splitters: np.ndarray):
        self.splitters = splitters
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.turn = 0

    def add(self, lead, follow, doc, key, number, tags) -> None:
        self.parts.append((lead >> np.uint64(64 - 8 * LEAD_BYTES), follow & np.uint64((1 << 48) - 1), doc, key, number, tags))
        self.size += len(lead)

    def flush(self) -> pa.RecordBatch:
        lead, follow, doc, key, number, tags = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        done, _ = settle(lead, follow, doc, tags)
        bucket, kind, blob = [], [], []
        if done.any():  # settled here; carried through any bucket
            bucket.append(self.turn % (len(self.splitters) + 1))
            kind.append(1)
            none = np.zeros(int(done.sum()), np.uint64)
            blob.append(_pack(none, none, doc[done], key[done], number[done], none))
            self.turn += 1
        lead, follow, doc, key, number, tags = (x[~done] for x in (lead, follow, doc, key, number, tags))
        place = np.searchsorted(self.splitters, lead, "right")
        order = np.argsort(place, kind="stable")
        lead, follow, doc, key, number, tags, place = (x[order] for x in (lead, follow, doc, key, number, tags, place))
        cuts = np.searchsorted(place, np.arange(len(self.splitters) + 2))
        for k in range(len(self.splitters) + 1):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                bucket.append(k)
                kind.append(0)
                blob.append(_pack(lead[a:b], follow[a:b], doc[a:b], key[a:b], number[a:b], tags[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int8()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


def _marks(key: np.ndarray, number: np.ndarray, kind: int, parts: int) -> pa.RecordBatch:
    """Marked numbers, the texts dealt over parts by a hash of the key."""
    part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((number, key, part))
    part, key, number = part[order], key[order], number[order]
    cuts = np.append(np.flatnonzero(_groups(part)), len(part))
    blobs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        blobs.append(int(b - a).to_bytes(8, "little") + _planes(_steps(key[a:b]), 8) + _planes(number[a:b], 4))
    own = part[cuts[:-1]].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), kind, np.int8)), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def _settled(sent: DataFrame, buckets: int, kinds: tuple[int, int | None], parts: int) -> DataFrame:
    """(part, kind, blob): numbers within texts that are repeated (first kind) or open (second kind, if any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = _unpack(blob.as_py())
                if kind:
                    yield _marks(piece[3], piece[4], kinds[0], parts)
                else:
                    held.append(piece)
        if held:
            lead, follow, doc, key, number, tags = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for mask, kind in zip(settle(lead, follow, doc, tags), kinds, strict=True):
                if kind is not None and mask.any():
                    yield _marks(key[mask], number[mask], kind, parts)

    dealt = sent.repartitionById(buckets, "bucket").select("kind", "blob")
    return mapped(dealt, run, "part int, kind tinyint, blob binary")


def _gathered(marks: DataFrame, kinds: tuple[int, ...], parts: int) -> DataFrame:
    """(key, k..): for each marked text its numbers of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: ([], []) for k in kinds}
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_py()
                n = int.from_bytes(raw[:8], "little")
                held[kind][0].append(np.cumsum(_unplanes(raw[8 : 8 + 8 * n], n, 8).view(np.int64)))
                held[kind][1].append(_unplanes(raw[8 + 8 * n :], n, 4).astype(np.uint32))
        texts, numbers = {}, {}
        for k, (t, m) in held.items():
            key, number = (np.concatenate(t), np.concatenate(m)) if t else (NO_ROWS, np.zeros(0, np.uint32))
            order = np.argsort(key, kind="stable")
            texts[k], numbers[k] = key[order], number[order]
        keys = np.unique(np.concatenate(list(texts.values())))
        for at in range(0, len(keys), 10_000):
            some = keys[at : at + 10_000]
            columns = []
            for k in kinds:
                a, b = np.searchsorted(texts[k], some, "left"), np.searchsorted(texts[k], some, "right")
                columns.append(pa.array([numbers[k][x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(some), *columns], ["key", *[f"k{k}" for k in kinds]])

    dealt = marks.filter(F.col("kind").isin(*kinds)).repartitionById(parts, "part").select("kind", "blob")
    return mapped(dealt, run, ", ".join(["key bigint", *[f"k{k} binary" for k in kinds]]))


REPEATED, OPEN, WINDOW = 0, 1, 2


def _suffixes(texts: DataFrame, length: int, splitters: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(splitters)
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, _, data, starts in text_runs(batch, "text", RUN_BYTES):
                row, first, last, token, tags = anchors(data, starts, length)
                if len(row):
                    block.add(token, span_hashes(data, first, last + length), ids[i + row], keys[i + row], ordinals(row, len(starts) - 1), tags)
                if block.size >= BLOCK_ROWS:
                    yield block.flush()
        if block.size:
            yield block.flush()

    return mapped(texts, run, "bucket int, kind tinyint, blob binary")


def _open_windows(marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """Windows of open anchors, keyed by the hash of their bytes."""
    splitters = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0 ** (8 * LEAD_BYTES)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(splitters)
        for batch in batches:
            batch = batch.select(["id", "key", "text", f"k{OPEN}"])
            batch = batch.filter(batch.column(3).is_valid())
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            marks, at = utf8(batch.column(3))
            for i, _, data, starts in text_runs(batch, "text", RUN_BYTES):
                row, first, last, *_ = anchors(data, starts, length)
                chosen = _flags(marks, at, i, row, len(starts) - 1)
                row, first, last = row[chosen], first[chosen], last[chosen]
                n = last - first + 1
                window = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                row = np.repeat(row, n)
                if len(window):
                    h = span_hashes(data, window, window + length)
                    block.add(h, h, ids[i + row], keys[i + row], window - starts[row], np.zeros(len(h), np.uint64))
                if block.size >= BLOCK_ROWS:
                    yield block.flush()
        if block.size:
            yield block.flush()

    return mapped(marked, run, "bucket int, kind tinyint, blob binary")


def _numbers(blob: np.ndarray, at: np.ndarray, i: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the packed numbers of rows i..i+rows."""
    numbers = np.frombuffer(blob[at[i] : at[i + rows]].tobytes(), np.uint32).astype(np.int64)
    return np.repeat(np.arange(rows), np.diff(at[i : i + rows + 1]) // 4), numbers


def _flags(blob: np.ndarray, at: np.ndarray, i: int, row: np.ndarray, rows: int) -> np.ndarray:
    """Which anchors have their number among the packed ones."""
    count = np.bincount(row, minlength=rows)
    base = np.cumsum(count) - count
    r, k = _numbers(blob, at, i, rows)
    out = np.zeros(len(row), bool)
    out[base[r] + k] = True
    return out


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """docs to (row, n_bytes, spans, kept): row holds the columns besides the text, spans the removed
    byte ranges, kept the remaining bytes. ``whole_characters`` widens the spans to characters."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))
    # doc_ids may repeat with other texts, so that what is found of a text goes back to it by a key of both
    texts = docs.select(own.alias("id"), F.xxhash64(own, text).alias("key"), text.alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts in text_runs(batch, "text", RUN_BYTES):
                token = anchors(data, starts, length)[3]
                yield pa.RecordBatch.from_arrays([pa.array((token[:: SAMPLE // 4 + 1] >> np.uint64(1)).view(np.int64))], ["lead"])

    sample = mapped(texts.filter(F.pmod("key", F.lit(SAMPLE)) == 0).select("text"), leads, "lead bigint")
    cuts = sample.approxQuantile("lead", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    splitters = np.unique(np.array([int(c) for c in cuts], np.uint64) >> np.uint64(63 - 8 * LEAD_BYTES))

    marks = stash(_settled(_suffixes(texts.select("id", "key", "text"), length, splitters), len(splitters) + 1, (REPEATED, OPEN), buckets), "suffixes")
    # both joins take all columns of the texts, so that they share one exchange of them
    opened = texts.join(_gathered(marks, (OPEN,), buckets), "key", "left")
    windows = _settled(_open_windows(opened, length, buckets), buckets, (WINDOW, None), buckets)
    found = _gathered(marks.filter(F.col("kind") == REPEATED).unionByName(windows), (REPEATED, WINDOW), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at0 = utf8(batch.column(batch.schema.get_field_index(f"k{REPEATED}")))
            single, at2 = utf8(batch.column(batch.schema.get_field_index(f"k{WINDOW}")))
            for i, j, data, starts in text_runs(batch, "text", RUN_BYTES):
                rows = j - i
                depth = np.zeros(len(data) + 1, np.int32)
                if at0[j] > at0[i]:
                    row, first, last, *_ = anchors(data, starts, length)
                    hit = _flags(whole, at0, i, row, rows)
                    np.add.at(depth, first[hit], 1)
                    np.add.at(depth, last[hit] + length, -1)
                if at2[j] > at2[i]:
                    r, k = _numbers(single, at2, i, rows)
                    np.add.at(depth, starts[r] + k, 1)
                    np.add.at(depth, starts[r] + k + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                if whole_characters and gone.any():
                    character = np.cumsum((data & 0xC0) != 0x80) - 1
                    hit = np.zeros(character[-1] + 1, bool)
                    hit[character[gone]] = True
                    gone = hit[character]
                kept = data[~gone]
                left = np.concatenate(([0], np.cumsum(~gone)))[starts]
                edge = gone.copy()
                heads = starts[:-1][np.diff(starts) > 0]
                edge[1:] &= ~gone[:-1]
                edge[heads] = gone[heads]
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                tails = starts[1:][np.diff(starts) > 0] - 1
                stop[tails] = gone[tails]
                begin, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
                owner = np.searchsorted(starts, begin, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(begin - starts[owner]), pa.array(end - starts[owner])], ["begin", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), spans)
                bytes_ = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("row")).slice(i, rows), pa.array(np.diff(starts)), lists, bytes_],
                    ["row", "n_bytes", "spans", "kept"],
                )

    spans = "array<struct<begin:bigint,end:bigint>>"
    kind = texts.schema["row"].dataType.simpleString()
    return mapped(texts.join(found, "key", "left"), run, f"row {kind}, n_bytes bigint, spans {spans}, kept binary")


def trimmed(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents (text, n_chars and other columns) with their remaining text.

    A character of which a byte is removed goes as a whole. A document that repeats earlier ones in
    all its bytes goes; one that was empty before stays. A text without repeats is kept as it is, null too.
    """
    found = remove_repeats(docs.withColumn("_null", F.col("text").isNull()), length, whole_characters=True)
    rest = found.filter((F.col("n_bytes") == 0) | (F.octet_length("kept") > 0))
    text = F.when(~F.col("row._null"), F.col("kept").cast("string"))
    size = F.when(F.size("spans") > 0, F.char_length(F.col("kept").cast("string")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    own = {"text": text, "n_chars": size}
    return rest.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
