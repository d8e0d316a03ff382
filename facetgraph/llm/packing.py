"""Packing of tokenised documents into fixed windows, with bounded memory per partition.

Every document is its token ids and an end id. A partition keeps a fixed number of open windows:
whole windows of a long document leave at once; the rest goes to the open window that it fits best,
or to a new one while windows are free; when none fits, the fullest window is filled up with the
beginning of the rest and emitted. At the end of a partition its open windows are merged: their
pieces fill windows one after the other, and the last tokens become windows whose sizes are powers
of two. So no window needs padding and no partition waits for another.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they
stand; a null doc_id is passed through; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import categories, code_points, span_hashes, text_runs
from .shared import mapped

RUN_BYTES = 1 << 21
SCHEMA = "doc_id {id}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
MOST_KNOWN = 200_000
MARKER = b"<|endoftext|>"


@functools.cache
def whole_tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def encoder(name: str):
    """The tokenizer's vocabulary as ranks, for single pieces of text."""
    import base64

    import tiktoken

    stem = name.removesuffix(".json")
    with open(public_tokenizers.path(f"{stem}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _known(name: str) -> dict[int, bytes]:
    """Ids of pieces that this worker has met, by the piece's 64-bit hash."""
    return {}


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces begin into which a byte-level BPE splits texts before merging.

    A piece is a run of letters, of numbers or of other signs with one blank before it, a run of
    white space but for its last character before anything else, or an English contraction.
    """
    n = len(points)
    kind = categories()[points]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    head = np.zeros(n + 1, bool)
    head[starts] = True
    begin |= head[:n]
    after = np.flatnonzero(begin[1:] & (kind[1:] != 0) & (kind[:-1] == 0) & ~head[1:n]) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero(points == 39)
    if len(quote):
        pad = np.concatenate((points, np.zeros(3, points.dtype)))
        last = np.concatenate((head, np.ones(3, bool)))
        free = begin[quote]
        one, two = pad[quote + 1], pad[quote + 2]
        single = free & ~last[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        double = free & ~last[quote + 1] & ~last[quote + 2] & np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        for at, size in ((quote[single], 1), (quote[double], 2)):
            begin[at + 1] = False
            ends = at + size + 1
            ends = ends[ends < n]
            begin[ends] |= kind[ends] == 1
    return np.flatnonzero(begin)


def token_ids(data: np.ndarray, starts: np.ndarray, name: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows end to end, each row closed by ``end_id``, and where each row begins.

    Every different piece of text is encoded once a run; a bounded table keeps pieces between runs.
    """
    encoding = encoder(name)
    points, begins = code_points(data, starts)
    text = data.tobytes().decode("utf-8", "replace")
    first = piece_starts(points, begins)
    end = np.append(first[1:], len(points))
    keys, at, inverse = np.unique(span_hashes(points, first, end), return_index=True, return_inverse=True)
    known = _known(name)
    if len(known) > MOST_KNOWN:
        known.clear()
    encoded = []
    for key, a, b in zip(keys.tolist(), first[at].tolist(), end[at].tolist(), strict=True):
        one = known.get(key)
        if one is None:
            one = known[key] = array("I", encoding.encode_ordinary(text[a:b])).tobytes()
        encoded.append(one)
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    flat = np.frombuffer(b"".join(encoded), np.uint32)
    size = sizes[inverse]
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[inverse] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    stops = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(first, begins)]
    each = [ids[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
    if MARKER in data.tobytes():  # a special token's own string: left to the tokenizer
        for k in range(len(each)):
            row = data[starts[k] : starts[k + 1]].tobytes()
            if MARKER in row:
                each[k] = np.array(whole_tokenizer(name).encode(row.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
    stop = np.array([end_id], np.uint32)
    out = np.concatenate([x for one in each for x in (one, stop)]) if each else np.zeros(0, np.uint32)
    return out, np.concatenate(([0], np.cumsum([len(x) + 1 for x in each]))).astype(np.int64)


class Packer:
    """The open windows of one partition. Pieces are (row, start, ids, row's tokens)."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.open: list[list] = []  # windows as lists of pieces
        self.free: list[int] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for row, start, ids, total in pieces:
            self.out.append((row, start, len(ids), total, self.next_id, at, ids.tobytes()))
            at += len(ids)
        self.next_id += 1

    def close(self, k: int) -> None:
        self.emit(self.open.pop(k))
        self.free.pop(k)

    def put(self, k: int, piece: tuple) -> None:
        self.open[k].append(piece)
        self.free[k] -= len(piece[2])
        if not self.free[k]:
            self.close(k)

    def add(self, row, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.emit([(row, start, ids[start : start + self.size], total)])
            start += self.size
        while start < total:
            rest = total - start
            fits = [(f, k) for k, f in enumerate(self.free) if f >= rest]
            if fits:
                self.put(min(fits)[1], (row, start, ids[start:].copy(), total))
                return
            if len(self.open) < self.most:
                self.open.append([])
                self.free.append(self.size)
                continue
            k = min(range(len(self.free)), key=self.free.__getitem__)
            cut = start + self.free[k]
            self.put(k, (row, start, ids[start:cut].copy(), total))
            start = cut

    def finish(self) -> None:
        """Merge the open windows: full ones first, then powers of two."""
        pieces = [p for window in self.open for p in window]
        left = sum(len(p[2]) for p in pieces)
        self.open, self.free = [], []
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            taken = []
            while want:
                row, start, ids, total = pieces[0]
                n = min(want, len(ids))
                taken.append((row, start, ids[:n], total))
                want -= n
                if n == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0] = (row, start + n, ids[n:], total)
            self.emit(taken)


def pack(docs: DataFrame, size: int = 2048, windows: int = 16, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) to one row per piece with its ids (little-endian unsigned 32-bit numbers)."""
    kind = docs.schema["doc_id"].dataType
    schema = SCHEMA.format(id=kind.simpleString())
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, windows, TaskContext.get().partitionId() << 33)

        def rows(id_type) -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0)
            for i, j, data, starts in text_runs(batch, "text", RUN_BYTES):
                ids, begins = token_ids(data, starts, tokenizer, end_id)
                for row, a, b in zip(keys.slice(i, j - i).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    packer.add(row, ids[a:b])
                if packer.out:
                    yield rows(id_type)
        packer.finish()
        if packer.out:
            yield rows(id_type)

    return mapped(docs.select("doc_id", F.col("text")), run, schema)
