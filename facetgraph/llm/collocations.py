"""Phrases whose words occur together more often than apart, counted exactly for each language.

Texts become blocks of word codes once. Words that occur often enough are ranked by frequency; a
pair of neighbouring ranks is a cell of a tile of SIDE x SIDE ranks. A block counts the cells of a
well filled tile with a dense ``bincount`` and those of a sparse tile by sorting (sorted COO). Cells
are dealt to partitions by tile and column, so that no tile of frequent words lands in one task,
and are added there in the same two ways. Cells that reach the threshold are phrases; they are
ranked by frequency in turn and, as left neighbours of a word, give the pairs of the next level.

No vocabulary is broadcast or collected: a block asks for the ranks of its own distinct words and
cells by joins, and gets back what it asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import mix
from .shared import Scratch, mapped

SIDE = 256
#: Words of a block, bytes of text that wait for it in a task, and bytes that are split into words at a time.
BLOCK_WORDS, WAITING, SLICE = 1 << 20, 1 << 24, 1 << 20
#: Sums of a partition are compacted when so many cells wait.
CELLS = 1 << 22

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Words:
    """Words of one language that wait for a block: their bytes, lengths, and whether a piece begins with them."""

    def __init__(self) -> None:
        self.data: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.words = self.bytes = 0
        self.border = True

    def add(self, text: np.ndarray) -> None:
        """Words of bytes that end with a separator or with the text."""
        kind = _KIND[text]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        borders = np.flatnonzero(kind == 2)
        if len(begin):
            piece = np.searchsorted(borders, begin)
            begins = np.diff(piece, prepend=0) > 0
            begins[0] |= self.border
            self.border = bool(len(borders) and borders[-1] > begin[-1])
            self.data.append(_LOWER[text[inside]])
            self.lengths.append(end - begin)
            self.begins.append(begins)
            self.words += len(begin)
            self.bytes += len(text)
        else:
            self.border |= bool(len(borders))

    def block(self, whole: bool) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
        """(distinct words, their counts, codes with the high bit where a piece begins) of what waits up to the last piece border."""
        if not self.words:
            return None
        data, lengths, begins = np.concatenate(self.data), np.concatenate(self.lengths), np.concatenate(self.begins)
        n = len(lengths) if whole or self.border else int(np.flatnonzero(begins)[-1])
        if not n:
            return None
        stops = np.zeros(n + 1, np.int64)
        np.cumsum(lengths[:n], out=stops[1:])
        self.data, self.lengths, self.begins = [data[stops[-1] :]], [lengths[n:]], [begins[n:]]
        self.words, self.bytes = len(lengths) - n, len(data) - int(stops[-1])
        words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(data[: stops[-1]].tobytes())]).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
        counts = np.bincount(codes, minlength=len(words.dictionary))
        return words.dictionary, counts, codes | (begins[:n].astype(np.uint32) << np.uint32(31))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    waiting: dict[str, _Words] = {}

    def row(lang: str, whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        if found := waiting[lang].block(whole):
            made += 1
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang], pa.string()), "block": pa.array([(part << 32) + made], pa.int64()),
                "words": pa.array([found[0].cast(pa.string())], pa.list_(pa.string())),
                "counts": pa.array([found[1]], pa.list_(pa.int64())), "codes": pa.array([_packed_ints(found[2], "<u4")], pa.binary()),
            })

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words = waiting.setdefault(lang, _Words())
            data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            at = 0
            while at < len(data):
                stop = min(at + SLICE, len(data))
                while stop < len(data):  # a word is never cut
                    gaps = np.flatnonzero(_KIND[data[max(at, stop - SLICE) : stop]])
                    if len(gaps):
                        stop = max(at, stop - SLICE) + int(gaps[-1]) + 1
                        break
                    stop = min(stop + SLICE, len(data))
                words.add(data[at:stop])
                at = stop
                if words.words >= BLOCK_WORDS:
                    yield from row(lang, False)
            words.border = True  # nothing reaches over the end of a text
        while sum(w.bytes for w in waiting.values()) > WAITING:
            largest = max(waiting, key=lambda g: waiting[g].bytes)
            yield from row(largest, True)
            del waiting[largest]
    for lang in list(waiting):
        yield from row(lang, True)


def ranked(df: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with its place (from 0) among the rows of its ``lang`` by ``order``.

    Ranges are sorted side by side and numbered by the counts of the ranges before them, so no
    language has to fit in one task. ``df`` is read several times: give a written one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, "lang", *order).sortWithinPartitions("lang", *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            langs, places = batch.column("lang").to_pylist(), np.zeros(batch.num_rows, np.int64)
            for k, lang in enumerate(langs):
                seen = seen + 1 if lang == last else 0
                last, places[k] = lang, seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)], [*batch.schema.names, "range", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", `range` int, place bigint"
    dealt = scratch.keep(mapped(dealt, number, schema), name)
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("lang", "range").agg(F.count("*").alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return dealt.join(starts.drop("rows"), ["lang", "range"]).withColumn("rank", F.col("start") + F.col("place")).drop("range", "place", "start")


def _packed_ints(values: np.ndarray, kind: str) -> bytes:
    """All first bytes, then all second ones, and so on: the high bytes are mostly alike and compress away."""
    values = np.ascontiguousarray(values, kind)
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _ints(packed: bytes | pa.Scalar, kind: str) -> np.ndarray:
    data = np.frombuffer(packed.as_buffer() if isinstance(packed, pa.Scalar) else packed, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


def _coded(codes: np.ndarray) -> bytes:
    """Ascending codes by their steps."""
    return _packed_ints(np.diff(codes, prepend=0), "<i8")


def _codes(packed: pa.Scalar) -> np.ndarray:
    return np.cumsum(_ints(packed, "<i8"))


def _packed(**columns) -> pa.RecordBatch:
    """A batch of equally long columns; arrays of bytes become binary values."""
    kinds = {"lang": pa.string(), "block": pa.int64(), "words": pa.binary(), "phrases": pa.binary(), "group": pa.int32(), "codes": pa.binary(), "values": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], list(columns))


def _with_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of blocks as ranks: -1 for a word without one and between pieces, several in a row as one."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes, found = _ints(batch.column("codes")[k], "<u4"), batch.column("ranks")[k].values
            table = np.full(batch.column("size")[k].as_py(), -1, np.int32)
            table[found.field("at").to_numpy()] = found.field("rank").to_numpy()
            ranks = np.insert(table[codes & np.uint32(0x7FFFFFFF)], np.flatnonzero(codes >> np.uint32(31)), -1)
            ranks = _packed_ints(ranks[(ranks >= 0) | np.append(True, ranks[:-1] >= 0)], "<i4")
            yield _packed(lang=[batch.column("lang")[k].as_py()], block=[batch.column("block")[k].as_py()], words=[ranks], phrases=[None])


def _state(words: bytes | pa.Scalar, phrases: bytes | pa.Scalar | None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the words of a block, and of the phrases that begin at each of them; single words are their own phrases."""
    ranks = _ints(words, "<i4")
    return ranks, ranks if phrases is None or (isinstance(phrases, pa.Scalar) and not phrases.is_valid) else _ints(phrases, "<i4")


def _cells(words: np.ndarray, phrases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of k words is followed by a word so that the last k words are a phrase too, and both ranks as one code."""
    n = len(words) - k
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((phrases[:n] >= 0) & (phrases[1 : n + 1] >= 0))
    return at, phrases[at].astype(np.int64) << 32 | words[at + k].astype(np.int64)


def summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and their (summed) counts: dense tiles by direct address, all others as sorted COO.

    Ranks follow frequency, so the tiles of the lowest ranks are the filled ones; as many of them are
    dense as leaves a few addresses for each code.
    """
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    wide = int((4 * len(codes) / SIDE**2) ** 0.5)  # dense tiles on a side
    left, right = codes >> 32, codes & 0xFFFFFFFF
    dense = (left < wide * SIDE) & (right < wide * SIDE)
    found, sums = [], []
    if dense.any():
        a, b = left[dense], right[dense]
        address = (((a // SIDE) * wide + b // SIDE) * SIDE + a % SIDE) * SIDE + b % SIDE
        tiles = np.bincount(address, None if counts is None else counts[dense], minlength=(wide * SIDE) ** 2)  # exact: counts stay below 2**53
        address = np.flatnonzero(tiles)
        tile, cell = address // SIDE**2, address % SIDE**2
        found.append((tile // wide * SIDE + cell // SIDE) << 32 | (tile % wide * SIDE + cell % SIDE))
        sums.append(tiles[address].astype(np.int64))
    rest = codes[~dense]
    if len(rest):
        order = np.argsort(rest, kind="stable")
        rest = rest[order]
        begin = np.flatnonzero(np.diff(rest, prepend=-1))
        found.append(rest[begin])
        sums.append(np.diff(np.append(begin, len(rest))) if counts is None else np.add.reduceat(counts[~dense][order], begin))
    return np.concatenate(found), np.concatenate(sums)


def _group(codes: np.ndarray, groups: int) -> np.ndarray:
    """Partition of a cell: by its tile and its column within the tile."""
    key = (codes >> 32) // SIDE << 32 | codes & 0xFFFFFFFF
    return (mix(key.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _asked(k: int, groups: int):
    """Cells of each block and their counts, a row for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                _, codes = _cells(*_state(batch.column("words")[b], batch.column("phrases")[b]), k)
                codes, counts = summed(codes)
                group = _group(codes, groups)
                order = np.lexsort((codes, group))
                codes, counts, group = codes[order], counts[order], group[order]
                cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
                rows = range(len(cuts) - 1)
                yield _packed(
                    lang=[batch.column("lang")[b].as_py()] * len(rows), block=[batch.column("block")[b].as_py()] * len(rows), group=group[cuts[:-1]],
                    codes=[_coded(codes[cuts[r] : cuts[r + 1]]) for r in rows], values=[_packed_ints(counts[cuts[r] : cuts[r + 1]], "<u4") for r in rows],
                )

    return run


def _added(least: int):
    """Cells of a partition that reach the threshold over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, int] = {}
        for batch in batches:
            for b, lang in enumerate(batch.column("lang").to_pylist()):
                codes = _codes(batch.column("codes")[b])
                held.setdefault(lang, []).append((codes, _ints(batch.column("values")[b], "<u4").astype(np.int64)))
                waiting[lang] = waiting.get(lang, 0) + len(codes)
                if waiting[lang] > CELLS:
                    held[lang] = [summed(*map(np.concatenate, zip(*held[lang])))]
                    waiting[lang] = 0
        for lang, parts in held.items():
            codes, counts = summed(*map(np.concatenate, zip(*parts)))
            codes, counts = codes[counts >= least], counts[counts >= least]
            names = ["lang", "group", "code", "a"]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(np.full(len(codes), group, np.int32)), pa.array(codes), pa.array(counts)], names)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the cells that blocks asked for, the ranks of those that are phrases; the phrases of a language and group come first."""
    known, codes, ranks = None, [], []
    for batch in batches:
        out = []
        for b, lang in enumerate(batch.column("lang").to_pylist()):
            key = (lang, batch.column("group")[b].as_py())
            if key != known:
                known, codes, ranks = key, [], []
            if batch.column("block")[b].as_py() is None:
                codes.append(batch.column("code")[b].as_py())
                ranks.append(batch.column("rank")[b].as_py())
                continue
            if not isinstance(codes, np.ndarray):
                order = np.argsort(np.array(codes, np.int64))
                codes, ranks = np.array(codes, np.int64)[order], np.array(ranks, "<i4")[order]
            if len(codes):
                asked = _codes(batch.column("codes")[b])
                at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                hit = codes[at] == asked
                if hit.any():
                    out.append((batch.column("block")[b].as_py(), _coded(asked[hit]), _packed_ints(ranks[at[hit]], "<i4")))
        if out:
            block, asked, found = zip(*out)
            yield _packed(block=block, codes=asked, values=found)


def _kept(words: np.ndarray, phrases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the next level can use: stretches where two phrases of k words follow each other, with -1 between them."""
    at = np.flatnonzero((phrases[:-1] >= 0) & (phrases[1:] >= 0))
    inside = np.zeros(len(words) + 1, np.int64)
    inside[at] += 1
    inside[at + k + 1] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    border = ~inside & np.append(False, inside[:-1])
    words, phrases = np.where(border, -1, words), np.where(border, -1, phrases)
    return words[inside | border], phrases[inside | border]


def _next(k: int):
    """Blocks with the ranks of phrases of k + 1 words; a block comes first, then the answers to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        codes: list[np.ndarray] = []
        ranks: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            if head is None or not codes:  # without a phrase there is none longer
                return
            lang, block, words, phrases = head
            words, phrases = _state(words, phrases)
            found, rank = np.concatenate(codes), np.concatenate(ranks)
            order = np.argsort(found)
            found, rank = found[order], rank[order]
            at, asked = _cells(words, phrases, k)
            hit = np.minimum(np.searchsorted(found, asked), len(found) - 1)
            fine = found[hit] == asked
            longer = np.full(len(words), -1, "<i4")
            longer[at[fine]] = rank[hit[fine]]
            words, longer = _kept(words, longer, k + 1)
            if len(words):
                yield _packed(lang=[lang], block=[block], words=[_packed_ints(words, "<i4")], phrases=[_packed_ints(longer, "<i4")])

        for batch in batches:
            for b in range(batch.num_rows):
                if batch.column("words")[b].is_valid:
                    yield from close()
                    head = tuple(batch.column(c)[b].as_py() for c in ("lang", "block", "words", "phrases"))
                    codes, ranks = [], []
                else:
                    codes.append(_codes(batch.column("codes")[b]))
                    ranks.append(_ints(batch.column("values")[b], "<i4"))
        yield from close()

    return run


STATE = "lang string, block bigint, words binary, phrases binary"


def counts(docs: DataFrame, scratch: Scratch, longest: int = 4, least: int = 30) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each number of words the phrases (lang, phrase, a, rank) that occur ``least`` times."""
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.keep(mapped(docs, _blocks, "lang string, block bigint, words array<string>, counts array<bigint>, codes binary"), "blocks")
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a"))
    each = scratch.keep(each, "words")
    total = each.groupBy("lang").agg(F.sum("a").alias("n"))
    order = [F.col("a").desc(), F.col("phrase").asc()]
    phrases = [scratch.keep(ranked(scratch.keep(each.filter(F.col("a") >= least), "often"), order, scratch, "ranges"), "phrases")]

    asked = blocks.select("lang", "block", F.posexplode("words").alias("at", "phrase")).join(phrases[0], ["lang", "phrase"])
    ranks = asked.groupBy("block").agg(F.collect_list(F.struct("at", "rank")).alias("ranks"))  # one for each word of a block at most
    state = blocks.select("lang", "block", "codes", F.size("words").alias("size")).join(ranks, "block").select("lang", "block", "codes", "size", "ranks")
    state = scratch.keep(mapped(state, _with_ranks, STATE), "ranks")
    scratch.drop(blocks)
    for k in range(1, longest):
        cells = scratch.keep(mapped(state, _asked(k, groups), "lang string, block bigint, `group` int, codes binary, values binary"), "cells")
        often = mapped(cells.select("lang", "codes", "values", "group").repartitionById(groups, F.col("group")).drop("group"), _added(least), "lang string, `group` int, code bigint, a bigint")
        often = scratch.keep(often, "often")
        order = [F.col("a").desc(), F.col("code").asc()]
        places = scratch.keep(ranked(often, order, scratch, "ranges"), "places")
        left = phrases[-1].select("lang", F.col("rank").alias("left"), F.col("phrase").alias("head"))
        right = phrases[0].select("lang", F.col("rank").alias("right"), F.col("phrase").alias("tail"))
        spelt = places.withColumns({"left": F.shiftright("code", 32), "right": F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))})
        spelt = spelt.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        phrases.append(scratch.keep(spelt.select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a", "rank"), "phrases"))
        if k + 1 == longest:
            break
        none = {c: F.lit(None).cast(t) for c, t in (("block", "bigint"), ("codes", "binary"), ("code", "bigint"), ("rank", "bigint"))}
        heads = places.select("lang", "group", none["block"].alias("block"), none["codes"].alias("codes"), "code", "rank")
        asks = cells.select("lang", "group", "block", "codes", none["code"].alias("code"), none["rank"].alias("rank"))
        met = heads.unionByName(asks).repartitionById(groups, F.col("group")).sortWithinPartitions("lang", F.col("block").asc_nulls_first())
        answers = mapped(met, _answered, "block bigint, codes binary, values binary")
        empty = F.lit(None).cast("binary")
        answers = answers.select(F.lit(None).cast("string").alias("lang"), "block", empty.alias("words"), empty.alias("phrases"), "codes", "values")
        held = state.select("*", empty.alias("codes"), empty.alias("values"))
        met = held.unionByName(answers).repartition(groups, "block").sortWithinPartitions("block", F.col("lang").asc_nulls_last())
        before, state = state, scratch.keep(mapped(met, _next(k), STATE), "ranks")
        scratch.drop(before, cells, often, places)
    scratch.drop(state)
    return total, phrases


def scored(phrases: list[DataFrame]) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of several words by their lowest-scoring cut, ties to the earliest."""
    known = phrases[0].select("lang", "phrase", "a")
    for more in phrases[1:]:
        known = known.unionByName(more.select("lang", "phrase", "a"))
    several = known.filter(F.contains("phrase", F.lit(" "))).withColumn("words", F.split("phrase", " "))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({
        "first": F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))),
        "rest": F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))),
    })
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("cast(a AS decimal(25, 0)) * 2000000 div (cast(l AS decimal(25, 0)) + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", F.split("phrase", " ").alias("words"), "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Text is split at .,;:!? and line ends into pieces, these at spaces and tabs into words, A-Z in
    lower case; phrases of 2 to ``longest`` words that occur at least ``least`` times are scored by
    their lowest-scoring cut, and go if a longer phrase that holds them occurs ``covered`` per cent
    as often. A null or empty text has no words, a null language is ``und``; repeated rows count
    each time; ties in the score fall to the more frequent, then to the smaller phrase in byte
    order; other columns are not read. An empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    total, phrases = counts(docs, scratch, longest, least)
    best = scratch.keep(scored(phrases), "scored")
    longer = best.filter(F.size("words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    longer = longer.withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    inner = longer.select("lang", F.concat_ws(" ", F.slice("words", F.col("begin"), F.col("size"))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = best.drop("words").join(inner, ["lang", "phrase"], "left").filter(F.expr(f"most IS NULL OR cast(most AS decimal(25, 0)) * 100 < cast(a AS decimal(25, 0)) * {covered}"))
    free = scratch.keep(free.drop("most"), "free")
    first = ranked(free, [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], scratch, "ranges")
    first = first.filter(F.col("rank") < top).join(total, "lang")
    out = scratch.last(first.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    return out
