"""Document quality as perplexity under modified Kneser-Ney models of trusted text, one per language.

Texts fall into HELD shares by their hash, and each language has one model per share, counted over
its trusted texts of all other shares; a text is read by the models of its own share. So no text,
trusted or not, is judged by counts of itself or of its copies, and every trusted text has such a
perplexity. For each language two quantiles of those of its trusted texts are the limits of what is
kept: text above is unlike trusted text, text below repeats itself. Perplexity is per character.

Counts are sharded by gram and joined, shard by shard, with the totals of their contexts and with the
probabilities of their shorter grams (kneser_ney.tables); the models stay tables and nothing of them is
broadcast. Documents of one language lie together in blocks of about BLOCK_BYTES, packed in a bucketed
table, since texts of a language share most of their grams. A block asks for its different grams, joins
give each its exact probability (what no model has seen backs off by further joins), and the answers go
to the bucket of the block, so a task holds one block and its different grams however large the models
are, and texts travel once. Stashes are removed as soon as nothing reads them any more.

Defined results: a null text, or one without a character but white space, has no perplexity and is
not kept; a null or unknown language is taken as the one of the lowest perplexity; a language whose
trusted texts are none or all in one share has no model, since nothing is left once a text is left
out, and its documents are read by the best one; a language with few trusted texts has the lowest
and highest of their perplexities as limits; without any trusted text no document has a perplexity
and none is kept; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kneser_ney as kn
from .arrow import text_runs
from .shared import Scratch, cleaned, mapped

HELD = 8
BLOCK_BYTES = 1 << 25
#: Bytes of texts that a task packs at once.
PACK_BYTES = 1 << 25
HELD_GRAMS = 1_000_000


@dataclass
class Shards:
    """grams[k] and contexts[k] are tables (grp, code, v) of order k: language, code, logarithm per left-out share."""

    scratch: Scratch
    order: int
    width: int
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]


def share_of(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(text), F.lit(HELD)).cast("int")


def _number(languages: list[str]) -> Column:
    """Number of the language, -1 for one without a model."""
    numbers = F.create_map(*[x for k, name in enumerate(languages) for x in (F.lit(name), F.lit(k))])
    return F.coalesce(F.try_element_at(numbers, F.col("lang")), F.lit(-1))


def train(trusted: DataFrame, order: int = 5, width: int = 12) -> tuple[list[str], Shards | None]:
    """trusted(text, lang) to the languages and their models."""
    scratch = Scratch(trusted.sparkSession, "zstd")
    known = trusted.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", share_of().alias("share"))
    known = scratch.keep(known, "trusted")  # read twice
    shares = known.groupBy("lang").agg(F.count_distinct("share").alias("n")).filter("n > 1")
    languages = sorted(r[0] for r in shares.collect())  # one row per language
    if not languages:
        scratch.clear()
        return [], None
    counted = known.withColumn("grp", _number(languages)).filter("grp >= 0").select((F.col("grp") * HELD + F.col("share")).alias("cls"), "text")
    counts = kn.task_counts(counted, order, False, width)
    per = [F.sum(F.when(F.col("cls") % HELD == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(HELD)]
    grams = counts.groupBy(F.floor(F.col("cls") / HELD).cast("int").alias("grp"), "code").agg(*per)
    total = sum(F.col(f"n{f}") for f in range(HELD))
    grams = scratch.keep(grams.select("grp", "code", F.array(*[(total - F.col(f"n{f}")).cast("double") for f in range(HELD)]).alias("a")), "grams")
    scratch.drop(known)
    model = Shards(scratch, order, width, {}, {})
    for k, model.grams[k], model.contexts[k] in kn.tables(grams, HELD, order, width, modified=True, scratch=scratch):
        pass
    return languages, model


def _blocks(docs: DataFrame) -> DataFrame:
    """docs(text, own, ..) to (text_block, packed): rows of a block as compressed Arrow streams.

    A block has rows of one language, told by a hash of the whole row, so that copies of a text are spread.
    """
    sizes = docs.groupBy("own").agg(F.sum(F.octet_length("text")).alias("n")).collect()  # one row per language
    first, numbers = 0, []
    for own, n in sorted((r[0], r[1] or 0) for r in sizes):
        count = -(-n // BLOCK_BYTES) or 1
        numbers += [F.lit(own), F.struct(F.lit(first).cast("bigint").alias("first"), F.lit(count).cast("bigint").alias("count"))]
        first += count
    plain = [f.name for f in docs.schema.fields if not _has_map(f.dataType)]
    place = F.create_map(*numbers)[F.col("own")] if numbers else F.struct(F.lit(0).alias("first"), F.lit(1).alias("count"))
    docs = docs.withColumn("text_block", (place["first"] + F.pmod(F.xxhash64(*plain), place["count"])).cast("bigint"))
    at = docs.columns.index("text")

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        block = rows.column("text_block").to_numpy()
        rank = np.argsort(block, kind="stable")
        rows, block = rows.drop_columns(["text_block"]).take(rank), block[rank]
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        out = []
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as stream:
                stream.write_table(rows.slice(i, j - i).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[begin]), pa.array(out, pa.binary())], ["text_block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if len(batch):
                waiting.append(batch)
                held += pc.sum(pc.binary_length(batch.column(at))).as_py() or 0
            if held >= PACK_BYTES:
                yield packed(waiting)
                waiting, held = [], 0
        if waiting:
            yield packed(waiting)

    return mapped(docs, run, "text_block bigint, packed binary")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _unpacked(packed: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(row, batch) for each batch in a column of packed rows."""
    for k, one in enumerate(packed):
        with pa.ipc.open_stream(one.as_buffer()) as stream:
            for batch in stream:
                yield k, batch


def _codes(data: np.ndarray, starts: np.ndarray, order: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    s, begins = kn.symbols(data, starts, False, width)
    return begins, kn.gram_codes(s, begins, order, width)


def _asked(blocks: DataFrame, count: int, order: int, width: int) -> DataFrame:
    """blocks(text_block, packed) to (text_block, grp, code): the different grams of each block and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = {}, 0

        def out():
            for (block, g), codes in parts.items():
                codes = np.unique(np.concatenate(codes))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), x, t)) for x, t in ((block, np.int64), (g, np.int32))] + [pa.array(codes)], ["text_block", "grp", "code"])

        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            for k, part in _unpacked(batch.column(1)):
                own = part.column("own").to_numpy(zero_copy_only=False)
                for i, j, data, starts in text_runs(part, "text", kn.RUN_BYTES):
                    begins, codes = _codes(data, starts, order, width)
                    by = np.repeat(own[i:j], np.diff(begins))
                    for g in range(count) if (by < 0).any() else np.unique(by).tolist():
                        parts.setdefault((int(block[k]), g), []).append(np.unique(codes[(by == g) | (by < 0)]))
                        held += len(parts[int(block[k]), g][-1])
                    if held > HELD_GRAMS:
                        parts = {key: [np.unique(np.concatenate(c))] for key, c in parts.items()}
                        held = sum(len(c[0]) for c in parts.values())
                        if held > HELD_GRAMS // 2:
                            yield from out()
                            parts, held = {}, 0
        yield from out()

    return mapped(blocks.select("text_block", "packed"), run, "text_block bigint, grp int, code bigint")


def resolved(asked: DataFrame, model: Shards, scratch: Scratch) -> DataFrame:
    """asked(grp, code), different grams of the full order, to (grp, code, v), which lies in ``scratch``."""
    met = {}
    for k in range(model.order, 0, -1):
        met[k] = scratch.keep(asked.join(model.grams[k], ["grp", "code"], "left"), "met")
        asked = met[k].filter(F.col("v").isNull()).select("grp", F.col("code").bitwiseAND(F.lit((1 << (model.width * (k - 1))) - 1)).alias("code")).distinct()
    found = None
    for k in range(1, model.order + 1):
        missed = met[k].filter(F.col("v").isNull()).select("grp", "code", F.shiftright("code", model.width).alias("ctx"))
        weighed = missed.join(model.contexts[k].select("grp", F.col("code").alias("ctx"), F.col("v").alias("w")), ["grp", "ctx"], "left")
        if found is None:
            weighed = weighed.withColumn("q", F.array(*[F.lit(-model.width * float(np.log(2))).cast("float")] * HELD))
        else:
            short = F.col("code").bitwiseAND(F.lit((1 << (model.width * (k - 1))) - 1))
            weighed = weighed.withColumn("short", short).join(found.select("grp", F.col("code").alias("short"), F.col("v").alias("q")), ["grp", "short"])
        v = F.array(*[F.coalesce(F.col("w")[f], F.lit(0.0).cast("float")) + F.col("q")[f] for f in range(HELD)])
        found = met[k].filter(F.col("v").isNotNull()).unionByName(weighed.select("grp", "code", v.alias("v")))
    found = scratch.keep(found, "found")
    scratch.drop(*met.values())
    return found


def perplexities(docs: DataFrame, languages: list[str], model: Shards | None, scratch: Scratch | None = None, with_text: bool = True) -> DataFrame:
    """docs(text, lang, ..) with read_as and perplexity, and without their texts if ``with_text`` is false.

    What the result is made from lies in ``scratch``, if there is one; this is then the last use of the model,
    whose tables are removed.
    """
    docs = docs.drop("read_as", "perplexity")
    out_docs = docs if with_text else docs.drop("text")
    if model is None:
        return out_docs.withColumns({"read_as": F.lit(None).cast("string"), "perplexity": F.lit(None).cast("double")})
    order, width, count = model.order, model.width, len(languages)
    kept = scratch or Scratch(docs.sparkSession, "zstd")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(docs.withColumns({"own": _number(languages), "text_share": share_of()}))
    with cleaned(docs.sparkSession):
        blocks = kept.bucketed(rows.repartition(buckets, "text_block"), "text_blocks", "text_block")
    asked = kept.keep(_asked(blocks, count, order, width), "asked")
    found = resolved(asked.select("grp", "code").distinct(), model, kept)
    if scratch:
        model.scratch.clear()
    answers = asked.join(found, ["grp", "code"])
    names = out_docs.columns

    def run(texts: pa.Table, heard: pa.Table) -> pa.Table:
        grp, code = (heard.column(x).to_numpy() for x in ("grp", "code"))
        v = heard.column("v").combine_chunks().flatten().to_numpy().reshape(-1, HELD)
        rank = np.lexsort((code, grp))
        cut = np.searchsorted(grp[rank], np.arange(count + 1))
        table = [(code[rank[cut[g] : cut[g + 1]]], v[rank[cut[g] : cut[g + 1]]]) for g in range(count)]
        out = []
        for _, piece in _unpacked(texts.column("packed")):
            own = piece.column("own").to_numpy(zero_copy_only=False).astype(np.int64)
            share = piece.column("text_share").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, starts in text_runs(piece, "text", kn.RUN_BYTES):
                begins, codes = _codes(data, starts, order, width)
                n = np.diff(begins)
                row, mine = np.repeat(np.arange(j - i), n), own[i:j].copy()
                ce = np.full((j - i, count), np.inf)
                for g in range(count):
                    asks = (mine == g) | (mine < 0)
                    spots = np.flatnonzero(asks[row])
                    if len(spots):
                        known, logs = table[g]
                        values = logs[np.searchsorted(known, codes[spots]), share[i:j][row[spots]]]
                        ce[asks, g] = -np.bincount(row[spots], values, j - i)[asks] / np.maximum(n[asks], 1)
                mine = np.where(mine < 0, ce.argmin(axis=1), mine)
                read = pa.array(np.array(languages, object)[mine], pa.string(), mask=n == 0)
                value = pa.array(np.exp(ce[np.arange(j - i), mine]), mask=n == 0)
                out.append(pa.RecordBatch.from_arrays([*[piece.column(c).slice(i, j - i) for c in names], read, value], [*names, "read_as", "perplexity"]))
        return pa.Table.from_batches(out)

    schema = T.StructType([*out_docs.schema.fields, T.StructField("read_as", T.StringType()), T.StructField("perplexity", T.DoubleType())])
    return blocks.groupBy("text_block").cogroup(answers.groupBy("text_block")).applyInArrow(run, schema)


def limits(scored_trusted: DataFrame, low: float = 0.005, high: float = 0.98) -> DataFrame:
    """(read_as, lowest, highest): quantiles of each language over trusted documents."""
    cut = F.percentile_approx("perplexity", F.array(F.lit(low), F.lit(high)), 10_000)
    return scored_trusted.groupBy("read_as").agg(cut.alias("c")).select("read_as", F.col("c")[0].alias("lowest"), F.col("c")[1].alias("highest"))


def judged(scored: DataFrame, limits_: DataFrame) -> DataFrame:
    """scored with lowest, highest and keep. limits_ has one row per language."""
    inside = (F.col("perplexity") >= F.col("lowest")) & (F.col("perplexity") <= F.col("highest"))
    return scored.join(F.broadcast(limits_), "read_as", "left").withColumn("keep", F.coalesce(inside, F.lit(False)))
