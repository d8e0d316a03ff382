"""Interpolated Kneser-Ney models over characters, one distribution per class.

A character is a symbol of ``width`` bits, so a gram of order 60 / width is an exact 60-bit code: its low
symbol is the predicted one, the code without it the context, the code without its first symbol the shorter gram.
Counting, continuation counts, context totals and probabilities are grouped sums and joins on these
codes. tables() leaves the logarithms in tables, which grow with the text and are joined; train()
takes them into sorted arrays of exact codes, one row of log-probabilities each, so that an unseen
gram is never taken for another one and backs off. Arrays grow with the number of different grams.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import categories, code_points, lower_points, mix, text_runs
from .shared import Scratch, mapped, stash

RUN_BYTES = 1 << 19
HELD_GRAMS = 1_000_000


@functools.cache
def symbol_table(letters_only: bool, width: int) -> np.ndarray:
    """Symbol of each code point; 0 is a boundary: anything but a letter, or white space alone."""
    low = lower_points().astype(np.uint64)
    out = (mix(low) % np.uint64((1 << width) - 1) + np.uint64(1)).astype(np.int64)
    kind = categories()
    out[(kind != 1) if letters_only else (kind == 0)] = 0
    return out


def symbols(data: np.ndarray, starts: np.ndarray, letters_only: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, boundaries in a row taken once and none at a text's beginning."""
    points, begins = code_points(data, starts)
    s = symbol_table(letters_only, width)[points]
    keep = s != 0
    if len(keep):
        after = keep[:-1].copy()
        heads = begins[(begins > 0) & (begins < len(s))]
        after[heads - 1] = False
        keep[1:] |= after
    place = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return s[keep], place[begins]


def gram_codes(s: np.ndarray, starts: np.ndarray, order: int, width: int) -> np.ndarray:
    """Code of the gram that ends at each symbol; a text is preceded by boundaries."""
    code = s.copy()
    at = np.arange(len(s)) - np.repeat(starts[:-1], np.diff(starts))
    for j in range(1, order):
        part = s[:-j] << (width * j)
        part[at[j:] < j] = 0
        code[j:] |= part
    return code


def task_counts(texts: DataFrame, order: int, letters_only: bool, width: int = 12) -> DataFrame:
    """texts(cls, text) to (cls, code, n): grams of the full order, summed in each task only."""

    def merged(parts):
        cls, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank = np.lexsort((code, cls))
        cls, code, n = cls[rank], code[rank], n[rank]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])
        begin = np.flatnonzero(new)
        return cls[begin], code[begin], np.add.reduceat(n, begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, starts in text_runs(batch, "text", RUN_BYTES):
                s, begins = symbols(data, starts, letters_only, width)
                code = gram_codes(s, begins, order, width)
                cls = np.repeat(classes[i:j], np.diff(begins))
                for c in np.unique(cls):
                    grams, n = np.unique(code[cls == c], return_counts=True)
                    parts.append((np.full(len(grams), c, np.int32), grams, n.astype(np.int64)))
                    held += len(grams)
                if held > HELD_GRAMS:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > HELD_GRAMS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["cls", "code", "n"])
                        parts = []
                    held = len(parts[0][0]) if parts else 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], ["cls", "code", "n"])

    return mapped(texts.select(F.col("cls").cast("int"), "text"), run, "cls int, code bigint, n bigint")


def gram_counts(texts: DataFrame, order: int, letters_only: bool, width: int = 12) -> DataFrame:
    """texts(cls, text) to (cls, code, n): grams of the full order, summed in each task first."""
    return task_counts(texts, order, letters_only, width).groupBy("cls", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted arrays: grams[k] and contexts[k] are (codes, log values per class)."""

    order: int
    width: int
    classes: int
    letters_only: bool
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]

    def codes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of texts, where each text begins among them, and the gram that ends at each."""
        s, begins = symbols(data, starts, self.letters_only, self.width)
        return s, begins, gram_codes(s, begins, self.order, self.width)

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Natural logarithms, one row per gram code and one column per class."""
        out = np.zeros((len(code), self.classes), np.float32)
        left = np.arange(len(code))
        for k in range(self.order, 0, -1):
            gram = code[left] & ((1 << (self.width * k)) - 1)
            row, hit = _find(self.grams[k][0], gram)
            if k == self.order and hit.all():
                return self.grams[k][1][row]
            out[left[hit]] += self.grams[k][1][row[hit]]
            left, gram = left[~hit], gram[~hit]
            if not len(left):
                return out
            row, hit = _find(self.contexts[k][0], gram >> self.width)
            out[left[hit]] += self.contexts[k][1][row[hit]]
        out[left] += np.float32(-self.width * np.log(2))
        return out


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def _discounts(grams: DataFrame, classes: int, modified: bool) -> DataFrame:
    """(grp, d): D1, D2 and D3+ of each class from its counts of counts (four numbers per group and class)."""
    ask = [F.sum((F.col("a")[c] == r).cast("bigint")) for c in range(classes) for r in (1, 2, 3, 4)]
    found = []
    for grp, *seen in grams.groupBy("grp").agg(*ask).collect():  # one row per group
        out = []
        for c in range(classes):
            n1, n2, n3, n4 = (x or 0 for x in seen[4 * c : 4 * c + 4])
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            each = [y, y, y]
            if modified and n1 and n2 and n3:
                each = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            out.append([min(max(d, 0.1), r - 0.1) for r, d in enumerate(each, 1)])
        found.append((grp, out))
    return grams.sparkSession.createDataFrame(found, "grp int, d array<array<double>>")


def _arrays(table: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, v: array of logarithms) as arrays sorted by code."""
    got = table.select("code", *[F.col("v")[c].cast("float").alias(f"v{c}") for c in range(classes)]).toArrow()
    key = got.column(0).to_numpy()
    rank = np.argsort(key)
    matrix = np.empty((len(key), classes), np.float32)
    for c in range(classes):
        matrix[:, c] = got.column(c + 1).to_numpy()[rank]
    return key[rank], matrix


def tables(
    grams: DataFrame, classes: int, order: int, width: int = 12, modified: bool = False, shared_orders: int = 0, scratch: Scratch | None = None
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """grams(grp, code, a: count per class) to (k, grams, contexts) of each order from 1, both (grp, code, v: logarithm per class).

    Groups share nothing. Orders up to ``shared_orders`` are pooled over the classes. The tables lie in ``scratch``,
    if there is one, and counts go from it once they have been used, ``grams`` too.
    """
    keep = scratch.keep if scratch else stash
    counted = {order: grams}
    for k in range(order - 1, 0, -1):
        # how many different symbols come before the shorter gram
        if k <= shared_orders:
            ext = [F.sum(F.lit(1.0))] * classes
        else:
            ext = [F.sum((F.col("a")[c] > 0).cast("double")) for c in range(classes)]
        short = F.col("code").bitwiseAND(F.lit((1 << (width * k)) - 1)).alias("code")
        counted[k] = keep(counted[k + 1].groupBy("grp", short).agg(F.array(*ext).alias("a")), "grams")
    lower = None
    logs = lambda name: F.array(*[F.log(F.greatest(F.col(name)[c], F.lit(1e-30))).cast("float") for c in range(classes)])
    for k in range(1, order + 1):
        a = lambda c: F.col("a")[c]
        d = lambda c, r: F.col("d")[c][r]
        off = lambda c: F.when(a(c) >= 3, d(c, 2)).when(a(c) >= 2, d(c, 1)).when(a(c) >= 1, d(c, 0)).otherwise(0.0)  # noqa: E731, B023
        coded = counted[k].withColumn("ctx", F.shiftright("code", width)).join(F.broadcast(_discounts(counted[k], classes, modified)), "grp")
        context = coded.groupBy("grp", "ctx").agg(
            F.array(*[F.sum(a(c)) for c in range(classes)]).alias("total"),
            F.array(*[F.sum(off(c)) for c in range(classes)]).alias("freed"),
        )
        weight = [F.when(F.col("total")[c] > 0, F.col("freed")[c] / F.col("total")[c]).otherwise(1.0) for c in range(classes)]
        context = keep(context.select("grp", "ctx", "total", F.array(*weight).alias("weight")), "contexts")
        joined = coded.join(context, ["grp", "ctx"])
        if lower is None:
            joined = joined.withColumn("q", F.array(*[F.lit(0.5**width)] * classes))
        else:
            joined = joined.withColumn("short", F.col("code").bitwiseAND(F.lit((1 << (width * (k - 1))) - 1)))
            joined = joined.join(lower.select("grp", F.col("code").alias("short"), F.col("p").alias("q")), ["grp", "short"])
        p = [
            F.when(F.col("total")[c] > 0, (a(c) - off(c)) / F.col("total")[c]).otherwise(0.0) + F.col("weight")[c] * F.col("q")[c]
            for c in range(classes)
        ]
        lower = keep(joined.select("grp", "code", F.array(*p).alias("p")), "probabilities")
        if scratch:
            scratch.drop(counted[k])
        yield k, lower.select("grp", "code", logs("p").alias("v")), context.select("grp", F.col("ctx").alias("code"), logs("weight").alias("v"))


def train(counts: DataFrame, classes: int, order: int, letters_only: bool, width: int = 12, modified: bool = False, shared_orders: int = 0) -> Model:
    """A model from gram_counts(). Orders up to ``shared_orders`` are pooled over the classes."""
    per = [F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).cast("double") for c in range(classes)]
    grams = stash(counts.groupBy("code").agg(F.array(*per).alias("a")).select(F.lit(0).alias("grp"), "code", "a"), "grams")
    model = Model(order, width, classes, letters_only, {}, {})
    for k, grams_k, contexts_k in tables(grams, classes, order, width, modified, shared_orders):
        model.grams[k], model.contexts[k] = _arrays(grams_k, classes), _arrays(contexts_k, classes)
    return model


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of each row's stretch of a vector or of the columns of a matrix."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]
