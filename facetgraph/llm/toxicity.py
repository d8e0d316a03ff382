"""Toxicity by class-conditional Kneser-Ney models over characters.

The toxic and the ordinary labelled texts give one model each; the short grams to which both back off
are counted over both classes together, so an expression that neither has seen weighs nothing. Every
whole text is read by both, and six numbers describe it: the length-normalised difference of the two
log-likelihoods, the difference of its most toxic word and of its three most toxic ones together, both
also for the first STEM letters of words alone (endings add noise), and its length. A logistic function of these gives the score; it is fitted on labelled texts that the counts
leave out (a share of one in HELD by the hash of the text), at most ``fit_rows`` of them.

Defined results: a null text or one without a letter scores as an empty one, with all differences
zero; without labels of both classes every score is 0; rows of labels with a null label teach
nothing; repeated rows count as often as they stand; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kneser_ney as kn
from .arrow import text_runs
from .shared import mapped

HELD = 8
FEATURES = 6
STEM = 5


@dataclass
class Judge:
    model: kn.Model | None
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-x))


def describe(model: kn.Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of each row: mean, word, three words, length, stem, three stems."""
    s, begins, codes = model.codes(data, starts)
    rows = len(starts) - 1
    out = np.zeros((rows, FEATURES))
    n = np.diff(begins)
    out[:, 3] = np.log1p(n)
    if not len(s):
        return out
    logs = model.log_probabilities(codes)
    d = logs[:, 1].astype(np.float64) - logs[:, 0]
    out[:, 0] = kn.row_sums(d, begins) / np.maximum(n, 1)
    head = np.zeros(len(s), bool)
    head[begins[:-1][n > 0]] = True
    head[1:] |= s[:-1] == 0  # a word takes the boundary behind it
    word = np.flatnonzero(head)
    end = np.append(word[1:], len(s))
    sums = np.concatenate(([0.0], np.cumsum(d)))
    row = np.searchsorted(begins, word, "right") - 1
    first = np.searchsorted(row, np.arange(rows))
    count = np.bincount(row, minlength=rows)
    for column, stop in ((1, end), (4, np.minimum(end, word + STEM))):
        total = sums[stop] - sums[word]
        total = total[np.lexsort((-total, row))]
        for k in range(3):
            ok = count > k
            best = np.maximum(total[first[ok] + k], 0)
            if k == 0:
                out[ok, column] = best
            out[ok, column + 1] += best
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _described(texts: DataFrame, model: kn.Model) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in text_runs(batch, "text", kn.RUN_BYTES):
                features = describe(shipped.value, data, starts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(features), pa.list_(pa.float64()))], ["cls", "features"])

    return mapped(texts.select("cls", "text"), run, "cls int, features array<double>")


def fit(labelled: DataFrame, order: int = 5, width: int = 12, shared_orders: int = 3, fit_rows: int = 20_000) -> Judge:
    """labelled(text, toxic 0/1) to a judge. All labelled texts count; ``fit_rows`` bounds the logistic fit."""
    known = labelled.filter(F.col("toxic").isin(0, 1)).select(F.col("toxic").cast("int").alias("cls"), F.coalesce("text", F.lit("")).alias("text"))
    share = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    model = kn.train(kn.gram_counts(known.filter(~share), order, True, width), 2, order, True, width, shared_orders=shared_orders)
    held = known.filter(share)
    count = held.count()
    if count > fit_rows:
        held = held.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / count))
    rows = _described(held, model).limit(fit_rows).toArrow()
    y = rows.column(0).to_numpy().astype(float) if len(rows) else np.zeros(0)
    none = np.zeros(FEATURES)
    if not len(y) or y.min() == y.max():
        return Judge(None if not len(y) or y.max() == 0 else model, none, none + 1, np.array([0.0, 1.0, 0.0, 0.0, 1.0, 0.0, -4.0]))
    x = np.array(rows.column(1).to_pylist())
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Judge(model, centre, scale, _logistic(np.clip((x - centre) / scale, -8, 8), y))


def judge(docs: DataFrame, fitted: Judge) -> DataFrame:
    """docs with score, and the numbers behind it as ``evidence``."""
    docs = docs.drop("score", "evidence")
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in text_runs(batch, "text", kn.RUN_BYTES):
                if shipped.value.model is None:
                    features, score = np.zeros((j - i, FEATURES)), np.zeros(j - i)
                else:
                    features = describe(shipped.value.model, data, starts)
                    score = shipped.value.score(features)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in batch.columns], pa.array(score), pa.array(list(features), pa.list_(pa.float64()))],
                    [*batch.schema.names, "score", "evidence"],
                )

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.DoubleType()))])
    return mapped(docs, run, schema)
