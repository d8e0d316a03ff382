"""Language identification by Kneser-Ney character models, one per language.

A text goes to the language of the lowest cross-entropy per character. Rejection is calibrated on
labelled texts that the counts leave out (one in CALIBRATION by the hash of the text): for each
language they give the mean cross-entropy, its spread between texts and its spread per character, and
a text is rejected if it lies more than ``z_max`` such deviations above the mean. They also choose the
temperature that turns cross-entropies into the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without
labelled texts everything is; a tie goes to the language that is first by name; rows with a null
language teach nothing; repeated rows count as often as they stand; other columns pass through.
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

UNKNOWN = "und"
CALIBRATION = 16
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


@dataclass
class Identifier:
    languages: list[str]
    model: kn.Model | None
    mean: np.ndarray
    spread: np.ndarray  # variance between texts
    grain: np.ndarray  # variance per character
    temperature: float
    z_max: float


def entropies(model: kn.Model, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, cross-entropy per class and mean squared log-probability per class of each row."""
    _, begins, codes = model.codes(data, starts)
    logs = model.log_probabilities(codes)
    n = np.diff(begins)
    some = np.maximum(n, 1)[:, None]
    return n, -kn.row_sums(logs, begins) / some, kn.row_sums(logs * logs, begins) / some


def fit(train: DataFrame, order: int = 4, z_max: float = 6.0) -> Identifier:
    """train(text, lang) to an identifier. Every text counts, but for the calibration share."""
    train = train.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages = sorted(r[0] for r in train.select("lang").distinct().collect())
    none = np.zeros(0)
    if not languages:
        return Identifier([], None, none, none, none, 1.0, z_max)
    numbers = F.create_map(*[x for k, name in enumerate(languages) for x in (F.lit(name), F.lit(k))])
    share = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    known = train.select(numbers[F.col("lang")].alias("cls"), "text")
    model = kn.train(kn.gram_counts(known.filter(~share), order, True), len(languages), order, True)
    shipped = train.sparkSession.sparkContext.broadcast(model)
    count = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, starts in text_runs(batch, "text", kn.RUN_BYTES):
                n, ce, square = entropies(shipped.value, data, starts)
                ok = np.flatnonzero(n > 0)
                own = cls[i:j][ok]
                columns = [own, n[ok], ce[ok, own], square[ok, own], _log_posterior(ce[ok], own)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in columns[:4]], pa.array(list(columns[4]), pa.list_(pa.float64()))], ["cls", "n", "ce", "square", "fit"])

    seen = mapped(known.filter(share), run, "cls int, n bigint, ce double, square double, fit array<double>")
    n, ce = F.col("n"), F.col("ce")
    fits = [F.sum(F.col("fit")[k]).alias(f"t{k}") for k in range(len(TEMPERATURES))]
    rows = seen.groupBy("cls").agg(
        (F.sum(n * ce) / F.sum("n")).alias("mean"), F.variance(F.when(n >= 200, ce)).alias("spread"), (F.sum(n * F.col("square")) / F.sum("n")).alias("square"), *fits
    ).collect()  # one row per language
    mean, spread, grain = np.full(count, 3.0), np.full(count, 0.25), np.full(count, 9.0)
    total = np.zeros(len(TEMPERATURES))
    for r in rows:
        mean[r.cls] = r["mean"]
        spread[r.cls] = max(r["spread"] or 0.0, 1e-2)
        grain[r.cls] = max(r["square"] - r["mean"] ** 2, 1e-3)
        total += [r[f"t{k}"] for k in range(len(TEMPERATURES))]
    return Identifier(languages, model, mean, spread, grain, TEMPERATURES[int(np.argmax(total))], z_max)


def _log_posterior(ce: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log-posterior of the true class at each temperature."""
    out = []
    for t in TEMPERATURES:
        x = -t * (ce - ce.min(axis=1, keepdims=True)) if len(ce) else ce
        out.append(x[np.arange(len(ce)), own] - np.log(np.exp(x).sum(axis=1)))
    return np.stack(out, axis=1)


def identify(docs: DataFrame, fitted: Identifier) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for i, j, data, starts in text_runs(batch, "text", kn.RUN_BYTES):
                if known.model is None:
                    n = np.zeros(j - i, np.int64)
                    best, ce, score, low = n, n * 0.0, n * 0.0, n * 0.0
                    names_of = np.array([UNKNOWN])
                    bad = n == 0
                else:
                    n, all_ce, _ = entropies(known.model, data, starts)
                    best = all_ce.argmin(axis=1)
                    low = all_ce[np.arange(len(best)), best]
                    score = 1.0 / np.exp(-known.temperature * (all_ce - low[:, None])).sum(axis=1)
                    z = (low - known.mean[best]) / np.sqrt(known.spread[best] + known.grain[best] / np.maximum(n, 1))
                    names_of = np.array(known.languages, object)
                    bad = (n == 0) | (z > known.z_max)
                lang = names_of[best].astype(object)
                lang[n == 0] = UNKNOWN
                score = np.where(n == 0, 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in batch.columns], pa.array(lang, pa.string()), pa.array(score), pa.array(low, mask=n == 0), pa.array(bad)],
                    [*batch.schema.names, *names],
                )

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return mapped(docs, run, schema)


def accepted(docs: DataFrame, **settings) -> DataFrame:
    """The documents that are not rejected, with the identified language."""
    found = identify(docs, fit(docs, **settings)).filter(~F.col("rejected"))
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])
