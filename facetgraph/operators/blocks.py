"""Block plumbing for operators whose result is defined over pairs of rows.

Rows are hashed into blocks of bounded size and each row is sent to the block pairs it takes part
in, so the pairs are formed by an equi-join key (left block, right block). The work of one task
is bounded by two blocks, whatever the keys look like, and a kernel multiplies the two blocks as
small dense matrices. Kernels reduce what they compute (pairs over a threshold, best partner,
sums per cluster) before anything leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1024
#: Blocks of a set until they would hold over MOST_ROWS each: so many times are its rows sent, however many they are.
BLOCKS, MOST_ROWS = 24, 1 << 16
STRIP = 256  # rows of a block that are multiplied at once


def block_count(rows: int, per_block: int = ROWS_PER_BLOCK) -> int:
    return max(1, math.ceil(rows / per_block))


def vector_blocks(rows: int) -> int:
    """Blocks of vectors for kernels that work strip by strip, in place of one small matrix."""
    return block_count(rows, min(MOST_ROWS, max(ROWS_PER_BLOCK, math.ceil(rows / BLOCKS))))


def _block(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def self_block_pairs(df: DataFrame, key: str, n: int) -> DataFrame:
    """Each row once per block pair (bl <= br) its block belongs to."""
    return (
        df.withColumn("b", _block(key, n))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("bl", F.least("b", "o"))
        .withColumn("br", F.greatest("b", "o"))
        .drop("o")
    )


def rectangle_blocks(left: DataFrame, right: DataFrame, key: str, n_left: int, n_right: int) -> DataFrame:
    """Left rows to all right blocks and the other way round; ``side`` tells them apart."""
    one = left.withColumn("bl", _block(key, n_left)).withColumn("br", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    two = right.withColumn("br", _block(key, n_right)).withColumn("bl", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    return one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Row-normalised matrix; a zero vector stays zero, so its cosine with anything is 0."""
    m = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def over_block_pairs(
    pairs: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, n: int
) -> DataFrame:
    """Run ``kernel(left, right, same)`` per block pair of :func:`self_block_pairs`."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bl, br = key
        left = pdf[pdf.b == bl]
        right = left if bl == br else pdf[pdf.b == br]
        return kernel(left, right, bl == br)

    return pairs.groupBy("bl", "br").applyInPandas(run, schema)
