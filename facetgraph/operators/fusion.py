"""Learned view weights: spectral self-weighting and the L1 variant."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, release
from . import laplacian, views as vw
from .spectral import Basis, Stack, smallest_eigenvectors, stack_views, trace_losses

# Sharpness, iteration limit and tolerance of both generations.
SETTINGS = {
    "current": {"gamma": 0.5, "max_iter": 20, "tol": 1e-4, "keep_diagonal": False},
    "v4": {"gamma": 2.0, "max_iter": 50, "tol": 1e-6, "keep_diagonal": True},
}


def softmax_weights(losses: np.ndarray, gamma: float) -> np.ndarray:
    e = np.exp(-gamma * (losses - losses.min()))
    return e / e.sum()


@dataclass
class Fusion:
    names: list[str]
    weights: dict[str, float]
    history: list[tuple]
    basis: Basis
    stack: Stack

    def history_table(self, spark: SparkSession) -> DataFrame:
        """One row per iteration and view: (iteration, view, weight_before, weight, loss, step)."""
        schema = "iteration int, view string, weight_before double, weight double, loss double, step double"
        return spark.createDataFrame(self.history, schema)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.weights.items()), "view string, weight double")


def self_weighted(views: dict[str, DataFrame], entities: DataFrame, k: int, variant: str = "current", tol: float = 1e-5) -> Fusion:
    """Learn the view weights.

    From uniform weights: combine, take the k smallest eigenvectors, measure every view by its
    trace loss on them, and weight the views by the softmax of the negative losses, until the
    weights stand still. Each round starts from the vectors of the one before.
    """
    s = SETTINGS[variant]
    stack = stack_views(views, entities, keep_diagonal=s["keep_diagonal"])
    names = stack.names
    weights = np.full(len(names), 1 / len(names))
    history: list[tuple] = []
    basis: Basis | None = None
    for it in range(s["max_iter"]):
        before, basis = basis, smallest_eigenvectors(stack, weights, k, start=basis, tol=tol)
        if before is not None:
            release(before.rows)
        losses = trace_losses(stack, basis)
        updated = softmax_weights(losses, s["gamma"])
        step = float(np.linalg.norm(updated - weights))
        history += [(it, n, float(weights[v]), float(updated[v]), float(losses[v]), step) for v, n in enumerate(names)]
        weights = updated
        if step < s["tol"]:
            break
    return Fusion(names, dict(zip(names, weights.tolist())), history, basis, stack)


# --- L1 variant --------------------------------------------------------------------------------

# Mixing share, step of the attraction term and its slope.
L1_MIX, L1_PULL, L1_SLOPE = 0.7, 0.1, 10.0


def unit_range(view: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean-symmetrised, diagonal 1, clipped to [0, 1]."""
    sym = vw.with_diagonal(laplacian.symmetrise_mean(view), entities, 1.0)
    return sym.withColumn("w", F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)))


def _wide(views: list[DataFrame]) -> DataFrame:
    parts = [
        v.select("i", "j", *[(F.col("w") if u == n else F.lit(0.0)).alias(f"a{u}") for u in range(len(views))])
        for n, v in enumerate(views)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("i", "j").agg(*[F.sum(f"a{v}").alias(f"a{v}") for v in range(len(views))])


def l1_norms(cells: DataFrame, expressions: dict) -> dict[str, float]:
    """Largest column sum of absolute values of several cell expressions, in one pass."""
    columns = cells.groupBy("j").agg(*[F.sum(F.abs(e)).alias(n) for n, e in expressions.items()])
    return columns.agg(*[F.max(n).alias(n) for n in expressions]).first().asDict()


def l1_fusion(
    views: dict[str, DataFrame], entities: DataFrame, max_iter: int = 100, tol: float = 1e-6, cut_every: int = 5
) -> tuple[DataFrame, dict[str, float], list[tuple]]:
    """Self-weighted fusion by L1 distance; returns the fused cells, the weights and the history.

    Starts from the mean of the views. A cell outside all views stays zero, so the union of their
    cells is enough. The inputs are brought to symmetric form with unit diagonal first, which the
    update keeps, so a round is a per-cell expression plus the column sums behind the weights.
    """
    names = list(views)
    wide = _wide([unit_range(views[n], entities) for n in names])
    mean = sum((F.col(f"a{v}") for v in range(len(names))), F.lit(0.0)) / len(names)
    cells = cut(wide.withColumn("u", F.when(F.col("i") == F.col("j"), 1.0).otherwise(mean)))
    weights = np.full(len(names), 1 / len(names))
    history: list[tuple] = []
    gaps = l1_norms(cells, {n: F.col("u") - F.col(f"a{v}") for v, n in enumerate(names)})
    for it in range(max_iter):
        raw = np.array([1 / (2 * np.sqrt(gaps[n])) if gaps[n] > 1e-10 else 1.0 for n in names])
        weights = raw / raw.sum()
        pulled = sum(
            (F.lit(float(p)) * (F.col(f"a{v}") + L1_PULL * F.tanh((F.col("u") - F.col(f"a{v}")) * L1_SLOPE)) for v, p in enumerate(weights)),
            F.lit(0.0),
        )
        mixed = L1_MIX * pulled + (1 - L1_MIX) * F.col("u")
        moved = cells.withColumn("next", F.when(F.col("i") == F.col("j"), 1.0).otherwise(mixed))
        if (it + 1) % cut_every == 0:
            moved = cut(moved)
        # one pass: how far the cells moved, and the column sums that the next round starts from
        columns = moved.groupBy("j").agg(
            F.sum((F.col("next") - F.col("u")) ** 2).alias("moved"), *[F.sum(F.abs(F.col("next") - F.col(f"a{v}"))).alias(n) for v, n in enumerate(names)]
        )
        gaps = columns.agg(F.sqrt(F.sum("moved")).alias("moved"), *[F.max(n).alias(n) for n in names]).first().asDict()
        change = float(gaps["moved"] or 0.0)
        history.append((it + 1, change, *weights.tolist()))
        cells = moved.drop("u").withColumnRenamed("next", "u")
        if change < tol and it > 10:
            break
    return cells.select("i", "j", F.col("u").alias("w")), dict(zip(names, weights.tolist())), history


def matrix_norms(view: DataFrame, n: DataFrame) -> DataFrame:
    """L1 norm, Frobenius norm and mean of a view; ``n`` is the one-row table of its order (n)."""
    per = view.groupBy("j").agg(F.sum(F.abs("w")).alias("c"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    order = n.select("n").scalar()
    total = per.agg(F.max("c").alias("l1"), F.sqrt(F.sum("q")).alias("frobenius"), F.sum("s").alias("total")).withColumn("n", order)
    return total.select("l1", "frobenius", (F.col("total") / (F.col("n") * F.col("n"))).alias("mean"))


def expand(view: DataFrame, mapping: DataFrame, size: int, known: int, original: int) -> DataFrame:
    """Place a view (i, j, w) of ``original`` entities into ``size`` target positions.

    ``mapping`` has (i, position). Cells that stay zero are filled: 1 on the diagonal, the mean of
    the view times 0.7 between the first ``known`` positions and times 0.5 elsewhere. The result
    is the full grid by definition, built row by row from the positions.
    """
    view = cut(view)
    placed = view.join(mapping.select("i", F.col("position").alias("r")), "i").join(
        mapping.select(F.col("i").alias("j"), F.col("position").alias("c")), "j"
    ).filter("w <> 0").select("r", "c", "w")
    mean = view.agg((F.coalesce(F.sum("w"), F.lit(0.0)) / F.lit(float(original * original))).alias("m")).scalar()
    spark = view.sparkSession
    grid = spark.range(size).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("c"))
    known_pair = (F.col("r") < known) & (F.col("c") < known)
    fill = F.when(F.col("r") == F.col("c"), 1.0).otherwise(mean * F.when(known_pair, 0.7).otherwise(0.5))
    return grid.join(placed, ["r", "c"], "left").select("r", "c", F.coalesce("w", fill).alias("w"))


@dataclass
class Placed:
    """A view at its places in a larger space, as sparse cells and constants; the grid is never formed.

    Cells (r, c, w) that are not there are 1 on the diagonal, ``near`` between the first ``known``
    places and ``far`` elsewhere.
    """

    cells: DataFrame
    near: float
    far: float
    size: int
    known: int

    def _fill(self) -> Column:
        inside = (F.col("r") < self.known) & (F.col("c") < self.known)
        return F.when(F.col("r") == F.col("c"), 1.0).when(inside, self.near).otherwise(self.far)

    def _line(self, r: Column, value) -> Column:
        """Sum of ``value`` over a whole row of constants."""
        inner = value(self.near) * (self.known - 1) + value(self.far) * (self.size - self.known)
        return value(1.0) + F.when(r < self.known, inner).otherwise(value(self.far) * (self.size - 1))

    def _places(self) -> DataFrame:
        return self.cells.sparkSession.range(self.size).select(F.col("id").alias("r"))

    def degrees(self) -> DataFrame:
        """(r, degree): row sums of the whole matrix, its diagonal too."""
        extra = self.cells.groupBy("r").agg(F.sum(F.col("w") - self._fill()).alias("x"))
        whole = self._line(F.col("r"), float) + F.coalesce("x", F.lit(0.0))
        return self._places().join(extra, "r", "left").select("r", whole.alias("degree"))

    def norms(self) -> DataFrame:
        """L1 norm, Frobenius norm and mean of the whole matrix."""
        fill = self._fill()
        extra = self.cells.withColumn("f", fill).groupBy(F.col("c").alias("r")).agg(
            F.sum(F.abs("w") - F.abs("f")).alias("a"), F.sum(F.col("w") - F.col("f")).alias("s"), F.sum(F.col("w") ** 2 - F.col("f") ** 2).alias("q")
        )
        per = self._places().join(extra, "r", "left").na.fill(0.0, ["a", "s", "q"])
        r = F.col("r")
        total = per.agg(
            F.max(F.col("a") + self._line(r, abs)).alias("l1"),
            F.sqrt(F.sum(F.col("q") + self._line(r, lambda x: x * x))).alias("frobenius"),
            (F.sum(F.col("s") + self._line(r, float)) / (float(self.size) ** 2)).alias("mean"),
        )
        return total

    def times(self, vector: DataFrame) -> DataFrame:
        """(r, y): the matrix times a vector (r, x) that has all places."""
        sums = vector.agg(F.sum("x").alias("all"), F.sum(F.when(F.col("r") < self.known, F.col("x")).otherwise(0.0)).alias("known")).first()
        extra = self.cells.withColumn("d", F.col("w") - self._fill()).join(vector.select(F.col("r").alias("c"), "x"), "c")
        extra = extra.groupBy("r").agg(F.sum(F.col("d") * F.col("x")).alias("e"))
        inside = F.col("r") < self.known
        block = F.lit(self.far * sums["all"]) + F.when(inside, (self.near - self.far) * sums["known"]).otherwise(0.0)
        own = F.when(inside, 1.0 - self.near).otherwise(1.0 - self.far) * F.col("x")
        return vector.join(extra, "r", "left").select("r", (block + own + F.coalesce("e", F.lit(0.0))).alias("y"))


def place(view: DataFrame, mapping: DataFrame, size: int, known: int, original: int) -> Placed:
    """:func:`expand` without the grid: linear in the cells of the view and in the places."""
    view = cut(view)
    cells = view.join(mapping.select("i", F.col("position").alias("r")), "i").join(
        mapping.select(F.col("i").alias("j"), F.col("position").alias("c")), "j"
    ).filter("w <> 0").select("r", "c", "w")
    mean = float(view.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]) / (original * original)
    return Placed(cells, mean * 0.7, mean * 0.5, size, known)
