"""One-to-one matching of two vector sets by mutual best partners (greedy matching)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import views


class _Side:
    """Free rows of one side and their queues: the best partners (i, j, w) each of them has left."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.select("i", "v")
        self.queue: DataFrame | None = None

    def refill(self, partners: DataFrame, length: int) -> None:
        """Rows whose partners in the queue are all taken ask the free partners anew."""
        hungry = self.rows if self.queue is None else cut(self.rows.join(self.queue.select("i").distinct(), "i", "left_anti"))
        if self.queue is not None and not hungry.limit(1).count():
            return
        asked = views.cosine_rectangle(hungry, partners, best=length)
        self.queue = cut(asked if self.queue is None else self.queue.unionByName(asked))

    def heads(self) -> DataFrame:
        """The best free partner of each row, the smallest of equals."""
        first = self.queue.groupBy("i").agg(F.min(F.struct((-F.col("w")).alias("w"), "j")).alias("t"))
        return first.select("i", F.col("t.j").alias("j"), (-F.col("t.w")).alias("w"))

    def drop(self, own: DataFrame, partners: DataFrame) -> None:
        self.rows = cut(self.rows.join(own, "i", "left_anti"))
        self.queue = cut(self.queue.join(own, "i", "left_anti").join(partners.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "w"))


def mutual_best(left: DataFrame, right: DataFrame, rounds: int | None = None, queue: int = 16) -> DataFrame:
    """Pairs (i, j, w, round): each is the other's best among those still free.

    Every row keeps a queue of its ``queue`` best partners. A round takes the pairs whose heads
    agree and strikes both from all queues; only rows whose queue has run empty are compared again,
    with the partners that are left, so that the work of a round falls with the free rows. Without
    ``rounds`` it runs until one side is used up. This equals taking the globally best free pair
    again and again; it need not reach the largest total similarity.
    """
    one, two = _Side(left), _Side(right)
    done: DataFrame | None = None
    r = 0
    while rounds is None or r < rounds:
        r += 1
        one.refill(two.rows, queue)
        two.refill(one.rows, queue)
        back = two.heads().select(F.col("i").alias("j"), F.col("j").alias("i"))
        agreed = cut(one.heads().join(back, ["i", "j"]).select("i", "j", "w", F.lit(r).alias("round")))
        if not agreed.limit(1).count():
            break
        done = agreed if done is None else done.unionByName(agreed)
        taken = agreed.select("i"), agreed.select(F.col("j").alias("i"))
        one.drop(*taken)
        two.drop(*reversed(taken))
    return done if done is not None else left.sparkSession.createDataFrame([], "i bigint, j bigint, w double, round int")
