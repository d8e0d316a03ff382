"""Reading tables and keeping intermediates in the shared folder of the session."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Spark drops the shuffle files of a write as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def own_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id, or for a row without one a very large number that follows from its text."""
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(1 << 62) + mark.bitwiseAND(F.lit((1 << 61) - 1)))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS rows: rows with whole texts are large."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCHES)) > BATCH_ROWS:
        conf.set(BATCHES, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written once and read back: later jobs neither repeat it nor depend on its executors."""
    spark = df.sparkSession
    path = path or folder(spark, name)
    with cleaned(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stashes of one computation; each goes when it is dropped, the others once the last one is written."""

    def __init__(self, spark: SparkSession, codec: str | None = None) -> None:
        self._spark = spark
        self._codec = codec
        self._kept: list[tuple[DataFrame, str]] = []
        self._tables: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = folder(self._spark, name)
        self._kept.append((stash(df, name, path, self._codec), path))
        return self._kept[-1][0]

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table of the warehouse with a bucket for each shuffle partition: what is grouped by ``key`` later needs no shuffle."""
        table_name = f"{name}_{uuid.uuid4().hex}"
        buckets = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table_name)
        self._tables.append(table_name)
        return self._spark.table(table_name)

    def drop(self, *frames: DataFrame) -> None:
        """Remove stashes that nothing will read again."""
        for frame in frames:
            for k, (kept, path) in enumerate(self._kept):
                if kept is frame:
                    self._remove(path)
                    del self._kept[k]
                    break

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """The result, written and read back; all that was kept before is removed, tables too."""
        out = stash(df, name)
        self.clear()
        return out

    def clear(self) -> None:
        """Remove all stashes and tables."""
        for _, path in self._kept:
            self._remove(path)
        for name in self._tables:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._kept.clear()
        self._tables.clear()

    def _remove(self, path: str) -> None:
        context = self._spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
