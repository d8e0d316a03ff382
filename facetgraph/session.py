"""Session settings and lineage cutting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "facetgraph") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's own setting always wins. Only a local session without one gets a temporary
    folder; on a cluster a missing setting is an error, since a machine-local folder would be
    lost together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="facetgraph-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


#: Rows that one task joins or sums at most, where their number is known.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in so many partitions that a task gets about ``TASK_ROWS`` of its ``rows``.

    The session's own number of partitions stays where it is enough; it may be fixed while the data grow.
    """
    wanted = -(-rows // TASK_ROWS)
    if wanted <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(wanted, *keys)


#: Spark drops the shuffle files of an action as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables that :func:`cut` and :func:`kept` have written, for :func:`release`.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    with cleaned(df.sparkSession):
        out = df.checkpoint(eager=True)
    _written[out] = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    return out


def kept(df: DataFrame) -> DataFrame:
    """:func:`cut` for tables with very many rows: in compressed columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the files of tables that :func:`cut` or :func:`kept` have written and nothing will read again."""
    for frame in frames:
        path = _written.pop(frame, None)
        if path is not None:
            context = frame.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
