"""Tables and folders that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Only where the session names none (single-machine runs, tests) a local one is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPARK_ARROW_ROWS = "10000"  # Spark's own default


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long rows: unless the session names another number, tasks get some megabytes of them at a time."""
    if spark.conf.get(ARROW_ROWS, SPARK_ARROW_ROWS) == SPARK_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, str(rows))


def row_key():
    """A number that names a row by its doc_id and text: rows equal in both have the same, also without an id."""
    from pyspark.sql import functions as F

    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside lose their shuffle files when they end, and not only when the driver happens to
    collect garbage. While a query runs they stay, so a lost executor costs what it always does."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a shared folder and read it back: lineage is cut, and a lost executor
    costs one read of the file. The folder goes with ``discard`` or at the end of the session, the shuffle
    files behind it as soon as it is written."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    _written[path] = df.sparkSession
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the folder behind a frame made by ``staged``; call it when nothing unevaluated reads it."""
    path = df._staged_path
    if _written.pop(path, None) is not None:
        delete_folder(df.sparkSession, path)


@contextlib.contextmanager
def only_kept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frames staged inside go at its end, but for those passed through the function it gives. What leaves it
    must read kept frames alone. For one thread at a time."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_path)
        return df

    yield keep
    for path in set(_written) - before - kept:
        delete_folder(_written.pop(path), path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_written.items()):
        try:
            delete_folder(spark, path)
        except Exception:  # the session has ended before this process
            return


def empty_text_if_null(name: str = "text"):
    from pyspark.sql import functions as F

    return F.coalesce(F.col(name), F.lit(""))
