"""Cutting lineage and bounded hand-over between jobs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 20_000

# The JVM only ever interprets methods of more bytes than this.
METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A single-machine session that names none gets a folder of its own. On a cluster that would be a folder
    other machines do not see, so there a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextlib.contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside get no generated method that the JVM would not compile: where one would be longer,
    as with readers of many fields, Spark splits the work of each step into short ones."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's checkpoint folder and continue from there.

    Used before a frame is read by two branches: it avoids parsing text twice, and it freezes row
    positions, which a re-planned text scan does not promise.
    """
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    with compiled(spark):
        return df.checkpoint(eager=True)


def small_or_lazy(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> tuple[DataFrame, bool]:
    """Evaluate ``df`` if it has at most ``row_limit`` rows, so that it may be broadcast.

    Returns the frame and whether it was small. At most ``row_limit + 1`` rows reach the driver; a
    larger frame is handed back unevaluated and the caller joins it by shuffle.
    """
    rows = df.limit(row_limit + 1).collect()
    if len(rows) > row_limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def literal_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few constant rows, planned as an expression so that Spark knows they are few."""
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast after counting; a larger frame is joined the way Spark chooses."""
    df, small = small_or_lazy(df, row_limit)
    return F.broadcast(df) if small else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a job's own tables, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
