"""Tables that grow by micro-batches, kept as a few sorted runs.

Every commit adds one immutable run. When a level holds ``fanout`` runs they are merged into one of the next level,
without superseded rows, so that a reader opens a number of runs that grows with the logarithm of the commits, and
a row is rewritten as often as there are levels. A manifest per commit lists the runs; readers take the newest
one, so they see a commit whole or not at all.

Rows go in two ways without a rewrite: a retraction adds the names of files that are gone, a reset a root below
which all is gone. Both hide what was committed before them and nothing later; merges leave hidden rows out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.sources.transcripts import keep_last_snapshot

FANOUT = 4
KEPT_MANIFESTS = 8


@dataclass
class Manifest:
    """What a table consists of after a commit. ``runs`` are (name, level, first version, version of writing),
    ``gone`` (folder of file names, version), ``roots`` (prefix, version), ``committed`` the last batch per
    stream."""

    version: int = 0
    runs: list[list] = field(default_factory=list)
    gone: list[list] = field(default_factory=list)
    roots: list[list] = field(default_factory=list)
    committed: dict[str, int] = field(default_factory=dict)


class Folder:
    """The few file operations that commits need, on any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that must not exist yet: it appears under its name only when it is complete."""
        if self._fs.exists(self._at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer has committed")
        hidden = self._at(f".{name}.tmp")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(hidden, self._at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer has committed")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class RunTable:
    """A table with one writer and any number of readers.

    ``key`` names a row, the copy of the last version (then of the greatest ``order``) counts; without a key every
    row counts. ``schema`` must
    have ``source_file``, by which rows are retracted. ``partitions`` are columns that runs are partitioned by.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], order: list[str], partitions: tuple[str, ...] = (), fanout: int = FANOUT
    ):
        self.spark, self.path, self.key, self.order, self.partitions, self.fanout = spark, path.rstrip("/"), key, order, list(partitions), fanout
        self.columns = [f.name for f in schema.fields]
        # Spark puts partition columns last when it reads them back.
        last = [f for name in self.partitions for f in schema.fields if f.name == name]
        first = [f for f in schema.fields if f.name not in self.partitions]
        self.schema = T.StructType([*first, T.StructField("version", T.LongType()), *last])
        self._manifests = Folder(spark, f"{self.path}/manifests")

    def manifest(self) -> Manifest:
        names = [n for n in self._manifests.names() if n.endswith(".json") and not n.startswith(".")]
        return Manifest(**json.loads(self._manifests.read(max(names)))) if names else Manifest()

    def committed(self, stream: str) -> int:
        """Number of the last batch of a stream that is in the table; below 0 where there is none."""
        return self.manifest().committed.get(stream, -1)

    # --- reading

    def _read(self, manifest: Manifest, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        # The folder of runs is the base, so that each run is a partition of one table for the reader.
        reader = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("run", T.StringType())])).option("basePath", f"{self.path}/runs")
        rows = reader.parquet(*[f"{self.path}/runs/{n}" for n in names]).drop("run")
        for prefix, version in manifest.roots:
            rows = rows.where(~(F.col("source_file").startswith(prefix) & (F.col("version") < version)))
        if manifest.gone:
            gone = self.spark.read.schema("source_file string, gone_at bigint").parquet(*[f"{self.path}/{n}" for n, _ in manifest.gone])
            gone = gone.groupBy("source_file").agg(F.max("gone_at").alias("gone_at"))
            rows = rows.join(gone, "source_file", "left")
            rows = rows.where(F.col("gone_at").isNull() | (F.col("version") >= F.col("gone_at"))).select(*[f.name for f in self.schema.fields])
        return rows

    def rows(self) -> DataFrame:
        """Every row that runs still hold, superseded copies included, with the ``version`` of its commit."""
        manifest = self.manifest()
        return self._read(manifest, [r[0] for r in manifest.runs])

    def newest(self) -> DataFrame:
        """One row per key. Copies are combined before the shuffle."""
        return self._last(self.rows()).select(*self.columns)

    def _last(self, rows: DataFrame) -> DataFrame:
        if not self.key:
            return rows
        position: Column = F.struct("version", *self.order)
        return keep_last_snapshot(rows.withColumn("__position", position), self.key, "__position").drop("__position")

    # --- writing

    def _write(self, rows: DataFrame, name: str) -> None:
        ordered = rows.sortWithinPartitions(*self.partitions, *[k for k in self.key or ["source_file"] if k not in self.partitions])
        ordered.write.mode("overwrite").partitionBy(*self.partitions).parquet(f"{self.path}/runs/{name}")

    def _commit(self, manifest: Manifest) -> None:
        self._manifests.create(f"{manifest.version:012d}.json", json.dumps(manifest.__dict__))

    def append(self, batch: DataFrame, stream: str = "", batch_id: int | None = None) -> bool:
        """Add a batch as one commit. A batch that a stream runs again after its commit changes nothing; what
        an earlier attempt left uncommitted is written over. Returns whether something was committed."""
        now = self.manifest()
        if batch_id is not None and now.committed.get(stream, -1) >= batch_id:
            return False
        now.version += 1
        name = f"run={now.version:012d}-0"
        self._write(batch.select(*self.columns).withColumn("version", F.lit(now.version).cast("bigint")), name)
        now.runs.append([name, 0, now.version, now.version])
        if batch_id is not None:
            now.committed[stream] = batch_id
        self._merge_full_levels(now)
        self._commit(now)
        return True

    def _merge_full_levels(self, now: Manifest) -> None:
        level = 0
        while len(full := [r for r in now.runs if r[1] == level]) >= self.fanout:
            self._merge(now, full, level + 1)
            level += 1

    def _merge(self, now: Manifest, runs: list[list], level: int) -> None:
        name = f"run={now.version:012d}-{level}"
        self._write(self._last(self._read(now, [r[0] for r in runs])), name)
        now.runs = [r for r in now.runs if r not in runs] + [[name, level, min(r[2] for r in runs), now.version]]
        # A retraction is done with once every run with older rows was written after it.
        open_since = lambda version: any(first < version > written for _, _, first, written in now.runs)
        now.gone = [g for g in now.gone if open_since(g[1])]
        now.roots = [r for r in now.roots if open_since(r[1])]

    def retract(self, live: DataFrame) -> None:
        """Hide the rows of files that ``live`` (``source_file``) no longer lists; only the column of names is
        read. A file that comes back later counts again from then on."""
        now = self.manifest()
        now.version += 1
        known = self._read(now, [r[0] for r in now.runs]).select("source_file").distinct()
        gone = known.join(live.select("source_file").distinct(), "source_file", "left_anti")
        name = f"gone-{now.version:012d}"
        gone.withColumn("gone_at", F.lit(now.version).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        now.gone.append([name, now.version])
        self._commit(now)

    def reset(self, prefix: str = "") -> None:
        """Hide all rows of files whose name starts with ``prefix``, and let their streams start anew."""
        now = self.manifest()
        now.version += 1
        if prefix:
            now.roots.append([prefix, now.version])
        else:
            now.runs, now.gone, now.roots, now.committed = [], [], [], {}
        self._commit(now)

    def compact(self) -> None:
        """Merge everything into one run; retractions are then part of it."""
        now = self.manifest()
        if now.runs:
            now.version += 1
            self._merge(now, list(now.runs), max(r[1] for r in now.runs) + 1)
            self._commit(now)

    def vacuum(self, kept: int = KEPT_MANIFESTS) -> None:
        """Delete manifests but the newest, and folders that none of these names. Readers of the deleted ones
        must have ended."""
        names = sorted(n for n in self._manifests.names() if n.endswith(".json") and not n.startswith("."))
        used = {entry[0] for n in names[-kept:] for m in [json.loads(self._manifests.read(n))] for entry in (*m["runs"], *m["gone"])}
        for n in names[:-kept]:
            self._manifests.delete(n)
        for folder, kind in ((Folder(self.spark, f"{self.path}/runs"), "run="), (Folder(self.spark, self.path), "gone-")):
            for n in folder.names():
                if n.startswith(kind) and n not in used:
                    folder.delete(n)
