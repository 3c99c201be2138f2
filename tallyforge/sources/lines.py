"""Log files as rows of text that remember where they came from.

A lines frame has ``source_file``, ``block`` (where the file split starts), ``pos`` (grows within a block)
and ``value``. Big files stay splittable: a block is one input split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Directories never searched.
SKIPPED_DIRECTORIES = [
    "node_modules", ".git", ".hg", ".svn", "__pycache__", ".venv", "venv",
    "target", "dist", "build", "Cache", "cache", "tmp", "temp",
]

# Room for one part's bytes where a part number and a block start share one block number.
PART_SPACE = 1 << 40

# Begins the one line that stands for the rest of a file that cannot be read.
UNREADABLE = "\0unreadable: "

JSONL = "*.[jJ][sS][oO][nN][lL]"
TABLE_FILES = "*.{[dD][bB],[sS][qQ][lL][iI][tT][eE],[sS][qQ][lL][iI][tT][eE]3}"
COMPRESSED = "*.[jJ][sS][oO][nN][lL].{[zZ][sS][tT][dD],[zZ][sS][tT]}"


def plain_path(uri: Column) -> Column:
    """Path text of a file URI, escapes undone."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def root_folders(spark: SparkSession, root: str | list[str]) -> list[str]:
    """The folders (or files) that ``root`` names, as their file system names them, in the form of ``plain_path``.

    Relative paths and paths without a scheme are qualified by Hadoop as Spark's readers do it; a glob gives
    each path it matches.
    """
    found = set()
    for name in [root] if isinstance(root, str) else root:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        path = fs.makeQualified(path)
        matched = fs.globStatus(path) if set("{}[]*?\\") & set(name) else None
        paths = [path] if matched is None else [status.getPath() for status in matched]
        found.update(re.sub("^file:/+", "/", x.toString()).rstrip("/") for x in paths)
    return sorted(found)


def searched(path: Column, folders: list[str], max_depth: int | None = None) -> Column:
    """Is a file within the searched part of the tree below one of ``folders`` (see ``root_folders``)? The depth
    is bounded only on request."""
    levels: dict[int, list[str]] = {}
    for folder in folders:
        levels.setdefault(len(folder.split("/")), []).append(folder)
    parts = F.split(path, "/")
    within = F.lit(False)
    for level, names in levels.items():
        between = F.slice(parts, level + 1, F.greatest(F.size(parts) - (level + 1), F.lit(0)))
        kept = ~F.arrays_overlap(between, F.array(*map(F.lit, SKIPPED_DIRECTORIES)))
        if max_depth is not None:
            kept &= F.size(between) <= max_depth
        within |= F.substring_index(path, "/", level).isin(names) & kept
    return within


def list_usage_files(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """Log and table files below ``root``; contents are not read (the column is pruned)."""

    def listed(glob: str, kind: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        return files.load(root).select(
            plain_path(F.col("_metadata.file_path")).alias("source_file"), "length", "modificationTime", F.lit(kind).alias("kind")
        )

    both = listed(JSONL, "lines").unionByName(listed(TABLE_FILES, "table"))
    return both.where(searched(F.col("source_file"), root_folders(spark, root), max_depth)).orderBy("source_file")


def _text_columns() -> list[Column]:
    return [
        plain_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value"),
    ]


def scan_lines(
    spark: SparkSession,
    root: str | list[str],
    glob: str = JSONL,
    changed_since: str | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Text lines of all matching files below ``root`` (or several roots): the files that
    ``list_usage_files`` lists, by the same rule. A root is what Spark's readers take: a path or URI, relative
    to the default file system or not, or a glob.

    ``changed_since`` (ISO time) re-reads only files modified after it, for logs that still grow.
    """
    roots = [root] if isinstance(root, str) else root
    reader = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    reader = reader.option("lineSep", "\n")
    if changed_since is not None:
        reader = reader.option("modifiedAfter", changed_since)
    # Filtered before positions are given, so that Spark leaves files out without reading them.
    kept = searched(plain_path(F.col("_metadata.file_path")), root_folders(spark, root), max_depth)
    return reader.load(roots).where(kept).select(*_text_columns())


def number_lines(lines: DataFrame) -> DataFrame:
    """Replace ``pos`` by ``line_no`` (1 for a file's first line) and mark each file's last line.

    Only a table with one row per block is computed; lines are not sorted or windowed.
    """
    blocks = lines.groupBy("source_file", "block").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    along = Window.partitionBy("source_file").orderBy("block")
    extent = F.col("last_pos") - F.col("first_pos") + 1
    before = F.sum(extent).over(along.rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.select(
        "source_file",
        "block",
        (F.coalesce(before, F.lit(0)) - F.col("first_pos") + 1).alias("shift"),
        F.when(F.lead("block").over(along).isNull(), F.col("last_pos")).alias("end_pos"),
    )
    kept = [c for c in lines.columns if c not in ("source_file", "block", "pos")]
    return lines.join(placed, ["source_file", "block"]).select(
        "source_file",
        "block",
        (F.col("pos") + F.col("shift")).alias("line_no"),
        F.coalesce(F.col("pos") == F.col("end_pos"), F.lit(False)).alias("is_last"),
        *kept,
    )
