"""Lines of zstd files, read by ranges of frames.

A zstd file is a row of frames that decompress alone. Their lengths stand in frame and block headers, so one walk
over the headers, without decompressing, tells where frames start. Whole frames are put together to ranges of some
megabytes; each range is one task's work, however large its file is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.staging import cut
from tallyforge.sources.lines import COMPRESSED, UNREADABLE, plain_path, root_folders, searched

RANGE_BYTES = 8 << 20  # compressed bytes that make a range, if frames are shorter
MOST_TASKS = 100_000
WINDOW_BYTES = 4 << 20  # read at a time
BATCH_LINES = 8_192  # handed to the JVM at a time
LINES = "source_file string, block bigint, pos bigint, value string"
RANGES = "source_file string, uri string, block bigint, start bigint, size bigint"

# Fixed values of the published frame format (RFC 8878): magic numbers, and widths of header fields by flag.
FRAME_MAGIC, SKIPPABLE_MAGIC = 0xFD2FB528, 0x184D2A50
DICTIONARY_ID_BYTES, CONTENT_SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)
RLE_BLOCK = 1


class StoredFile:
    """A file of any store that Arrow opens, read at positions through one window."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
        self._file = store.open_input_file(path)
        self.length = self._file.size()
        self._at, self._window = 0, b""

    def read_at(self, at: int, n: int) -> bytes:
        if not (self._at <= at and at + n <= self._at + len(self._window)):
            self._file.seek(at)
            self._at, self._window = at, self._file.read(max(n, WINDOW_BYTES))
        return self._window[at - self._at : at - self._at + n]

    def close(self) -> None:
        self._file.close()


def frame_end(file: StoredFile, at: int) -> int | None:
    """Where the frame that starts at ``at`` ends by its headers; None where no frame starts."""
    magic = int.from_bytes(file.read_at(at, 4), "little")
    if magic & ~0xF == SKIPPABLE_MAGIC:
        return at + 8 + int.from_bytes(file.read_at(at + 4, 4), "little")
    if magic != FRAME_MAGIC:
        return None
    flags = file.read_at(at + 4, 1)
    if not flags:
        return None
    single, sized = flags[0] >> 5 & 1, CONTENT_SIZE_BYTES[flags[0] >> 6]
    at += 5 + (1 - single) + DICTIONARY_ID_BYTES[flags[0] & 3] + (sized or single)
    while len(header := file.read_at(at, 3)) == 3:
        block = int.from_bytes(header, "little")
        at += 3 + (1 if block >> 1 & 3 == RLE_BLOCK else block >> 3)
        if block & 1:
            return at + 4 * (flags[0] >> 2 & 1)
    return at


def file_ranges(file: StoredFile, range_bytes: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """Start and size of each range of whole frames, from the frame at ``start`` on. What is no frame, or one cut short, is a range of its own up
    to the file's end; its reader finds out what is wrong with it."""
    at = start
    while at < file.length:
        end = frame_end(file, at)
        if (end is None or end > file.length) and at > start:
            yield start, at - start
            start = at
        at = file.length if end is None else min(end, file.length)
        if at - start >= range_bytes or at == file.length:
            yield start, at - start
            start = at


class _Stretch:
    """Bytes of a stored file from ``start`` to ``end``, as a stream."""

    closed = False

    def __init__(self, file: StoredFile, start: int, end: int):
        self._file, self._at, self._end = file, start, end

    def read(self, n: int = -1) -> bytes:
        left = self._end - self._at
        data = self._file.read_at(self._at, left if n < 0 else min(n, left)) if left > 0 else b""
        self._at += len(data)
        return data

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        pass


def _decompressed(file: StoredFile, start: int, end: int) -> Iterator[bytes]:
    import pyarrow as pa

    if start >= end:
        return
    with pa.CompressedInputStream(pa.PythonFile(_Stretch(file, start, end), "r"), "zstd") as stream:
        while piece := stream.read(1 << 20):
            yield piece


def range_lines(file: StoredFile, start: int, size: int, first: bool) -> Iterator[bytes]:
    """The lines that start inside a range or right at its end. A range but the file's first skips to its first
    line end, since the line before belongs to the range before, which reads on to that end."""
    import pyarrow as pa

    open_line: list[bytes] | None = [] if first else None
    for piece in _decompressed(file, start, start + size):
        *ended, rest = piece.split(b"\n")
        for part in ended:
            if open_line is not None:
                yield b"".join([*open_line, part])
            open_line = []
        if open_line is not None:
            open_line.append(rest)
    if open_line is None:
        return
    try:
        for frame in file_ranges(file, 1, start + size):
            for piece in _decompressed(file, frame[0], sum(frame)):
                head, found, _ = piece.partition(b"\n")
                open_line.append(head)
                if found:
                    yield b"".join(open_line)
                    return
    except (OSError, pa.ArrowException):
        if any(open_line):  # else nothing of this range is lost
            raise
    if any(open_line):
        yield b"".join(open_line)


def _marked(file: StoredFile, start: int, size: int, first: bool) -> Iterator[str]:
    """Lines as text; where frames are broken one marked line follows what could be read of the range."""
    import pyarrow as pa

    try:
        for line in range_lines(file, start, size, first):
            yield line.decode("utf-8", "replace")
    except (OSError, pa.ArrowException) as problem:
        yield f"{UNREADABLE}{problem}"


def _ranges_of(range_bytes: int):
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in RANGES.split(", ")]
        for frame in frames:
            for source_file, uri in zip(frame["source_file"], frame["uri"]):
                file = StoredFile(uri)
                numbered = enumerate(file_ranges(file, range_bytes))
                while some := list(islice(numbered, BATCH_LINES)):
                    yield pd.DataFrame([(source_file, uri, n, *found) for n, found in some], columns=names)
                file.close()

    return walk


def _rows_of_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, str]]:
    """Ranges that follow one another in a file share the open file and its window."""
    now, file = None, None
    for frame in frames:
        for source_file, uri, block, start, size in frame.itertuples(index=False):
            if uri != now:
                if file is not None:
                    file.close()
                now, file = uri, StoredFile(uri)
            for n, line in enumerate(_marked(file, start, size, block == 0)):
                yield source_file, block, n, line
    if file is not None:
        file.close()


def _read_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in LINES.split(", ")]
    rows = _rows_of_ranges(frames)
    while some := list(islice(rows, BATCH_LINES)):
        yield pd.DataFrame(some, columns=names)


def opened_by_arrow(folders: list[str]) -> bool:
    """Can Python workers open these folders by themselves? Stores that only Spark reads they cannot."""
    import pyarrow as pa
    from pyarrow import fs

    try:
        for folder in folders:
            if not folder.startswith("/"):
                fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def frame_ranges(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index of all compressed files below ``root``: one row per range of frames. Headers are walked once, a
    file by one task, and the rows are kept in the checkpoint folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", COMPRESSED)
    path = F.col("_metadata.file_path")
    uri = F.when(path.startswith("file:"), plain_path(path)).otherwise(path)
    found = files.load(root).select(plain_path(path).alias("source_file"), uri.alias("uri"))
    found = found.where(searched(F.col("source_file"), root_folders(spark, root)))
    return cut(found.mapInPandas(_ranges_of(range_bytes), RANGES))


def frame_lines(ranges: DataFrame, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Lines of the indexed ranges. ``block`` is the number of the range in its file. Short ranges that follow one
    another are read by one task up to about ``RANGE_BYTES``, so tasks grow in number with the bytes, not with the
    ranges; there are at least two for each core while there are ranges for them."""
    found = ranges.agg(F.count(F.lit(1)), F.sum("size")).first()
    wanted = max(2 * ranges.sparkSession.sparkContext.defaultParallelism, -(-(found[1] or 0) // RANGE_BYTES))
    tasks = max(1, min(most_tasks, found[0], wanted))
    near = ranges.repartitionByRange(tasks, "source_file", "block").sortWithinPartitions("source_file", "block")
    return near.mapInPandas(_read_ranges, LINES)
