"""Repeated byte strings by a logarithmic family of suffix arrays.

A batch of documents gets a suffix array: its distinct suffixes by the name of their first bytes, kept sorted
and bucketed by that name. The array is scanned together with those of the levels already there, where equal
names stand side by side, and then joins the levels. Before the next batch two of equal size merge into one of
the next, so a suffix is rewritten as often as the logarithm of the number of batches. Occurrences are kept
beside the levels as they were found and are looked up once, by the names that repeat.

Suffixes are sampled by content: of the starts of short grams inside each string of ``length`` bytes, the one
with the least hash. Equal strings choose the same start, so every repeated string meets its copies at a
sampled suffix, and only about 2 / (length - GRAM) of all suffixes are kept.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap, bytetext
from .storage import delete_folder, discard, row_key, shared_folder, short_batches, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 64
PLACE_BITS = 28
CLASS = 16  # strings compared at a time
FILTER_BITS = 27
BATCHES = 4


class ByteHasher(bytetext.Hasher):
    """Hashes of byte strings as they are."""

    def __init__(self):
        super().__init__(seed=2)
        self.values = bytetext.byte_values(2)

    def windows(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return bytetext.mix((sums[size:] - sums[:n]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def sampled_suffixes(hasher: ByteHasher, data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, at, low, high, key, whole) of each sampled suffix, places in bytes of ``data``.

    The suffix starts at ``at``; the strings that chose it start at ``low`` to ``high``. ``key`` names its first
    ``GRAM`` bytes and ``whole`` all bytes of those strings. Ties of the least hash go to the first.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = hasher.sums(data)
    names = hasher.windows(sums, GRAM)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    marked = (names & ~low_bits) | (np.arange(len(names), dtype=np.uint64) & low_bits)
    least = sliding_least(marked, length - GRAM + 1)[: n - length + 1]
    starts = np.arange(len(least))
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    starts = starts[starts + length <= end]
    at = starts + (((least[starts] & low_bits).astype(np.int64) - starts) & int(low_bits))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else none
    low, at = starts[first], at[first]
    high = starts[np.concatenate([first[1:], [len(starts)]]) - 1] if len(first) else none
    whole = bytetext.mix(hasher.spans(sums, low, high + length) + (at - low).astype(np.uint64))
    return np.searchsorted(bounds, low, "right") - 1, at, low, high, names[at], whole


SUFFIX = "key long, whole long, doc_id long, at int, left int, wide int"


def suffix_table(docs: DataFrame, length: int) -> DataFrame:
    names = [part.split()[0] for part in SUFFIX.split(", ")]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                text, at, low, high, key, whole = sampled_suffixes(hasher, data, bounds, length)
                if len(text):
                    start = bounds[text]
                    places = [x.astype(np.int32) for x in (at - start, at - low, high - low)]
                    made = (bytetext.signed(key), bytetext.signed(whole), ids[row:end][text], *places)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(sample, SUFFIX)


def combined(suffixes: DataFrame, *more) -> DataFrame:
    """Each distinct (key, whole) once, with its number of occurrences and the place of one. ``left`` and
    ``wide`` (how far before ``at`` its strings start, and how many more there are) follow from ``whole``."""
    place = (F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"), F.min("left").alias("left"), F.min("wide").alias("wide"))
    return suffixes.groupBy("key", "whole").agg(F.sum("n").alias("n"), *place, *more)


class SuffixIndex:
    """Suffix arrays of all batches added so far, in levels of geometrically growing size.

    Arrays are tables bucketed and sorted by ``key`` in a shared folder, so scans and merges of two need no
    shuffle. A level holds each distinct (key, whole) once, with its number of occurrences and one of them;
    these are counted before the shuffle, so a suffix of a third of all documents is no hot row group.
    ``doc_id`` of the documents added names a row; rows without one are left out.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, buckets: int | None = None):
        self.spark, self.length = spark, length
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = shared_folder(spark, "suffix-index")
        self.occurrences: list[DataFrame] = []  # one per batch: every sampled suffix
        self.levels: list[tuple[int, str]] = []  # largest first; the last two may be of equal size
        self.met: list[DataFrame] = []

    def _write(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folder(self.spark, f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> None:
        """Build the batch's suffix array, scan it against the levels, and put it beside them."""
        self._merge()
        self.occurrences.append(staged(suffix_table(docs, self.length), "suffix-occurrences"))
        distinct = combined(self.occurrences[-1].withColumn("n", F.lit(1).cast("long")))
        fresh = self._write(distinct.repartition(self.buckets, "key"))
        self._scan(fresh)
        self.levels.append((0, fresh))

    def _merge(self) -> None:
        """Merge levels of equal size, which a batch leaves behind, into one of the next."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (level, one), (_, other) = self.levels.pop(), self.levels.pop()
            both = self.spark.table(one).unionByName(self.spark.table(other))
            self.levels.append((level + 1, self._write(combined(both))))
            self._drop(one)
            self._drop(other)

    def _scan(self, fresh: str) -> None:
        """Keep the suffixes whose name the batch has, if the name occurs more than once in all."""
        rows = self.spark.table(fresh).withColumn("new", F.lit(True))
        for _, name in self.levels:
            rows = rows.unionByName(self.spark.table(name).withColumn("new", F.lit(False)))
        names = rows.groupBy("key").agg(F.sum("n").alias("all"), F.max("new").alias("new")).where("`all` > 1 and new").select("key")
        self.met.append(staged(combined(rows.drop("new").join(names, "key", "left_semi")), "suffix-matches"))

    def seal(self) -> None:
        """No more batches follow: the levels, which only new batches are scanned against, are dropped."""
        while self.levels:
            self._drop(self.levels.pop()[1])

    def repeats(self, docs: DataFrame) -> DataFrame:
        """``doc_id, spans``: the strings of ``length`` bytes that occur more than once, as byte ranges.

        A stretch that occurs whole more than once is repeated whole. Where different stretches meet at one
        name, one occurrence of each is read again and compared class by class. ``docs`` are all documents
        added.
        """
        met = self.met[0]
        for more in self.met[1:]:
            met = met.unionByName(more)
        met = staged(combined(met, F.max("n").alias("most")).drop("n"), "suffix-distinct")
        while self.met:
            discard(self.met.pop())
        kinds = met.groupBy("key").agg(F.count("*").alias("kinds"))
        distinct, met = met, staged(met.join(kinds, "key").withColumn("stretch", F.monotonically_increasing_id()), "suffix-met")
        discard(distinct)
        partial = met.where("kinds > 1").select("stretch", "doc_id", "at", "left", "wide")
        ranges = staged(repeated_offsets(docs, partial, self.length), "suffix-ranges")
        ranges_read, ranges = ranges, ranges.groupBy("stretch").agg(F.collect_list(F.struct("low", "high")).alias("offsets"))
        found = met.where("most > 1").select("key", "whole", F.lit(None).cast("array<struct<low:int,high:int>>").alias("offsets"))
        found = found.unionByName(met.where("most = 1").join(ranges, "stretch").select("key", "whole", "offsets"))
        found = staged(found, "suffix-found")
        everything = self.occurrences[0]
        for more in self.occurrences[1:]:
            everything = everything.unionByName(more)
        everything = bitmap.rows_with_keys(everything, found, "key", FILTER_BITS)
        spans = everything.join(found, ["key", "whole"]).select("doc_id", F.struct("at", "left", "wide", "offsets").alias("span"))
        spans = staged(spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "suffix-spans")
        for used in (met, ranges_read, found):
            discard(used)
        return spans

    def close(self) -> None:
        self.seal()
        while self.occurrences:
            discard(self.occurrences.pop())


def string_classes(docs: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """``stretch, class, core, around, before, after``: the strings of the stretches, ``CLASS`` at a time.

    A string starts ``offset`` bytes before its suffix; those with equal ``offset // CLASS`` are a class. All
    contain its ``core`` and lie in ``around``, which is ``CLASS - 1`` bytes longer on either side (``before``
    and ``after``, shorter at a text's ends). Both are named by hashes.
    """
    schema = "stretch long, class int, core long, around long, before binary, after binary"
    columns = [part.split()[0] for part in schema.split(", ")]
    flank = CLASS - 1

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(1)):
                lists = batch.column(2)[row:end]
                flat, each = lists.flatten(), lists.value_lengths().to_numpy()
                if len(data) < length or not len(flat):
                    continue
                field = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("stretch", "at", "left", "wide")}
                least = (field["left"] - field["wide"]) // CLASS
                count = field["left"] // CLASS - least + 1
                pick = np.repeat(np.arange(len(count)), count)
                kind = least[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
                start, stop = (np.repeat(b, each)[pick] for b in (bounds[:-1], bounds[1:]))
                place = start + field["at"][pick] - kind * CLASS
                fits = np.flatnonzero((place >= start) & (place + length - flank <= stop))
                pick, kind, start, stop, place = (x[fits] for x in (pick, kind, start, stop, place))
                sums = hasher.sums(data)
                salt = kind.astype(np.uint64) * np.uint64(bytetext.STEP)
                core = bytetext.mix(hasher.spans(sums, place, place + length - flank) + salt)
                first, last = np.maximum(place - flank, start), np.minimum(place + length, stop)
                around = bytetext.mix(hasher.spans(sums, first, last) + salt + (place - first).astype(np.uint64) * np.uint64(bytetext.COMBINE))
                raw = data.tobytes()
                before = pa.array([raw[a:b] for a, b in zip(first.tolist(), place.tolist(), strict=True)], pa.binary())
                after = pa.array([raw[a:b] for a, b in zip((place + length - flank).tolist(), last.tolist(), strict=True)], pa.binary())
                made = (field["stretch"][pick], kind.astype(np.int32), bytetext.signed(core), bytetext.signed(around))
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), before, after], columns)

    per_doc = stretches.groupBy("doc_id").agg(F.collect_list(F.struct("stretch", "at", "left", "wide")).alias("parts"))
    per_doc = staged(per_doc, "suffix-stretches")
    texts = bitmap.rows_with_ids(docs, per_doc.select("doc_id"))
    found = staged(texts.join(per_doc, "doc_id").select("doc_id", "text", "parts").mapInArrow(classes, schema), "suffix-classes")
    discard(per_doc)
    return found


def repeated_offsets(docs: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """``stretch, low, high``: ranges of offsets whose strings occur in another stretch too.

    Where ``around`` is found again, the class is repeated whole. Where only the ``core`` is, one stretch for
    each ``around`` is taken and the strings of the class are told apart by the bytes beside the core. Groups
    are counted, not gathered.
    """
    flank = CLASS - 1
    classes = string_classes(docs, stretches, length)
    groups = classes.groupBy("core", "around").agg(F.count("*").alias("n"), F.min("stretch").alias("one"))
    open_ = groups.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("core")
    marked = staged(classes.join(groups, ["core", "around"]).join(open_.withColumn("open", F.lit(True)), "core", "left"), "suffix-groups")
    discard(classes)
    first = F.col("class") * CLASS
    whole = marked.where("n > 1").select(
        "stretch",
        (first + (F.lit(flank) - F.octet_length("after"))).alias("low"),
        (first + F.octet_length("before")).alias("high"),
    )
    reach = F.sequence(F.lit(flank) - F.octet_length("after"), F.octet_length("before"))
    apart = marked.where("stretch = one and octet_length(before) + octet_length(after) >= %d" % flank)
    apart = apart.where("open").select("*", F.explode(reach).alias("j"))
    left = F.expr("substring(before, octet_length(before) - j + 1, j)")
    right = F.expr(f"substring(after, 1, {flank} - j)")
    apart = staged(apart.select("stretch", "n", (first + F.col("j")).alias("offset"), F.xxhash64("core", "j", left, right).alias("name")), "suffix-strings")
    again = apart.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name")
    single = apart.where("n = 1").join(again, "name").select("stretch", F.col("offset").alias("low"), F.col("offset").alias("high"))
    return whole.where("low <= high").unionByName(single)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,stop:int>>"


def byte_ranges(spans, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of ``size`` bytes that the spans of a document cover."""
    starts, stops = [], []
    for span in spans:
        low = span["at"] - span["left"]
        if span["offsets"] is None:
            starts.append(low)
            stops.append(low + span["wide"] + length)
        else:
            starts += [span["at"] - o["high"] for o in span["offsets"]]
            stops += [span["at"] - o["low"] + length for o in span["offsets"]]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    starts, stops = np.array(starts, np.int64)[order], np.maximum.accumulate(np.array(stops, np.int64)[order])
    fresh = np.concatenate([[True], starts[1:] > stops[:-1]])
    ends = np.concatenate([stops[:-1][fresh[1:]], stops[-1:]])
    return np.minimum(starts[fresh], size), np.minimum(ends, size)


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """One row per document: what is left when every byte goes that a repeated string of ``length`` bytes covers.

    Texts are UTF-8 bytes; matches do not cross documents; overlapping copies in one document count; all
    copies go, judged on the input. Documents are added to a suffix index in ``batches`` parts by a hash of
    id and text. ``removed`` lists the maximal ranges.

    Null text is empty. Rows are judged each for itself by doc_id and text: without an id, or with one id and
    different texts, too. Rows equal in both are occurrences of each other. Empty table: no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    index = SuffixIndex(spark, length)
    keyed = docs.select(row_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("own_id"))
    part = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(batches))
    for b in range(batches):
        index.add(keyed.where(part == b))
    index.seal()
    spans = index.repeats(keyed)
    index.close()
    columns = [part.split()[0] for part in RESULT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*batch.columns, strict=True):
                doc_id, raw = doc_id.as_py(), text.as_py().encode()
                a, b = byte_ranges(found.as_py(), len(raw), length)
                kept, at = hashlib.sha256(), 0
                for start, stop in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(raw[at:start])
                    at = max(at, stop)
                kept.update(raw[at:])
                ranges = [{"start": s, "stop": e} for s, e in zip(a.tolist(), b.tolist(), strict=True) if s < e]
                out.append((doc_id, len(raw), int((b - a).sum()), len(ranges), kept.hexdigest(), ranges))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], columns)

    affected, others = bitmap.split_by_ids(keyed, spans.select("doc_id"), more=("own_id",))
    nothing = F.array().cast(spans.schema["spans"].dataType)
    joined = affected.join(spans, "doc_id", "left").select("own_id", "text", F.coalesce("spans", nothing).alias("spans"))
    return joined.unionByName(others.select("own_id", "text", nothing.alias("spans"))).mapInArrow(cut, RESULT)
