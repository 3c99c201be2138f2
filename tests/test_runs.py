"""Tables of runs: merges, commits, retractions and resets."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.streaming.runs import RunTable

TYPES = {"source_file": T.StringType(), "key": T.StringType(), "day": T.IntegerType(), "line_no": T.LongType(), "n": T.LongType()}
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in TYPES.items()])


@pytest.fixture
def table(spark, tmp_path):
    return lambda fanout=3: RunTable(spark, str(tmp_path / "t"), SCHEMA, ["source_file", "key"], ["line_no"], ("day",), fanout)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def contents(table):
    return {(r["source_file"], r["key"]): (r["day"], r["line_no"], r["n"]) for r in table.newest().collect()}


def test_against_a_dictionary(spark, table):
    """Batches, retractions, a reset of a root and a compaction in any order give what a dictionary gives."""
    rng = random.Random(3)
    t, want = table(), {}
    assert t.newest().collect() == [] and t.newest().columns == ["source_file", "key", "day", "line_no", "n"]
    for step in range(14):
        rows = [(f"{'ab'[rng.randrange(2)]}/{rng.randrange(4)}", f"k{rng.randrange(6)}", rng.randrange(3), line, step * 100 + line) for line in range(rng.randrange(0, 9))]
        t.append(frame(spark, rows))
        want.update({(f, k): (d, line, n) for f, k, d, line, n in rows})
        if step in (4, 9):
            live = {f"{x}/{rng.randrange(4)}" for x in "ab"}
            t.retract(spark.createDataFrame([(f,) for f in live], "source_file string"))
            want = {k: v for k, v in want.items() if k[0] in live}
        if step == 7:
            t.reset("a/")
            want = {k: v for k, v in want.items() if not k[0].startswith("a/")}
        assert contents(t) == want, step
        assert len(t.manifest().runs) <= 6
    t.compact()
    now = t.manifest()
    assert contents(t) == want and len(now.runs) == 1 and not now.gone and not now.roots
    assert t.rows().count() == len(want)
    t.vacuum(kept=1)
    assert contents(t) == want
    t.reset()
    assert contents(t) == {}


def test_number_of_runs_is_logarithmic(spark, table):
    t = table(4)
    merged = []
    t._write = lambda rows, name: merged.append(name)  # the bookkeeping alone
    t._read = lambda *_: spark.range(0).withColumn("version", F.lit(0)).withColumns({f.name: F.lit(None) for f in SCHEMA.fields})
    for k in range(200):
        t.append(frame(spark, []), "s", k)
    runs = t.manifest().runs
    assert len(runs) <= 3 * 4 and len(merged) < 200 * 1.5
    assert sorted(r[2] for r in runs)[0] == 1 and t.committed("s") == 199


def test_batches_run_again_change_nothing(spark, table):
    t = table()
    assert t.append(frame(spark, [("f", "k", 1, 1, 1)]), "s", 0)
    assert not t.append(frame(spark, [("f", "k", 1, 1, 2)]), "s", 0)
    assert t.append(frame(spark, [("g", "k", 1, 1, 3)]), "other", 0)
    assert contents(t) == {("f", "k"): (1, 1, 1), ("g", "k"): (1, 1, 3)} and t.committed("s") == 0 and t.committed("none") == -1


def test_uncommitted_runs_are_not_seen_and_are_written_over(spark, table, monkeypatch):
    t = table()
    t.append(frame(spark, [("f", "k", 1, 1, 1)]), "s", 0)

    def lost(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(RunTable, "_commit", lost)
        with pytest.raises(OSError):
            t.append(frame(spark, [("f", "k", 1, 2, 2), ("h", "k", 1, 1, 9)]), "s", 1)
    assert contents(t) == {("f", "k"): (1, 1, 1)}
    t.append(frame(spark, [("f", "k", 1, 2, 2)]), "s", 1)
    assert contents(t) == {("f", "k"): (1, 2, 2)}


def test_two_writers_cannot_commit_one_version(spark, table):
    a, b = table(), table()
    now = b.manifest()
    now.version += 1
    a.append(frame(spark, [("f", "k", 1, 1, 1)]))
    with pytest.raises(FileExistsError):
        b._commit(now)


def test_readers_keep_their_version(spark, table):
    t = table(2)
    t.append(frame(spark, [("f", "k", 1, 1, 1)]))
    before = t.newest()
    t.append(frame(spark, [("f", "k", 2, 2, 2)]))
    assert [r["n"] for r in before.collect()] == [1] and [r["n"] for r in t.newest().collect()] == [2]
