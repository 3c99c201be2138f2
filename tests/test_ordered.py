"""Chunked running values against a plain loop, and the counter and segment rules."""

import random

from pyspark.sql import functions as F

from tallyforge.plans.ordered import Count, First, Last, Max, final_values, running
from tallyforge.sources import rollouts


def _loop(rows):
    out, state = [], {}
    for key, pos, v in rows:
        s = state.setdefault(key, {"last": None, "prev": None, "first": None, "n": 0, "max": None})
        prev, high = s["prev"], s["max"]
        if v is not None:
            s["last"], s["prev"] = v, v
            s["first"] = v if s["first"] is None else s["first"]
            s["n"] += 1
            s["max"] = v if s["max"] is None else max(v, s["max"])
        out.append((key, pos, s["last"], prev, s["first"], s["n"], high))
    return sorted(out)


def _specs():
    v = F.col("v")
    return [Last("last", v), Last("prev", v, inclusive=False), First("first", v), Count("n", v.isNotNull()), Max("high", v)]


def _data(n, seed):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else "cold", i, rng.choice([None, None, rng.randrange(100)])) for i in range(n)]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "key string, pos bigint, v bigint")
    return df.withColumn("chunk", F.expr("pos div 7"))


COLUMNS = ["key", "pos", "last", "prev", "first", "n", "high"]


def test_running_equals_a_loop(spark):
    rows = _data(300, 1)
    got = running(_frame(spark, rows), ["key"], "chunk", ["pos"], _specs())
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == _loop(rows)


def test_state_continues_over_batches(spark):
    rows = _data(200, 2)
    first, second = _frame(spark, rows[:90]), _frame(spark, rows[90:])
    along = (["key"], "chunk", ["pos"])
    state = final_values(first, *along, _specs())
    parts = [running(first, *along, _specs()), running(second, *along, _specs(), state)]
    got = [tuple(r) for p in parts for r in p.select(*COLUMNS).collect()]
    assert sorted(got) == _loop(rows)
    whole = final_values(_frame(spark, rows), *along, _specs())
    later = final_values(second, *along, _specs(), state)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, later.collect()))


def test_counter_delta(spark):
    df = spark.createDataFrame([(100, None), (140, 100), (40, 100), (5, 5)], "c bigint, p bigint")
    got = [r[0] for r in df.select(rollouts.counter_delta(F.col("c"), F.col("p"))).collect()]
    assert got == [100, 40, 40, 0]


def test_request_window_bounds(spark):
    df = spark.createDataFrame([(0, 99), (0, 100), (0, 600_000), (0, 600_001), (50, 40), (None, 9)], "s bigint, e bigint")
    got = [r[0] for r in df.select(rollouts.accepted_duration(F.col("s"), F.col("e"))).collect()]
    assert got == [None, 100, 600_000, None, None, None]
