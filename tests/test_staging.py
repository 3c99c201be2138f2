"""Frames that are written once: how the work of writing them is compiled."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import staging
from tallyforge.sources import event_logs
from tests_data import event


def test_wide_readers_are_cut_in_methods_that_get_compiled(spark, monkeypatch):
    """Two deliveries of a log: parsing runs under the bound, which is gone afterwards, and events count once."""
    before = spark.conf.get(staging.METHOD_LIMIT)
    seen, checkpoint = [], type(spark.range(1)).checkpoint

    def watched(self, eager=True):
        seen.append(int(spark.conf.get(staging.METHOD_LIMIT)))
        return checkpoint(self, eager)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", watched)
    rows = [event("request/header", 0, {"header": {"config": {"model": "m"}}}), *[event("assistant/message", n, {"usage": {"inputTokens": n}}) for n in (1, 2)]]
    lines = spark.createDataFrame(
        [("/logs/f1.jsonl", again, 10 * again + i, json.dumps(row)) for again in (0, 1) for i, row in enumerate(rows)],
        "source_file string, block bigint, pos bigint, value string",
    )
    usage = event_logs.event_usage(event_logs.keep_new_sequence(event_logs.event_records(lines)))
    assert seen == [staging.COMPILED_BYTES] and spark.conf.get(staging.METHOD_LIMIT) == before
    assert sorted((r.model, r.input_tokens) for r in usage.collect()) == [("m", 1), ("m", 2)]


def test_the_bound_goes_with_a_failed_write(spark):
    before = spark.conf.get(staging.METHOD_LIMIT)
    with pytest.raises(Exception):
        staging.cut(spark.range(1).select(F.raise_error(F.lit("lost"))))
    assert spark.conf.get(staging.METHOD_LIMIT) == before
