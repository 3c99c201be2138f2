"""Readers on real files."""

import json
import os

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.functions import caliber
from tallyforge.operators import aggs, quality
from tallyforge.schema import USAGE, with_ts_date
from tallyforge.sources import event_logs, lines, rollouts, tables, transcripts
from tests_data import T0, assistant, event, iso, usage_event

def total(usage):
    return usage.agg(F.sum(caliber.display_total())).first()[0]


# --- files and lines ---------------------------------------------------------------------------------


def test_listing_skips_folders(spark, log_dir):
    root = log_dir({
        "a/one.jsonl": ["{}"], "a/two.JSONL": ["{}"], "b/usage.db": ["x"], "b/usage.db-wal": ["x"], "c/notes.txt": ["x"],
        "node_modules/no.jsonl": ["{}"], "a/.git/no.jsonl": ["{}"], "with space+plus/three.jsonl": ["{}"],
        "1/2/3/4/5/6/7/8/deep.jsonl": ["{}"], "1/2/3/4/5/6/7/8/9/too-deep.jsonl": ["{}"],
    })
    def names(found):
        return sorted(r.source_file.removeprefix(root + "/") for r in found.select("source_file").distinct().collect())

    texts = ["1/2/3/4/5/6/7/8/deep.jsonl", "a/one.jsonl", "a/two.JSONL", "with space+plus/three.jsonl"]
    deep = "1/2/3/4/5/6/7/8/9/too-deep.jsonl"
    listed = lines.list_usage_files(spark, root)
    assert names(listed.where("kind = 'table'")) == ["b/usage.db"]
    assert names(listed.where("kind = 'lines'")) == names(lines.scan_lines(spark, root)) == sorted([deep, *texts])
    assert names(lines.list_usage_files(spark, root, 8).where("kind = 'lines'")) == texts
    assert names(lines.scan_lines(spark, root, max_depth=8)) == texts
    assert names(lines.scan_lines(spark, [f"{root}/a", f"{root}/1/2/3"])) == sorted([deep, texts[0], *texts[1:3]])


def test_roots_in_every_form(spark, log_dir):
    root = log_dir({
        "a/one.jsonl": ["{}"], "a/b/two.jsonl": ["{}"], "ab/three.jsonl": ["{}"], "a/tmp/no.jsonl": ["{}"], "c [d]/e%41.jsonl": ["{}"],
    })
    def names(found):
        return sorted(r.source_file.removeprefix(root + "/") for r in found.select("source_file").distinct().collect())

    here = os.path.relpath(root, spark._jvm.java.lang.System.getProperty("user.dir"))
    whole = ["a/b/two.jsonl", "a/one.jsonl", "ab/three.jsonl", "c [d]/e%41.jsonl"]
    for form in (root, f"{root}/", f"file:{root}", f"file://{root}", f"file://{root}/", here, f"{here}/"):
        assert names(lines.scan_lines(spark, form)) == names(lines.list_usage_files(spark, form)) == whole, form
        assert names(lines.scan_lines(spark, form, max_depth=1)) == [whole[1], *whole[2:]], form
    for form in (f"{root}/a*", f"file://{root}/{{a,ab}}", f"{here}/a*"):
        assert names(lines.scan_lines(spark, form)) == names(lines.list_usage_files(spark, form)) == whole[:3], form
        assert names(lines.scan_lines(spark, form, max_depth=0)) == whole[1:3], form
    assert names(lines.scan_lines(spark, [f"file://{root}/a", f"{here}/ab"])) == whole[:3]
    assert names(lines.scan_lines(spark, [f"{root}/a", f"{root}/a/tmp"])) == ["a/b/two.jsonl", "a/one.jsonl", "a/tmp/no.jsonl"]
    assert names(lines.scan_lines(spark, f"file://{root}/a/one.jsonl")) == ["a/one.jsonl"]


def test_line_numbers_survive_splitting(spark, log_dir):
    root = log_dir({"a.jsonl": [f"a{i:05d}" for i in range(3_000)], "b.jsonl": [f"b{i:05d}" for i in range(10)]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2_000)
    try:
        scanned = lines.scan_lines(spark, root)
        assert scanned.rdd.getNumPartitions() > 5
        rows = lines.number_lines(scanned).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3_010
    assert all(int(r.value[1:]) == r.line_no - 1 for r in rows)
    assert sorted(r.value for r in rows if r.is_last) == ["a02999", "b00009"]


# --- generic transcripts -----------------------------------------------------------------------------


def test_generic_dialects_and_rejects(spark, log_dir):
    stem = "11111111-2222-3333-4444-555555555555"
    root = log_dir({f"projects/my-app/{stem}.jsonl": [
        {"type": "assistant", "sessionId": "s9", "timestamp": iso(0), "message": {"model": "m1", "usage": {
            "input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 20}}},
        {"ts": 1_700_000_001, "model_name": "m2", "prompt_tokens": "7", "completion_tokens": 3.9,
         "completion_tokens_details": {"reasoning_tokens": 2}, "prompt_tokens_details": {"cached_tokens": 4}},
        {"usage": "not an object", "tokens": {"output_tokens": 1, "model": "inner"}, "time": T0},
        {"usage": {"input_tokens": None, "prompt_tokens": 6}, "model": 5, "timestamp": None, "ts": T0},
        {"type": "user", "message": {"content": "hello"}},
        {"usage": {"output_tokens": True}, "ts": T0},
        {"usage": {"input_tokens": 1}},
        "[1, 2]", '"text"', "{broken", "", "   ", '{"a": 1} {"b": 2}', "x" * (8 * 1024 * 1024 + 1),
        '{"half": ',
    ]})
    limit = 8 * 1024 * 1024
    usage, rejects = transcripts.read_jsonl_usage(lines.scan_lines(spark, root), max_line_bytes=limit)
    rows = {r.line_no: r for r in usage.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    unlimited = transcripts.read_jsonl_usage(lines.scan_lines(spark, root))[1]
    assert [r.reason for r in unlimited.where("line_no = 14").collect()] == ["not JSON"]
    assert usage.schema.fieldNames() == USAGE.fieldNames()
    assert (rows[1].session_id, rows[1].project, rows[1].model) == ("s9", "my-app", "m1")
    assert rows[2].session_id == stem and rows[2].ts_ms == 1_700_000_001_000
    assert (rows[2].input_tokens, rows[2].output_tokens, rows[2].reasoning_tokens, rows[2].cache_read_tokens) == (7, 3, 2, 4)
    assert (rows[3].model, rows[3].input_tokens) == ("inner", 0)
    assert (rows[4].model, rows[4].input_tokens) == ("unknown", 6)
    assert total(usage.where("line_no = 1")) == 135
    reasons = sorted((r.line_no, r.reason) for r in rejects.collect())
    assert reasons == [
        (7, "tokens without a timestamp"), (8, "not an object"), (9, "not an object"), (10, "not JSON"),
        (13, "not JSON"), (14, "oversized line"),
    ]
    audit = quality.ingest_audit(usage, rejects, lines.list_usage_files(spark, root))
    assert audit.files.select("records_read", "lines_skipped", "last_error").first() == (4, 6, "oversized line")
    assert audit.recent.count() == 3 and audit.untracked.first().untracked == 0


# --- rollouts ----------------------------------------------------------------------------------------


def item(ms, kind, role=None, text=None):
    payload = {"type": kind} | ({"role": role} if role else {})
    if text is not None:
        payload["content"] = [{"type": "image"}, {"type": "input_text", "text": text}]
    return {"timestamp": iso(ms), "type": "response_item", "payload": payload}


def context(model):
    return {"timestamp": iso(0), "type": "turn_context", "payload": {"model": model}}


def read_rollout(spark, log_dir, rows, name="rollout-x.jsonl"):
    usage, files = rollouts.read_cumulative_rollouts(lines.scan_lines(spark, log_dir({name: rows})))
    return usage.orderBy("line_no").collect(), files.first()


def test_each_counter_falls_by_itself(spark, log_dir):
    """Output starts over on the third line, input on the fourth; the sum of both never falls."""
    rows, _ = read_rollout(spark, log_dir, [
        usage_event(0, 700, input_tokens=620, output_tokens=80),
        usage_event(1, 815, input_tokens=700, output_tokens=115),
        usage_event(2, 960, input_tokens=951, output_tokens=9),
        usage_event(3, 972, input_tokens=33, output_tokens=9),
        usage_event(4, 972, input_tokens=61, output_tokens=30),
    ])
    assert [r.input_tokens for r in rows] == [620, 80, 251, 33, 28]
    assert [r.output_tokens for r in rows] == [80, 35, 9, 0, 21]
    assert [r.total_override for r in rows] == [700, 115, 145, 12, 0]


def test_contexts_stay_in_their_log(spark, log_dir):
    """A context names the model of the lines after it, in its own log; a name on the line itself goes before."""
    root = log_dir({
        "x.jsonl": [context("early"), usage_event(5, 3), usage_event(6, 4, model="own"), context(""), usage_event(7, 9)],
        "y.jsonl": [usage_event(5, 2), context("late"), context("later"), usage_event(8, 11)],
    })
    usage, _ = rollouts.read_cumulative_rollouts(lines.scan_lines(spark, root))
    got = sorted((r.source_file[-7:], r.line_no, r.model, r.total_override) for r in usage.collect())
    assert got == [
        ("x.jsonl", 2, "early", 3), ("x.jsonl", 3, "own", 1), ("x.jsonl", 5, "early", 5),
        ("y.jsonl", 1, "unknown", 2), ("y.jsonl", 4, "later", 9),
    ]


def test_request_durations(spark, log_dir):
    rows, _ = read_rollout(spark, log_dir, [
        item(0, "message", "user"), item(1_200, "reasoning"), item(4_350, "function_call"), usage_event(5_000, 1),
        item(6_100, "function_call_output"), item(6_400, "custom_tool_call_output"), item(7_720, "message", "assistant"),
        usage_event(8_000, 2),
        item(8_000, "local_shell_call_output"), item(8_040, "message", "assistant"), usage_event(8_050, 3),
        item(9_000, "reasoning"), usage_event(9_700, 4),
        item(10_000, "message", "user"), usage_event(13_300, 5),
        item(14_000, "message", "user"), item(14_000 + 600_001, "reasoning"), usage_event(14_000 + 600_002, 6),
    ])
    assert [r.duration_ms for r in rows] == [4_350, 1_620, None, None, 3_300, None]
    assert [r.duration_derived for r in rows] == [True, True, False, False, True, False]


def test_session_project_title(spark, log_dir):
    rows, facts = read_rollout(spark, log_dir, [
        usage_event(0, 1),
        {"type": "session_meta", "payload": {"id": "first", "cwd": "/w/one"}},
        item(1, "message", "user", "<environment>"), item(2, "message", "user", "  Fix the bug "),
        usage_event(3, 2),
        {"type": "session_meta", "payload": {"session_id": "second", "id": "x", "cwd": "/w/two"}},
        usage_event(4, 3), "not json", '{"no": "kind"}',
        {"timestamp": iso(5), "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": "9"}}}},
    ])
    assert [(r.session_id, r.project) for r in rows] == [("rollout-x", None), ("first", "/w/one"), ("second", "/w/one")]
    assert (facts.session_id, facts.title, facts.project_path) == ("second", "Fix the bug", "/w/one")


def test_rate_limits(spark, log_dir):
    def limits(ms, plan):
        row = usage_event(ms, 1)
        row["payload"]["rate_limits"] = {"plan_type": plan, "primary": {"used_percent": 12.5, "window_minutes": 300}}
        return row

    root = log_dir({"a.jsonl": [limits(5, "new"), limits(5, "newest"), limits(1, "old")]})
    row = rollouts.latest_rate_limits(rollouts.rollout_records(lines.scan_lines(spark, root))).first()
    assert (row.plan_type, row.primary.used_percent, row.primary.resets_at) == ("newest", 12.5, None)


# --- event logs --------------------------------------------------------------------------------------


EVENTS = [
    event("request/header", 0, {"header": {"config": {"provider": "p", "model": "deep"}, "cwd": "/w/z"}}),
    event("assistant/message", 1, {"usage": {
        "inputTokens": 731, "outputTokens": 218, "reasoningTokens": 57, "cacheReadTokens": 1302, "cacheWriteTokens": 66}}),
    {"event": event("model/selection", 2, {"selection": {"model": {"modelId": "picked"}}})},
    {"event": event("assistant/message", 3, {"usage": {"outputTokens": 13}})},
    event("tool/result", 4, {"usage": {"inputTokens": 999}}),
    {"type": "assistant/message", "time": T0, "data": {"usage": {"inputTokens": 4}}},
]


def test_event_log(spark, log_dir):
    usage, files = event_logs.read_event_logs(lines.scan_lines(spark, log_dir({"sessions/id1/log.jsonl": EVENTS})))
    rows = usage.orderBy("line_no").collect()
    assert [(r.model, r.total_override, r.reasoning_tokens) for r in rows] == [
        ("deep", 2317, 57), ("picked", 13, 0), ("picked", 4, 0)
    ]
    assert {r.session_id for r in rows} == {"id1"} and rows[0].project == "/w/z"
    assert usage.agg(F.sum(caliber.display_total())).first()[0] == 2334
    assert files.first().project_path == "/w/z"


def test_compressed_event_log(spark, tmp_path):
    def frame(rows):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "zstd") as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        return sink.getvalue().to_pybytes()

    folder = tmp_path / "x" / "id2"
    folder.mkdir(parents=True)
    # two frames in one file; the second repeats events of the first
    (folder / "log.jsonl.zstd").write_bytes(frame(EVENTS) + frame(EVENTS[:4] + [event("assistant/message", 9, {"usage": {"inputTokens": 3}})]))
    scanned = event_logs.scan_compressed_lines(spark, str(tmp_path / "x"))
    usage, _ = event_logs.read_compressed_event_logs(scanned)
    assert [(r.model, r.total_override) for r in usage.orderBy("line_no").collect()] == [
        ("deep", 2317), ("picked", 13), ("picked", 3)
    ]
    assert usage.first().session_id == "id2"


# --- assistant transcripts ---------------------------------------------------------------------------


def test_snapshots_keep_the_last_per_file(spark, log_dir):
    root = log_dir({
        "p/abc.jsonl": [
            {"type": "user", "cwd": "/w/a", "message": {"role": "user", "content": [{"type": "text", "text": "[Request interrupted by user]"}]}},
            {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": " Build it "}]}},
            {"type": "summary", "summary": "later"},
            assistant(0, "m1", 10, 1), assistant(1, "m1", 10, 5), assistant(2, "m1", 10, 300),
            assistant(3, "m2", 3, 110, sessionId="own", isSidechain=True),
            assistant(4, None, 0, 0, uuid="u"), assistant(5, None, 1, 0, uuid="u1"), assistant(6, None, 1, 0, uuid="u1"),
            {"type": "progress", "timestamp": iso(7), "usage": {"input_tokens": 50}},
        ],
        "p/copy.jsonl": [assistant(0, "m1", 10, 1)],
    })
    usage, files = transcripts.read_transcripts(lines.scan_lines(spark, root))
    mine = usage.where(F.col("source_file").endswith("abc.jsonl"))
    rows = {r.event_key: r for r in mine.collect()}
    assert sorted(rows) == ["m1", "m2", "u1"]
    assert rows["m1"].output_tokens == 300 and rows["m1"].project == "/w/a" and rows["m1"].session_id == "abc"
    assert rows["m2"].session_id == "own"
    assert total(mine) == 430 + 233 + 121
    # the same message in another file counts again
    assert total(usage) == 430 + 233 + 121 + 131
    facts = {r.source_file[-9:]: r for r in files.collect()}
    assert (facts["abc.jsonl"].title, facts["abc.jsonl"].session_id) == ("Build it", "abc")


# --- relational tables -------------------------------------------------------------------------------


def test_pick_and_map_table(spark):
    events = spark.createDataFrame(
        [(1_700_000_000, "m", "s", 10, 5, 3, None), (None, "m", "s", 1, 1, 1, 1), (1_700_000_001, None, "s", 1, 1, 1, 1),
         (1_700_000_002, "m", "s", None, None, 1, 1)],
        "request_timestamp bigint, model_name string, session_id string, prompt_tokens bigint, completion_tokens bigint, "
        "cached_tokens bigint, reasoning_tokens bigint",
    )
    notes = spark.createDataFrame([("x",)], "body string")
    half = spark.createDataFrame([(1, 2)], "input bigint, output bigint")
    assert tables.pick_usage_table({"notes": notes, "half": half, "usage_events": events}) == "usage_events"
    assert tables.pick_usage_table({"notes": notes}) is None
    row = tables.map_usage_table(events, source_file="db").collect()
    assert len(row) == 1 and row[0].ts_ms == 1_700_000_000_000
    assert (row[0].input_tokens, row[0].cache_read_tokens, row[0].reasoning_in_output) == (10, 3, False)


def test_source_total_marks_nested_reasoning(spark):
    df = spark.createDataFrame(
        [("k1", "2023-11-14T22:13:20Z", "m", 100, 50, 20, 150, "", 2.5)],
        "id string, started_at string, model_id string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, "
        "computed_total_tokens bigint, status string, duration_ms double",
    )
    row = tables.map_usage_table(df).first()
    assert (row.total_override, row.reasoning_in_output, row.status, row.duration_ms) == (150, True, None, None)
    assert row.event_key == "k1" and row.ts_ms == T0


def test_session_meta(spark):
    df = spark.createDataFrame([(" a ", " T ", "/x/y/"), ("b", "  ", None), ("  ", "t", "/x")], "id string, title string, path string")
    got = sorted(tuple(r) for r in tables.read_session_meta(df).collect())
    assert got == [("a", "T", "/x/y/", "y"), ("b", None, None, None)]
    assert tables.read_session_meta(df.drop("title")) is None


def test_three_sources_together(spark, log_dir):
    root = log_dir({
        "r/a.jsonl": [context("m"), usage_event(0, 700, input_tokens=600, output_tokens=100), usage_event(1, 905, input_tokens=790, output_tokens=115)],
        "e/s1/log.jsonl": EVENTS[:2],
        "t/b.jsonl": [assistant(0, "m1", 31, 212)],
    })
    scan = lambda part: lines.scan_lines(spark, f"{root}/{part}")
    usage = aggs.union_sources(
        rollouts.read_cumulative_rollouts(scan("r"))[0], event_logs.read_event_logs(scan("e"))[0],
        transcripts.read_transcripts(scan("t"))[0],
    )
    got = {r.source: r.total for r in aggs.usage_agg(usage, ["source"]).collect()}
    assert got == {"codex": 905, "dsh": 2317, "claude-code": 363}


# --- bad and repeated inputs -------------------------------------------------------------------------


def test_rejects_of_every_format(spark, log_dir):
    bad = ["{broken", '"text"', "", '{"no": "kind"}', "{half"]
    root = log_dir({"x/log.jsonl": bad})
    for read in (rollouts.rollout_records, event_logs.event_records, transcripts.transcript_records):
        got = transcripts.rejected_lines(read(lines.scan_lines(spark, root))).collect()
        assert sorted((r.line_no, r.reason) for r in got) == [(1, "not JSON"), (2, "not an object")]


def test_unreadable_compressed_file_is_a_reject(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "bad.jsonl.zst").write_bytes(b"no frame at all")
    records = event_logs.event_records(event_logs.scan_compressed_lines(spark, str(tmp_path / "x")))
    got = transcripts.rejected_lines(records).collect()
    assert [(r.source_file[-13:], r.reason) for r in got] == [("bad.jsonl.zst", "unreadable file")]


def test_far_times_are_rejects(spark, log_dir):
    root = log_dir({"a.jsonl": [
        {"ts": n, "usage": {"input_tokens": 1}} for n in (T0, 9_000_000_000_000_000_000, 253_402_300_799_999, 253_402_300_800_000)
    ] + [{"ts": "x", "usage": {"input_tokens": 1}}]})
    usage, rejects = transcripts.read_jsonl_usage(lines.scan_lines(spark, root))
    days = [str(r.ts_date) for r in with_ts_date(usage).orderBy("line_no").collect()]
    assert days == ["2023-11-14", "9999-12-31"]
    assert sorted((r.line_no, r.reason) for r in rejects.collect()) == [(n, "unusable timestamp") for n in (2, 4, 5)]


def test_huge_counts_stop_at_the_largest_number(spark, log_dir):
    most = 9_223_372_036_854_775_807
    root = log_dir({"a.jsonl": [{"ts": T0, "usage": {"input_tokens": most, "output_tokens": 5}}] * 2})
    usage, _ = transcripts.read_jsonl_usage(lines.scan_lines(spark, root))
    row = aggs.usage_agg(usage).first()
    assert (row.input, row.output, row.total) == (most, 10, most)
    empty = aggs.usage_agg(usage.where("false")).first()
    assert (empty.requests, empty.input, empty.total) == (0, 0, 0)


def test_newest_session_metadata_counts(spark):
    rows = [("a", "old", "/x", 1), ("a", "new", "/y", 5), ("b", "one", None, None), ("b", "two", None, None)]
    df = spark.createDataFrame(rows, "id string, title string, directory string, time_updated long")
    got = sorted(tuple(r) for r in tables.read_session_meta(df).select("id", "title", "directory").collect())
    assert got == [("a", "new", "/y"), ("b", "two", None)]


def test_folders_never_searched_are_not_read(spark, log_dir):
    """Files of skipped folders are left out of the scan's partitions, not filtered line by line."""
    from tallyforge.sources.lines import scan_lines

    root = log_dir({"a.jsonl": ["{}", "{}"], **{f"cache/{i}.jsonl": ["{}"] for i in range(40)}})
    lines = scan_lines(spark, root)
    assert [r.value for r in lines.collect()] == ["{}", "{}"]
    assert lines.rdd.getNumPartitions() == 1


def test_each_line_is_parsed_once(spark):
    """The parser stands once in the plan, and gives what the one expression gives."""
    from tallyforge.functions import variant as V
    from tallyforge.sources import transcripts

    texts = ['{"type":"a"}', '{"type":1} x', '{"type":"a"},{"type":"b"}', "", None, "[]", '{"ts":1700000000}', "{broken"]
    lines = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(texts)], "source_file string, block long, pos long, value string")
    parsed = transcripts._parsed(lines, None)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    seen = parsed.select("pos", F.col("line.type").cast("string"), F.col("line.ts").cast("long"), F.col("line").isNull())
    one = lines.withColumn("line", V.parse_object(F.col("value"), transcripts._LINE))
    assert seen.collect() == one.select("pos", F.col("line.type").cast("string"), F.col("line.ts").cast("long"), F.col("line").isNull()).collect()


def test_epoch_bounds(spark):
    from tallyforge.functions import variant as V

    last = V.LAST_MS
    numbers = [None, -5, 0, 100_000_000, 100_000_001, last // 1000, last // 1000 + 1, 10**12, 10**12 + 1, last, last + 1, V.MAX_COUNT]
    want = [None, None, None, None, 100_000_001_000, last // 1000 * 1000, None, None, 10**12 + 1, last, None, None]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i long, n long")
    assert [r[0] for r in frame.orderBy("i").select(V.epoch_ms(F.col("n"))).collect()] == want
