"""Near duplicates, fingerprints, mixing, chat formatting and resharding against plain versions."""

import glob
import hashlib
import os
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from tallyforge.llm import bitmap, bytetext, chat, components, fingerprints, mixing, near_dedup, queries, resharding, storage


def lower(text):
    return text.encode().lower().decode()


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def plain_components(texts, size, percent=80):
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(5))
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    texts = {i * 3 + 1: edited(prose(i % 5, 6), rng, rng.randrange(0, 6)) for i in range(90)}
    return texts | {1000: None, 1001: "", 1002: "one two", 1003: "One  TWO\n", 1004: "one two three", 1005: texts[1], 1006: texts[1].upper()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs_of, copies, size):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(*copies.items()), size).collect()}
    want = plain_components(copies, size)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert len({c for _, c in want.values()}) < len(copies) - 20


def test_fingerprint_components(docs_of, copies):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in fingerprints.near_copies(docs_of(*copies.items())).collect()}
    assert got == plain_components(copies, 5)


def test_near_duplicates_hostile(hostile):
    rows = near_dedup.near_duplicates(hostile).collect()
    assert len(rows) == hostile.count()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert (by[1], by[2], by[3], by[4], by[6], by[7], by[8], by[10]) == (1, 1, 3, 4, 6, 6, 8, 10)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert near_dedup.near_duplicates(hostile.where("false")).collect() == []


def test_large_group_without_hub(docs_of):
    """Copies that differ from one another by several edits: none is close to all, few are linked."""
    rng = random.Random(9)
    texts = {i: edited(prose(77, 6), rng, rng.randrange(0, 9)) for i in range(150)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(*texts.items()), 4).collect()}
    assert got == plain_components(texts, 4)


def test_circulant_signature_estimates_likeness():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    other = np.concatenate([base[:700], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    for signature in (near_dedup.circulant_signature, fingerprints.universal_signature):
        s = signature(np.concatenate([base, other]), np.array([0, 1000]), 512)
        assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.08


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)]
    links += [(5, 5), (61, 60), (61, 60)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: c for n, c in root.items() if any(n in link and link[0] != link[1] for link in links)}
    assert len(got) == len({r["node"] for r in got})
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_never_holds_back(docs_of):
    docs = docs_of(*[(i, str(i)) for i in range(300)], (None, "x"))
    inside, outside = bitmap.split_by_ids(docs, docs.where("doc_id % 7 = 0"), bits=10)
    a, b = ({r["doc_id"] for r in part.collect()} for part in (inside, outside))
    assert {i for i in range(300) if i % 7 == 0} <= a and not a & b and a | b == {*range(300), None}


def test_byte_words_match_patterns():
    import pyarrow as pa

    texts = ["", "A b", None, "  x\ty\vz ", "ÄB漢 c-d", "one", "\n", "e f g h i"]
    column = pa.array(texts)
    for table, pattern in ((bytetext.not_blank(), rb"[^\x20\x09-\x0D]+"), (bytetext.letters_and_digits(), rb"[0-9A-Za-z\x80-\xff]+")):
        for size in (1, 4, 1 << 20):
            found = []
            for row, end, data, bounds in bytetext.pieces(column, size):
                starts, ends, firsts = bytetext.word_bounds(data, bounds, table)
                found += [[data[a:b].tobytes() for a, b in zip(starts[firsts[k] : firsts[k + 1]], ends[firsts[k] : firsts[k + 1]])] for k in range(end - row)]
            assert found == [re.findall(pattern, (t or "").encode()) for t in texts]


def check_edited(rows, got, size):
    ordered = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        for name, other in (("near_edited", edit), ("near_next", after)):
            a, b = shingle_set(text, 5), shingle_set(other, 5)
            truth = len(a & b) / len(a | b) if a or b else 1.0
            assert abs(got[i][name] - truth) < 0.3, (i, name)


@pytest.mark.parametrize("chunk", [3, 512])
def test_fingerprints_of_edited_texts(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(fingerprints, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(fingerprints.range_tops, "__defaults__", (chunk, 20_000))
    rows = [(i * 7 - 50, prose(i % 9, 1 + i % 6) + "漢\U0001f600" * (i % 3)) for i in range(40)] + [(9001, None), (9002, ""), (9003, "x")]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs_of(*rows)).collect()}
    assert len(got) == len(rows)
    check_edited(rows, got, 5)
    by_text = defaultdict(set)
    for i, text in rows:
        by_text[text or ""].add(got[i]["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs_of(*rows)).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


def test_fingerprints_hostile(docs_of, hostile):
    rows = fingerprints.compare_edited(hostile).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in hostile.collect())
    assert fingerprints.compare_edited(hostile.where("false")).collect() == []
    one = fingerprints.compare_edited(docs_of((5, "abcd efgh"))).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest()


def test_fingerprints_query_links_near_copies(docs_of, hostile, copies, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs_of(*copies.items()))
    rows = queries.op7_fingerprints(None, "").collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: c for i, (_, c) in plain_components(copies, 5).items()}
    assert len(rows) == len(copies)
    whole = fingerprints.with_components(hostile)
    assert whole.drop("component_id").exceptAll(fingerprints.compare_edited(hostile)).isEmpty()
    assert whole.count() == hostile.count() and whole.where("component_id is null and doc_id is not null").isEmpty()


def test_fingerprints_without_ids(docs_of):
    """Rows without an id come below all ids, as one document with several texts."""
    rows = [(3, "aa bb cc dd"), (1, "ee ff gg hh"), (None, "zz yy"), (None, "kk ll mm nn")]
    got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in fingerprints.compare_edited(docs_of(*rows)).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {
        (3, 11): digest("aa bb " + "ee ff"), (1, 11): digest("ee ff " + "kk ll"),
        (None, 5): digest("zz " + "aa"), (None, 11): digest("kk ll " + "aa bb"),
    }


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        rest = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / rest > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        capped |= set(over)


@pytest.mark.parametrize("chunk_rows", [7, 4096])
def test_mixing(docs_of, chunk_rows):
    rng = random.Random(8)
    names = ["b", "a", None, "ä", "", "c", "d"]
    rows = [(i, prose(i, 1 + rng.randrange(5)), rng.choice(names + ["a"] * 6)) for i in range(400)] + [(900, None, "a"), (901, "", None)]
    got = mixing.mix_sources(docs_of(*rows), chunk_rows=chunk_rows).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[s] += r["taken"]
    slack = 12 if chunk_rows == 4096 else 60
    assert all(abs(taken[s] - want[s]) <= slack for s in sizes)
    again = mixing.mix_sources(docs_of(*rows).repartition(7), chunk_rows=chunk_rows).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_repeats_rows(docs_of, hostile):
    mixed = mixing.mix_sources(hostile)
    copies = Counter()
    for r in mixed.collect():
        copies[r["doc_id"]] += r["copies"]
    again = mixing.repeat_mixed(hostile)
    assert again.columns == hostile.columns
    assert Counter(r["doc_id"] for r in again.collect()) == +copies
    assert mixing.mix_sources(hostile.where("false")).collect() == []
    assert mixing.repeat_mixed(hostile.where("false")).collect() == []


def test_mixing_has_no_python(docs_of):
    plan = mixing.mix_sources(docs_of((1, "a b"), (2, "c")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|a<\\\\|", "<", "|im_end|>", "", None, "a\nb\r\n", "\\n", "漢\U0001f600<|", "<<||>>"]
    talks = {1: [("system", "s"), ("user", odd[0]), ("assistant", odd[1])], 2: [(r, t) for t in odd for r in ("user", "assistant")]}
    talks |= {3: [("ro\nle<|\\n", "x"), (None, "y"), ("assistant", None)], 4: [("assistant", "only")], -7: [("user", "long " * 50_000), ("assistant", "z")]}
    rows = [(c, k, r, t, "x", 1) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node_id string, score int").repartition(5)
    formatted = chat.format_conversations(chat.linear_messages(table))
    got = {r["conv_id"]: r for r in chat.digest_formatted(formatted).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        row = got[c]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), digest(turns)), c
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    texts = {r["tree_id"]: r["formatted"] for r in formatted.collect()}
    assert all(texts[c].count("<|im_start|>") == len(turns) for c, turns in talks.items())
    assert all(got[c]["formatted_chars"] == len(texts[c]) for c in talks)


def test_chat_ties_and_nulls(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "x"), (5, 0, "user", "x"), (5, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest_formatted(chat.format_conversations(chat.linear_messages(table))).collect()}
    assert got == {None: 2, 5: 3}
    assert chat.format_conversations(chat.linear_messages(table.where("false"))).collect() == []


def test_reply_tree_branches(spark):
    rows = [
        ("t", "r", None, "user", "root", 0.0), ("t", "a", "r", "assistant", "good", 5.0), ("t", "b", "r", "assistant", "bad", 1.0),
        ("t", "b1", "b", "user", "deep", 3.0), ("t", "b2", "b1", "assistant", "end", 2.0), ("t", "c", "r", "assistant", "none", None),
        ("u", "lost", "gone", "user", "orphan", 1.0),
    ]
    messages = spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.root_paths(messages, 3).orderBy(F.desc("above")).collect():
        paths[r["tree_id"], r["path_rank"]].append(r["node_id"])
    assert paths == {("t", 1): ["r", "b", "b1", "b2"], ("t", 2): ["r", "a"], ("t", 3): ["r", "c"], ("u", 1): ["lost"]}
    best = chat.format_conversations(messages).where("tree_id = 't'").first()
    assert [t for _, t in chat.read_turns(best["formatted"])] == ["root", "bad", "deep", "end"]


def test_long_chain_of_replies(spark):
    rows = [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = chat.digest_formatted(chat.format_conversations(chat.linear_messages(table))).first()
    assert (row["n_turns"], row["turns_sha256"]) == (300, digest([(r, t) for _, _, r, t in rows]))


@pytest.mark.parametrize("seed", range(5))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    supply = {i: rng.choice([0, rng.randrange(1000)]) for i in range(rng.randrange(1, 7))}
    demand = resharding.even_capacities(sum(supply.values()), rng.randrange(1, 7))
    flow = resharding.minimum_cost_flow(supply, demand)
    for i, n in supply.items():
        assert sum(v for (o, _), v in flow.items() if o == i) == n
    for j, n in demand.items():
        assert sum(v for (_, to), v in flow.items() if to == j) == n
    assert sum(v for (i, j), v in flow.items() if i == j) == sum(min(n, demand.get(i, 0)) for i, n in supply.items())


def test_resharding(spark, hostile):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 19, None]), 1 + rng.randrange(200), "x", 3) for i in range(3000)] + [(5, 0, 7, "x", 3)] * 20
    table = spark.createDataFrame(rows, "doc_id long, old_shard int, size long, chunk string, start int")
    got = resharding.reshard(table, 8, chunk_rows=100).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 200 * 2 * 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    old = Counter()
    for r in rows:
        old[r[1]] += r[2]
    even = sum(old.values()) / 8
    assert abs(moved - (sum(old.values()) - sum(min(old[i], even) for i in range(8)))) <= 200 * 2 * 6
    assert resharding.reshard(table.where("false"), 8).collect() == []
    sized = hostile.select("doc_id", resharding.byte_size().alias("size"), F.lit(0).alias("old_shard"))
    assert resharding.reshard(sized, 4).count() == hostile.count()


def test_rewriting_shards(spark, docs_of, tmp_path):
    docs = docs_of(*[(i, prose(i, 1 + i % 3)) for i in range(200)], (5, prose(5, 3)))
    old = docs.withColumn("old_shard", F.when(F.col("doc_id") < 150, 0).otherwise(1))
    path = str(tmp_path / "shards")
    old.withColumnRenamed("old_shard", "shard").write.partitionBy("shard").parquet(path)
    moved = resharding.reshard(old.select("doc_id", "old_shard", resharding.byte_size().alias("size")), 4)
    want = Counter((r["doc_id"], r["shard"]) for r in moved.collect())
    assert {0, 2, 3} <= set(resharding.rewrite_shards(docs, moved, path)) <= {0, 1, 2, 3}
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()) == want


def test_rewrite_keeps_every_row(spark, tmp_path):
    """Null ids, repeated rows and one id at several texts."""
    rows = [(None if i % 3 == 0 else i % 7, prose(i % 20, 2), i % 3) for i in range(90)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, old_shard int")
    path = f"{tmp_path}/shards"
    docs.withColumnRenamed("old_shard", "shard").write.partitionBy("shard").parquet(path)
    moved = resharding.reshard(docs.select("doc_id", "old_shard", resharding.byte_size().alias("size")), 5)
    assert set(resharding.rewrite_shards(docs, moved, path)) == set(range(5))
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    assert Counter(r["shard"] for r in back.collect()) == Counter(r["shard"] for r in moved.collect())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["shards"]


def test_rewrite_refuses_too_many_shards(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 1), i % 4) for i in range(40)], "doc_id long, text string, old_shard int")
    path = f"{tmp_path}/shards"
    docs.withColumnRenamed("old_shard", "shard").write.partitionBy("shard").parquet(path)
    moved = resharding.reshard(docs.select("doc_id", "old_shard", resharding.byte_size().alias("size")), 3)
    monkeypatch.setattr(resharding, "SHARD_LIMIT", 1)
    with pytest.raises(ValueError):
        resharding.rewrite_shards(docs, moved, path)
    assert spark.read.parquet(path).count() == 40


def test_size_and_checksum(spark):
    texts = ["", None, "é漢\U0001f600", "abc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = rows.select("doc_id", resharding.byte_size().alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("crc")).collect()
    assert [(r["size"], r["crc"]) for r in got] == [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts]


def shuffle_files(spark):
    root = spark.conf.get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(f"{root}/blockmgr-*/**/shuffle_*.data", recursive=True))


def test_only_kept_frames_and_no_shuffles_stay_behind(spark, hostile):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("*"))
    whole = fingerprints.with_components(hostile)
    assert [f.name.split("-")[:2] for f in set(root.glob("*")) - before] == [["fingerprint", "components"]]
    assert whole.count() == hostile.count() == len(whole.collect())
    assert spark.conf.get(storage.DROP_SHUFFLES) == "false"
    before = shuffle_files(spark)
    held = storage.staged(hostile.groupBy("doc_id").count(), "counts")
    assert held.count() == hostile.select("doc_id").distinct().count()
    kept = [f for f in shuffle_files(spark) - before if os.path.getmtime(f) < os.path.getmtime(held._staged_path)]
    assert kept == []
