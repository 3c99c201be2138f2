"""The pipeline and the registered queries of the subpackage, on small tables."""

from collections import Counter

import pytest
from conftest_llm import prose
from test_set_operators import plain_components, plain_targets
from test_text_operators import insulted

import corpus_pipeline
from tallyforge.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, tmp_path):
    """Documents with planted copies, benchmark passages and insults; every eighth is toxic."""
    item = prose(501, 3)
    rows = [(i, insulted(i, 4) if i % 8 == 0 else prose(i, 6), "ab"[i % 5 == 0]) for i in range(200)]
    rows += [(1000 + i, prose(i, 6) + "tail", "a") for i in range(1, 8)]
    rows += [(1100, prose(2000) + item + prose(2001), "b"), (1101, None, None), (1102, "", "a"), (None, prose(3000), "a"), (3, prose(3, 6), "a")]
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages_against_plain_versions(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.where("doc_id is not null").select("doc_id").collect())

    clean = by_name["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(i for i, _, _ in rows if i is not None and not (i % 8 == 0 and i < 200))

    single = by_name["near duplicates"](spark, clean, folder)
    texts = {i: t for i, t, _ in rows if i is not None and not (i % 8 == 0 and i < 200)}
    assert ids(single) == sorted(i for i, (_, c) in plain_components(texts, corpus_pipeline.SHINGLE_WORDS).items() if i == c)
    assert single.where("doc_id is null").count() == 1 and single.columns == docs.columns

    kept = by_name["decontamination"](spark, single, folder)
    assert ids(kept) == [i for i in ids(single) if i != 1100]

    mixed = by_name["mixing"](spark, kept, folder)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(kept))
    sizes, taken = Counter(), Counter()
    for into, frame in ((sizes, kept), (taken, mixed)):
        for r in frame.collect():
            into[r["source"]] += len((r["text"] or "").split())
    assert all(abs(taken[s] - n) <= 60 for s, n in plain_targets(sizes).items())

    sharded = by_name["sharding"](spark, mixed, folder).collect()
    assert Counter(r["doc_id"] for r in sharded) == Counter(r["doc_id"] for r in mixed.collect())
    slots = Counter(r["shard"] for r in sharded)
    assert all(sorted(r["slot"] for r in sharded if r["shard"] == s) == list(range(n)) for s, n in slots.items())


def test_decisions_fall_on_rows(spark, corpus):
    """One id at two texts: both stay, or only the one that leaks goes. Rows without an id are compared too."""
    folder, _ = corpus
    by_name = dict(corpus_pipeline.STAGES)
    a, b, item = prose(81, 6), prose(82, 6), prose(501, 3)
    rows = [(1, a), (1, b), (1, a), (2, a + "tail"), (None, b), (None, prose(83, 6)), (3, b + item), (3, prose(84, 6)), (None, item + prose(85, 6)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = by_name["near duplicates"](spark, docs, folder)
    assert Counter((r["doc_id"], r["text"]) for r in single.collect()) == Counter({rows[k] for k in (0, 1, 5, 6, 7, 8, 9)})
    kept = by_name["decontamination"](spark, single, folder)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({rows[k] for k in (0, 1, 5, 7, 9)})
    assert kept.columns == docs.columns


def test_stages_on_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_run_on_the_small_tables(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r["shard"] for r in rows} <= set(range(16))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    n = out.count()
    per_row = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert n > 0 if name in ("op6_decontamination", "op8_chat_format", "op11_url_filter", "op12_spelling_variants") else n == per_row


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import oracle

    problem = oracle.compare(name, queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.ORACLES[name])
    assert problem is None, problem
