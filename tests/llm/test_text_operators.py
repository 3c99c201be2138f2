"""Licence scan, toxicity, decontamination, sentence spans and suffix arrays against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose, sentence

from tallyforge.llm import decontamination, license_scan, sentence_spans, storage, suffix_index, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.encode().lower().decode()


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND ISC", ["mit", "apache-2.0", "isc", "and", "or"]),
        ("(MIT OR ISC) AND GPL-2.0-only WITH Classpath-exception-2.0", ["mit", "isc", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"]),
        ("", None),
        ("MIT OR", None),
        ("(MIT", None),
        ("MIT)", None),
        ("MIT ISC", None),
        ("OR MIT", None),
    ],
)
def test_expression_order(text, postfix):
    assert license_scan.parse_expression(text) == postfix


def test_expression_value():
    value = lambda text: license_scan.evaluate_expression(license_scan.parse_expression(text))[0]
    assert value("MIT OR GPL-3.0-only") == license_scan.RESTRICTION["mit"]
    assert value("MIT AND GPL-3.0-only") == license_scan.RESTRICTION["gpl"]
    assert value("GPL-2.0-only WITH Classpath-exception-2.0") == pytest.approx(license_scan.RESTRICTION["gpl"] - 0.2)
    assert value("MIT AND Unheard-1.0") == license_scan.UNKNOWN_IDENTIFIER


def plain_scan(text):
    words = WORD.findall(lower(text or ""))
    found = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({x for _, x in found}))


def test_license_scan(docs_of, hostile):
    texts = [
        "CC BY cc-by CC.BY-NC 4.0", "the Lesser General Public License; ALL rights\nreserved all rights reserved",
        "occ by", "cc byé", "Kcc by", "cc cc by by", "SPDX-License-Identifier: (MIT OR Apache-2.0)\ncc by",
        "spdx-license-identifier : GPL-3.0-only AND Odd-1\nx", "SPDX-License-Identifier: MIT AND\n", "all rights " * 50 + "reserved",
    ]
    table = docs_of(*enumerate(texts, 100)).unionByName(hostile)
    got = license_scan.scan_licenses(table).collect()
    assert len(got) == table.count()
    want = Counter((r["doc_id"], *plain_scan(r["text"])) for r in table.collect())
    assert want == Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[106] == ("apache,cc-by,mit", license_scan.RESTRICTION["cc-by"])
    assert labels[107] == ("gpl,odd-1", 1.0)
    assert labels[108] == ("", 0.0)
    assert labels[101][0] == "gpl,lgpl,reserved"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_licenses(table.where("false")).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("<!-- SPDX-License-Identifier: MIT -->", "mit"),
        ("<!-- SPDX-License-Identifier: MIT-->", "mit"),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ (function () {", "apache,mit"),
        ("SPDX-License-Identifier: MIT - see LICENSE", "mit"),
        ("SPDX-License-Identifier: MIT, see LICENSE", "mit"),
        ("under SPDX-License-Identifier: MIT.", "mit"),
        ("under SPDX-License-Identifier: Apache-2.0. Or later words.", "apache"),
        ("(SPDX-License-Identifier: MIT)", "mit"),
        ("SPDX-License-Identifier: GPL-3.0-only AND Odd-1 # include", "gpl,odd-1"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 this file is", "gpl"),
        ("SPDX-License-Identifier: MIT and is free", "mit"),
        ("SPDX-License-Identifier: MIT OR -->", "mit"),
        ("SPDX-License-Identifier: MIT AND (ISC and so on", "mit"),
        ("x SPDX-License-Identifier: MIT y SPDX-License-Identifier: ISC and SPDX-License-Identifier: Zlib z", "isc,mit,zlib"),
        ("SPDX-License-Identifier: MIT\r\nint main", "mit"),
        ("SPDX-License-Identifier: Ruby this file", "ruby"),
        ("SPDX-License-Identifier: mit or ruby", "mit,ruby"),
        ("the SPDX-License-Identifier: tag of each file", ""),
        ("SPDX-License-Identifier: MIT OR\nint main", ""),
        ("SPDX-License-Identifier:\nMIT", ""),
    ],
)
def test_tags_inside_lines(text, labels):
    found = license_scan.scan_text(text, license_scan.automaton([*license_scan.NOTICE_PHRASES, license_scan.TAG]))
    assert found[5] == labels


def insulted(seed, n):
    rng = random.Random(seed)
    words = prose(seed).split()
    for _ in range(n):
        words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numbskulls", "numbskullery"]))
    return " ".join(words)


def test_toxicity_on_held_out_rows(spark, docs_of, hostile):
    toxic = {i: i % 4 == 0 for i in range(400)}
    docs = docs_of(*[(i, insulted(i, 3 + i % 5 if toxic[i] else 0)) for i in toxic])
    labels = spark.createDataFrame([(i, None, int(t)) for i, t in toxic.items() if i < 300] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_severity(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = rows_by_id(toxicity.score_severity(docs, model))
    assert all(got[i]["rejected"] == toxic[i] for i in range(300, 400))
    assert got[396]["severity"] > got[397]["severity"]
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {i for i in toxic if not toxic[i]}
    odd = toxicity.score_severity(hostile, model).collect()
    assert len(odd) == hostile.count() and not any(r["rejected"] for r in odd)
    assert toxicity.keep_clean(hostile, model).count() == hostile.count()
    assert toxicity.keep_clean(hostile, model).columns == hostile.columns
    assert toxicity.score_severity(docs.where("false"), model).collect() == []


def test_toxicity_without_labels(spark, hostile):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["rejected"] for r in toxicity.toxicity(hostile, labels).collect())


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 600)
    rows, columns = np.repeat(np.arange(600), 2), np.stack([grades, np.full(600, 4)], 1).reshape(-1)
    weights, cuts = toxicity.fit_ordinal(rows, columns, grades, np.ones(600), 5, 4)
    assert (np.diff(weights[:4]) > 0).all() and (np.diff(cuts) > 0).all()
    over = toxicity.SeverityModel(np.zeros(0), weights, cuts).exceed(weights[:4] + weights[4])
    assert (over.sum(1).round() == [0, 1, 2, 3]).all()


@pytest.fixture
def items(spark):
    rows = [(1, prose(501, 3)), (2, prose(502, 2)), (3, "too short item"), (4, None), (None, prose(503)), (2, prose(502, 2))]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc_id string, h long")


def test_decontamination(docs_of, hostile, items):
    item = prose(501, 3).split()
    swapped = [w if k % 7 else "OTHER" for k, w in enumerate(item)]
    docs = docs_of(
        (50, prose(7) + " " + " ".join(item).upper() + " " + prose(8)),
        (51, prose(9) + " " + " ".join(swapped) + " " + prose(10)),
        (52, " ".join(item[5:20])),
        (53, " ".join(item[5:14])),
        (54, prose(11)),
        (55, prose(502, 2) + " " + prose(501, 3)),
        (56, "too short item"),
    ).unionByName(hostile)
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_contamination(docs, items).collect()}
    assert set(found) == {(50, 1), (51, 1), (52, 1), (55, 1), (55, 2)}
    assert found[50, 1]["n_matched"] == len(item) and found[50, 1]["item_word"] == 0 and found[50, 1]["share"] == 1
    assert found[51, 1]["n_matched"] == sum(a == b for a, b in zip(item, swapped, strict=True))
    assert (found[52, 1]["item_word"], found[52, 1]["doc_word"], found[52, 1]["n_words"]) == (5, 0, 15)
    assert decontamination.find_contamination(docs.where("false"), items).collect() == []
    assert decontamination.find_contamination(docs, items.where("false")).collect() == []


def plain_stretch(equal, words):
    """Greatest number of ``4 * matches - 3 * words`` over all stretches of enough words; None if below 0."""
    sums = [0, *np.cumsum([1 if e else -3 for e in equal])]
    most = max((sums[b] - sums[a] for b in range(len(sums)) for a in range(b - words + 1)), default=-1)
    return int(most) if most >= 0 else None


@pytest.mark.parametrize("n", [11, 12, 15, 16, 18, 19, 20, 24, 30])
def test_best_stretch_is_the_best_of_enough_words(n):
    rng = random.Random(n)
    for substituted in range(5):
        places = list(itertools.combinations(range(n), substituted))
        for gone in places if len(places) <= 400 else rng.sample(places, 400):
            equal = np.array([k not in gone for k in range(n)])
            a, b, same = decontamination.best_stretch(equal, 0.75, 12)
            got = 4 * same - 3 * (b - a) if b else None
            assert got == plain_stretch(equal, 12), gone
            assert not b or (b - a >= 12 and same == equal[a:b].sum())


def seeded(equal):
    words = np.arange(1, len(equal) + 1, dtype=np.uint64)
    other = np.where(equal, words, words + np.uint64(1000))
    firsts = np.array([0, len(words)])
    seeds = ((decontamination.seed_hashes(x, firsts, mask)[0] for x in (words, other)) for mask in decontamination.MASKS)
    return any((a == b).any() for a, b in seeds)


def test_every_placement_of_substitutions_has_a_seed():
    for n in (12, 16):
        for gone in itertools.combinations(range(n), n // 4):
            assert seeded(np.array([k not in gone for k in range(n)])), gone
    assert seeded(np.array([e == "E" for e in "EEEEEEXXEEEEEEXXEEEEEE"]))


def test_decontamination_of_short_overlaps(spark, docs_of):
    """Overlaps whose best part alone is too short."""
    patterns = {60: "EEEXEEEEEEEEEEE", 61: "EEEEEEXXEEEEEEE", 62: "EEEXEEEEEEEEEEEXEEE", 63: "EEEEEEEEEEEXEEXEEXEE"}
    words = {i: [f"w{i}n{k}" for k in range(len(p))] for i, p in patterns.items()}
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "item_id long, text string")
    texts = [(i, " ".join(w if e == "E" else "other" for w, e in zip(words[i], p, strict=True))) for i, p in patterns.items()]
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_contamination(docs_of(*texts), items).collect()}
    assert set(found) == {(i, i) for i in patterns}
    assert all(r["n_words"] >= 12 and r["share"] >= 0.75 for r in found.values())


def test_decontamination_without_filter(docs_of, items, monkeypatch):
    docs = docs_of((50, prose(7) + " " + prose(501, 3)), (54, prose(11)))
    want = decontamination.find_contamination(docs, items).collect()
    monkeypatch.setattr(decontamination.bitmap, "MOST_WORDS", 0)
    assert decontamination.find_contamination(docs, items).collect() == want


def plain_spans(texts, sentences, words):
    parts = {i: re.findall(r"[^.!?\n,;:]*[.!?\n,;:][.!?\n,;: \t\r]*|[^.!?\n,;:]+", t or "") for i, t in texts.items()}
    seen, gone = {}, {i: set() for i in texts}
    runs = []
    for i, ss in parts.items():
        n = [len(s.split()) for s in ss]
        for a in range(len(ss)):
            b = next((b for b in range(a + sentences, len(ss) + 1) if sum(n[a:b]) >= words), None)
            if b:
                runs.append((i, a, b))
            a2 = next((c for c in range(a + 1 - sentences, -1, -1) if sum(n[c : a + 1]) >= words), None)
            if a2 is not None:
                runs.append((i, a2, a + 1))
    for i, a, b in sorted(set(runs)):
        name = tuple(s.strip(" \t\r\n") for s in parts[i][a:b])
        if name in seen and seen[name] != (i, a):
            gone[i] |= set(range(a, b))
        else:
            seen[name] = (i, a)
    return {i: (len(ss), sorted(gone[i]), "".join(s for k, s in enumerate(ss) if k not in gone[i])) for i, ss in parts.items()}


def test_sentence_spans(docs_of):
    rng = random.Random(5)
    stock = [sentence(rng, rng.randrange(1, 9)).replace(" the", ", the") for _ in range(40)]
    texts = {i: "".join(stock[(s + k) % 40] for s in (rng.randrange(40),) for k in range(rng.randrange(0, 12))) for i in range(60)}
    texts |= {100: None, 101: "", 102: ".. !\n\n", 103: "  lead" + stock[0], 104: "no end", 105: prose(1) * 2}
    got = rows_by_id(sentence_spans.remove_repeated_spans(docs_of(*texts.items())))
    for i, (n, removed, kept) in plain_spans(texts, sentence_spans.SENTENCES, sentence_spans.WORDS).items():
        row = got[i]
        assert (row["n_sentences"], row["removed"], row["kept_text"]) == (n, removed, kept), i
        assert row["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and row["n_removed"] == len(removed)


def test_sentence_spans_hostile(hostile):
    got = sentence_spans.remove_repeated_spans(hostile)
    rows = got.collect()
    assert len(rows) == hostile.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] == 0 and by[2]["kept_text"] == "" and by[6]["n_removed"] == 0 and by[7]["kept_text"] == ""
    assert sentence_spans.remove_repeated_spans(hostile.where("false")).collect() == []


def test_sentence_spans_by_row(docs_of):
    """Rows with one id and different texts, and rows without an id, are judged each for itself."""
    a, b, c = (prose(i, 5) for i in (61, 62, 63))
    table = docs_of((1, a), (1, b), (2, a), (None, a), (None, c), (None, b), (4, c))
    got = Counter((r["doc_id"], r["n_removed"], r["kept_text"]) for r in sentence_spans.remove_repeated_spans(table).collect())
    assert got == Counter([(1, 0, a), (1, 0, b), (2, 5, ""), (None, 5, ""), (None, 5, ""), (None, 5, ""), (4, 0, c)])


def plain_repeats(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    times = Counter(b[p : p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def edited(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * rng.randrange(1, 5)
    return " ".join(words)


@pytest.mark.parametrize("batches", [1, 3])
def test_suffix_dedup(docs_of, batches):
    rng = random.Random(batches)
    texts = {i: edited(prose(i % 6, 14), rng, rng.randrange(0, 9)) for i in range(40)}
    texts |= {50: "ab" * 400, 51: "a" * 199, 52: "a" * 200, 53: None, 54: "", 55: prose(1, 14) + prose(1, 14), 56: "é漢" * 150}
    texts |= {57: prose(2, 14)[13:260], 58: "x" + prose(2, 14)[13:230], 59: "漢" * 90}
    got = rows_by_id(suffix_index.remove_repeats(docs_of(*texts.items()), batches=batches))
    for i, want in plain_repeats(texts, 200).items():
        row = got[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == want, i
        assert sum(r["stop"] - r["start"] for r in row["removed"]) == want[1]


def test_suffix_levels(spark, docs_of):
    index = suffix_index.SuffixIndex(spark, buckets=2)
    sizes = []
    for k in range(5):
        index.add(docs_of((k, prose(k, 14))))
        sizes.append([level for level, _ in index.levels])
    assert sizes == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]  # equal ones merge before the next batch
    index.close()


def test_suffix_dedup_hostile(hostile):
    rows = suffix_index.remove_repeats(hostile).collect()
    assert len(rows) == hostile.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["n_removed"] == by[6]["n_bytes"] == by[7]["n_removed"] and by[4]["n_bytes"] == by[3]["n_bytes"] == 0
    assert suffix_index.remove_repeats(hostile.where("false")).collect() == []


@pytest.mark.parametrize("batches", [1, 4])
def test_suffix_dedup_by_row(docs_of, batches):
    """Rows with one id and different texts, and rows without an id, are judged each for itself."""
    a, b, c, d = (prose(i, 12) for i in (71, 72, 73, 74))
    rows = [(1, a), (1, b + a[50:400]), (None, b), (None, c), (None, d[30:] + c[:230]), (2, d), (2, d), (3, "z" * 500), (3, "y" * 201), (None, None)]
    want = plain_repeats(dict(enumerate(text for _, text in rows)), 200)
    want = Counter((rows[i][0], *figures) for i, figures in want.items())
    got = suffix_index.remove_repeats(docs_of(*rows), batches=batches).drop("removed").collect()
    assert Counter(map(tuple, got)) == want


def test_suffix_dedup_takes_texts_in_short_batches(spark, docs_of):
    """Tasks hold some megabytes of texts at a time, unless the session names another number of rows."""
    docs = docs_of(*((i, prose(i)) for i in range(3)))
    before = spark.conf.get(storage.ARROW_ROWS)
    try:
        for given, used in ((storage.SPARK_ARROW_ROWS, "1000"), ("77", "77")):
            spark.conf.set(storage.ARROW_ROWS, given)
            assert suffix_index.remove_repeats(docs).count() == 3
            assert spark.conf.get(storage.ARROW_ROWS) == used
    finally:
        spark.conf.set(storage.ARROW_ROWS, before)
