"""URL filters, spelling variants and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose

from tallyforge.llm import importance, spelling, url_filter

ALPHABET = "ab/.?=é"


def lower(text):
    return text.encode().lower().decode()


def glob_regex(glob):
    parts = re.findall(r"\*\*|\*|\?|\[!?[^\]]+\]|\\.|.", glob, re.DOTALL)
    special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    set_of = lambda p: f"[^/{p[2:-1]}]" if p.startswith("[!") else p
    one = lambda p: special.get(p) or (set_of(p) if len(p) > 1 and p[0] == "[" else re.escape(p[1:] if p[0] == "\\" else p))
    return re.compile("".join(map(one, parts)), re.DOTALL)


def fits(automaton, texts):
    raw = [t.encode() for t in texts]
    return automaton.run(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_globs_against_regular_expressions():
    rng = random.Random(4)
    pieces = ["*", "**", "?", "[ab]", "[!ab]", "\\?", "\\*", "a", "b", "/", ".", "é", "=", "[a-z]"]
    globs = ["", "*", "**", *("".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(150))]
    automaton = url_filter.WildcardAutomaton(globs)
    assert len(automaton.start) > 4  # rules span several words
    texts = ["", *("".join(rng.choices(ALPHABET, k=rng.randrange(0, 14))) for _ in range(400)), "漢" * 3, "a" * 300]
    got = fits(automaton, texts)
    for k, glob in enumerate(globs):
        want = [bool(glob_regex(glob).fullmatch(t)) for t in texts]
        assert got[:, k].tolist() == want, glob


def test_one_word_more():
    """A rule whose bits cross from one word of the mask to the next."""
    for n in (60, 62, 63, 64, 65, 127, 128, 200):
        automaton = url_filter.WildcardAutomaton(["a" * n, "b*", "c" * n + "**"])
        assert fits(automaton, ["a" * n, "a" * (n - 1), "a" * n + "b", "b", "bb", "c" * (n + 1), "c" * (n - 1)]).tolist() == [
            [True, False, False], [False] * 3, [False] * 3, [False, True, False], [False, True, False], [False, False, True], [False] * 3,
        ]


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest).group()
    host = lower(raw)
    path, query = re.match(r"([^?#]*)(\?[^#]*)?", rest[len(raw) :]).groups()
    best = None
    for verdict, rule in url_filter.SITE_RULES:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], None, best[0]
    fitting = [(-len(g), v != "allow", g, v) for v, g in url_filter.GLOB_RULES if glob_regex(g).fullmatch(f".{host}{path}{query or ''}")]
    if fitting:
        _, _, glob, verdict = min(fitting)
        return host, path, None, glob, verdict
    return host, path, None, None, url_filter.DEFAULT


URLS = [
    "http://NET/", "http://net", "http://a.net/x", "https://www.Example.net/en/1?page=2#top", "https://example.net/en", "x://example.net/en/",
    "http://xexample.net/en/", "http://example.com/de/1", "http://a.example.com/DE/1", "http://b.org/fr/", "http://org/fr/x", "http://b.org?x=/fr/",
    "http://b.org/a.net/x", "//net/", "net/", None, "", "://", "http://a.com/setup.exe", "http://a.com/setup.exe?x", "http://a.com/setup.exe#x",
    "http://x.ads.com/", "http://a.com/x.ads./", "http://a.com/login", "http://a.com/?page=1", "http://a.com/a.html?page=1", "http://a.com?utm_source=a",
    "http://x.m.example.com/en/1", "http://a.com/漢/cart/é", "http://a.com/" + "x" * 5000 + ".zip", "http://user@net:80/", "http://a\nb.net/\nx?y", "ftp://ÄÖ.NET/",
]


def test_judge_urls(spark):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(None, URLS[2], "x", "y", "z")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string")
    got = url_filter.judge_urls(pages)
    want = Counter((r[0], *plain_verdict(r[1])) for r in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["page_id", "host", "path", "rule", "pattern", "verdict"]
    assert url_filter.judge_urls(pages.where("false")).collect() == []
    only_default = url_filter.judge_urls(pages, [], [], "block")
    assert {(r["rule"], r["pattern"], r["verdict"]) for r in only_default.collect()} == {(None, None, "block")}


def test_allow_wins_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    row = url_filter.judge_urls(pages, [("block", "a.b/c"), ("allow", "a.b/c")], []).first()
    assert (row["rule"], row["verdict"]) == ("a.b/c", "allow")


def test_globs_of_one_length_decide_as_in_sql(spark, tmp_path):
    import duckdb
    import oracle

    from tallyforge.llm import queries

    urls = ["http://m.a.com/en/1?utm_source=b", "http://x.m.a.com/de/1?a=1&utm_source=b", "http://a.com/x?session=y.html?page=1", "http://a.com/cart/login", "http://a.com/login/cart/1"]
    pages = [(i, u) for i, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    name = "op11_url_filter"
    problem = oracle.compare(name, queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name])
    assert problem is None, problem


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows, least_length, least_count, factor):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("block_rows", [512, 3, 1])
def test_spelling_variants(docs_of, hostile, block_rows):
    rng = random.Random(2)
    stems = ["".join(rng.choices("abÉé×", k=rng.randrange(6, 13))) for _ in range(40)] + ["a" * 7, "a" * 8, "ab" * 60, "ab" * 60 + "a", "ÀÀÀÀÀÀÀ"]
    words = []
    for s in stems:
        words += [s] * rng.choice([1, 2, 30, 400])
        for _ in range(6):
            i = rng.randrange(len(s))
            words += [rng.choice([s[:i] + s[i + 1 :], s[:i] + "b" + s[i:], s[:i] + "a" + s[i + 1 :]])] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    rows = [(i, " 1".join(words[i::50]).replace("a", "A" if i % 2 else "a")) for i in range(50)]
    table = docs_of(*rows).unionByName(hostile)
    want = plain_variants([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()], 7, 2, 10)
    got = spelling.group_variants(table, block_rows=block_rows).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(w[1] and w[2] != w[1] for w in want)  # chains of forms
    assert spelling.group_variants(table.where("false")).collect() == []


@pytest.mark.parametrize("lengths", [(1, 4), (2, 9)])
def test_near_words_of_any_length(spark, lengths):
    rng = random.Random(sum(lengths))
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(*lengths))) for _ in range(150)} | {"x" * 3000, "x" * 2999, "y" + "x" * 2999})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = Counter((r["word"], r["near"], r["near_n"]) for r in spelling.near_words(frame, 16).collect())
    assert got == Counter((a, b, words.index(b)) for a in words for b in words if one_edit(a, b))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall(lower(text or ""))
    return words, words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def plain_resample(rows, target, percent, least, buckets=importance.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in plain_features(t)[1])
    s, t = count(text for _, text in rows), count(target)
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (whole_s + buckets)) / ((s[b] + 1) * (whole_t + buckets))))
    out = []
    for doc_id, text in rows:
        words, features = plain_features(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(words), len(features), weight, score))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = Counter((*r, k + 1) for k, r in enumerate(order[: percent * len(order) // 100]))
    ranks.update((*r, None) for r in order[percent * len(order) // 100 :])
    ranks.update((*r, None) for r in out if r[1] < least)
    return ranks


def test_importance_resampling(spark, docs_of, hostile):
    odd = [(500, "x" * 70 + " " + "漢字" * 40 + " a1 B2"), (501, "one"), (502, "ÀB àb"), (503, "9" * 64 + "," + "9" * 65 + " end")]
    table = docs_of(*[(i, prose(i % 60, 3 + i % 5)) for i in range(120)], *odd).unionByName(hostile)
    target = spark.createDataFrame([(1, prose(3)), (2, None), (3, "")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    got = importance.resample(table, target).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(rows, [prose(3)], 25, 20)
    assert importance.resample(table.where("false"), target).collect() == []
    assert importance.resample(table, target.where("false")).count() == len(rows)
    everything = importance.resample(table, target, percent=100, least_words=0).where("rank is not null")
    assert sorted(r["rank"] for r in everything.collect()) == list(range(1, len(rows) + 1))


def test_features_never_span_texts():
    features = importance.Features(ngram_words=3, buckets=1 << 30)
    texts = ["a b", "", "c", "D e f g", " ", "hé " + "w" * 200 + " i"]
    runs = list(features.of([t.encode() for t in texts]))
    for n, (text, bucket) in enumerate(runs, 1):
        words = [WORD.findall(lower(t)) for t in texts]
        want = [(k, zlib.crc32(" ".join(w[i : i + n]).encode()) % (1 << 30)) for k, w in enumerate(words) for i in range(len(w) - n + 1)]
        assert list(zip(text.tolist(), bucket.tolist(), strict=True)) == want
