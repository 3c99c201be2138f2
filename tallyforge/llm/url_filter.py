"""URL filters: wildcard rules over hosts, paths and queries, all simulated at once by one bit-parallel automaton.

A rule is a glob over a page's address. Its positions are bits of a multiword Shift-And mask; all rules of a list
lie side by side in the mask, so that one shift and two masks a byte advance every rule over a block of urls.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import bytetext

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALLOW, BLOCK = "allow", "block"
# Rules of (host, path) that the query judges by.
SITE_RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
# For addresses that no site rule fits: downloads, sessions, forms, advertising, repeated views of one page.
GLOB_RULES = (
    (BLOCK, "**.exe"),
    (BLOCK, "**.zip"),
    (BLOCK, "**/login**"),
    (BLOCK, "**/cart/**"),
    (BLOCK, "*.ads.**"),
    (BLOCK, "**\\?**session=*"),
    (BLOCK, "**[?&]page=[0-9]**"),
    (BLOCK, "**\\?**utm_source=**"),
    (BLOCK, "*.m.*/[a-z][a-z]/**"),
    (ALLOW, "**.html\\?page=1"),
)
DEFAULT = ALLOW


def parse_glob(glob: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Positions of a glob, as tables over byte values: where the start may wait, then for each position what it
    takes and where it may wait after that.

    ``*`` is any run without ``/``, ``**`` any run, ``?`` one character but ``/``, ``[...]`` one of an ASCII set
    (ranges, ``!`` first for all others but ``/``), a backslash takes the next character as it is. The glob must
    fit the whole address. A character outside ASCII is a literal of its UTF-8 bytes.
    """
    inside = np.zeros(256, bool)  # later bytes of a character
    inside[0x80:0xC0] = True
    start, positions = np.zeros(256, bool), []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            deep = glob[i : i + 2] == "**"
            waits = positions[-1][1] if positions else start
            waits |= deep | (np.arange(256) != ord("/"))
            i += 2 if deep else 1
            continue
        takes, waits = np.zeros(256, bool), np.zeros(256, bool)
        if c in "?[":
            end = glob.index("]", i + 2) if c == "[" else i
            members = glob[i + 1 : end]
            negated = c == "?" or members.startswith("!")
            members = members.removeprefix("!")
            chosen, k = np.zeros(256, bool), 0
            while k < len(members):
                span = members[k + 1 : k + 2] == "-" and k + 2 < len(members)
                chosen[ord(members[k]) : ord(members[k + 2] if span else members[k]) + 1] = True
                k += 3 if span else 1
            if negated:
                takes = ~chosen & ~inside
                takes[ord("/")] = False
                waits |= inside
            else:
                takes = chosen
            positions.append((takes, waits))
            i = end + 1
            continue
        if c == "\\" and i + 1 < len(glob):
            i += 1
            c = glob[i]
        for byte in c.encode():
            takes, waits = np.zeros(256, bool), np.zeros(256, bool)
            takes[byte] = True
            positions.append((takes, waits))
        i += 1
    return start, positions


class WildcardAutomaton:
    """All globs of a list as one Shift-And automaton of as many 64-bit words as its positions need."""

    def __init__(self, globs: Sequence[str]):
        parsed = [parse_glob(g) for g in globs]
        bits = sum(1 + len(positions) for _, positions in parsed)
        words = -(-max(bits, 1) // 64)
        takes, waits = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start, self.ends = np.zeros(words, np.uint64), []
        at = 0
        for start, positions in parsed:
            for k, (take, wait) in enumerate([(np.zeros(256, bool), start), *positions]):
                bit = np.uint64(1) << np.uint64(at % 64)
                takes[take, at // 64] |= bit
                waits[wait, at // 64] |= bit
                if k == 0:
                    self.start[at // 64] |= bit
                at += 1
            self.ends.append(at - 1)
        self.takes, self.waits = takes, waits

    def run(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text of ``data`` (cut at ``bounds``) which globs fit it: one row of booleans per text. The
        texts advance together, one byte at a time; those that have ended drop out."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        falling, first = -lengths[order], bounds[:-1][order]
        state = np.tile(self.start, (len(lengths), 1))
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -k, "left"))
            now, byte = state[:live], data[first[:live] + k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.takes[byte]) | (now & self.waits[byte])
        ends = np.array(self.ends, np.int64)
        fits = np.empty((len(lengths), len(ends)), bool)
        fits[order] = (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)
        return fits


def site_glob(rule: str) -> str:
    """The glob of a site rule, host and start of the path: it fits the host and all its subdomains. Addresses
    start with a dot, and a single star stays inside the host."""
    host, slash, path = rule.partition("/")
    literal = "".join("\\" + c if c in "*?[\\" else c for c in f".{host}{slash}{path}")
    return f"*{literal}**" if slash else f"*{literal}"


def longest_first(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules in the order in which they decide: longest first, among equals those that allow."""
    return sorted(dict.fromkeys(rules), key=lambda r: (-len(r[1]), r[0] != ALLOW, r[1]))


def deciding_globs(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Globs in the order in which they decide: longest first, among equals the last in code-point order; of one glob
    given twice the one that allows."""
    return sorted(dict.fromkeys(rules), key=lambda r: (len(r[1]), r[1], r[0] == ALLOW), reverse=True)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and query with its question mark, as they stand after the first ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path, query = F.regexp_extract(tail, r"^[^?#]*", 0), F.regexp_extract(tail, r"^[^?#]*(\?[^#]*)?", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path, query


def judge_urls(
    pages: DataFrame, site_rules: Sequence[tuple[str, str]] = SITE_RULES, glob_rules: Sequence[tuple[str, str]] = GLOB_RULES, default: str = DEFAULT
) -> DataFrame:
    """``page_id, host, path, rule, pattern, verdict`` of every row of ``pages``.

    The canonical address of a url is a dot, its host in lower case, its path and its query; scheme and fragment
    do not count. Site rules and globs run over it in one automaton. The longest site rule that fits decides
    (``rule``), among those of one length one that allows; where none fits the longest glob does (``pattern``), among
    those of one length the last in code-point order; else ``default``.

    Null url, or one without ``://``: host and path are empty, only globs that fit a lone dot could decide. Null
    page_id and repeated rows are returned like others. Empty table: no rows. Other columns are not read. Urls
    of any length are walked whole, in blocks of bounded size.
    """
    sites, globs = longest_first(site_rules), deciding_globs(glob_rules)
    host, path, query = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    rows = rows.select("page_id", "host", "path", F.concat(F.lit("."), "host", "path", "query").alias("address"))
    texts = [StructField(name, StringType()) for name in ("host", "path", "rule", "pattern", "verdict")]
    schema = StructType([rows.schema["page_id"], *texts])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton([*(site_glob(rule) for _, rule in sites), *(glob for _, glob in globs)])
        rules, patterns = (pa.array([*(r[1] for r in group), None], pa.string()) for group in (sites, globs))
        verdicts = pa.array([*(v for v, _ in sites), *(v for v, _ in globs), default])
        for batch in batches:
            for row, end, data, bounds in bytetext.pieces(batch.column(3)):
                fits = automaton.run(data, bounds)
                never = np.ones((end - row, 1), bool)
                site = np.argmax(np.hstack([fits[:, : len(sites)], never]), axis=1)
                glob = np.argmax(np.hstack([fits[:, len(sites) :], never]), axis=1)
                glob[site < len(sites)] = len(globs)
                decides = np.where(site < len(sites), site, len(sites) + glob)
                made = [rules.take(pa.array(site)), patterns.take(pa.array(glob)), verdicts.take(pa.array(decides))]
                yield pa.RecordBatch.from_arrays([*(c[row:end] for c in batch.columns[:3]), *made], schema.names)

    return rows.mapInArrow(judge, schema)
