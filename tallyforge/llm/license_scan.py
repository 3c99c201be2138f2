"""Licence notices and identifier tags in documents.

One Aho-Corasick automaton finds all phrases in one pass over a text's words; text after an identifier tag
is read as a licence expression (``and``, ``or``, ``with``, parentheses) as far as one goes, by a shunting-yard parser.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The contract's base phrases.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notice phrases, words in lower case.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons": "cc",
    "public domain": "public-domain",
}

# Identifiers that may stand in a licence expression, with their label.
IDENTIFIERS = {
    "0bsd": "bsd", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc", "mit": "mit", "apache-2.0": "apache",
    "zlib": "zlib", "unlicense": "public-domain", "cc0-1.0": "public-domain", "mpl-2.0": "mpl", "epl-2.0": "epl",
    "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl",
    "gpl-2.0": "gpl", "gpl-2.0-only": "gpl", "gpl-2.0-or-later": "gpl", "gpl-3.0": "gpl", "gpl-3.0-only": "gpl",
    "gpl-3.0-or-later": "gpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl", "cc-by-4.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd",
}

# How much a label restricts use, from 0 (not at all) to 1.
RESTRICTION = {
    "public-domain": 0.1, "mit": 0.2, "isc": 0.2, "bsd": 0.2, "zlib": 0.2, "apache": 0.25, "cc": 0.3, "cc-by": 0.3,
    "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9,
    "reserved": 1.0,
}
UNKNOWN_IDENTIFIER = 1.0
EXCEPTION_RELIEF = 0.2  # what a "with" exception takes off

TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier[^\S\n]*:([^\n]*?)(?=$|(spdx-license-identifier[^\S\n]*:))", re.IGNORECASE | re.MULTILINE)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """Operands and operators in postfix order; None if ``text`` is no whole expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in TOKEN.findall(text):
        word = token.lower()
        if word == "(":
            if not operand_next:
                return None
            waiting.append(word)
        elif word == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif word in PRECEDENCE:
            if operand_next:
                return None
            while waiting and PRECEDENCE.get(waiting[-1], 0) >= PRECEDENCE[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def leading_expression(text: str, more: bool = False) -> list[str] | None:
    """Postfix order of the longest expression at the start of ``text``, the rest of a tag's line; None if there
    is none. ``more`` says that the line goes on after ``text``.

    Dots and comment marks after an identifier end the expression. Where other text follows, an operator without
    an operand is left out, and so is a word in lower case that is no listed identifier and has no digit, hyphen
    or plus sign: it belongs to the prose. An operator at the end of the line leaves the expression unfinished.
    """
    tokens: list[str] = []
    whole = doubted = 0  # tokens of the longest expression so far, without and with doubtful words at its end
    depth, operand_next, ended = 0, True, False
    for found in TOKEN.finditer(text):
        token = found.group().strip(".-")
        word = token.lower()
        fits = not operand_next if word in (*PRECEDENCE, ")") else operand_next
        if ended or not token or not fits or (word == ")" and not depth):
            more = True
            break
        tokens.append(token)
        if word == "(":
            depth += 1
            continue
        operand_next = word in PRECEDENCE
        depth -= word == ")"
        ended = found.group()[-1] in ".-"
        if not operand_next and not depth:
            doubted = len(tokens)
            if word in IDENTIFIERS or token != word or re.search(r"[0-9+)-]", word):
                whole = doubted
    if operand_next and not more:
        return None
    return parse_expression(" ".join(tokens[: whole if more else doubted]))


def evaluate_expression(postfix: list[str]) -> tuple[float, set[str]]:
    """Restriction of an expression and the labels of its licences.

    With ``or`` the user may choose the freer side, with ``and`` both bind, ``with`` names an exception that
    relieves the licence before it. An identifier not in the list restricts fully and is its own label.
    """
    stack: list[float | str] = []
    labels: set[str] = set()

    def weight(operand: float | str) -> float:
        if not isinstance(operand, str):
            return operand
        label = IDENTIFIERS.get(operand, operand)
        labels.add(label)
        return RESTRICTION.get(label, UNKNOWN_IDENTIFIER)

    for item in postfix:
        if item == "with":
            stack.pop()  # the exception's name
            stack.append(max(0.0, weight(stack.pop()) - EXCEPTION_RELIEF))
        elif item in PRECEDENCE:
            right, left = weight(stack.pop()), weight(stack.pop())
            stack.append(min(left, right) if item == "or" else max(left, right))
        else:
            stack.append(item)
    return weight(stack.pop()), labels


def automaton(phrases: list[str]):
    """All phrases, each between blanks, so that only whole words match."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in phrases:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan_text(text: str, machine) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, places) of one text.

    ``places`` are (phrase, number of its first word), in order.
    """
    words = WORD.findall(text.encode().lower().decode())  # bytes.lower() changes A-Z only
    spaced = f" {' '.join(words)} "
    places, number, counted = [], 0, 0
    for start, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in machine.iter(spaced)):
        number += spaced.count(" ", counted, start)
        counted = start
        places.append((phrase, number))
    base = [(BASE_PHRASES[p], n) for p, n in places if p in BASE_PHRASES]
    labels = {BASE_PHRASES.get(p) or NOTICE_PHRASES[p] for p, _ in places if p != TAG}
    restriction = max([RESTRICTION[label] for label in labels], default=0.0)
    if any(p == TAG for p, _ in places):
        for rest, following in TAG_TEXT.findall(text):
            if (postfix := leading_expression(rest, bool(following))) is not None:
                weight, named = evaluate_expression(postfix)
                restriction = max(restriction, weight)
                labels |= named
    numbers = [n for _, n in base]
    return (
        len(words),
        len(base),
        min(numbers, default=None),
        max(numbers, default=None),
        ",".join(sorted({label for label, _ in base})),
        ",".join(sorted(labels)),
        restriction,
        [{"phrase": p, "word": n} for p, n in places],
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, places array<struct<phrase:string,word:long>>"
)


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: words, base notices, labels, restriction score and all places found.

    Null or empty text: no words, no notices, empty labels, score 0. Repeated rows give repeated rows. Only
    the two named columns are read, so other columns may have any name. A tag that no expression
    follows adds nothing. Texts are scanned whole, one Arrow batch at a time; no shuffle.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    place = pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), place]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton([*BASE_PHRASES, *NOTICE_PHRASES, TAG])
        for batch in batches:
            found = [scan_text(value.as_py() or "", machine) for value in batch.column(1)]
            made = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(scan, SCHEMA)
