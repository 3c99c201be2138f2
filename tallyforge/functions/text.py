"""String rules: folder names, titles, session prefixes and hints taken from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.schema import SESSION_PREFIXES, SOURCE_RELATIONAL

# Fixed values.
TITLE_LIMIT = 300
SESSION_STEM_MIN_LENGTH = 30
INTERRUPTED_MARK = "[Request interrupted"

# White space that a trim removes from both ends.
_EDGE_SPACE = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, _EDGE_SPACE, "")


def non_blank(col: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trimmed(col), F.lit(""))


def folder_name(path: Column) -> Column:
    """Last path segment under either separator, ignoring trailing separators."""
    return non_blank(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1))


def normalize_title(text: Column, reject_interrupted: bool = False) -> Column:
    """A human-written title: trimmed, not blank, not markup, at most 300 characters."""
    body = non_blank(text)
    rejected = body.startswith("<")
    if reject_interrupted:
        rejected = rejected | body.startswith(INTERRUPTED_MARK)
    return F.when(~rejected, F.left(body, F.lit(TITLE_LIMIT)))


def canonical_model_key(model: Column) -> Column:
    """Case-insensitive lookup key; a blank name matches nothing."""
    return F.nullif(F.lower(trimmed(model)), F.lit(""))


def prefix_session(source: Column, session_id: Column) -> Column:
    prefix = F.lit("")
    for name, text in SESSION_PREFIXES.items():
        if text:
            prefix = F.when(source == name, F.lit(text)).otherwise(prefix)
    return F.concat(prefix, session_id)


def split_prefixed(shown_id: Column) -> Column:
    """``struct<source, session_id>`` of a shown id; exactly one prefix is removed."""
    source, raw = F.lit(SOURCE_RELATIONAL), shown_id
    for name, text in SESSION_PREFIXES.items():
        if text:
            hit = shown_id.startswith(text)
            source = F.when(hit, F.lit(name)).otherwise(source)
            raw = F.when(hit, F.substring(shown_id, len(text) + 1, 1 << 30)).otherwise(raw)
    return F.struct(source.alias("source"), raw.alias("session_id"))


# A match tried only where a segment starts, and never given back: time grows with the path, not with its square.
_SEGMENT = r"(?<![^/\\])([^/\\]*+)"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, _SEGMENT + "$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.nullif(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""), F.lit(""))


def parent_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, _SEGMENT + r"[/\\][^/\\]*+$", 1), F.lit(""))


def session_hint(path: Column) -> Column:
    """A file stem long enough to be a session id."""
    stem = file_stem(path)
    return F.when(F.octet_length(stem) >= SESSION_STEM_MIN_LENGTH, stem)


def project_hint(path: Column) -> Column:
    """The segment after the first ``projects`` directory, in any letter case."""
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|[/\\])projects[/\\]+([^/\\]+)", 1), F.lit(""))


def event_log_session(path: Column) -> Column:
    """One directory per session; a flat layout falls back to the file stem."""
    stem = F.nullif(F.regexp_replace(file_stem(path), r"\.jsonl$", ""), F.lit(""))
    parent = parent_name(path)
    return F.coalesce(F.when(parent != "sessions", parent), stem, F.lit("dsh-session"))
