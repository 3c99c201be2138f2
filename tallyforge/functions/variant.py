"""Tolerant reading of JSON lines held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: largest count that fits the bigint columns.
MAX_COUNT = 9_223_372_036_854_775_807

# The first and the last millisecond of the calendar, years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999

# Numbers above the first are epoch milliseconds, above the second epoch seconds.
MILLIS_ABOVE = 1_000_000_000_000
SECONDS_ABOVE = 100_000_000

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def schema(leaves: list[str], **nested: str) -> str:
    """Struct type with a VARIANT for every dotted path, plus given types for some names.

    Parsing straight into such a struct reads a line once and keeps each value's own type; fields nobody
    asked for are skipped unparsed.
    """
    tree: dict = {}
    for leaf in leaves:
        *parents, last = leaf.split(".")
        node = tree
        for parent in parents:
            node = node.setdefault(parent, {})
        node.setdefault(last, "variant")

    def render(node: dict) -> str:
        fields = [f"`{k}`: {v if isinstance(v, str) else render(v)}" for k, v in node.items()]
        return f"struct<{', '.join(fields)}>"

    return render(_merged(tree, nested))


def _merged(tree: dict, nested: dict[str, str]) -> dict:
    out = dict(tree)
    for path, kind in nested.items():
        node = out
        *parents, last = path.split("__")
        for parent in parents:
            node[parent] = dict(node.get(parent, {}))
            node = node[parent]
        node[last] = kind
    return out


def parse_object(value: Column, struct: str) -> Column:
    """The one JSON object a line consists of, else NULL. The brackets turn text after the object into an
    error, which the parser alone would let pass."""
    items = F.from_json(_bracketed(value), f"array<{struct}>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def with_object(df: DataFrame, name: str, value: Column, struct: str) -> DataFrame:
    """``df`` with ``parse_object`` of ``value`` as a column. The parsed items are a step of their own: in one expression
    the parser runs for their number and once more for the object."""
    parsed = df.withColumn("__items", F.from_json(_bracketed(value), f"array<{struct}>"))
    return parsed.withColumn(name, F.when(F.size("__items") == 1, F.get("__items", F.lit(0)))).drop("__items")


def is_json(value: Column) -> Column:
    """Is the text exactly one JSON value?"""
    items = F.try_parse_json(_bracketed(value))
    return items.isNotNull() & F.try_variant_get(items, "$[1]", "variant").isNull()


def _bracketed(value: Column) -> Column:
    return F.concat(F.lit("["), value, F.lit("]"))


def present(v: Column) -> Column:
    """JSON null counts as absent."""
    return F.when(~F.is_variant_null(v), v)


def first_present(values: list[Column]) -> Column:
    return F.coalesce(*[present(v) for v in values])


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_of(v: Column) -> Column:
    """String value; other types give NULL."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text_at(v: Column, path: str) -> Column:
    return text_of(F.try_variant_get(v, path, "variant"))


def long_of(v: Column) -> Column:
    """Integer number; other types give NULL."""
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def count_of(v: Column) -> Column:
    """Unsigned integer number; other types and negative numbers give NULL."""
    n = long_of(v)
    return F.when(n >= 0, n)


def _digits(text: Column) -> Column:
    plain = F.trim(text)
    wide = F.try_to_number(F.regexp_replace(plain, r"^\+?0*(?=\d)", ""), F.lit("9" * 38))
    number = F.when(F.length(plain) <= 38, F.least(wide, F.lit(MAX_COUNT).cast("decimal(38,0)")))
    return F.when(plain.rlike(r"^\+?[0-9]+$"), number.try_cast("bigint"))


def to_count(v: Column) -> Column:
    """Token count: integer; a fraction is cut and floored at zero; text only if it is a plain unsigned
    integer; booleans are no counts."""
    t = kind(v)
    whole = F.greatest(F.try_variant_get(v, "$", "bigint"), F.lit(0))
    real = F.least(F.greatest(F.try_variant_get(v, "$", "double"), F.lit(0.0)), F.lit(9.2e18))
    return (
        F.when(t == "BIGINT", whole)
        .when(t == "STRING", _digits(F.try_variant_get(v, "$", "string")))
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.floor(real).cast("bigint"))
    )


def pick_count(values: list[Column]) -> Column:
    """First value that is a count. Almost always the first value there is, so the search through all of
    them is kept out of the generated code of the usual case."""
    first = F.coalesce(*values)
    searched = F.get(F.array_compact(F.transform(F.array(*values), to_count)), F.lit(0))
    return F.coalesce(to_count(first), F.when(first.isNotNull(), searched))


def in_calendar(ms: Column) -> Column:
    """Epoch ms of the years 1 to 9999, else NULL: what days and buckets can be computed for."""
    return F.when(ms.between(FIRST_MS, LAST_MS), ms)


def epoch_ms(n: Column) -> Column:
    """Epoch ms of the years up to 9999. The bounds stand for seconds and for milliseconds, so that ``n``, which may
    be costly, is read as few times as can be."""
    return F.when(n <= SECONDS_ABOVE, None).when(n <= MILLIS_ABOVE, F.when(n <= LAST_MS // 1000, n * 1000)).when(n <= LAST_MS, n)


def parse_rfc3339(text: Column) -> Column:
    """Epoch ms of a timestamp with an offset, else NULL."""
    parsed = F.try_to_timestamp(F.upper(text))
    return F.when(text.rlike(_RFC3339), F.unix_millis(parsed))


def parse_ts_text(text: Column) -> Column:
    """Epoch number in text, RFC 3339, or the leading ``yyyy-MM-ddTHH:mm:ss`` read as UTC. No text is both of the first
    two; what logs mostly hold is tried first, since each further try reads ``text`` again."""
    plain = F.trim(text)
    number = F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))
    as_utc = F.unix_millis(F.try_to_timestamp(F.concat(F.left(plain, F.lit(19)), F.lit("Z"))))
    return F.coalesce(parse_rfc3339(plain), epoch_ms(number), F.when(plain.rlike(_PLAIN), as_utc))


def parse_ts(v: Column) -> Column:
    """Epoch ms from a number (seconds or milliseconds) or text."""
    t = kind(v)
    real = F.try_variant_get(v, "$", "double")
    return (
        F.when(t == "STRING", parse_ts_text(F.try_variant_get(v, "$", "string")))
        .when(t == "BIGINT", epoch_ms(F.try_variant_get(v, "$", "bigint")))
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), epoch_ms(F.when(F.abs(real) < 9e15, real.cast("bigint"))))
    )


def first_text_part(content: Column, part_types: list[str]) -> Column:
    """First non-blank text among the typed parts of a content array."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.when(text_at(p, "$.type").isin(*part_types), text_at(p, "$.text")))
    return F.element_at(F.filter(texts, lambda t: t.rlike(r"[^\p{IsWhite_Space}]")), 1)
