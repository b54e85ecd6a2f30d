"""Scalar expressions: normalising, parsing, classifying. All of them built-in and null-safe."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def r6(c: Column) -> Column:
    """Rounded for comparison between engines; the sum turns a negative zero positive."""
    return F.round(c, 6) + F.lit(0.0)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded above and below; a null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def ticker(c: Column) -> Column:
    """Trimmed, upper case, dots as hyphens; null where blank, longer than 32 or with white space inside."""
    t = F.upper(F.trim(F.translate(c, ".", "-")))
    return F.when((t != "") & (F.length(t) <= 32) & ~t.rlike(r"\s"), t)


def form(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def base_form(c: Column) -> Column:
    return F.regexp_replace(form(c), "/A$", "")


def is_amendment(c: Column) -> Column:
    return form(c).endswith("/A")


def items(c: Column) -> Column:
    """Distinct item numbers (digits, dot, digits) in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!\d)(\d+\.\d+)(?!\d)"), 1))


# What a flag's text may be, by field. Blank is no, but for a plan flag, where it is unknown.
YES, NO = ("Y", "YES", "TRUE", "1"), ("N", "NO", "FALSE", "0")
SPLIT_YES, REVISED_YES = (*YES, "S"), (*YES, "R", "REVISED")


def flag(c: Column, yes: tuple[str, ...] = YES, no: tuple[str, ...] = (*NO, "")) -> Column:
    """True, false, or null for what is neither; blank is false unless ``no`` lacks it."""
    v = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(*yes), F.lit(True)).when(v.isin(*no), F.lit(False))


def number(c: Column, kind: str = "double") -> Column:
    """A non-negative number with optional thousands separators; null where blank, malformed, negative or not finite."""
    v = F.regexp_replace(F.trim(c), ",", "").try_cast(kind)
    return F.when((v >= 0) & (v < F.lit(float("inf"))), v)


def count(c: Column) -> Column:
    """A whole number of digits alone, thousands separators apart, within 64 bits; null for anything else."""
    v = F.regexp_replace(F.trim(c), ",", "")
    return F.when(v.rlike(r"^[0-9]+$"), v.try_cast("long"))


def bad_count(c: Column, required: bool = False) -> Column:
    """Whether a count is malformed (or blank, where it is required): strict readers refuse it."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(required)).otherwise(count(c).isNull())


def bad_flag(c: Column, yes: tuple[str, ...] = YES, no: tuple[str, ...] = (*NO, "")) -> Column:
    """Whether a flag is neither yes nor no: strict readers refuse it."""
    return flag(c, yes, no).isNull() & (F.trim(F.coalesce(c, F.lit(""))) != "")


def bad_number(c: Column, kind: str = "double", required: bool = False) -> Column:
    """Whether a number is malformed, negative or not finite (or blank, where it is required): strict readers refuse it."""
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank, F.lit(required)).otherwise(number(c, kind).isNull())


DATE_FORMATS = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("yyyyMMdd", r"^\d{8}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("dd-MMM-yyyy", r"^\d{2}-[A-Za-z]{3}-\d{4}$"), ("MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"))


def date(c: Column) -> Column:
    """The first of DATE_FORMATS that fits; null where none does."""
    t = F.trim(c)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(F.initcap(t) if "MMM" in f else t, F.lit(f)).cast("date")) for f, shape in DATE_FORMATS])


def instant(c: Column) -> Column:
    """ISO time with offset, or 14 digits of New York wall clock; a time without offset is rejected (null)."""
    iso = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))
    wall = F.when(c.rlike(r"^\d{14}$"), F.to_utc_timestamp(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")), "America/New_York"))
    return F.coalesce(iso, wall)


# Ordered keyword rules of security types, first hit wins.
SECURITY_TYPES = (
    ("warrant", (" warrant",)),
    ("right", (" right",)),
    ("unit", (" - unit", " unit ", " units ")),
    ("preferred", (" preferred ", " preference share")),
    ("adr", (" american depositary share", " american depositary receipt", " american depository share")),
    ("common_stock", (" common stock", " common shares", " ordinary share")),
)

# Name markers of listings that aren't equity.
NON_EQUITY = (" warrant", " right", " - unit", " unit ", " units", " preferred stock", " preferred shares", " preferred ", " preference share", " preference shares", " debt", " debenture", " notes due", " bond")


def security_type(name: Column, etf: Column, next_shares: Column) -> Column:
    n = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    out = F.when(etf == "Y", "etf").when(next_shares == "Y", "nextshares")
    for kind, marks in SECURITY_TYPES:
        hit = n.contains(marks[0])
        for m in marks[1:]:
            hit = hit | n.contains(m)
        out = out.when(hit, kind)
    return out.otherwise("other")


def set_flags(**named: Column) -> Column:
    """Sorted names of what holds; a string value becomes name:value where it isn't blank."""
    parts = []
    for name, c in named.items():
        value = F.trim(c.cast("string"))
        parts.append(F.when(value == "true", F.lit(name)) if name in ("test_issue", "etf", "nextshares") else F.when(value != "", F.concat(F.lit(f"{name}:"), value)))
    return F.array_sort(F.array_compact(F.array(*parts)))


def plain_equity(name: Column, symbol: Column, test: Column, etf: Column, next_shares: Column) -> Column:
    """Ordinary listed equity by its directory row."""
    n = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))))
    marked = F.lit(False)
    for m in NON_EQUITY:
        marked = marked | n.contains(m)
    return (test == "N") & (etf == "N") & (F.coalesce(next_shares, F.lit("")) != "Y") & ~marked & ~symbol.rlike(r"[$^/]") & (F.trim(symbol) != "")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """The whole entity table of HTML; the built-ins know none."""
    return s.map(lambda x: None if x is None else html.unescape(x))


#: References that pages without a full entity table are read by, in the order of their resolution.
REFERENCES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def html_text(c: Column, entities: bool | Sequence[tuple[str, str]] = True, space: str = r"(?U)\s+") -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, entities resolved, white space collapsed; null if nothing is left.

    entities: True for HTML's whole table, which knows references without their semicolon too; pairs for these alone, as they are spelt; False for
    ``REFERENCES``. space: the pattern of what becomes one space."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    if entities is True:
        bare = unescape(bare)
    else:
        for name, sign in entities or REFERENCES:
            bare = F.replace(bare, F.lit(name), F.lit(sign))
    text = F.trim(F.regexp_replace(bare, space, " "))
    return F.when(text != "", text)


def any_pattern(c: Column, patterns) -> Column:
    """Whether some pattern occurs, case ignored and over line ends."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(f"(?is){p}")
    return F.coalesce(out, F.lit(False))


def is_accession(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))


def is_base_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^/\\]+$") & ~c.isin(".", ".."), F.lit(False))


def is_archive_path(c: Column) -> Column:
    """edgar/data/<cik>/<file> without empty or upward parts."""
    return F.coalesce(c.rlike(r"^edgar/data/\d+/[^/\\]+(/[^/\\]+)*$") & ~c.rlike(r"(^|/)\.\.?(/|$)"), F.lit(False))


def is_strategy(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))


def digest(*columns: str) -> Column:
    """SHA-256 of a row as JSON with its keys sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
