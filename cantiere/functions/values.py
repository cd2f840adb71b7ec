"""Typed parsing of text columns: money, codes, years, dates, composite values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantiere.functions.text import blank_to_null, known, squeeze

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def money(c: Column) -> Column:
    """Locale decimal: with a comma present dots are thousands, otherwise commas are."""
    t = F.translate(F.replace(c, F.lit("&euro;"), F.lit("")), "€ \u00a0\t\r\n", "")
    t = F.when(
        F.contains(t, F.lit(",")),
        F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
    ).otherwise(t)
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def exact_sum(c: Column) -> Column:
    """Order-independent sum of a money column, returned as double."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def percentage(part: Column, whole: Column, digits: int | None = None) -> Column:
    """Share in percent, 0 for an empty whole; rounded half-even when digits is given."""
    share = F.coalesce(F.try_divide(F.lit(100.0) * part, whole.cast("double")), F.lit(0.0))
    return share if digits is None else F.bround(share, digits)


def zero_pad(c: Column, width: int) -> Column:
    """Left-pad with zeros without ever cutting longer values."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def code(c: Column, pattern: str = "[A-Z0-9]{15}") -> Column:
    """First match of the code pattern, or the known value when nothing matches."""
    v = known(c)
    return F.coalesce(F.nullif(F.regexp_extract(v, pattern, 0), F.lit("")), v)


def code_year(c: Column, pivot: int = 40) -> Column:
    """Year from characters 5-6 of a project code."""
    two = F.substring(squeeze(c), 5, 2)
    n = two.try_cast("int")
    return F.when(two.rlike("^[0-9]{2}$"), F.when(n <= pivot, n + 2000).otherwise(n + 1900))


def labelled_year(c: Column, label: str = "Anno decisione") -> Column:
    """Four-digit year that follows a label in free text."""
    found = F.regexp_extract(squeeze(c), rf"(?i)\Q{label}\E:\s*(\d{{4}})", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def postal_code(c: Column, width: int = 5) -> Column:
    digits = F.regexp_replace(c, r"\D+", "")
    return zero_pad(F.nullif(digits, F.lit("")), width)


_ISO, _DAY_FIRST = "yyyy-M-d", "d/M/yyyy"


def parse_date(c: Column, formats: Sequence[str] = (_ISO, _DAY_FIRST)) -> Column:
    """First format that fits; NULL when none does.

    The two usual formats are rearranged to ISO and cast, which is much cheaper on non-matching
    rows than the pattern parser.
    """
    v = squeeze(c)
    if tuple(formats) == (_ISO, _DAY_FIRST):
        iso = F.regexp_replace(v, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$2-$1")
        return F.when(iso.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), iso.try_cast("date"))
    return F.coalesce(*[F.try_to_date(v, f) for f in formats])


def composite(c: Column, separator: str = "*") -> Column:
    """Split ``title*location*description`` into a struct.

    A missing description falls back to the whole value.
    """
    v = blank_to_null(c)
    parts = F.split(v, rf"\Q{separator}\E")
    piece = lambda i: blank_to_null(F.get(parts, F.lit(i)))
    return F.struct(
        piece(0).alias("title"),
        piece(1).alias("location"),
        F.when(F.size(parts) > 2, piece(2)).otherwise(v).alias("description"),
    )


def joined_or(parts: Sequence[Column], fallback: Column) -> Column:
    """Non-blank parts joined with blanks, or the fallback."""
    text = F.concat_ws(" ", *[blank_to_null(p) for p in parts])
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def first_flagged(cols: Sequence[Column], allowed: Sequence[str]) -> Column:
    """First column value whose upper case is one of the allowed words."""
    hits = F.filter(F.array(*cols), lambda x: F.upper(squeeze(x)).isin(*allowed))
    return squeeze(F.get(hits, F.lit(0)))


def pipe_list(c: Column) -> Column:
    """Split ``A | B`` into a trimmed array without blanks; NULL gives an empty array."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), squeeze)
    return F.filter(items, lambda x: x != "")


def pipe_pairs(first: Column, second: Column, first_name: str = "name", second_name: str = "tax") -> Column:
    """Pair two pipe lists by position; the first list decides the length."""
    a, b = pipe_list(first), pipe_list(second)
    return F.transform(
        a, lambda x, i: F.struct(x.alias(first_name), F.get(b, i).alias(second_name))
    )


def pipe_text(c: Column) -> Column:
    """Array back to ``A | B`` text, for delimited sinks."""
    return F.array_join(c, " | ")


def gated(cols: Sequence[str], evidence: Column) -> dict[str, Column]:
    """Columns kept only where evidence holds; use with ``withColumns``."""
    ok = F.coalesce(evidence, F.lit(False))
    return {name: F.when(ok, F.col(name)) for name in cols}


def has_text(c: Column) -> Column:
    """True when the column holds something other than blanks."""
    return F.coalesce(c.cast("string").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
