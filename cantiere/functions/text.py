"""Text cleaning columns.

Missing values are SQL ``NULL`` throughout; an empty string coming from a file
becomes ``NULL`` in :func:`blank_to_null`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import presets

# (?U) makes \s Unicode aware; the four separator controls are added by hand.
_SPACES = r"(?U)[\s\x1c-\x1f]+"
# a character that is not printable ASCII, or a blank at the start, at the end or before another one
_UNEVEN = r"[^!-~](?:(?<! )|(?<=\A )|(?= |\z))"


def squeeze(c: Column) -> Column:
    """Collapse every whitespace run to one blank and trim.

    Values that hold nothing to collapse, nearly all, are only searched, which costs a fraction of a replacement.
    """
    c = c.cast("string")
    return F.when(c.rlike(_UNEVEN), F.trim(F.regexp_replace(c, _SPACES, " "))).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def known(c: Column, sentinels: Sequence[str] = presets.MISSING_TOKENS) -> Column:
    """Squeezed value, or NULL for blanks, sentinel words and runs of asterisks."""
    words = "|".join([r"\*+", *(re.escape(s) for s in sentinels)])
    return F.nullif(F.regexp_replace(squeeze(c), rf"(?i)^(?:{words})$", ""), F.lit(""))


def repair(c: Column, table: Sequence[tuple[str, str]] = presets.GLYPH_REPAIRS) -> Column:
    """Replace damaged or typographic glyphs, then squeeze.

    Sequences of several characters are replaced first and in table order; the
    single characters go through one ``translate`` call.
    """
    singles = [(bad, good) for bad, good in table if len(bad) == 1 and len(good) <= 1]
    for bad, good in table:
        if len(bad) > 1 or len(good) > 1:
            c = F.replace(c, F.lit(bad), F.lit(good))
    # translate drops characters that have no counterpart, so those go last
    singles.sort(key=lambda pair: pair[1] == "")
    if singles:
        c = F.translate(c, "".join(b for b, _ in singles), "".join(g for _, g in singles))
    return squeeze(c)


def geo_key(c: Column) -> Column:
    """Comparison key of a place name: upper case letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-ZÀ-ÖØ-Ý0-9]+", " "))


def header_key(name: str, joiner: str = "_") -> str:
    """Comparison key of a column header (plan time, plain string)."""
    key = re.sub(r"[^a-z0-9]+", joiner, name.lower().replace("\ufeff", "").strip())
    return key.strip(joiner) if joiner else key


def lower_text(*cols: Column) -> Column:
    """Lower-cased, squeezed columns joined with blanks; missing parts are left out."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(c) for c in cols]))


def lower_joined(*cols: Column) -> Column:
    """Like :func:`lower_text` for columns that are clean already."""
    return F.lower(F.concat_ws(" ", *cols))


def person_name(c: Column) -> Column:
    """True for values that can be a person: not a number, two words with letters."""
    v = squeeze(c)
    words = F.filter(F.split(v, " "), lambda w: w.rlike(r"\p{L}"))
    return F.coalesce(~v.rlike(r"^[0-9]+([.,][0-9]+)?$") & (F.size(words) >= 2), F.lit(False))


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """ASCII letters of decomposed Latin characters: two strings for single ones, a table for the others."""
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0x2100, 0x2150), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
    plain = {}
    for block in blocks:
        for code in block:
            plain[chr(code)] = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
    single = {c: to for c, to in plain.items() if len(to) == 1}
    return "".join(single), "".join(single.values()), {c: to for c, to in plain.items() if len(to) > 1}


def without_accents(c: Column) -> Column:
    """ASCII text: Latin characters decomposed, ligatures spelt out, everything else dropped."""
    single, to, several = _decompositions()
    v = F.translate(c, single, to)
    spelt = v
    for ligature, letters in several.items():
        spelt = F.replace(spelt, F.lit(ligature), F.lit(letters))
    v = F.when(v.rlike(f"[{''.join(several)}]"), spelt).otherwise(v)
    return F.regexp_replace(v, r"[^\x00-\x7f]", "")


def slug(c: Column) -> Column:
    """File-name slug: accents decomposed, other runs to ``_``, fixed sentinels in capitals."""
    v = F.coalesce(blank_to_null(c), F.lit(presets.UNASSIGNED))
    s = F.regexp_replace(F.regexp_replace(without_accents(v), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    fallback = F.lit(presets.UNASSIGNED.replace(" ", "_"))
    return (
        F.when(F.lower(v).isin("non assegnata", "non_assegnata"), fallback)
        .when(F.lower(v) == "ambigua", F.lit(presets.AMBIGUOUS))
        .otherwise(F.coalesce(F.nullif(s, F.lit("")), fallback))
    )


def display_name(c: Column, fixes: dict[str, str]) -> Column:
    """Replace misspelt names by the given fixes."""
    out = F.lit(None).cast("string")
    v = squeeze(c)
    for bad, good in fixes.items():
        out = F.coalesce(out, F.when(v == bad, F.lit(good)))
    return F.coalesce(out, v)


# -- column resolution ------------------------------------------------------

def find_column(columns: Iterable[str], candidates: Sequence[str], partial: bool = True) -> str | None:
    """Header lookup: exact normalised name in candidate order, else first header
    whose normalised name contains a candidate."""
    keyed = {header_key(name, ""): name for name in columns}
    wanted = [header_key(c, "") for c in candidates]
    for key in wanted:
        if key in keyed:
            return keyed[key]
    if partial:
        for key, name in keyed.items():
            if any(w and w in key for w in wanted):
                return name
    return None


def first_present(df: DataFrame, candidates: Sequence[str], partial: bool = True) -> Column:
    """Row-wise lookup: first non-blank value among the headers that match exactly
    (candidate order), then among those that contain a candidate (header order)."""
    keyed = {header_key(name): name for name in df.columns}
    wanted = [header_key(c) for c in candidates]
    order = [keyed[w] for w in wanted if w in keyed]
    if partial:
        order += [n for k, n in keyed.items() if n not in order and any(w and w in k for w in wanted)]
    if not order:
        return F.lit(None).cast("string")
    return F.coalesce(*[blank_to_null(F.col(f"`{n}`").cast("string")) for n in order])


def first_alias(df: DataFrame, *names: str) -> Column:
    """First non-blank among the named columns that exist."""
    present = [n for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[blank_to_null(F.col(f"`{n}`").cast("string")) for n in present])
