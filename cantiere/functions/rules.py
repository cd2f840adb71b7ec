"""Rule tables as columns: containment, first match, multi label, points, bands, flags."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Mapping[str, Sequence[str]]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a costly expression once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Matched:
    """Terms found in a text, taken once for many rule tables; stands for the text in every rule function."""

    def __init__(self, found: Column, searched: Sequence[str]):
        self.found, self.searched = found, frozenset(searched)

    def has(self, terms: Sequence[str]) -> Column:
        unknown = [t for t in terms if t not in self.searched]
        if unknown:
            raise ValueError(f"terms that were not searched: {unknown}")
        return F.arrays_overlap(self.found, F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))


def distinct_terms(*tables: Rules | Sequence[str]) -> list[str]:
    """All distinct terms of rule tables and term lists."""
    lists = [words for t in tables for words in (t.values() if isinstance(t, Mapping) else [t])]
    return sorted({word for words in lists for word in words})


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """Array of the terms inside the text: one search per distinct term, whatever the number of tables."""
    words = F.array(*[F.lit(t) for t in terms])
    # the text is bound once, not evaluated per term
    found = F.flatten(F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.filter(words, lambda w: F.contains(t, w))))
    return F.coalesce(found, F.array().cast("array<string>"))


def contains_any(text: Column | Matched, terms: Sequence[str], word_boundary: bool = False) -> Column:
    """Substring test against a term list; ``text`` must already be in the terms' case.

    Terms that contain another term of the list cannot change the answer and are left out.  Short
    lists are a chain of ``contains`` inside generated code; longer ones loop over a
    constant array, which measured faster than the chain and than a regex alternation.
    """
    if isinstance(text, Matched):
        return text.has(terms)
    if word_boundary:
        pattern = "|".join(re.escape(t) for t in terms)
        return F.coalesce(text.rlike(rf"(?U)(?<!\w)(?:{pattern})(?!\w)"), F.lit(False))
    needed = list(dict.fromkeys(t for t in terms if not any(o != t and o in t for o in terms)))
    if len(needed) <= 4:
        found = any_of([F.contains(text, F.lit(t)) for t in needed])
    else:
        words = F.array(*[F.lit(t) for t in needed])
        found = F.exists(F.array(text), lambda t: F.exists(words, lambda w: F.contains(t, w)))
    return F.coalesce(found, F.lit(False))


def first_match(text: Column | Matched, rules: Rules, default: str | None = None) -> Column:
    """Label of the first rule, in table order, with a term inside the text."""
    out = None
    for label, terms in rules.items():
        hit = contains_any(text, terms)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default).cast("string"))


def ranked_labels(flags: Mapping[str, Column], weights: Mapping[str, int], fallback: str | Column = "Altro") -> Column:
    """Array of the labels whose flag holds, heaviest first (name breaks ties).

    Written without lambda functions, so that it and the flags stay in generated code.
    """
    order = sorted(flags, key=lambda name: (-weights.get(name, -10), name))
    none = F.lit("")
    found = [F.when(flags[n], F.lit(n)).otherwise(none) for n in order]
    other = F.when(any_of([flags[n] for n in order]), none).otherwise(fallback)
    return F.array_remove(F.array(*found, other), "")


def lookup(c: Column, table: Mapping, default=None) -> Column:
    """Small literal dictionary."""
    if not table:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def steps(c: Column, table: Sequence[tuple[float, object]], below) -> Column:
    """Value of the first threshold (descending) reached by the column."""
    out = None
    for threshold, value in table:
        hit = c >= F.lit(threshold)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(below))


def points(condition: Column, yes: int, no: int = 0) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def score(*terms: Column, low: int = 0, high: int = 100) -> Column:
    """Sum of terms, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), reduce(add, terms)))


def flags(conditions: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))


def labelled_bands(edges: Sequence[tuple[float, str]], below: str) -> Callable[[Column], tuple[Column, Column]]:
    """Return a function giving (band label, band order) for a value column."""
    ordered = list(edges)

    def apply(value: Column) -> tuple[Column, Column]:
        v = F.coalesce(value, F.lit(0.0))
        order = [(t, i + 1) for i, (t, _) in enumerate(ordered)]
        return steps(v, ordered, below), steps(v, order, len(ordered) + 1)

    return apply
