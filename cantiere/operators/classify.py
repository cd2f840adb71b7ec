"""Classification and scoring of whole tables.

Each step first puts what it needs of a text into a column of its own: the distinct terms of all its
rule tables that occur in the normalised text.  Every text is normalised and searched once per row,
however many rules read it.  Rule tables of a few terms are searched in the normalised text itself, by
generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions.text import lower_text, squeeze
from cantiere.operators.scale import computed_once

#: Distinct terms up to which the rules search the text themselves.
FEW_TERMS = 16


def with_segments(df: DataFrame, text_columns: Sequence[str], category: str = "category",
                  terms: R.Rules = P.SEGMENT_TERMS, weights: Mapping[str, int] = P.SEGMENT_WEIGHTS,
                  reduced: bool = False) -> DataFrame:
    """Add ``segment_tags`` (heaviest first) and ``primary_segment``."""
    words = R.distinct_terms(terms, [] if reduced else P.ENVIRONMENT_UTILITY_TERMS)
    text = lower_text(*[F.col(c) for c in text_columns])
    few = len(words) <= FEW_TERMS
    staged = computed_once(df, {"_found": text if few else R.found_terms(text, words), "_category": F.lower(squeeze(F.col(category)))})
    searched = F.col("_found") if few else R.Matched(F.col("_found"), words)
    tags = D.segments(searched, F.col("_category"), terms, weights, reduced)
    return staged.withColumn("segment_tags", tags).withColumn(
        "primary_segment", F.get("segment_tags", F.lit(0))).drop("_found", "_category")


def with_operational_score(df: DataFrame, macro: Column, full: bool = True, **steps) -> DataFrame:
    """Add ``operational_score``; the reduced variant leaves out year and status."""
    upper = lambda c: F.upper(squeeze(F.col(c)))
    staged = df.withColumns({"_client": upper("client"), "_place": upper("municipality"),
                             "_category": squeeze(F.col("category")), "_macro": macro})
    extra = {}
    if full:
        staged = staged.withColumn("_status", upper("status"))
        extra = dict(year=F.col("year"), status=F.col("_status"))
    score = D.operational_score(F.col("primary_segment"), F.col("value_eur"), F.col("_client"), F.col("_place"),
                                F.col("_category"), F.col("_macro"), F.col("cup"), F.col("source_url"), **extra, **steps)
    out = computed_once(staged, {"operational_score": score})
    return out.drop("_client", "_place", "_category", "_macro", "_status")


def with_categories(df: DataFrame, text_columns: Sequence[str], rules: R.Rules = P.NATIONAL_CATEGORIES) -> DataFrame:
    """Add ``category`` and ``intervention_type`` from the joined text."""
    words = R.distinct_terms(rules, P.INTERVENTION_TYPES)
    staged = computed_once(df, {"_found": R.found_terms(lower_text(*[F.col(c) for c in text_columns]), words)})
    text = R.Matched(F.col("_found"), words)
    return staged.withColumns({
        "category": D.category(text, rules), "intervention_type": D.intervention_type(text),
    }).drop("_found")
