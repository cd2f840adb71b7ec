"""Feature extraction from a table of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions.text import blank_to_null, squeeze
from cantiere.operators.dedupe import top_per_key

_INVISIBLE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _unescape(c: Column) -> Column:
    for bad, good in _ENTITIES:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def _tags_off(c: Column) -> Column:
    return squeeze(_unescape(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    return _tags_off(F.regexp_replace(html, _INVISIBLE, " "))


def first_heading(html: Column) -> Column:
    inner = F.regexp_extract(F.regexp_replace(html, _INVISIBLE, " "), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return F.nullif(_tags_off(inner), F.lit(""))


def find_first(c: Column, pattern: str) -> Column:
    """First group of a case-insensitive pattern, squeezed; NULL without match."""
    return blank_to_null(F.regexp_extract(c, f"(?i){pattern}", 1))


def power_mw(text: Column) -> Column:
    """Power in MW: a figure in MW(p), else one in kW(p) divided by 1000."""
    t = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    figure = lambda unit: F.nullif(
        F.regexp_extract(t, rf"(?iU)([0-9]+(?:\.[0-9]+)?)\s*{unit}p?\b", 1), F.lit("")
    ).try_cast("double")
    return F.coalesce(figure("MW"), F.bround(figure("kW") / 1000, 3))


def after_label(text: Column, label: str, labels: Sequence[str]) -> Column:
    """Text after a label up to the next of the labels."""
    stop = "|".join(re.escape(x) for x in labels)
    return find_first(text, rf"{re.escape(label)}\s+(.+?)(?:\s+(?:{stop})\s+|$)")


def labelled_fields(df: DataFrame, text: str, fields: dict[str, str], labels: Sequence[str] = P.DETAIL_LABELS) -> DataFrame:
    """One column per (name, label)."""
    return df.withColumns({name: after_label(F.col(text), label, labels) for name, label in fields.items()})


def links(html: Column, pattern: str, base: str = "") -> Column:
    """Sorted distinct absolute link targets that match the pattern."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    kept = F.filter(found, lambda u: u.rlike(pattern))
    absolute = F.transform(kept, lambda u: F.when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(u))
    return F.array_sort(F.array_distinct(absolute))


def environment_phase(text: Column) -> Column:
    """Procedure phase of an environmental page (lower-case text)."""
    has = lambda *words: R.contains_any(text, words)
    return (
        F.when(has("verifica di assoggettabilità"), "verifica assoggettabilità VIA")
        .when(has("valutazione di impatto ambientale", "procedura di via", "via"), "VIA")
        .when(has("provvedimento") & has("positivo"), "provvedimento positivo")
        .when(has("osservazioni"), "osservazioni")
        .when(has("integrazioni"), "richiesta integrazioni")
        .otherwise("procedura ambientale")
    )


def page_features(pages: DataFrame, id_pattern: str, id_prefix: str, url: str = "url", html: str = "html",
                  sectors: R.Rules = P.ENERGY_SECTORS, default_sector: str = P.DEFAULT_ENERGY_SECTOR,
                  description_length: int = 900) -> DataFrame:
    """Project record of every page.  All rules read the whole text; only the displayed
    description is cut."""
    base = pages.withColumns({"_text": visible_text(F.col(html)), "_h1": first_heading(F.col(html))})
    text, low = F.col("_text"), F.lower(F.col("_text"))
    page_id = F.nullif(F.regexp_extract(F.col(url), id_pattern, 1), F.lit(""))
    external = F.concat(F.lit(id_prefix), page_id)
    first = lambda patterns: F.coalesce(*[find_first(text, p) for p in patterns])
    town, proponent = first(P.PAGE_MUNICIPALITY), first(P.PAGE_PROPONENT)
    return base.withColumns({
        "external_id": external,
        "title": F.coalesce("_h1", find_first(text, P.PAGE_TITLE),
                            F.concat_ws(" ", F.lit("Progetto"), external)),
        "description": blank_to_null(F.substring(text, 1, description_length)),
        "province": find_first(text, P.PAGE_PROVINCE),
        "municipality": town,
        "sector": R.first_match(low, sectors, default_sector),
        "intervention_type": F.when(F.contains(low, F.lit("realizzazione")), F.lit("nuova costruzione")),
        "phase": environment_phase(low),
        "client": proponent,
        "client_type": F.when(proponent.isNotNull(), F.lit("privato")),
        "power_mw": power_mw(text),
    }).drop("_text", "_h1")


def dedupe_pages(features: DataFrame, order: Sequence[Column], url: str = "url") -> DataFrame:
    """One record per id, url or title."""
    key = F.coalesce(F.col("external_id"), F.col(url), F.col("title"))
    return top_per_key(features.withColumn("_key", key), ["_key"], order).drop("_key")
