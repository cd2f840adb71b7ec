"""Column functions on literal edge cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions import text as T
from cantiere.functions import values as V


def apply(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_whitespace_and_sentinels(spark):
    values = [" a  b\t c ", "N.D.", "nd", "****", "-", "NO", "Noto", "", None, "   "]
    assert apply(spark, values, T.squeeze)[0] == "a b c"
    assert apply(spark, values, T.known) == ["a b c", None, None, None, None, None, "Noto", None, None, None]


def test_repair(spark):
    assert apply(spark, ["cittÃ  “nuova” – l’asilo", "perchÃ¨ \u0092x\u0092"], T.repair) == ["città \"nuova\" - l'asilo", "perchè 'x'"]


def test_money(spark):
    values = ["1.234.567,89", "1234.5", "1,234", "€ 10", "", "abc", "1d", "nan", None, "79998822.0", "1e3", "10 &euro;"]
    assert apply(spark, values, V.money) == [1234567.89, 1234.5, 1.234, 10.0, None, None, None, None, None, 79998822.0, 1000.0, 10.0]


def test_geo_key_and_headers(spark):
    assert apply(spark, ["Forlì-Cesena", "Valle d'Aosta", " à  b "], T.geo_key) == ["FORLÌ CESENA", "VALLE D AOSTA", "À B"]
    assert T.header_key("﻿Den. Regione ") == "den_regione"
    assert T.find_column(["Codice CIG (gara)", "x"], ["cig"]) == "Codice CIG (gara)"
    assert T.find_column(["a_cig", "CIG"], ["cig"]) == "CIG"
    assert T.find_column(["a_cig"], ["cig"], partial=False) is None


def test_first_present_prefers_values(spark):
    df = spark.createDataFrame([("", "b", "c"), ("a", "b", None), (" ", " ", "c")], "`Stato Progetto` string, stato string, `stato cup extra` string")
    assert [r[0] for r in df.select(T.first_present(df, ["stato progetto", "stato"])).collect()] == ["b", "a", "c"]


def test_codes_and_years(spark):
    values = ["codice F24H20000820001 x", "corto", "ABCD40", "ABCD41", "ABCDxy", None, "ND"]
    assert apply(spark, values, V.code) == ["F24H20000820001", "corto", "ABCD40", "ABCD41", "ABCDxy", None, None]
    assert apply(spark, values[2:6], V.code_year) == [2040, 1941, None, None]
    assert apply(spark, ["x | Anno decisione: 2019", "anno DECISIONE:2020", "Anno decisione:"], V.labelled_year) == [2019, 2020, None]
    assert apply(spark, ["I-123", "1234567", "", "abc"], V.postal_code) == ["00123", "1234567", None, None]


def test_dates(spark):
    values = ["2024-02-29", "29/2/2024", "2024-13-01", "", None, "31/12/99", "2023-2-29"]
    day = datetime.date(2024, 2, 29)
    assert apply(spark, values, V.parse_date) == [day, day, None, None, None, None, None]
    assert apply(spark, ["20240229"], lambda c: V.parse_date(c, ["yyyyMMdd"])) == [day]


def test_composite(spark):
    out = apply(spark, ["t", "t*l", "t * l * d", "t*l*d*e", "*l", "t*l*", None], V.composite)
    assert [tuple(r) for r in out] == [
        ("t", None, "t"), ("t", "l", "t*l"), ("t", "l", "d"), ("t", "l", "d"), (None, "l", "*l"), ("t", "l", None), (None, None, None)]


def test_lists(spark):
    assert apply(spark, ["a | b||  c ", "", None], V.pipe_list) == [["a", "b", "c"], [], []]
    pairs = apply(spark, ["a|b"], lambda c: V.pipe_pairs(c, F.lit("1")))[0]
    assert [tuple(p) for p in pairs] == [("a", "1"), ("b", None)]
    flagged = lambda c: V.first_flagged([F.lit("x"), c, F.lit("PRIVATA")], P.FUNDING_WORDS)
    assert apply(spark, [" Statale ", "zzz", None], flagged) == ["Statale", "PRIVATA", "PRIVATA"]


def test_status_person_slug(spark):
    assert apply(spark, ["Italia", "in Attivo", "boh", None], D.clean_status) == [None, "IN ATTIVO", None, None]
    assert apply(spark, ["Mario Rossi", "27.5", "Mario", "a 1", "È Ù", None], T.person_name) == [True, False, False, False, True, False]
    assert apply(spark, ["Forlì  d'Arno!", "ambigua", "Non assegnata", "", "€€"], T.slug) == [
        "Forli_d_Arno", "AMBIGUA", "NON_ASSEGNATA", "NON_ASSEGNATA", "NON_ASSEGNATA"]


def test_contains_any_forms_agree(spark):
    terms = ["ers", "rsa", "asilo nido", "asilo", "via", "ponte"]
    texts = ["persona", "asilo nido", "un ponte", "niente", None, "corsa via"]
    brute = [t is not None and any(w in t for w in terms) for t in texts]
    assert apply(spark, texts, lambda c: R.contains_any(c, terms)) == brute
    assert apply(spark, texts, lambda c: R.contains_any(c, terms[:2])) == [t is not None and any(w in t for w in terms[:2]) for t in texts]
    assert apply(spark, texts, lambda c: R.contains_any(c, terms, word_boundary=True)) == [False, True, True, False, False, True]


def test_taxonomy_first_wins(spark):
    assert apply(spark, ["scuola e palestra", "palestra", "persona", "xyz"], D.category) == [
        "Scuole / formazione", "Sport / impianti sportivi", "Residenziale pubblico / ERS", "Altro"]


@pytest.mark.parametrize("text,category,reduced,want", [
    ("verde", "riqualificazione urbana", False, ["Verde"]),
    ("niente", "riqualificazione urbana", False, ["Edilizia"]),
    ("verde", "riqualificazione urbana", True, ["Edilizia", "Verde"]),
    ("acquedotto", "ambiente / rifiuti / depurazione", False, ["Impiantisti sottoservizi"]),
    ("niente", "ambiente / rifiuti / depurazione", False, ["Bonifiche e gestione rifiuti"]),
    ("niente", "ambiente / rifiuti / depurazione", True, ["Impiantisti sottoservizi"]),
    ("tetto e fognatura", "x", False, ["Completamento e finitura edifici", "Impiantisti sottoservizi"]),
    ("niente", "x", False, ["Altro"]),
])
def test_segments(spark, text, category, reduced, want):
    terms = P.REDUCED_SEGMENT_TERMS if reduced else P.SEGMENT_TERMS
    df = spark.createDataFrame([(text, category)], "t string, c string")
    assert df.select(D.segments(F.col("t"), F.col("c"), terms, P.SEGMENT_WEIGHTS, reduced)).first()[0] == want


def test_value_steps_both_sides(spark):
    for edge, points in P.OPERATIONAL_VALUE_STEPS:
        got = apply(spark, [edge, edge - 0.01], lambda c: R.steps(c, P.OPERATIONAL_VALUE_STEPS, P.OPERATIONAL_VALUE_BELOW), "double")
        assert got[0] == points and got[1] != points


def test_ratio_edges(spark):
    ratios = [0.004999, 0.005, 0.00999, 0.01, 0.0999, 0.10, 0.4999, 0.50, 1.50, 1.50001]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ratios)], "i int, a double").orderBy("i")
    one = F.lit(1.0)
    rows = df.select(D.award_weight(F.col("a"), one), D.ratio_check(F.col("a"), one)["status"]).collect()
    minor, sig, lot, main = "Affidamento minore", "Lotto / servizio significativo", "Lotto rilevante", "Appalto principale / molto rilevante"
    assert [r[0] for r in rows] == [minor, minor, minor, sig, sig, lot, lot, main, main, main]
    assert [r[1] for r in rows] == ["anomalia"] + ["ok"] * 8 + ["anomalia"]
    bad = spark.range(1).select(D.award_weight(F.lit(5.0), F.lit(0.0)), D.ratio_check(F.lit(5.0), F.lit(None).cast("double"))["note"]).first()
    assert tuple(bad) == ("Non valutabile", P.RATIO_NOTES["missing"])


def quality_of(spark, **kw):
    row = dict(title="x", year=2020, has=True, n=1, value=0.0, branch="B") | kw
    df = spark.createDataFrame([tuple(row.values())], "title string, year int, has boolean, n int, value double, branch string")
    q = D.quality(F.col("title"), F.col("year"), F.col("has"), F.col("n"), F.col("value"), F.col("branch"))
    return df.select(q.alias("q")).first()[0]


def test_quality(spark):
    assert quality_of(spark)["commercial_score"] == 75 and quality_of(spark)["data_reliability"] == "ALTA"
    assert quality_of(spark, n=3)["commercial_score"] == 81
    assert quality_of(spark, n=9)["commercial_score"] == 87
    bad = quality_of(spark, title="verde pubblico", year=2010, has=False, n=0, value=2e8, branch="AMBIGUA")
    assert bad["quality_flags"] == ["NO_ANAC_MATCH", "OLD_CUP", "GENERIC_OR_MAINTENANCE_TITLE", "HIGH_VALUE_WITHOUT_ANAC", "OLD_HIGH_VALUE",
                                    "VALUE_SUSPICIOUS", "BRANCH_AMBIGUOUS"]
    assert bad["commercial_score"] == 0 and bad["data_reliability"] == "BASSA"
    unknown = quality_of(spark, year=None, branch=None)
    assert unknown["quality_flags"] == ["CUP_YEAR_UNKNOWN", "BRANCH_MISSING"]


def test_missing_value_scores(spark):
    """A missing value costs points in the national score only."""
    none = F.lit(None).cast("string")
    v2 = D.commercial_score_v2(none, F.lit(None).cast("double"), F.lit("p"), F.lit("i"), none, none, none, none)
    v1 = D.commercial_score_v1(F.lit("x"), none, F.lit(None).cast("double"), F.lit("Programmazione"), none, none, none, none, none, none, none, none, F.lit("d"))
    assert tuple(spark.range(1).select(v2, v1).first()) == (5, 20)


def test_power(spark):
    from cantiere.operators.pages import power_mw

    assert apply(spark, ["pari a 34,62 MW", "160 MWp", "41.247 kWp", "8200 kW", "8200 kWh", "MW"], power_mw) == [34.62, 160.0, 41.247, 8.2, None, None]
