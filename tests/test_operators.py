"""Table operators on small literal tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.operators import awards as A
from cantiere.operators import dedupe, geo, jsonflat, link, pages, report, scale, search, sets, shards, snapshot


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lists_per_key_keeps_everything_of_a_hot_key(spark):
    data = [("hot", i % 700) for i in range(2000)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(data, "k string, v int")
    whole = {r["k"]: r["items"] for r in scale.lists_per_key(df, ["k"], F.col("v")).collect()}
    parts = scale.lists_per_key(df, ["k"], F.col("v"), limit=100).collect()
    assert len([p for p in parts if p["k"] == "hot"]) == 7 and [p["part"] for p in parts if p["k"] == "cold"] == [0]
    merged = sorted(v for p in parts if p["k"] == "hot" for v in p["items"])
    assert merged == whole["hot"] == list(range(700)) and whole["cold"] == list(range(5))
    assert {p["n_items"] for p in parts if p["k"] == "hot"} == {700}
    # equal rows do not spread a key: the rule counts distinct items
    same = spark.createDataFrame([("k", 1)] * 1001, "k string, v int")
    assert [tuple(r) for r in scale.lists_per_key(same, ["k"], F.col("v"), limit=3).collect()] == [("k", 0, [1], 1)]


def test_large_tenders_and_projects_lose_nothing(spark):
    """A tender with many contractor rows, a project with many awards: a small limit changes the parts only."""
    people = [("T1", f"N{i % 4}", str(i % 4), None, None) for i in range(11)] + [("T2", "N0", "0", None, None)] * 11
    contractors = spark.createDataFrame(people, "cig string, contractor_name string, contractor_tax_code string, contractor_vat string, contractor_role string")
    whole = {r["cig"]: r["contractors"] for r in link.contractor_profile(contractors, 1000).collect()}
    for limit in (3, 1000):
        parts = link.contractor_profile(contractors, limit).collect()
        assert {k: sorted(c for p in parts if p["cig"] == k for c in p["contractors"]) for k in whole} == whole
        assert {p["cig"]: p["n_contractors"] for p in parts} == {"T1": 4, "T2": 1}
        sets = link.tender_sets(contractors.select(F.lit("P").alias("cup"), F.concat("cig", "contractor_name").alias("cig")), limit).collect()
        assert {s["cig_count"] for s in sets} == {5} and len([c for s in sets for c in s["cigs"]]) == 5
    awards = spark.createDataFrame([("P1", f"T{i:02}", 10.0, True, "2020-01-01", float(i)) for i in range(11)], "cup string, cig string, value_eur double, "
                                   "has_award boolean, award_date string, award_amount_eur double")
    who = F.struct(F.col("cig").alias("name"), F.lit("1").alias("tax"), F.lit(None).cast("string").alias("role"))
    members = awards.select(F.col("cig").alias("set_id"), who.alias("item"))
    raw = awards.withColumns({"contractor_set": F.col("cig"), "contractors_count": F.lit(1), "id": F.lit("x"), "award_share_pct": F.lit(1.0), "award_weight": F.lit("w"), "ratio_note": F.lit("n"), "award_result": F.lit("r")})
    master = A.group_projects(raw, ["cup", "value_eur", "cig"], members)
    assert rows(master, "awards_count", "awards_total_eur", "contractors_count", "cig", "contractors_summary") == [(11, 55.0, 11, "T00", "T00 + altri 10 OE")]
    for limit in (3, 100):
        parts = A.nested(master, raw, limit).collect()
        assert sorted(a["cig"] for p in parts for a in p["awards"]) == [f"T{i:02}" for i in range(11)]
        assert {p["awards_count"] for p in parts} == {11} and (len(parts) > 1) == (limit == 3)


def test_interned_sets(spark):
    """A tender with a third of all rows has bounded rows, equal sets are stored once, order and repeats do not matter."""
    data = [("hot", f"N{i}") for i in range(1000)] + [("copy", f"N{i}") for i in reversed(range(1000))] + [(f"c{i}", x) for i in range(300) for x in ("A", "B", "A")]
    data += [("c9", "C"), ("none", None), (None, "A")]
    df = spark.createDataFrame(data, "k string, v string").repartition(7)
    ids, members = sets.intern(df, ["k"], F.col("v"))
    of = {r["k"]: (r["set_id"], r["n_items"]) for r in ids.collect()}
    assert of["hot"] == of["copy"] and of["hot"][1] == 1000 and of["c0"] == of["c299"] != of["c9"] and "none" not in of and None not in of
    assert len(set(of.values())) == 3 and members.count() == 1000 + 2 + 3
    parts = sets.lists(members, limit=100).collect()
    assert max(len(p["items"]) for p in parts) < 150 and {p["n_items"] for p in parts if p["set_id"] == of["hot"][0]} == {1000}
    assert sorted(x for p in parts if p["set_id"] == of["hot"][0] for x in p["items"]) == sorted(f"N{i}" for i in range(1000))
    # missing fields do not make different contractors equal
    people = spark.createDataFrame([("a", "N", None, "R"), ("b", "N", "R", None)], "k string, name string, tax string, role string")
    assert sets.intern(people, ["k"], F.struct("name", "tax", "role"))[0].select("set_id").distinct().count() == 2


def test_a_tender_with_a_third_of_all_rows(spark):
    n = F.lit(None).cast("string")
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "P0").otherwise(F.concat(F.lit("P"), F.col("id"))).alias("cup"), F.when(F.col("id") % 3 == 0, "T0").otherwise("T1").alias("cig"),
        F.lit(1000.0).alias("value_eur"), F.lit(600.0).alias("award_amount_eur"), F.lit("AGGIUDICATA").alias("award_result"), F.concat(F.lit("N"), F.col("id") % 997).alias("contractor_name"),
        n.alias("contractor_tax_code"), n.alias("contractor_vat"), n.alias("contractor_role"), F.lit("2020-01-01").cast("date").alias("award_date"), F.col("id").alias("pos"))
    c, members = A.consolidate(hot, [F.asc("pos")], min_award=100.0)
    out = A.award_texts(c, members, limit=50).filter("cup = 'P0'").collect()
    names = [x for r in out for x in r["contractors"].split(" | ")]
    assert len(out) == -(-out[0]["contractors_count"] // 50) and len(names) == len(set(names)) == out[0]["contractors_count"] == len({i % 997 for i in range(0, 3000, 3)})
    assert max(len(r["contractors"].split(" | ")) for r in out) < 100


def test_computed_once_is_not_inlined(spark):
    df = scale.computed_once(spark.range(10), {"x": F.sqrt(F.col("id"))}).filter("x > 2")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1 and df.count() == 5


def test_best_award_ties(spark):
    df = spark.createDataFrame(
        [("t", "AGGIUDICATA", "2", 10.0, "2019-01-01", 1), ("t", "AGGIUDICATA", "1", 0.0, "2018-01-01", 2),
         ("u", "DESERTA", "2", 5.0, "01/02/2020", 1), ("u", "DESERTA", "2", 5.0, "2020-05-05", 2), (" ", "AGGIUDICATA", "1", 9.0, "2020-01-01", 1)],
        "cig string, award_result string, award_result_code string, award_amount_eur double, award_date string, pos int")
    assert rows(link.best_outcome(df, [F.asc("pos")]), "cig", "pos", "preference") == [("t", 2, 2218), ("u", 1, 2050)]


def test_metadata_and_representative(spark):
    df = spark.createDataFrame([("c1", "t", None, 0), ("c1", "t", "x", 1), ("C2", "t", "x", 2), (None, "t", "x", 3)], "cup string, title string, client string, _pos int")
    best = link.richest_metadata(link.metadata(df), [F.asc("_pos")])
    assert rows(best, "cup", "client", "completeness") == [("C1", "x", 2), ("C2", "x", 2)]
    links = spark.createDataFrame([("C1", "g"), ("C2", "g"), ("C9", "h"), ("C2", "h")], "cup string, cig string")
    assert rows(link.representative_project(links, best), "cig", "cup") == [("g", "C1"), ("h", "C2")]


def test_identity_cascade(spark):
    df = spark.createDataFrame([("a", "b", "c"), (None, "b", "c"), (" ", None, "c"), (None, None, None)], "cup string, cig string, id string")
    x = F.lit("x")
    key = dedupe.identity_key(F.col("cup"), F.col("cig"), F.col("id"), x, x, x, x, x)
    got = [r[0] for r in df.select(key).collect()]
    assert got[:3] == ["CUP::A", "CIG::B", "ID::C"]
    import hashlib
    assert got[3] == "HASH::" + hashlib.sha1(b"X|X|X|X|x").hexdigest()


def test_link_norm_and_raw(spark):
    links = spark.createDataFrame([(" c1", "g1"), ("C1", ""), ("C1", None), ("c2", "g2")], "cup string, cig string")
    targets = spark.createDataFrame([("C1",)], "cup string")
    assert rows(link.link_projects(links, targets), "cup", "cig") == [("C1", "G1")]
    assert rows(link.link_projects_raw(links, targets), "cup", "cig") == [("C1", ""), ("C1", "")]


MAP = [
    # municipality, province, code, branch, candidates
    ("Alfa", "Uno", "U1", "B1", "B1"), ("Beta", "Uno", "U1", "AMBIGUA", "B1 | B2"), ("Gamma", "Uno", "U1", "B1", "B1"),
    ("Gamma", "Due", "D2", "B2", "B2"), ("Delta", "Forlì Cesena", "FC", "B3", "B3"), ("Eps", "Tre", "T3", "Quattro", "Quattro"),
    ("Zeta", "Tre", "T3", "Roma", "Roma"),
]


def branch_map(spark):
    df = spark.createDataFrame([(*m, "alta", i) for i, m in enumerate(MAP)],
                               "municipality string, province string, province_code string, branch string, branch_candidates string, confidence string, pos int")
    return df.withColumns({"municipality_norm": geo.geo_key(F.col("municipality")), "province_norm": geo.geo_key(F.col("province"))})


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_branch_cascade(spark, max_rows):
    cases = [
        ("alfa", "uno", "R", None, None, "B1", "exact_or_alias_province"),
        ("alfa", "U1", "R", None, None, "B1", "exact_or_alias_province"),
        ("beta", "Uno", "R", None, None, "AMBIGUA", "exact_or_alias_province"),
        ("alfa", None, "R", None, None, "B1", "fallback_comune_univoco"),
        ("alfa", "TUTTI", "R", None, None, "B1", "fallback_comune_univoco"),
        ("gamma", None, "Z", None, None, "NON ASSEGNATA", "none"),
        ("alfa", "Nove", "Z", None, None, "NON ASSEGNATA", "none"),
        ("speciale", None, "Z", None, None, "BS", "fallback_comune_territoriale"),
        ("speciale", "Nove", "Z", None, None, "NON ASSEGNATA", "none"),
        ("boh", "Quattro", "R", None, None, "Quattro", "fallback_provincia_omonima_filiale"),
        ("boh", "Roma", "R", None, None, "BR", "fallback_regione_territoriale"),
        ("boh", "Pesaro e Urbino", "R", None, None, "BP", "fallback_provincia_territoriale"),
        ("TUTTI", "Nove", "R", None, None, "BR", "fallback_regione_territoriale"),
        ("alfa", "uno", "R", "Mia", "manual_x", "Mia", "manual_x"),
        ("alfa", "uno", "R", "Vecchia", "auto", "B1", "exact_or_alias_province"),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)],
                               "i int, municipality string, province string, region string, branch string, branch_assignment_method string")
    df = df.unionByName(df.limit(0)).withColumn("branch_confidence", F.lit("x"))
    out = geo.assign_branch(df, branch_map(spark), ["pos"], {"Speciale": "BS"}, {"PU": "BP"}, {"R": "BR"}, max_dim_rows=max_rows)
    got = {r["i"]: (r["branch"], r["branch_assignment_method"]) for r in out.collect()}
    assert got == {i: c[5:] for i, c in enumerate(cases)}


def test_cascade_does_not_shuffle_facts(spark):
    df = spark.createDataFrame([("alfa", "uno", "R")], "municipality string, province string, region string")
    plan = geo.assign_branch(df, branch_map(spark), ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_fan_out(spark):
    df = spark.createDataFrame([("B1", ""), ("AMBIGUA", "B1 | B2 | B1"), ("B1", "B1"), ("NON ASSEGNATA", ""), (None, None)], "branch string, branch_candidates string")
    lists = df.select(geo.branch_list(F.col("branch"), F.col("branch_candidates"))).collect()
    assert [r[0] for r in lists] == [["B1"], ["AMBIGUA", "B1", "B2"], ["B1"], ["NON ASSEGNATA"], ["NON ASSEGNATA"]]
    assert geo.fan_out(df, include_sentinels=False).count() == 4


def test_postal_last_wins(spark):
    df = spark.createDataFrame([("123", "A", 1), ("00123", "B", 2), ("9", "C", 3), ("", "D", 4)], "cap string, branch string, pos int")
    assert rows(geo.cap_branch(df, ["pos"]), "cap", "branch", "conflict") == [("00009", "C", False), ("00123", "B", True)]


def award_rows(spark):
    data = [("P1", "T1", 1000.0, 600.0, "AGGIUDICATA", "Beta", "2", "MANDANTE", 2), ("P1", "T1", 1000.0, 600.0, "AGGIUDICATA", "Alfa", "1", None, 1),
            ("P1", "T1", 1000.0, 600.0, "AGGIUDICATA", "Alfa", "1", None, 3), ("P1", "T2", 1000.0, 1600.0, "aggiudicata x", None, None, None, 4),
            ("P2", "T1", 0.0, 600.0, "AGGIUDICATA", "Alfa", None, None, 5), ("P3", "T3", 10.0, 99.0, "AGGIUDICATA", "Alfa", "1", None, 6),
            ("P3", "T4", 10.0, 999.0, "DESERTA", "Alfa", "1", None, 7)]
    return spark.createDataFrame(data, "cup string, cig string, value_eur double, award_amount_eur double, award_result string, "
                                       "contractor_name string, contractor_tax_code string, contractor_role string, pos int").withColumns({
        "contractor_vat": F.lit(None).cast("string"), "award_date": F.lit("2020-01-01").cast("date")})


def test_consolidation_split(spark):
    c, members = A.consolidate(award_rows(spark), [F.asc("pos")], min_award=100.0)
    out = A.award_texts(c, members)
    assert rows(out, "cup", "cig", F.coalesce("contractors", F.lit("")), "ratio_status") == [
        ("P1", "T1", "Alfa | Beta (MANDANTE)", "ok"), ("P1", "T2", "", "anomalia"), ("P2", "T1", "Alfa", "anomalia")]
    assert rows(A.relevant(c), "cup", "cig") == [("P1", "T1")]
    assert A.relevant(c).count() + A.anomalies(c).count() == c.count()


def test_group_projects(spark):
    c, members = A.consolidate(award_rows(spark), [F.asc("pos")], min_award=100.0)
    c = A.relevant(c).withColumn("title", F.lit("t")).withColumn("id", F.lit("x"))
    register = spark.createDataFrame([("p1", "r", 1.0, "a"), ("P9", "r", 2.0, "b"), (None, "r", 3.0, "REGISTER::x")], "cup string, title string, value_eur double, id string")
    raw = A.raw_master(c, register)
    m = A.group_projects(raw, ["cup", "title", "value_eur", "source"], members)
    assert rows(m, "project_key", "has_award", "awards_count", F.coalesce("contractors_summary", F.lit("-"))) == [
        ("P1", True, 1, "Alfa + altri 1 OE"), ("P9", False, 0, "-"), ("REGISTER::x", False, 0, "-")]


def test_evidence_levels(spark):
    S = "cup string, cig string"
    links = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "1"), ("D", "1"), ("A", "2")], S)
    E = S + ", award_result string, award_amount_eur double, value_eur double"
    enriched = spark.createDataFrame([("A", "1", "AGGIUDICATA", 5.0, 1e6), ("B", "1", "AGGIUDICATA", 5.0, 1e6), ("B", "2", "AGGIUDICATA", 2e5, 1e6),
                                      ("C", "1", "DESERTA", 5.0, 1e6), ("C", "1", "AGGIUDICATA", 0.0, 1e6)], E)
    relevant, anomalies = spark.createDataFrame([("A", "9")], S), spark.createDataFrame([], S)
    ev = link.project_evidence(links, enriched, relevant, anomalies)
    master = spark.createDataFrame([(c,) for c in "ABCDE"], "cup string")
    levels = link.evidence_level(master, ev)
    assert rows(levels, "cup", "evidence_level") == [("A", "confirmed"), ("B", "small"), ("C", "review"), ("D", "technical"), ("E", "none")]
    funnel = {(r["section"], r["name"]): r["count"] for r in link.evidence_funnel(levels).collect()}
    assert sum(v for (s, _), v in funnel.items() if s == "level") == 5
    assert funnel[("funnel", "technical_match")] == 4 and funnel[("funnel", "enriched")] == 3 and funnel[("funnel", "confirmed")] == 1


def test_delta_and_upsert(spark):
    schema = "cup string, title string, contractors string, branch string"
    prev = spark.createDataFrame([("a", "t", None, "B"), ("b", "t", None, "B"), ("c", "t", "x", "B"), ("d", "t", "x", "B")], schema)
    cur = spark.createDataFrame([("a", "t", None, "B"), ("b", "T2", "x", "B"), ("c", "t2", "x", "B"), ("e", "t", "x", None), ("e", "zz", "x", "B")], schema)
    n = F.lit(None).cast("string")

    def state(df):
        has = report.has_text(F.col("contractors"))
        key = dedupe.identity_key(F.col("cup"), n, n, n, n, n, n, n)
        return snapshot.keyed_state(df, key, has, snapshot.signature(df, has), [F.col("title")])

    d = snapshot.delta(state(prev), state(cur))
    assert rows(d, "identity_key", "change_status", "branch") == [
        ("CUP::A", "unchanged", "B"), ("CUP::B", "evidence_added", "B"), ("CUP::C", "updated", "B"), ("CUP::D", "removed", "B"), ("CUP::E", "new", "Non assegnata")]
    assert rows(snapshot.manifest(d), "branch", "new", "updated", "evidence_added", "removed", "total_changes") == [("B", 0, 1, 1, 1, 3), ("Non assegnata", 1, 0, 0, 0, 1)]
    assert snapshot.delta(state(cur), state(cur)).filter("change_status <> 'unchanged'").count() == 0

    day = lambda s: F.lit(s).cast("date")
    base = spark.createDataFrame([("k1", "s", 1), ("k2", "s", 1), ("k3", "o", 1)], "record_key string, source string, v int")
    s0 = snapshot.as_snapshot(base, "r0", day("2020-01-01"))
    batch = spark.createDataFrame([("k1", "s", 5), ("k1", "s", 7), ("k4", "s", 1)], "record_key string, source string, v int")
    s1 = snapshot.upsert(s0, batch, "s", "r1", day("2021-01-01"), [F.desc("v")])
    cols = ["record_key", "v", "is_active", F.year("first_seen"), F.year("last_seen"), "last_run_id"]
    assert rows(s1, *cols) == [("k1", 7, True, 2020, 2021, "r1"), ("k2", 1, False, 2020, 2020, "r0"), ("k3", 1, True, 2020, 2020, "r0"), ("k4", 1, True, 2021, 2021, "r1")]
    again = snapshot.upsert(s1, batch, "s", "r1", day("2021-01-01"), [F.desc("v")])
    assert rows(again, *cols) == rows(s1, *cols)
    back = snapshot.upsert(s1, base.filter("record_key = 'k2'"), "s", "r2", day("2022-01-01"), [F.desc("v")])
    assert rows(back.filter("record_key = 'k2'"), *cols) == [("k2", 1, True, 2020, 2022, "r2")]
    partial = snapshot.upsert(s0, batch, "s", "r1", day("2021-01-01"), [F.desc("v")], deactivate=False)
    assert partial.filter("not is_active").count() == 0


def walked(sizes, limit):
    """Next fit by a sequential walk."""
    parts, part, filled = [], 1, 0
    for i, size in enumerate(sizes):
        if i and filled + size > limit:
            part, filled = part + 1, 0
        filled += size
        parts.append(part)
    return parts


@pytest.mark.parametrize("block", [3, 64, shards.BLOCK_ROWS])
def test_pack_parts_equals_a_walk(spark, block):
    rnd = random.Random(7)
    data = [("B1", i, rnd.randint(0, 5), rnd.choice([3, 9, 40])) for i in range(400)]
    data += [("B2", i, 1, 50) for i in range(400, 404)] + [("B3", i, 1, 120) for i in range(404, 406)] + [("B4", 406, 1, 1), (None, 407, 1, 7), (None, 408, 1, 99)]
    data += [("B5", i, 1, 1) for i in range(500, 800)] + [("B6", i, i % 7, rnd.randint(1, 150)) for i in range(800, 1000)]
    df = spark.createDataFrame(data, "listed_branch string, id int, s int, row_bytes int").repartition(5)
    got = {r["id"]: r["part"] for r in shards.pack_parts(df, [("s", True)], "id", 100, block=block).collect()}
    assert len(got) == len(data)
    for b in {d[0] for d in data}:
        order = sorted((d for d in data if d[0] == b), key=lambda d: (-d[2], d[1]))
        assert [got[d[1]] for d in order] == walked([d[3] for d in order], 100)


@pytest.mark.parametrize("unit, cap, more, parts", [(10, 100, [], 50), (10, 100, [90], 51), (10, 100, [150], 51), (5 << 20, 90 << 20, [200 << 20], 29)])
def test_one_large_record_leaves_the_other_parts_full(spark, unit, cap, more, parts):
    sizes = [unit] * 500 + more
    df = spark.createDataFrame([("B", i, n) for i, n in enumerate(sizes)], "listed_branch string, id int, row_bytes long")
    got = [r["part"] for r in shards.pack_parts(df, [], "id", cap, block=128).orderBy("id").collect()]
    assert got == walked(sizes, cap) and max(got) == parts


def test_json_flatten_depth(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":{"d":"x"}}]},"e":{},"f":[],"g":null}'), (2, '[true]'), (3, 'not json'), (4, '7')], "id int, j string")
    assert rows(jsonflat.flatten_json(df, "j", ["id"]), "id", "key", F.coalesce("value", F.lit("NULL"))) == [
        (1, "a_b_0", "1"), (1, "a_b_1_c_d", "x"), (1, "g", "NULL"), (2, "0", "true"), (4, "", "7")]
    gaps = spark.createDataFrame([(1, '{"a":[null,1],"b":[null],"c":null,"e":[null,null],"s":"{[","n":"[]"}')], "id int, j string")
    assert rows(jsonflat.flatten_json(gaps, "j", ["id"]), "key", F.coalesce("value", F.lit("NULL"))) == sorted([
        ("a_0", "NULL"), ("a_1", "1"), ("b_0", "NULL"), ("c", "NULL"), ("e_0", "NULL"), ("e_1", "NULL"), ("n", "[]"), ("s", "{[")])


def test_json_flatten_to_a_depth_of_60_in_one_plan(spark):
    deep, want = "0", {}
    for i in range(60):
        deep = '{"k":%s,"n":%d}' % (deep, i) if i % 2 else "[%s,%d]" % (deep, i)
    def walk(v, path):
        if isinstance(v, (dict, list)):
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                walk(x, [*path, str(k)])
        else:
            want["_".join(path)] = str(v)
    walk(json.loads(deep), [])
    df = spark.createDataFrame([(1, deep), (2, '{"x":1}')], "id int, j string")
    flat = jsonflat.flatten_json(df, "j", ["id"])
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("UnionLoop ") <= 2 and plan.count("Generate") <= 2
    got = flat.collect()
    assert {r.key: r.value for r in got if r.id == 1} == want and len(got) == len(want) + 1 and [(r.key, r.value) for r in got if r.id == 2] == [("x", "1")]


def test_json_flatten_with_a_known_depth(spark):
    texts = ['{"a":{"b":[1,{"c":"x"}]},"e":{},"f":[[]],"g":null}', '[true,[null],"[]",""]', "not json", "7", None, '{"":{"":2},"s":"{}"}', "[]", '{"a":[[1],[2,[3]]]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    every = lambda **known: sorted((tuple(r) for r in jsonflat.flatten_json(df, "j", ["id"], **known).collect()), key=str)
    assert every(max_depth=4) == every(max_depth=6) == every()
    assert (0, "a_b", '[1,{"c":"x"}]') in every(max_depth=2) and (7, "a_1_1", "[3]") in every(max_depth=3)
    assert "Exchange" not in jsonflat.flatten_json(df, "j", ["id"], max_depth=4)._jdf.queryExecution().executedPlan().toString()


def test_page_extraction(spark):
    html = ("<html><head><style>p{}</style><script>var t='<h1>no</h1>';</script></head><body><h1> Impianto <b>eolico</b> &amp; BESS </h1>"
            "<a href='/Oggetti/Info/9'>x</a><a class=k href=\"/Oggetti/Info/8\">y</a><a href='/altro'>z</a><a href='/Oggetti/Info/9'>x</a>"
            "<p>Proponente Acme Srl Procedura VIA nel comune di San Vito, provincia (RM). Potenza 34,62 MW</p><!-- via --></body></html>")
    df = spark.createDataFrame([(html, "https://p/Oggetti/Info/12"), ("<p>Progetto di un grande parco fotovoltaico nuovo. Fine</p>", "u")], "html string, url string")
    f = pages.page_features(df, r"/Oggetti/Info/(\d+)", "P-").select("external_id", "title", "sector", "client", "municipality", "province", "power_mw", "phase",
                                                                     pages.links(F.col("html"), "/Oggetti/Info/", "https://p").alias("l"))
    a, b = f.collect()
    assert a[:8] == ("P-12", "Impianto eolico & BESS", "eolico", "Acme Srl", "San Vito", "RM", 34.62, "VIA")
    assert a["l"] == ["https://p/Oggetti/Info/8", "https://p/Oggetti/Info/9"]
    assert b["title"] == "Progetto di un grande parco fotovoltaico nuovo" and b["sector"] == "fotovoltaico"
    text = F.lit("x Stato Attivo e Regione Emilia Romagna Provincia RE")
    assert spark.range(1).select(pages.after_label(text, "Regione", P.DETAIL_LABELS), pages.after_label(text, "Provincia", P.DETAIL_LABELS),
                                 pages.after_label(text, "Comune", P.DETAIL_LABELS)).first()[:] == ("Emilia Romagna", "RE", None)


def test_search_bounds(spark):
    df = spark.createDataFrame([(i, f"Scuola {i}", float(i), "2020-01-01" if i % 2 else None, "B1", "") for i in range(700)],
                               "id int, title string, value_eur double, award_date string, branch string, branch_candidates string")
    df = df.withColumn("award_date", F.col("award_date").cast("date"))
    cols = dict(text_columns=["title"])
    assert search.matches(df, search.SearchRequest(value_min=10, value_max=20), **cols).count() == 11
    assert search.matches(df, search.SearchRequest(date_from="2020-01-01", date_to="2020-01-01"), **cols).count() == 350
    assert search.matches(df, search.SearchRequest(text=" SCUOLA 69 "), **cols).count() == 11 and search.matches(df, search.SearchRequest(branch="zz"), **cols).count() == 0
    first = search.search(df, search.SearchRequest(), [F.asc("id")], **cols)
    assert first.count() == 300 and first.agg(F.max("id")).first()[0] == 299


def test_national_totals_use_unique_rows(spark):
    """Fan-out rows count once per branch, the national row once per project; values stay numeric."""
    df = spark.createDataFrame([("a", "AMBIGUA", "B1 | B2", 79998822.0, True), ("b", "B1", "", 1.0, False)], "cup string, branch string, branch_candidates string, value_eur double, has_contractor boolean")
    fan = report.kpis(geo.fan_out(df).drop("branch").withColumnRenamed("listed_branch", "branch"), ["branch"])
    assert rows(fan, "branch", "count") == [("AMBIGUA", 1), ("B1", 2), ("B2", 1)]
    national = report.kpis(df, []).first()
    assert national["count"] == 2 and national["coverage_pct"] == 50.0 and national["total_value_eur"] == 79998823.0
