"""Files: zip archives, delimiters, JSON roots, signatures, run log, storage, the national run."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cantiere.sources import files
from cantiere.sources.zipcsv import pick_delimiter


def zip_of(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "."), content)


def test_delimiters():
    assert pick_delimiter("a;b;c") == ";" and pick_delimiter("a|b,c,d") == "," and pick_delimiter("a\tb") == "\t"
    assert pick_delimiter("abc") == ";" and pick_delimiter("a;b|c") == ";" and pick_delimiter("a;b|c", "|;") == "|"
    assert pick_delimiter("a;b,c", ";,") == ";" and pick_delimiter("a,b,c;", ";,") == "," and pick_delimiter("a|b|c", ";,") == ";"


def test_every_plain_file_has_its_own_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cup;v\n" + "".join(f"{i};semi\n" for i in range(200)))
    (tmp_path / "b.csv").write_text("cup|v|w\n1|pipe|x,y,z;u\n")
    (tmp_path / "c.csv").write_text("cup\n7\n")
    rows = files.read_delimited(spark, str(tmp_path)).collect()
    assert sorted((r["cup"], r["v"], r["w"]) for r in rows if r["v"] != "semi") == [("1", "pipe", "x,y,z;u"), ("7", None, None)] and len(rows) == 202


def test_zip_members(spark, tmp_path):
    zip_of(tmp_path / "b.zip", one__csv="﻿CUP;CIG\nA;1\n\"B;x\";2;extra\nC\n".encode(), two__CSV="CIG,CUP\n9,Z\n".encode(), note__txt=b"x" * 999)
    zip_of(tmp_path / "a.zip", data__csv=b"CUP|CIG\nD\xff|4\n")
    df = files.read_zip(spark, str(tmp_path))
    got = sorted((r["CUP"], r["CIG"], os.path.basename(r["_file"]), r["_member"], r["_row"]) for r in df.collect())
    assert got == [("A", "1", "b.zip", "one.csv", 1), ("B;x", "2", "b.zip", "one.csv", 2), ("C", None, "b.zip", "one.csv", 3),
                   ("D", "4", "a.zip", "data.csv", 1), ("Z", "9", "b.zip", "two.CSV", 1)]
    assert df.select("CIG").rdd.getNumPartitions() == 3
    largest = files.read_zip(spark, str(tmp_path / "b.zip"), members="largest", delimiter=";")
    assert {r["_member"] for r in largest.select("_member").collect()} <= {"note.txt"}
    wide = files.read_zip(spark, str(tmp_path / "b.zip"), positional=3, delimiter=";")
    assert wide.filter("_member = 'one.csv'").orderBy("_row").select("_c0", "_c1", "_c2").collect()[1][:] == ("B;x", "2", "extra")


def test_large_member_is_streamed_in_batches(spark, tmp_path):
    zip_of(tmp_path / "x.zip", big__csv="n\n" + "\n".join(str(i) for i in range(20_000)))
    r = files.read_zip(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.max("_row"), F.sum(F.col("n").cast("long"))).first()
    assert tuple(r) == (20_000, 20_000, sum(range(20_000)))


def test_register_reads_zips_before_csv(spark, tmp_path):
    zip_of(tmp_path / "z.zip", a__csv=b"cup;v\n1;z\n")
    (tmp_path / "a.csv").write_bytes("﻿cup;v\n1;c\n2;c\n3\n".encode())
    df = files.read_register(spark, str(tmp_path))
    assert sorted((r["_source_order"], r["cup"], r["v"]) for r in df.collect()) == [(0, "1", "z"), (1, "1", "c"), (1, "2", "c"), (1, "3", None)]


def test_delimited_sink_has_mark_and_fixed_fields(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'q"q', 1)], "x string, y string, z int")
    files.write_delimited(df, str(tmp_path / "o"), ["y", "x", "none"], bom=True)
    part = next(p for p in (tmp_path / "o").iterdir() if p.name.startswith("part"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfy;x;none\n")
    back = files.read_delimited(spark, str(tmp_path / "o"))
    assert back.collect()[0][:] == ('q"q', "a;b", None)


def test_json_roots(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"cup":"a"},{"cup":"b"}]')
    (tmp_path / "root.json").write_text(json.dumps({"meta": 1, "rows": [{"cup": "no"}], "records": [{"cup": "c", "awards": [{"x": 1}]}]}))
    assert sorted(r["cup"] for r in files.read_json_rows(spark, str(tmp_path / "list.json")).collect()) == ["a", "b"]
    assert [r["cup"] for r in files.read_json_rows(spark, str(tmp_path / "root.json")).collect()] == ["c"]


def test_fallback_chain(spark, tmp_path):
    (tmp_path / "b.csv").write_text("cup;x\n1;2\n")
    df = files.first_source(spark, [("json", str(tmp_path / "no.json")), ("parquet", str(tmp_path / "no")), ("delimited", str(tmp_path / "b.csv"))])
    assert df.collect()[0][:] == ("1", "2")
    with pytest.raises(FileNotFoundError):
        files.first_source(spark, [("json", str(tmp_path / "no.json"))])


def test_signatures(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("1")
    now = files.file_signatures(spark, str(d))
    now.write.parquet(str(tmp_path / "sig"))
    stored = spark.read.parquet(str(tmp_path / "sig"))
    assert files.is_unchanged(files.file_signatures(spark, str(d)), stored)
    assert not files.is_unchanged(files.file_signatures(spark, str(d)), None)
    assert not files.is_unchanged(stored.limit(0), stored.limit(0))
    (d / "b.csv").write_text("2")
    (d / "a.csv").write_text("111")
    current = files.file_signatures(spark, str(d))
    assert not files.is_unchanged(current, stored)
    assert sorted(tuple(r) for r in files.signature_report(current, stored).collect()) == [("a.csv", "changed"), ("b.csv", "added")]


def test_run_log_and_peek(spark, tmp_path):
    log = files.RunLog(spark, str(tmp_path / "runs"))
    log.start("r1", "s", "n")
    log.start("r2", "s")
    log.finish("r1", "s", 5)
    got = {r["run_id"]: (r["total_records"], r["completed_at"] is not None) for r in log.runs().collect()}
    assert got == {"r1": (5, True), "r2": (0, False)}
    df = spark.createDataFrame([(i, "x" if i else "") for i in range(5)], "k int, v string")
    assert sorted(tuple(r) for r in files.peek(df, [F.asc("k")]).collect()) == [
        (1, "k", "0"), (2, "k", "1"), (2, "v", "x"), (3, "k", "2"), (3, "v", "x")]


def register_line(cup, title, region, province, town, client, cost, year, status="ATTIVO", text="LAVORI PUBBLICI"):
    row = [""] * 80
    for i, v in {0: cup, 1: f"{title}*{town}*{title}", 2: year, 3: status, 4: cost, 11: region, 14: province, 16: town, 17: client, 33: text, 58: "Statale"}.items():
        row[i] = v
    return ";".join(row)


def test_national_run(spark, tmp_path):
    from cantiere.plans import national

    lines = ["h" * 3 + ";" * 79,
             register_line("F24H20000820001", "Ristrutturazione scuola", "LAZIO", "RM", "Alfa", "COMUNE DI ALFA", "2.000.000,00", "2024"),
             register_line("F24H20000820001", "Doppione scuola", "LAZIO", "RM", "Alfa", "COMUNE DI ALFA", "9.000.000,00", "2024"),
             register_line("G11B21000000002", "Strada comunale", "LAZIO", "RM", "Beta", "COMUNE DI BETA", "1.000.000,00", "2023"),
             register_line("G11B21000000003", "Palestra", "LAZIO", "RM", "Alfa", "PROVINCIA X", "6.000.000,00", "2022"),
             register_line("H11B21000000004", "Scuola piccola", "LAZIO", "RM", "Alfa", "COMUNE", "199.999,99", "2024"),
             register_line("H11B21000000005", "Scuola con voucher", "LAZIO", "RM", "Alfa", "COMUNE", "900.000,00", "2024"),
             register_line("H11B21000000006", "Autostrada scuola", "LAZIO", "RM", "Alfa", "COMUNE", "900.000.000,00", "2024"),
             register_line("H11B21000000007", "Scuola vecchia", "LAZIO", "RM", "TUTTI", "ENTE", "300.000,00", "2010", "CHIUSO")]
    zip_of(tmp_path / "register.zip", r__csv="\n".join(lines))
    zip_of(tmp_path / "links.zip", l__csv="CUP;CIG\nf24h20000820001 ;t1\nF24H20000820001;T2\nG11B21000000002;T3\nZZZ;T9\nG11B21000000003;T4\n")
    zip_of(tmp_path / "people.zip", p__csv="codice_cig,Denominazione,Codice Fiscale,ruolo\nT1,Beta spa,2,MANDANTE\nT1,Alfa srl,1,\nT2,Gamma,3,\nT3,Gamma,3,\nT9,No,9,\n")
    zip_of(tmp_path / "outcomes.zip", o__csv="cig|esito|cod_esito|importo_aggiudicazione|data_aggiudicazione_definitiva\n"
           "T1|AGGIUDICATA|1|500000.5|2024-02-01\nT1|DESERTA|2|1|2025-01-01\nT2|AGGIUDICATA|1|99000|01/02/2024\nT3|ANNULLATA|3|200000|2024-01-01\n")
    bm = spark.createDataFrame([("ALFA", "RM", "Alfa", "RM", "B1", "B1", "alta", 1), ("BETA", "RM", "Beta", "RM", "AMBIGUA", "B1 | B2", "bassa", 2)],
                               "municipality_norm string, province_norm string, municipality string, province string, branch string, branch_candidates string, confidence string, pos int")
    inputs = national.Inputs(*[str(tmp_path / f"{n}.zip") for n in ("register", "links", "people", "outcomes")], bm, ["pos"], "https://r/")
    out = national.run(spark, inputs, str(tmp_path / "out"))
    projects = {r["cup"]: r for r in out["projects"].collect()}
    assert sorted(projects) == ["F24H20000820001", "G11B21000000002", "G11B21000000003", "H11B21000000006", "H11B21000000007"]
    p = projects["F24H20000820001"]
    assert (p["title"], p["category"], p["intervention_type"], p["funding"], p["year"], p["commercial_score"]) == (
        "Ristrutturazione scuola", "Scuole / formazione", "ristrutturazione", "Statale", 2024, 90)
    short = {r["cup"]: (r["operational_score"], r["primary_segment"]) for r in out["shortlist"].collect()}
    assert short == {"F24H20000820001": (100, "Edilizia"), "G11B21000000002": (100, "Lavori pubblici strade"), "G11B21000000003": (100, "Edilizia")}
    m = {r["cup"]: r for r in out["master"].collect()}
    assert {c: r["evidence_level"] for c, r in m.items()} == {"F24H20000820001": "confirmed", "G11B21000000002": "review", "G11B21000000003": "technical"}
    a = m["F24H20000820001"]
    assert (a["awards_count"], a["contractors_summary"], a["branch"], a["awards"][0]["cig"]) == (1, "Alfa srl + altri 1 OE", "B1", "T1")
    texts = {r["contractor_set"]: (r["part"], r["contractors"]) for r in out["contractor_sets"].collect()}
    assert texts[a["awards"][0]["contractor_set"]] == (0, "Alfa srl | Beta spa (MANDANTE)") and a["awards"][0]["contractors_count"] == 2
    assert len(texts) == 2  # T2 and T3 have the same contractor
    assert a["awards"][0]["award_amount_eur"] == 500000.5 and a["awards"][0]["award_weight"] == "Lotto rilevante"
    assert m["G11B21000000002"]["branch"] == "AMBIGUA" and "BRANCH_AMBIGUOUS" in m["G11B21000000002"]["quality_flags"]
    index = national.write_branch_shards(out["master"], str(tmp_path / "shards"))
    assert {r["listed_branch"]: r["count"] for r in index.collect()} == {"B1": 3, "B2": 1, "AMBIGUA": 1}
    assert spark.read.json(str(tmp_path / "shards")).count() == 5
