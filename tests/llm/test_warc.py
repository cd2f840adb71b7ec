import base64
import gzip
import hashlib
import random
import re
import time

import pytest

from cantiere.llm import warc
from cantiere.llm.common import table
from cantiere.session import scratch_dir
from oracle import compare, duck


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://a b\r\nX: y", "WARC/1.1\r\nfake\r\n\r\n"), (4, "u", big), (5, "u", big), (5, "u", big),
            (None, "u", big), (None, None, "x" * 2000), (6, "u", "short"), (7, "u", "short"), (8, "u", "".join(map(chr, range(300))) * 9), (9, "u", "y" * 17_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS kind", "2 AS head")


def test_round_trip_equals_sql(spark, sf, odd_pages):
    for pages in (table(spark, sf, "pages"), odd_pages):
        con = duck(sf)
        con.register("given", pages.select("page_id", "url", "html").toPandas().astype({"page_id": "Int64"}))
        con.execute("CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM given")
        assert compare(con, warc.ROUND_TRIP_SQL, warc.round_trip(pages)) is None


def test_payloads_and_plain_gzip_readers(spark, odd_pages):
    path = scratch_dir(spark, "warc")
    warc.write(odd_pages, path)
    rows = warc.read(spark, path).collect()
    want = {(r.page_id, hashlib.sha1((r.html or "").encode()).hexdigest()): (r.html or "").encode() for r in odd_pages.collect()}
    assert len(rows) == odd_pages.count() and all(r.kind == "record" for r in rows)
    assert all(bytes(r.payload) == want[r.page_id, r.payload_digest] for r in rows if r.record_type == "response")
    for file in {r.file for r in rows}:
        with gzip.open(file.removeprefix("file:")) as members:
            assert members.read().count(b"WARC-Record-ID") == sum(r.file == file for r in rows)


def archive(zipped=True, n=12):
    rng = random.Random(1)
    plain = [warc.record(i, "u", bytes(rng.choices(range(256), k=rng.randrange(3000))), "response", None) for i in range(n)]
    return [warc.member(p) if zipped else p for p in plain]


def ids(found):
    return [warc._page(head["warc-record-id"]) for kind, _, _, head, _ in found if kind == "record"]


@pytest.mark.parametrize("zipped", [True, False])
def test_damage_costs_only_the_damaged_records(zipped):
    parts = archive(zipped)
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(12)) and not list(warc.salvage(b""))
    bounds = [sum(map(len, parts[:i])) for i in range(13)]
    rng = random.Random(2)
    for _ in range(60):
        hit = sorted(rng.sample(range(12), rng.randrange(1, 4)))
        data = bytearray(whole)
        for i in hit:  # a changed byte in the middle, well inside content or checksum
            at = rng.randrange(bounds[i] + 1, bounds[i + 1] - 4)
            data[at] ^= 1 << rng.randrange(8)
        found = list(warc.salvage(bytes(data)))
        assert set(ids(found)) >= set(range(12)) - set(hit)
        covered = sorted((start, end) for _, start, end, _, _ in found)
        assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


@pytest.mark.parametrize("zipped", [True, False])
def test_cuts_insertions_and_ends(zipped):
    parts = archive(zipped)
    cut = b"".join(parts[:3]) + parts[3][:len(parts[3]) // 2] + b"".join(parts[4:])
    found = list(warc.salvage(cut))
    assert ids(found) == [0, 1, 2, *range(4, 12)]
    assert [(k, s, e) for k, s, e, _, _ in found if k == "gap"] == [("gap", sum(map(len, parts[:3])), sum(map(len, parts[:3])) + len(parts[3]) // 2)]
    junk = b"\x1f\x8b\x08junk WARC/1.0\r\nnot a record" * 3
    found = list(warc.salvage(junk + b"".join(parts) + junk))
    assert ids(found) == list(range(12)) and [k for k, *_ in found].count("gap") == 2
    found = list(warc.salvage(b"".join(parts)[:-9]))
    assert ids(found) == list(range(11)) and found[-1][0] == "gap"


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    parts = archive()
    (tmp_path / "part-1").write_bytes(parts[0] + b"garbage" + parts[1])
    rows = warc.read(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.kind, r.page_id, r.end - r.start) for r in rows] == [("record", 0, len(parts[0])), ("gap", None, 7), ("record", 1, len(parts[1]))]


def test_empty_table(odd_pages):
    assert warc.round_trip(odd_pages.limit(0)).count() == 0


def test_one_damaged_record_of_a_member_costs_only_itself():
    parts = archive(False)
    for hit in (0, 5, 11):
        bad = [p if i != hit else p.replace(b"Content-Length: ", b"Content-Length; ") for i, p in enumerate(parts)]
        found = list(warc.salvage(warc.member(b"".join(bad)) + warc.member(parts[3])))
        assert ids(found) == [i for i in range(12) if i != hit] + [3]
        gaps = [head for kind, _, _, head, _ in found if kind == "gap"]
        low = sum(map(len, bad[:hit]))
        assert gaps == [f"in member at {low}-{low + len(bad[hit])}: header line"]


def test_cut_and_damaged_members_give_the_records_before():
    parts = archive(False)
    whole = warc.member(b"".join(parts))
    for cut in (0.3, 0.6, 0.99):
        data = whole[:int(len(whole) * cut)]
        for more in (b"", warc.member(parts[3])):
            found = list(warc.salvage(data + more))
            inner = ids(found)[:-1] if more else ids(found)
            assert inner == list(range(len(inner))) and len(inner) >= int(12 * cut) - 3 and len(inner) > 0
            assert not more or ids(found)[-1] == 3
            assert any(kind == "gap" and end == len(data) for kind, _, end, _, _ in found)
    data = bytearray(whole)
    data[-6] ^= 1  # the checksum: every record but the one beside it is shown whole by its own digest
    found = list(warc.salvage(bytes(data)))
    assert ids(found) == list(range(11)) and any(kind == "gap" and "urn:page:11" in head for kind, _, _, head, _ in found)
    data = bytearray(whole)
    data[len(data) // 2] ^= 16
    assert 3 <= len(ids(warc.salvage(bytes(data)))) < 12 and set(ids(warc.salvage(bytes(data)))) >= set(range(4))


def with_digests(plain, block_digest, payload_digest):
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = [line for line in head.split(b"\r\n") if b"-Digest:" not in line]
    return b"\r\n".join([*lines, b"WARC-Block-Digest: " + block_digest, b"WARC-Payload-Digest: " + payload_digest]) + b"\r\n\r\n" + rest


def test_digests_of_other_algorithms_and_names_of_archives(spark, tmp_path):
    payload = b"<p>some page</p>"
    plain = warc.record(1, "u", payload, "response", None)
    block = plain.partition(b"\r\n\r\n")[2][:-4]
    good = [(f"{name}:{code(hashlib.new(name, block).digest())}".encode(), f"{name}:{code(hashlib.new(name, payload).digest())}".encode())
            for name in ("sha1", "sha256", "md5") for code in (bytes.hex, lambda d: d.hex().upper(), lambda d: base64.b32encode(d).decode(), lambda d: base64.b32encode(d).decode().lower())]
    good += [(b"blake9:abc", b"xyz"), (b"sha1:short", b"sha256:?")]
    bad = [(b"sha1:" + b"0" * 40, good[0][1]), (good[0][0], b"sha256:" + b"0" * 64), (good[0][0], b"md5:" + b"a" * 32)]
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "a.warc.gz").write_bytes(b"".join(warc.member(with_digests(plain, *d)) for d in good))
    (tmp_path / "b.warc").write_bytes(b"".join(with_digests(plain, *d) for d in bad))
    (tmp_path / "part-1.x").write_bytes(warc.member(plain))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    rows = warc.read(spark, str(tmp_path)).collect()
    kinds = [(r.file.rsplit("/", 1)[1], r.kind) for r in rows]
    assert kinds.count(("a.warc.gz", "record")) == len(good) and ("a.warc.gz", "gap") not in kinds
    assert ("b.warc", "record") not in kinds and ("b.warc", "gap") in kinds
    assert kinds.count(("part-1.x", "record")) == 1 and "notes.txt" not in dict(kinds)
    assert {r.payload_digest for r in rows if r.kind == "record"} == {hashlib.sha1(payload).hexdigest()}
    assert {r.file.rsplit("/", 1)[1] for r in warc.read(spark, str(tmp_path), files="*.warc").collect()} == {"b.warc"}


@pytest.mark.parametrize("mark", [b"WARC/1.0\r\n", b"x: WARC/1.1\r\n", b"WARC/1.0\r\na: b\r\n", b"WARC/1.0\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\n",
                                  b"WARC/1.", b"\x1f\x8b\x08junk-junk"])
@pytest.mark.parametrize("zipped", [True, False])
def test_false_marks_take_linear_time(mark, zipped):
    parts = archive(zipped)
    junk = mark * (2_000_000 // len(mark))
    for data in (b"".join(parts[:6]) + junk + b"".join(parts[6:]), warc.member(b"".join(archive(False)[:6]) + junk + b"".join(archive(False)[6:]))):
        began = time.perf_counter()
        assert ids(warc.salvage(data)) == list(range(12))
        assert time.perf_counter() - began < 15


def test_a_version_line_inside_a_damaged_header_begins_a_record():
    """Candidates that share a header's end: the first has a bad line, a wrong digest, or no damage at all."""
    good = warc.record(1, "u", b"payload", "response", None)
    for before, reason in ((b"WARC/1.1\r\nno colon\r\n", "header line"), (b"WARC/1.1\r\n", "header line"),
                           (b"WARC/1.0\r\nWARC-Block-Digest: sha1:" + b"0" * 40 + b"\r\n", "header line")):
        found = list(warc.salvage(before + good))
        assert [(kind, start) for kind, start, *_ in found] == [("gap", 0), ("record", len(before))] and found[0][3] == reason
    plain = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", good)
    wrong = b"WARC/1.0\r\nWARC-Block-Digest: sha1:" + b"0" * 40 + b"\r\nx: "
    found = list(warc.salvage(wrong + plain))
    assert [(kind, start) for kind, start, *_ in found] == [("gap", 0), ("record", len(wrong))] and found[0][3] == "block digest"
