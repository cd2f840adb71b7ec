"""WARC archives of pages, and a reader that salvages what damaged archives still hold.

Writing: every page is one gzip member with one record. Of equal payloads of at least LEAST_REVISIT bytes the one with
the largest page_id is written as ``response`` (every row of that id, should it repeat), the others as ``revisit`` records
that refer to it. The archives go through Spark's text writer, so that any store works and a
lost executor leaves no half file: a member ends with a zero byte (the high byte of its length; members
of 16 MB and more get an empty member behind them), and that byte is written as the line separator.

Reading: members and plain records are checked (gzip checksum, version line, length, end of record, block and payload
digests). After a failed check the reader searches the next place where a whole valid record begins, in the archive and
in the decompressed content of a member (also of one that is cut or damaged, up to there), goes on there
and logs the bytes between as a quarantined gap. An archive is read as one row: FILE_RECORDS keeps those written here small.

NULL html is the empty payload, a NULL url leaves the header out, a NULL page_id is written as ``null`` and counts as
the smallest id. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cantiere.session import scratch_dir

LEAST_REVISIT = 1000
FILE_RECORDS = 1000
#: Names of archives: those written here, and WARC files of others.
FILES = "{part-*,*.warc,*.warc.gz}"
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_STEP = 1 << 16
_FIRST = 48


# writing

def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (hex), record_type, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # one small row per repeated payload; copies are counted before the shuffle
    heads = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    again = F.col("head").isNotNull() & (F.col("payload_bytes") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("head"))
    return rows.join(heads.drop("n"), "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("head")).alias("refers_to"))


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _agrees(header: str, data: bytes) -> bool | None:
    """Whether data has the digest of a header (hex or base32); None where algorithm or encoding is unknown."""
    algorithm, _, value = header.strip().partition(":")
    name = algorithm.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    digest = hashlib.new(name, data).digest()
    if len(value) == 2 * len(digest) and re.fullmatch("[0-9A-Fa-f]+", value):
        return value.lower() == digest.hex()
    code = base64.b32encode(digest).decode().rstrip("=")
    if len(value.rstrip("=")) == len(code) and re.fullmatch("[A-Za-z2-7]+=*", value):
        return value.upper().rstrip("=") == code
    return None


def _name(page_id) -> str:
    return f"<{URN}{'null' if pd.isna(page_id) else int(page_id)}>"


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to) -> bytes:
    """One record as plain bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None and not pd.isna(url):
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte."""
    def packed(part: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(part) + z.flush()

    out = packed(data)
    return out if out[-1] == 0 else out + packed(b"")


def write(pages: DataFrame, path: str) -> None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record": [member(record(*row))[:-1] for row in zip(
                pdf["page_id"].astype("Int64"), pdf["url"], pdf["payload"], pdf["record_type"], pdf["refers_to"].astype("Int64"))]})

    records = with_types(pages).select("page_id", "url", "payload", "record_type", "refers_to").mapInPandas(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


# reading

class Damaged(Exception):
    pass


class _Scan:
    """Bytes of an archive or of a member's content with what a search has learnt: each mark is searched and each header read once.

    Places are asked for in ascending order. ``dead`` is the place before which no further plain record begins: candidates that share the end
    of a header share its lines from the end, so what fails for one of them fails for all before ``dead``.
    """

    def __init__(self, data: bytes):
        self.data, self.dead, self._marks, self._lines = data, 0, {}, (-1, -1, -1, {})

    def find(self, mark: bytes, at: int) -> int:
        """The first place of a mark from a position on; the length if there is none."""
        low, place = self._marks.get(mark, (0, -1))
        if not low <= at <= place:
            place = self.data.find(mark, at)
            place = len(self.data) if place < 0 else place
            self._marks[mark] = at, place
        return place

    def next_plain(self, at: int) -> int:
        return self.find(b"WARC/1.", max(at, self.dead))

    def lines(self, at: int, top: int) -> tuple[int, dict[str, tuple[int, str]]]:
        """Header lines before an end, read backwards: where the last line without a colon begins (-1: none behind ``at``), and place and value by name."""
        known, low, bad, fields = self._lines
        if known != top or (at < low and bad < at):
            bad, fields, end = -1, {}, top
            while end > at:
                start = self.data.rfind(b"\r\n", at, end)
                if start < 0:
                    break
                name, colon, value = self.data[start + 2:end].decode("utf-8", "replace").partition(":")
                if not colon:
                    bad = start + 2
                    break
                fields.setdefault(name.strip().lower(), (start + 2, value.strip()))
                end = start
            self._lines = top, at, bad, fields
        return bad, fields


def _plain(scan: _Scan, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record at a position: its end, headers and block."""
    data = scan.data
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    top = scan.find(b"\r\n\r\n", at)
    if top == len(data):
        scan.dead = top
        raise Damaged("header not ended")
    bad, fields = scan.lines(at, top)
    if bad > at:
        scan.dead = bad
        raise Damaged("header line")
    headers = {name: value for name, (place, value) in fields.items() if place > at}
    scan.dead = top  # but for a wrong digest, no later candidate of this header can do better
    if not headers.get("content-length", "").isdecimal():
        raise Damaged("no length")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damaged("no type or id")
    start = top + 4
    end = start + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record not ended")
    block = data[start:end]
    if _agrees(headers.get("warc-block-digest", ""), block) is False:
        scan.dead = fields["warc-block-digest"][0] + 1
        raise Damaged("block digest")
    scan.dead = at
    return end + 4, headers, block


def _member(data: bytes, at: int) -> tuple[int, bytes, str | None]:
    """The gzip member at a position: its end, its content, and what is wrong; then both reach up to the damage."""
    unzip, parts, read = zlib.decompressobj(31), [], at
    try:  # a false mark mostly fails here; so few bytes hold no whole record with a digest
        parts.append(unzip.decompress(data[read:read + _FIRST]))
        read += _FIRST
    except zlib.error:
        return at, b"", "gzip member"
    try:
        while not unzip.eof and read < len(data):
            parts.append(unzip.decompress(data[read:read + _STEP]))
            read += _STEP
    except zlib.error:
        return *_before_error(data, at), "gzip member"
    return min(read, len(data)) - len(unzip.unused_data), b"".join(parts), None if unzip.eof else "gzip member not ended"


def _before_error(data: bytes, at: int) -> tuple[int, bytes]:
    """How far a damaged member can be decompressed, and what it gives: a step with an error is taken again in smaller ones."""
    unzip, parts, step = zlib.decompressobj(31), [], _STEP
    while True:
        before = unzip.copy()
        try:
            parts.append(unzip.decompress(data[at:at + step]))
            at += step
        except zlib.error:
            if step == 1:
                return at, b"".join(parts)
            unzip, step = before, step // 16


def _inside(content: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """Records and gaps of decompressed content, as salvage gives them, by positions in the content."""
    at, scan = 0, _Scan(content)
    while at < len(content):
        place, reason = at, None
        while place < len(content):
            try:
                end, headers, block = _plain(scan, place)
                break
            except Damaged as damage:
                reason = reason or str(damage)
                place = scan.next_plain(place + 1)
        if place > at:
            yield "gap", at, place, reason, b""
        if place < len(content):
            yield "record", place, end, headers, block
            at = end
        else:
            return


def _next_start(scan: _Scan, at: int) -> int:
    """The next place that looks like a member or a version line; the length if there is none."""
    return min(scan.find(_GZIP, at), scan.next_plain(at))


def _found_at(scan: _Scan, at: int) -> tuple[int, str | None, list[tuple]]:
    """Where the member or plain record at a position ends, what is wrong with a member, and what it holds.

    Raises Damaged if not one record is valid there.
    """
    if not scan.data.startswith(_GZIP, at):
        end, headers, block = _plain(scan, at)
        return end, None, [("record", at, end, headers, block)]
    end, content, wrong = _member(scan.data, at)
    inner = list(_inside(content))
    if wrong:
        inner = [_vouched(one, wrong, len(content)) for one in inner]
    reasons = [head for kind, _, _, head, _ in inner if kind == "gap"]
    if not any(kind == "record" for kind, *_ in inner) and (wrong or reasons):
        raise Damaged(wrong or reasons[0])
    return end, wrong, [(kind, at, end, f"in member at {low}-{high}: {head}" if kind == "gap" else head, block) for kind, low, high, head, block in inner]


def _vouched(one: tuple, wrong: str, size: int) -> tuple:
    """A record of a damaged member, as a gap where it borders on the damage or where no digest shows that it is whole."""
    kind, low, high, head, block = one
    if kind == "record" and high == size:
        return "gap", low, high, f"{wrong} behind {head['warc-record-id']}", b""
    if kind == "record" and wrong == "gzip member" and not _agrees(head.get("warc-block-digest", ""), block):
        return "gap", low, high, f"{wrong}, no digest of {head['warc-record-id']}", b""
    return one


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """('record', start, end, headers, block) and ('gap', start, end, reason, b'') in the order of the archive.

    Records and gaps inside a member have the bounds of the member; the reason of such a gap names its place in the
    content. A cut or damaged member gives the records that are whole in the part before the damage and do not border on it,
    then a gap from the damage to the next valid place.
    """
    at, scan = 0, _Scan(data)
    while at < len(data):
        place, reason, found = at, "", []
        while place < len(data):
            try:
                end, wrong, found = _found_at(scan, place)
                break
            except Damaged as damage:
                reason = reason or str(damage)
                place = _next_start(scan, place + 1)
        if place > at:
            yield "gap", at, place, reason, b""
        if place >= len(data):
            return
        if wrong:  # the rest of the member ends where something valid begins
            rest, end = end, _next_start(scan, place + 1)
            while end < len(data):
                try:
                    _found_at(scan, end)
                    break
                except Damaged:
                    end = _next_start(scan, end + 1)
            rest = min(rest, end)
            found = [(kind, start, rest, head, block) for kind, start, _, head, block in found] + [("gap", rest, end, wrong, b"")]
        yield from found
        at = end


ROW = ("file string, kind string, start long, end long, reason string, page_id long, url string, record_type string, refers_to long, "
       "payload_bytes long, payload_digest string, payload binary")


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(number) if re.fullmatch("-?[0-9]+", number) else None


def _sha1_hex(digest: str) -> str | None:
    value = digest.strip()[5:] if digest.strip().lower().startswith("sha1:") else ""
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def read(spark: SparkSession, path: str, payloads: bool = True, files: str = FILES) -> DataFrame:
    """Rows of ROW: records (kind ``record``) and quarantined gaps (kind ``gap``) of all archives below the path.

    ``files`` is the pattern of the archives' names; folders below the path are read as well. A digest of another
    algorithm or encoding than those of ``_agrees`` is not checked; ``payload_digest`` is always the SHA-1 of the payload (of a
    revisit record the one in its header, NULL if that is no SHA-1).
    """
    def parse(file: str, data: bytes) -> Iterator[tuple]:
        for kind, start, end, head, block in salvage(data):
            if kind == "gap":
                yield (file, kind, start, end, head, None, None, None, None, None, None, None)
                continue
            http, _, payload = block.partition(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else (b"", b"", block)
            record_type = head.get("warc-type")
            if record_type == "revisit":  # the block is the HTTP head of the full response
                length = re.search(rb"(?im)^content-length: *([0-9]+)", http)
                size, digest, payload = int(length[1]) if length else None, head.get("warc-payload-digest", ""), None
            else:
                size, digest = len(payload), _digest(payload)
                if _agrees(head.get("warc-payload-digest", ""), payload) is False:
                    yield (file, "gap", start, end, "payload digest", None, None, None, None, None, None, None)
                    continue
            code = _sha1_hex(digest)
            yield (file, kind, start, end, None, _page(head.get("warc-record-id")), head.get("warc-target-uri"), record_type,
                   _page(head.get("warc-refers-to")), size, code, payload if payloads else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows, size = [], 0
                for row in parse(file, data):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 4 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", True).load(path)
    return found.select("path", "content").mapInPandas(run, ROW)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for name in ("start", "end", "page_id", "refers_to", "payload_bytes"):
        out[name] = out[name].astype("Int64")
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Write to a new shared folder, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_dir(pages.sparkSession, "warc")
    write(pages, path)
    rows = read(pages.sparkSession, path, payloads=False).filter("kind = 'record'")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same by DuckDB.
ROUND_TRIP_SQL = f"""
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS head FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head <> page_id OR (page_id IS NULL AND head IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN head <> page_id OR page_id IS NULL THEN head END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
