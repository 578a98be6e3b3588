"""WARC archives from legacy ARC archives.

ARC files hold records of one header line and as many bytes as it declares. A
file begins with a version block that says how the lines read: version 1 has
URL, IP, date, type, length; version 2 adds result code, checksum, location,
offset and file name before the length. The converter parses either, then
synthesises the WARC record: an identifier derived from page and payload, the
date in ISO form, the record type and the digest of the payload.

Of records with equal payloads the one with the largest page_id is a response,
the others are revisits that refer to it.

1. Pages are written as ARC archives of at most ARC_BYTES and one record, of
   either version by turns, beside an index of their page_ids, and stored.
2. The stored archives are parsed and converted to WARC archives, each record a
   gzip member of its own, which are stored as well; export() copies them to files.
3. Those are read back member by member, by the declared lengths.

An archive is one row of a table in the shared folder, which Spark commits as a
whole, so that a lost executor leaves no half archive. The date and the address
of a record come from the columns `fetched` (a timestamp) and `ip` where pages
has them; else the date is page_id seconds after EPOCH, and the address one of
the private range by a hash of the host.

Null html is an empty payload, a null url an empty one; payloads shorter than
min_bytes are always responses. Rows that repeat a page whole are each written;
if the largest page_id stands there twice, both are responses. No pages give no
archives; other columns take no part, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, written

ARC_BYTES = 8 << 20
EPOCH = 843_488_523  # 1996-09-23 14:22:03 UTC
#: Digests of payloads that stand twice: up to so many (some 40 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
END = "\r\n\r\n"
LINES = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    payload: bytes


def _token(value: str) -> str:
    """A header line's field: no blanks, no line ends."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


def write_arc(records: list[ArcRecord], version: int, name: str = "legacy.arc") -> bytes:
    body = f"{version} 0 archive\n{' '.join(LINES[version])}\n\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 19960923142103 text/plain {len(body)}\n".encode()
    else:
        head = f"filedesc://{name} 0.0.0.0 19960923142103 text/plain 200 - - 0 {name} {len(body)}\n".encode()
    parts, at = [head, body, b"\n"], len(head) + len(body) + 1
    for r in records:
        fields = [_token(r.url), r.ip, r.date, r.kind]
        if version == 2:
            fields += ["200", digest(r.payload), "-", str(at), name]
        line = " ".join([*fields, str(len(r.payload))]).encode() + b"\n"
        parts += [line, r.payload, b"\n"]
        at += len(line) + len(r.payload) + 1
    return b"".join(parts)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Header lines by the version that the file's first block names; bodies by their declared lengths."""
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = str(data[at:end], "utf-8", "replace").split(" ")
        length = int(line[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError("an ARC record is shorter than it declares")
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with a version block")
            version = int(body.split(b" ", 1)[0])
            fields = LINES[version]
        else:
            if len(line) != len(fields):
                raise ValueError(f"an ARC version {version} header line has {len(fields)} fields")
            r = dict(zip(fields, line, strict=True))
            if r.get("Checksum", "-") not in ("-", digest(body)):
                raise ValueError("an ARC record's checksum is wrong")
            yield ArcRecord(r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], body)
        at = end + 1 + length + 1  # a line end follows the body


def record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def iso_date(arc: str) -> str:
    return f"{arc[:4]}-{arc[4:6]}-{arc[6:8]}T{arc[8:10]}:{arc[10:12]}:{arc[12:14]}Z"


def to_warc(r: ArcRecord, page_id, refers_to) -> bytes:
    """The equivalent WARC record."""
    sha = digest(r.payload)
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha)}",
            f"WARC-Date: {iso_date(r.date)}", f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha1:{sha}",
            f"Page-Id: {'' if page_id is None else page_id}", f"Page-Payload-Length: {len(r.payload)}", f"Content-Type: {r.kind}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, sha)}", f"Page-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    block = r.payload if refers_to is None else b""
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + END).encode() + block + END.encode()


def read_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive; no more than one record is held at a time."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        head = {}
        while (line := file.readline()) != b"\r\n":
            if not line:
                raise ValueError("a WARC record has no end of its headers")
            name, value = line.decode().removesuffix("\r\n").split(": ", 1)
            head[name] = value
        n = int(head["Content-Length"])
        block = file.read(n)
        if len(block) != n or file.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is shorter than it declares")
        yield head, block


INFO = ("\r\n".join(["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:00000000-0000-5000-8000-000000000000>", "WARC-Date: 1996-09-23T14:21:03Z", "Content-Type: application/warc-fields", "Content-Length: 0"]) + END + END).encode()


def _arc_files(batches):
    """Pages as legacy archives, with what the format has no field for beside them."""
    part, files, records, ids, refers, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def done() -> pa.RecordBatch:
        name = f"part-{part:05}-{files:05}"
        content = write_arc(records, 1 + files % 2, f"{name}.arc")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([refers], pa.list_(pa.int64()))], ["name", "content", "page_ids", "refers_to"])

    for batch in batches:
        for page_id, refers_to, url, ip, date, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "refers_to", "url", "ip", "date", "payload")), strict=True):
            records.append(ArcRecord(url or "", ip, date, "text/html", payload))
            ids.append(page_id)
            refers.append(refers_to)
            size += len(payload)
            if size >= ARC_BYTES:
                yield done()
                files, records, ids, refers, size = files + 1, [], [], [], 0
    if records:
        yield done()


def member(record: bytes) -> bytes:
    return gzip.compress(record, 3, mtime=0)


def _warc_files(batches):
    """Each stored legacy archive as a WARC archive."""
    for batch in batches:
        for row in batch.to_pylist():
            records = zip(read_arc(row["content"]), row["page_ids"], row["refers_to"], strict=True)
            content = member(INFO) + b"".join(member(to_warc(r, p, t)) for r, p, t in records)
            yield pa.RecordBatch.from_arrays([pa.array([f"{row['name']}.warc.gz"]), pa.array([len(row["page_ids"])], pa.int64()), pa.array([content], pa.binary())], ["name", "records", "content"])


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, ip, date, payload, refers_to). Only payloads that occur twice are joined, by one slim row each."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    octets = [F.pmod(F.shiftright(host, 8 * k), F.lit(256)).cast("string") for k in range(3)]
    private = F.concat_ws(".", F.lit("10"), *octets)
    ip = F.coalesce(F.col("ip").cast("string"), private) if "ip" in pages.columns else private
    derived = F.timestamp_seconds(F.coalesce(F.pmod("page_id", F.lit(1 << 30)), F.lit(0)) + EPOCH)
    at = F.coalesce(F.col("fetched").cast("timestamp"), derived) if "fetched" in pages.columns else derived
    date = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMddHHmmss")
    rows = pages.select("page_id", "url", ip.alias("ip"), date.alias("date"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    twice = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1")
    twice = written(twice.select("sha", "kept"), "warc-twice")
    rows = rows.join(F.broadcast(twice) if twice.count() <= BROADCAST_DIGESTS else twice, "sha", "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.select("page_id", "url", "ip", "date", "payload", F.when(other, F.col("kept")).alias("refers_to"))


def legacy_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(name, content, page_ids, refers_to): ARC archives and their index, in the shared folder."""
    small_batches(pages.sparkSession)
    rows = with_types(pages, min_bytes).mapInArrow(_arc_files, "name string, content binary, page_ids array<long>, refers_to array<long>")
    return written(rows, "arc")


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(name, records, content): WARC archives made from legacy ones, in the shared folder."""
    legacy = legacy_archives(pages, min_bytes)
    return written(legacy.mapInArrow(_warc_files, "name string, records long, content binary"), "warc")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """The archives as files of a folder that the executors can reach: their names."""

    def copy(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content)
            yield batch.select(["name"])

    return written(archives.select("name", "content").mapInArrow(copy, "name string"), "exported")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("url", pa.string())])


def _read(batches):
    for batch in batches:
        for blob in batch.column("content").to_pylist():
            rows = []
            with gzip.open(io.BytesIO(blob)) as file:
                for head, block in read_warc(file):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (digest(block) != sha or len(block) != int(head["Page-Payload-Length"])):
                        raise ValueError("a payload's digest is wrong")
                    refers = head.get("Page-Refers-To")
                    rows.append((int(head["Page-Id"]) if head["Page-Id"] else None, int(head["Page-Payload-Length"]), sha, head["WARC-Type"], int(refers) if refers else None, head["WARC-Record-ID"], head["WARC-Date"], head["WARC-IP-Address"], head["WARC-Target-URI"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, date, ip, url."""
    small_batches(archives.sparkSession)
    return archives.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, ip string, url string")


def op5_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("record_id", "date", "ip", "url")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT x, count(*) AS n, max(page_id) AS last FROM p GROUP BY x),
r AS (SELECT *, n > 1 AND page_id IS DISTINCT FROM last AS again FROM p JOIN d USING (x))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r"""
