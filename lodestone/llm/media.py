"""Media columns: MPEG transport streams.

A payload becomes a transport stream of 188-byte packets: a program association
table, a program map table, then the bytes as packetised elementary packets of
at most CHUNK bytes, each with a presentation timestamp. The first packet of
each elementary packet is a random-access point with a clock reference; the last
one is filled up by a stuffing field. Reading parses the tables, checks the
continuity counters, reassembles the elementary packets and returns bytes,
timestamps and random-access points.

The streams are written as a binary column to the shared folder and read from
there. A stream of which a packet is missing, by its continuity counters, is
refused; decode() alone can be told to count the breaks instead.

Null texts are empty; a payload is the text's UTF-8 bytes, zero-padded to a
positive multiple of 64. Equal texts and repeated rows give equal streams, one
each. An empty table gives an empty one; other columns take no part, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, written

PACKET, CHUNK, BLOCK = 188, 32_768, 64
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0, 0x1000, 0x0100, 1
PRIVATE_DATA, STREAM_ID, TICKS = 0x06, 0xBD, 3600
_COLUMNS = np.arange(PACKET)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _packets(pes: bytes, counter: int, pts: int) -> np.ndarray:
    """One elementary packet as transport packets; counter is the first one's continuity counter."""
    first = PACKET - 4 - 8
    n = 1 + max(0, -(-(len(pes) - first) // 184))
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
    data = np.frombuffer(pes, np.uint8)
    if n == 1:
        pad = first - len(pes)
        out[0, 4:] = np.frombuffer(bytes([7 + pad, 0x50]) + clock + b"\xff" * pad + pes, np.uint8)
        return out
    out[0, 4:] = np.frombuffer(b"\x07\x50" + clock + pes[:first], np.uint8)
    full = (len(pes) - first) // 184
    out[1 : 1 + full, 4:] = data[first : first + full * 184].reshape(full, 184)
    if full < n - 1:
        rest = pes[first + full * 184 :]
        pad = 184 - len(rest)
        out[n - 1, 3] |= 0x20
        stuffing = b"\0" if pad == 1 else bytes([pad - 1, 0]) + b"\xff" * (pad - 2)
        out[n - 1, 4:] = np.frombuffer(stuffing + rest, np.uint8)
    return out


def encode(payload: bytes) -> bytes:
    parts, counter = [TABLES], 0
    for i in range(0, len(payload), CHUNK):
        chunk, pts = payload[i : i + CHUNK], i // CHUNK * TICKS
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(chunk) + 8, 0x84, 0x80, 5) + _stamp(pts) + chunk
        packets = _packets(pes, counter, pts)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes
    packets: int
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers
    lost: int = 0  # breaks of the continuity counter


def _section_of(packet: np.ndarray) -> bytes:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    section = raw[at : at + 3 + (struct.unpack(">H", raw[at + 1 : at + 3])[0] & 0xFFF)]
    if crc32_mpeg(section) != 0:
        raise ValueError("a table's checksum is wrong")
    return section


def decode(media: bytes, strict: bool = False) -> Stream:
    """The payload, timestamps and random-access points of a stream; strict ones have no breaks of the counters."""
    if not media or len(media) % PACKET:
        raise ValueError("a transport stream is whole packets of 188 bytes")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.uint16) & 0x1F) << 8 | p[:, 2]
    starts = p[:, 1] & 0x40 != 0
    pat = _section_of(p[np.flatnonzero((pid == PAT_PID) & starts)[0]])
    pmt_pid = struct.unpack(">H", pat[10:12])[0] & 0x1FFF
    pmt = _section_of(p[np.flatnonzero((pid == pmt_pid) & starts)[0]])
    at = 12 + (struct.unpack(">H", pmt[10:12])[0] & 0xFFF)
    es_pid = struct.unpack(">H", pmt[at + 1 : at + 3])[0] & 0x1FFF
    mine = np.flatnonzero(pid == es_pid)
    es = p[mine]
    adapts = es[:, 3] & 0x20 != 0
    counters = es[:, 3] & 15
    lost = int((np.diff(counters.astype(np.int16)) % 16 != 1).sum())
    begin = 4 + np.where(adapts, 1 + es[:, 4].astype(np.int64), 0)
    if strict and lost:
        raise ValueError(f"{lost} breaks of the continuity counter")
    data = es[_COLUMNS >= begin[:, None]]
    ends = np.cumsum(PACKET - begin)
    heads = np.flatnonzero(starts[mine])
    cuts = [*(ends[heads] - (PACKET - begin[heads])).tolist(), len(data)]
    raw = data.tobytes()
    out = Stream(b"", len(p), lost=lost)
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if raw[a : a + 3] != b"\0\0\1":
            raise ValueError("an elementary packet has no start code")
        length = struct.unpack(">H", raw[a + 4 : a + 6])[0]
        if raw[a + 7] & 0x80:
            out.pts.append(_time(raw[a + 9 : a + 14]))
        parts.append(raw[a + 9 + raw[a + 8] : min(b, a + 6 + length)])
    out.payload = b"".join(parts)
    out.random_access = mine[adapts & (es[:, 5] & 0x40 != 0) & (es[:, 4] > 0)].tolist()
    return out


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\0")


def _store(batches):
    for batch in batches:
        media = [encode(payload_of(t or b"")) for t in batch.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's transport stream in the binary column media."""
    small_batches(docs.sparkSession)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), data.alias("bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def features(s: Stream) -> str:
    return f"packets={s.packets};pes={len(s.pts)};rap={len(s.random_access)};first_pts={s.pts[0]};last_pts={s.pts[-1]};last_rap={s.random_access[-1]};lost={s.lost}"


def _read(batches):
    for batch in batches:
        cols = [[] for _ in range(8)]
        for media in batch.column("media").to_pylist():
            s = decode(media, strict=True)
            row = (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(s), s.pts, s.random_access)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"]
        arrays = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names)


def read(media: DataFrame) -> DataFrame:
    """Demultiplexes media: digests of what was read back, features, timestamps and random-access points."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(_read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>")


def op7_transport_streams(spark, sf_dir: str) -> DataFrame:
    return read(written(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
