"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenised, an end token is appended, and only documents longer than a
sequence are cut: into pieces of full length behind a first one that takes the
rest. What can share a sequence depends on lengths alone, so the driver sees one
number per length (2048 at most), never a document.

Bins are filled one pattern at a time. The longest length left opens the bin;
a bitset subset-sum over the lengths still available (bit s is set if s tokens
can be filled) finds the fullest combination for the rest of it, which is taken
back from the bitsets and removed as many times as the counts allow. Every
pattern uses up a length, so there are few patterns however many documents.

The pieces of each length are then numbered (in slices, so that no task sorts a
whole length) and take the places that the patterns have for their length.

Null and empty texts are one end token. Repeated rows are packed each.
"""

from __future__ import annotations

import array
import json
import sys
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import Unsupported
from lodestone.llm.common import small_batches, written

LENGTH, END = 2048, 0
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 50_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, without special tokens; ids follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}


def load_special(path: str) -> dict[str, int]:
    """The file's added tokens, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    for t in added:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or not t.get("special"):
            raise Unsupported(f"the added token {t['content']!r} with its flags")
    return {t["content"]: t["id"] for t in added}


def _encoder(ranks: dict[bytes, int], special: dict[str, int] | None = None):
    """One encoder per worker process, as building it takes longer than many texts. Without special, every text is ordinary."""
    import tiktoken

    kept = sys.__dict__.setdefault("_lodestone_encoders", {})
    special = special or {}
    key = (len(ranks), zlib.crc32(b"\0".join(ranks)), *sorted(special.items()))
    if key not in kept:
        kept[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return partial(kept[key].encode, allowed_special="all") if special else kept[key].encode_ordinary


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n if n <= length else (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def _pieces(ranks, special, length: int, end: int, with_ids: bool, batches):
    encode = _encoder(ranks, special)
    for batch in batches:
        doc, piece, start, size, crc, ids_of = [], [], [], [], [], []
        for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = array.array("I", encode(text.decode("utf-8", "replace")) if text else [])
            ids.append(end)
            if sys.byteorder == "big":
                ids.byteswap()
            raw = ids.tobytes()
            for p, (s, n) in enumerate(cut(len(ids), length)):
                doc.append(d)
                piece.append(p)
                start.append(s)
                size.append(n)
                part = raw[4 * s : 4 * (s + n)]
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids_of.append(np.frombuffer(part, "<u4").astype(np.int32))
        arrays = [pa.array(doc, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(ids_of, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    vocabulary = vocabulary or default_vocabulary()
    run = partial(_pieces, load_ranks(vocabulary), load_special(vocabulary), length, end, with_ids)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum <= room, longer lengths first among equals."""
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for n in order:
        copies = min(counts[n], room // n)
        take = 1
        while copies > 0 and not reach & full:
            take = min(take, copies)
            steps.append((n, take, reach))
            reach |= reach << n * take & mask
            copies -= take
            take *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return used


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(times, {piece length: count}) of the bins that hold all pieces."""
    left = {n: c for n, c in histogram.items() if c}
    order = sorted(left, reverse=True)
    out = []
    while order:
        longest = order[0]
        left[longest] -= 1
        room = length - longest
        used = fullest(left, [n for n in order if n <= room and left[n]], room) if room else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= times * c
        out.append((times, used))
        order = [n for n in order if left[n]]
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per piece length: rows (first rank, pieces per bin, first sequence, offset of the first piece), by first rank."""
    table, taken, sequence = {}, {}, 0
    for times, used in found:
        offset = 0
        for n in sorted(used, reverse=True):
            table.setdefault(n, []).append((taken.get(n, 0), used[n], sequence, offset))
            taken[n] = taken.get(n, 0) + times * used[n]
            offset += n * used[n]
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in table.items()}


def _assign(table: dict[int, np.ndarray], batches):
    for batch in batches:
        size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for n in np.unique(size):
            mine = size == n
            rows, r = table[int(n)], rank[mine]
            first, per, seq, off = rows[np.searchsorted(rows[:, 0], r, "right") - 1].T
            sequence[mine] = seq + (r - first) // per
            offset[mine] = off + (r - first) % per * n
        names = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank: the pieces of each length numbered from 0, by slices of about SLICE rows."""
    slices = F.element_at(F.array(*[F.lit(max(1, -(-histogram.get(n, 0) // SLICE))) for n in range(1, max(histogram) + 1)]), F.col("length").cast("int"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), slices))
    counts = rows.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("own", own).join(before, ["length", "slice"]).withColumn("rank", (F.col("before") + F.col("own") - 1).cast("long")).drop("slice", "own", "before")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence_id and their offset in it."""
    rows = written(pieces(docs, vocabulary, length, end, with_ids), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return rows.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    out = ranked(rows, histogram).select(*rows.columns, "rank")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return out.mapInArrow(partial(_assign, places(patterns(histogram, length))), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from pack(..., with_ids=True): sequence_id, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op2_minimum_slack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
