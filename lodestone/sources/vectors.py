"""Vector files: fbin, fvecs, ivecs and npy, and the line formats of queries, payloads and judgements.

Files are listed and read by Spark (binaryFile), so any file system that it
knows will do; each file is parsed in Arrow batches on the executors.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 8192


def parse_fbin(data: bytes, limit: int | None = None) -> np.ndarray:
    """(u32 rows, u32 dim), then rows of f32."""
    if len(data) < 8:
        raise ValueError("an fbin file begins with two counts")
    n, dim = struct.unpack("<II", data[:8])
    if len(data) != 8 + 4 * n * dim:
        raise ValueError(f"an fbin file of {n} x {dim} has {8 + 4 * n * dim} bytes, not {len(data)}")
    rows = np.frombuffer(data, "<f4", offset=8).reshape(n, dim)
    return rows if limit is None else rows[:limit]


def parse_vecs(data: bytes, kind: str = "<f4") -> np.ndarray:
    """Rows of (u32 dim, dim values of four bytes); all rows have one dimension."""
    if not data:
        return np.empty((0, 0), kind)
    dim = struct.unpack("<I", data[:4])[0]
    if len(data) % (4 * (dim + 1)):
        raise ValueError("rows differ in their dimension")
    rows = np.frombuffer(data, "<u4").reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError("rows differ in their dimension")
    return np.ascontiguousarray(rows[:, 1:]).view(kind)


def parse_npy(data: bytes) -> np.ndarray:
    """A two-dimensional array of f2 or f4 in C order, as f4."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = 2 if data[6] == 1 else 4
    size = int.from_bytes(data[8 : 8 + wide], "little")
    head = ast.literal_eval(data[8 + wide : 8 + wide + size].decode("latin1").strip())
    if head["fortran_order"] or head["descr"] not in ("<f2", "<f4") or len(head["shape"]) != 2:
        raise ValueError("npy files hold rows of <f2 or <f4 in C order")
    return np.frombuffer(data, head["descr"], offset=8 + wide + size).reshape(head["shape"]).astype(np.float32)


def fbin_bytes(rows: np.ndarray) -> bytes:
    return struct.pack("<II", *rows.shape) + np.ascontiguousarray(rows, "<f4").tobytes()


def vecs_bytes(rows: np.ndarray, kind: str = "<f4") -> bytes:
    out = np.empty((rows.shape[0], rows.shape[1] + 1), "<u4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = np.ascontiguousarray(rows, kind).view("<u4")
    return out.tobytes()


_PARSERS = {"fbin": parse_fbin, "fvecs": parse_vecs, "ivecs": lambda d: parse_vecs(d, "<i4"), "npy": parse_npy}


def read_vectors(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, row, vector) of each file under the path; offsets over several files follow from with_offsets()."""
    kind = kind or path.rsplit(".", 1)[-1]
    parse, item = _PARSERS[kind], pa.int32() if kind == "ivecs" else pa.float32()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = parse(data)
                for i in range(0, len(rows), ROWS):
                    part = rows[i : i + ROWS]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel(), item))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part)), pa.int64()), lists], ["file", "row", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, f"file string, row long, vector array<{'int' if kind == 'ivecs' else 'float'}>")


def with_offsets(rows: DataFrame) -> DataFrame:
    """Numbers rows over files in the order of their names: offset, vector."""
    from pyspark.sql import Window

    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n"))  # one row per file
    return rows.join(before, "file").select((F.col("before") + F.col("row")).alias("offset"), "vector")


def hold_out(points: DataFrame, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """The last n_queries offsets as queries (qid from 0), the rest as the base."""
    last = (points.agg(F.max("offset")).first()[0] or 0) + 1
    base = points.where(F.col("offset") < last - n_queries)
    held = points.where(F.col("offset") >= last - n_queries)
    return base, held.select((F.col("offset") - (last - n_queries)).alias("qid"), F.col("vector").alias("q"))


def read_embeddings(spark: SparkSession, path: str, column: str, order: str) -> DataFrame:
    """(order, vector) of a parquet data set with one list column; all rows must have one dimension."""
    rows = spark.read.parquet(path).select(order, F.col(column).cast("array<float>").alias("vector"))
    dims = rows.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if dims["low"] != dims["high"]:
        raise ValueError(f"vectors have {dims['low']} to {dims['high']} dimensions")
    return rows


TESTS = "query array<float>, conditions string, closest_ids array<long>, closest_scores array<double>"


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of query, conditions, closest_ids and closest_scores."""
    return spark.read.schema(TESTS).json(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one object each, as VARIANT."""
    return spark.read.text(path).select(F.parse_json("value").alias("payload"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of _id, title and text; values are the title, if any, and the text."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("id"), F.filter(F.array("title", "text"), lambda x: F.coalesce(x, F.lit("")) != "").alias("values"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query, document and grade under a header line."""
    return spark.read.option("sep", "\t").option("header", True).schema("qid string, doc string, grade int").csv(path)


def map_qrels(qrels: DataFrame, corpus: DataFrame, queries: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Judgements by numbers: corpus is (id, offset), queries (id, qid). Judged documents that are not there are an error unless allowed."""
    lost = qrels.join(corpus, qrels["doc"] == corpus["id"], "left_anti").where(~F.col("doc").isin(*allowed) if allowed else F.lit(True))
    missing = [r["doc"] for r in lost.select("doc").distinct().limit(5).collect()]
    if missing:
        raise ValueError(f"judged documents are missing: {', '.join(missing)}")
    c, q = corpus.select(F.col("id").alias("doc"), "offset"), queries.select(F.col("id").alias("qid"), F.col("qid").alias("number"))
    return qrels.join(c, "doc").join(q, "qid").select(F.col("number").alias("qid"), F.col("offset").alias("id"), "grade")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h
