"""Exact top-k inner-product search in three phases with a uniform threshold.

A vector's components are cut into SEGMENTS, which live apart: a cell holds one
segment of a block of rows and of a block of queries, and computes that segment's
inner products, the local scores. The score is the sum of the local ones, so no
cell knows a score; what it hands on are entries (query, row, local score).

1. Every cell gathers, per query, the k first of its local score list. The scores
   of the few rows that are in one of the lists are looked up; the k-th best of
   them is a safe cutoff, as k rows reach it.
2. The cutoffs go to the cells. A row that reaches the cutoff has a local score of
   at least cutoff / SEGMENTS, so only such entries are collected, and summed per
   query and row.
3. A row with all its entries has its score. Of another one, each missing entry is
   below cutoff / SEGMENTS; where that leaves it a chance against the k-th best
   score known by now, what is missing is resolved exactly. The rest cannot reach
   the cutoff. The rows are ranked, ties to the smaller id.

Of equal vectors only those of the k + 1 smallest ids go into the cells: one of
them may be the query's own, and the others come before all that were left out.

Null vectors and those that hold null or non-finite components take no part;
shorter vectors count as if zeros followed. Rows with a query's own id are no
candidates of it. If an id occurs twice among the queries, its smallest vector
is searched; among the rows, each is a candidate. Scores must fit in 64 bits.
Empty tables give empty ones; other columns take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

SEGMENTS = 2
ROW_BLOCK, QUERY_BLOCK = 4096, 2048


def integer_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), rows that take no part left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return embeddings.where(x.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", v.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _local_scores(rows: pa.Table, queries: pa.Table) -> np.ndarray:
    """The local score of each (query, row) of one cell. Floats where they are exact, else 64-bit integers."""
    width = max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (rows, queries)))
    a, q = _matrix(rows.column("v"), width), _matrix(queries.column("v"), width)
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * width
    kind = np.float64 if most < 2**53 else np.int64
    return q.astype(kind) @ a.astype(kind).T


_ENTRY = pa.schema([("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
ENTRY = "query_id long, rid long, vec_id long, score long"


def _entries(rows: pa.Table, queries: pa.Table, pick) -> pa.Table:
    """The entries of a cell that pick(local scores without the queries' own rows) names as (query, row)."""
    if not rows.num_rows or not queries.num_rows:
        return _ENTRY.empty_table()
    local = _local_scores(rows, queries)
    ids, qids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    own = ids == qids[:, None]
    qi, ri = pick(local)
    keep = ~own[qi, ri]
    qi, ri = qi[keep], ri[keep]
    return pa.table([qids[qi], rows.column("rid").to_numpy()[ri], ids[ri], local[qi, ri].astype(np.int64)], schema=_ENTRY)


def _heads(k: int, key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """Phase 1: the first entries of each query's local list, one more than k, as a query's own row may be among them."""

    def pick(local: np.ndarray):
        n = min(k + 1, local.shape[1])
        top = np.argpartition(-local, n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(local)), n), top.ravel()

    return _entries(rows, queries, pick)


def _above(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """Phase 2: the entries that reach their share of the cutoff; all of a query that has none."""
    cutoff = queries.column("cutoff").to_pylist()

    def pick(local: np.ndarray):
        least = np.array([-np.inf if c is None else c / SEGMENTS for c in cutoff])
        return np.nonzero(local >= least[:, None])

    return _entries(rows, queries, pick)


def _cells(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, width: int):
    """Segments of blocks of rows beside the same segments of blocks of queries."""
    r, q, part = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-width // SEGMENTS))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    segment = lambda df: df.withColumn("seg", every(SEGMENTS)).withColumn("v", F.slice("v", F.col("seg") * part + 1, part))
    rows = segment(rows.withColumn("rb", block("rid", r)).withColumn("qb", every(q)))
    queries = segment(queries.withColumn("qb", block("vec_id", q)).withColumn("rb", every(r)))
    return rows.groupBy("seg", "qb", "rb").cogroup(queries.groupBy("seg", "qb", "rb"))


def _scored(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rid, vec_id, score) of (query_id, rid) pairs, looked up."""
    product = F.aggregate(F.zip_with("v", "__q", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    pairs = pairs.select("query_id", "rid").join(rows.select("rid", "vec_id", "v"), "rid")
    return pairs.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("__q")), "query_id").select("query_id", "rid", "vec_id", product.alias("score"))


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """The k-th best score of each query that has so many."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    return scores.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k).where(F.col("rn") == k).select("query_id", F.col("score").alias(name))


def collected(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, rid, vec_id, known, segments) after phase 2, and (query_id, cutoff) of phase 1."""
    first = _cells(rows, queries, n_rows, n_queries, width).applyInArrow(lambda key, a, b: _heads(k, key, a, b), ENTRY)
    cutoffs = written(_kth(_scored(first.select("query_id", "rid").distinct(), rows, queries), k, "cutoff"), "topk-cutoffs")
    asked = queries.join(cutoffs.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    entries = _cells(rows, asked, n_rows, n_queries, width).applyInArrow(_above, ENTRY)
    sums = entries.groupBy("query_id", "rid").agg(F.first("vec_id").alias("vec_id"), F.sum("score").alias("known"), F.count("*").alias("segments"))
    return written(sums, "topk-sums"), cutoffs


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of each query among vectors: query_id, rank, vec_id, score.

    Both inputs are (vec_id, v array<long>); fewer candidates than k are all returned.
    """
    queries = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = vectors.select("vec_id", "v").withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= k + 1).drop("nth")
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "topk-rows")
    (n, width), nq = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first(), queries.count()
    sums, cutoffs = collected(rows, queries, n, nq, width, k)
    whole = sums.where(F.col("segments") == SEGMENTS).select("query_id", "rid", "vec_id", F.col("known").alias("score"))
    better = _kth(whole, k, "better")
    open_ = sums.where(F.col("segments") < SEGMENTS).join(cutoffs, "query_id").join(better, "query_id", "left")
    most = F.col("known") * SEGMENTS + (SEGMENTS - F.col("segments")) * F.col("cutoff")
    open_ = open_.where(most > SEGMENTS * F.greatest(F.col("cutoff"), F.coalesce("better", F.col("cutoff"))))
    found = whole.unionByName(_scored(open_, rows, queries))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_uniform_threshold(spark, sf_dir: str) -> DataFrame:
    vectors = written(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-vectors")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(p.v, q.v)::BIGINT AS score FROM v p, v q WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
