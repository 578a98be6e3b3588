"""Exact nearest neighbours for a batch of queries in one scan."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import metrics

MAX_WINDOW = 4096
#: A query batch above this many rows does not travel with the tasks; nor does one whose tasks would keep more than KEPT rows.
BROADCAST_QUERIES = 10_000
KEPT = 4_000_000
#: Larger batches meet the points in groups of at most about this many queries and rows.
CELL_QUERIES, CELL_ROWS = 32_768, 65_536
#: Queries and rows that are scored at once, and pairs whose exact scores are.
CHUNK, BLOCK, PAIRS = 256, 4096, 65_536


def check_window(limit: int, offset: int = 0) -> None:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if limit + offset > MAX_WINDOW:
        raise ValueError(f"limit + offset may not exceed {MAX_WINDOW}")


def rank_within(df: DataFrame, group: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit of each group, with their rank counted from 1 behind the offset."""
    check_window(limit, offset)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= limit + offset)
    if offset:
        ranked = ranked.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)
    return ranked


def _dense(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors must have {dim} components")
    return flat.reshape(-1, dim)


def _rough(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Similarities of all pairs, to find candidates by; differences are taken directly, never from squared norms."""
    if metric in ("dot", "cosine"):
        return q @ x.T
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        d = x - row
        out[i] = -np.einsum("ij,ij->i", d, d) if metric == "euclid" else -np.abs(d).sum(axis=1)
    return out


def _pairwise(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Similarities of rows, the same for equal rows wherever they stand."""
    if metric in ("dot", "cosine"):
        return np.einsum("ij,ij->i", q, x)
    d = q - x
    return -np.einsum("ij,ij->i", d, d) if metric == "euclid" else -np.abs(d).sum(axis=1)


class Exact:
    """Scores of vectors by a metric: rough ones of all pairs of a block, in single precision where it bounds the error, and exact ones of chosen pairs."""

    def __init__(self, metric: str, queries: pa.Table, prepare: Callable | None = None):
        self.metric = metric
        self.q = _dense(queries.column("q"), len(queries.column("q")[0]))
        self.dim, self.q = self.q.shape[1], prepare(self.q) if prepare else self.q
        self.q32, self.lengths, self.largest = self.q.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", self.q, self.q)), np.abs(self.q).max(initial=0)
        if not np.isfinite(self.lengths).all():
            self.lengths, self.largest = np.nan_to_num(self.lengths, posinf=0), np.inf

    def rows(self, batch: pa.RecordBatch):
        return self.block(_dense(batch.column("vector"), self.dim))

    def block(self, x: np.ndarray):
        squares = np.einsum("ij,ij->i", x, x)
        finite = np.isfinite(squares)
        longest = math.sqrt(squares[finite].max(initial=0))
        single = self.metric in ("dot", "cosine") and finite.all() and max(longest, self.largest) < 1e15
        return x, x.astype(np.float32) if single else None, longest

    def rough(self, a: int, b: int, x) -> tuple[np.ndarray, np.ndarray | float]:
        """Of queries a to b, and twice the error that these scores may have."""
        x, x32, longest = x
        single = x32 is not None
        error = (x.shape[1] + 4) * (2.0**-22 if single else 2.0**-50) * self.lengths[a:b] * longest + 1e-30
        return self.q32[a:b] @ x32.T if single else _rough(self.metric, self.q[a:b], x), error

    def allowed(self, a: int, b: int, x) -> np.ndarray | None:
        return None

    def exact(self, qi: np.ndarray, xi: np.ndarray, x) -> np.ndarray:
        return _pairwise(self.metric, self.q[qi], x[0][xi])


class Best:
    """The best `keep` (key, offset) of each of n queries, of rows in any order; ties go to the smaller offset, and NaN counts as the largest, as in Spark."""

    def __init__(self, n: int, keep: int):
        self.n, self.keep = n, keep
        self.floor, self.edge = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)  # the last place of each full list
        self.rows = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)
        self.waiting: list = []
        self.count = 0

    def add(self, qi: np.ndarray, key: np.ndarray, offset: np.ndarray, value: np.ndarray | None = None) -> None:
        """A value other than the key may go with it."""
        key = np.where(np.isnan(key), np.inf, key)
        better = (key > self.floor[qi]) | ((key == self.floor[qi]) & (offset < self.edge[qi]))
        self.waiting.append((qi[better], key[better], offset[better], (key if value is None else value)[better]))
        self.count += len(self.waiting[-1][0])
        if self.count > self.n * self.keep:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is kept, by query and place."""
        if self.count:
            qi, key, offset, value = (np.concatenate(c) for c in zip(self.rows, *self.waiting, strict=True))
            order = np.lexsort((offset, -key, qi))
            qi, key, offset = qi[order], key[order], offset[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            last = place == self.keep - 1
            self.floor[qi[last]], self.edge[qi[last]] = key[last], offset[last]
            self.rows = tuple(c[place < self.keep] for c in (qi, key, offset, value[order]))
            self.waiting, self.count = [], 0
        return self.rows


def _below(key: np.ndarray, error: np.ndarray | float, dtype) -> np.ndarray:
    """What a rough score of a row must reach whose exact score reaches the key."""
    with np.errstate(invalid="ignore"):
        out = np.where(np.isinf(key), key, key - error - 1e-9 * np.maximum(1, np.abs(key)) * (dtype == np.float64)) if np.any(error) else key
    return np.nextafter(out.astype(np.float32), np.float32(-np.inf)) if dtype == np.float32 else out


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BLOCK rows, however small they come."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if n and (n >= BLOCK or batch is None):
            table = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, n, BLOCK):
                yield from table.slice(at, BLOCK).to_batches()
            held, n = [], 0


def meet(rows: DataFrame, queries: DataFrame, work: Callable, schema: str, keep: int = 1) -> DataFrame:
    """What work(Arrow batches of rows, Arrow table of queries) yields, every query having met every row.

    A few queries, each of which keeps up to `keep` rows, travel with the tasks of one scan. More are dealt into blocks,
    as the rows are, and each pair of blocks is a group of its own, so that no task and no driver holds all of either.
    """
    travel, most = (max(1, min(n, KEPT // keep)) for n in (BROADCAST_QUERIES, CELL_QUERIES))
    some = queries.limit(travel + 1).toArrow()
    if not some.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    if some.num_rows <= travel:
        return rows.mapInArrow(lambda batches: work(batches, some), schema)
    n, m = queries.count(), rows.count()
    width = -(-n // most)
    wanted = -(-4 * rows.sparkSession.sparkContext.defaultParallelism // width)
    height = max(1, -(-m // CELL_ROWS), min(wanted, -(-m // BLOCK)))
    deal = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    left = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: w * height + deal("offset", height))))
    first = deal("qid", width) * height
    right = queries.withColumn("cell", F.explode(F.sequence(first, first + height - 1)))
    parts = min(width * height, 1000)
    left, right = left.repartition(parts, "cell").groupBy("cell"), right.repartition(parts, "cell").groupBy("cell")
    empty = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def group(x: pa.Table, q: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(work(x.to_batches(), q)) if x.num_rows and q.num_rows else [], empty)

    return left.cogroup(right).applyInArrow(group, schema)


def best_pairs(rows: DataFrame, queries: DataFrame, scorer: Callable, keep: int) -> DataFrame:
    """(qid, offset, sim): rows of rows(offset, ...) among which are the best `keep` for each query.

    scorer(table of queries) has rows(batch), rough(a, b, rows) of queries a to b, where `allowed` may narrow the pairs, and exact(qi, xi, rows).
    A task keeps the best rows so far, scores CHUNK queries against BLOCK rows at once, and looks closer only at pairs that could enter.
    """
    def work(batches: Iterable[pa.RecordBatch], table: pa.Table) -> Iterator[pa.RecordBatch]:
        qid, score = table.column("qid").to_numpy(), scorer(table)
        best = {a: Best(min(CHUNK, len(qid) - a), keep) for a in range(0, len(qid), CHUNK)}
        for batch in _blocks(batches):
            offsets, x = batch.column("offset").to_numpy(), score.rows(batch)
            for a, b in best.items():
                sim, error = score.rough(a, a + b.n, x)
                allowed, floor = score.allowed(a, a + b.n, x), b.floor
                if len(offsets) >= keep and not np.isfinite(floor).all():
                    inside = sim if allowed is None else np.where(allowed, sim, -np.inf)
                    floor = np.maximum(floor, np.nan_to_num(np.partition(inside, len(offsets) - keep, axis=1)[:, len(offsets) - keep], nan=np.inf, posinf=np.inf, neginf=-np.inf))
                near = ~(sim < _below(floor, error, sim.dtype)[:, None])
                qi, xi = np.nonzero(near if allowed is None else near & allowed)
                for at in range(0, len(qi), PAIRS):
                    i, j = qi[at : at + PAIRS], xi[at : at + PAIRS]
                    b.add(i, score.exact(a + i, j, x), offsets[j])
                if not np.isfinite(b.floor).all():
                    b.settle()
        for a, b in best.items():
            i, key, offset, _ = b.settle()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(qid[a + i], pa.int64()), pa.array(offset, pa.int64()), pa.array(np.where(key == np.inf, np.nan, key), mask=key == -np.inf)], ["qid", "offset", "sim"])

    return meet(rows, queries, work, "qid long, offset long, sim double", keep)


def places(points: DataFrame, queries: DataFrame, targets: DataFrame, metric: str) -> DataFrame:
    """(qid, offset, place) of targets (qid, offset, sim): where each stands among all points, whose number it does not hold. sim is the score that ranks."""
    listed = targets.groupBy("qid", "offset").agg(F.max("sim").alias("sim")).groupBy("qid").agg(F.collect_list("sim").alias("sims"), F.collect_list("offset").alias("offsets"))

    def work(batches: Iterable[pa.RecordBatch], table: pa.Table) -> Iterator[pa.RecordBatch]:
        qid, score = table.column("qid").to_numpy(), Exact(metric, table)
        sims, ids = table.column("sims").to_pylist(), table.column("offsets").to_pylist()
        wide = max(map(len, sims))
        s, o = np.full((len(qid), wide), np.nan), np.zeros((len(qid), wide), np.int64)  # nothing is above NaN
        for i, (v, w) in enumerate(zip(sims, ids, strict=True)):
            s[i, : len(v)], o[i, : len(w)] = v, w
        before = np.zeros((len(qid), wide), np.int64)
        for batch in _blocks(batches):
            offsets, x = batch.column("offset").to_numpy(), score.rows(batch)
            for a in range(0, len(qid), CHUNK):
                sim, error = score.rough(a, min(a + CHUNK, len(qid)), x)
                for t in range(wide):
                    at = s[a : a + CHUNK, t]
                    above = ~(sim <= -_below(-at, error, sim.dtype)[:, None])
                    before[a : a + CHUNK, t] += np.count_nonzero(above, axis=1)
                    qi, xi = np.nonzero((sim >= _below(at, error, sim.dtype)[:, None]) & ~above)
                    for at in range(0, len(qi), PAIRS):
                        i, j = a + qi[at : at + PAIRS], xi[at : at + PAIRS]
                        exact = score.exact(i, j, x)
                        first = (exact > s[i, t]) | ((exact == s[i, t]) & (offsets[j] < o[i, t]))
                        before[:, t] += np.bincount(i[first], minlength=len(qid))
        i, t = np.nonzero(~np.isnan(s))
        yield pa.RecordBatch.from_arrays([pa.array(qid[i], pa.int64()), pa.array(o[i, t], pa.int64()), pa.array(before[i, t], pa.int64())], ["qid", "offset", "before"])

    counts = meet(points.select("offset", "vector"), queries.select("qid", "q").join(listed, "qid"), work, "qid long, offset long, before long")
    return counts.groupBy("qid", "offset").agg((F.sum("before") + 1).alias("place"))


def knn(
    points: DataFrame,
    queries: DataFrame,
    metric: str = "dot",
    limit: int = 10,
    offset: int = 0,
    where: Column | str | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """Exact kNN of points(offset, vector, ...) for queries(qid, q).

    The filter works below the scores; ties go to the smaller offset. The
    threshold is strict and looks at the ranked page only. Returns qid, rank,
    offset, score.
    """
    if metric == "cosine":
        points = points.withColumn("vector", metrics.normalised(F.col("vector")))
        queries = queries.withColumn("q", metrics.normalised(F.col("q")))
    if where is not None:
        where = F.expr(where) if isinstance(where, str) else where
        points = points.where(F.coalesce(where, F.lit(False)))
    points, queries = points.select("offset", "vector"), queries.select("qid", "q")
    check_window(limit, offset)
    scored = best_pairs(points, queries, partial(Exact, metric), limit + offset)
    page = rank_within(scored, "qid", [F.col("sim").desc(), F.col("offset").asc()], limit, offset)
    out = page.select("qid", "rank", "offset", metrics.reported(metric, F.col("sim")).alias("score"))
    if threshold is not None:
        better = F.col("score") < threshold if metric in ("euclid", "manhattan") else F.col("score") > threshold
        out = out.where(better)
    return out
