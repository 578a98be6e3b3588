"""Vector codes: scalar (8 bits), binary (1, 1.5 and 2 bits), product, and rotation-based; and the two-stage search over them.

Scalar and binary codes are column expressions. Product and rotation codes need
matrices; they are fitted on a strided sample of bounded size and applied in
Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgument, Unsupported
from lodestone.operators import metrics
from lodestone.operators.topk import BROADCAST_QUERIES, Exact, _dense, best_pairs, rank_within

SAMPLE = 65_536
MAX_OVERSAMPLING = 65_536
BATCH_QUERIES = BROADCAST_QUERIES  # queries that travel with the tasks of one scan


def oversampled(limit: int, factor: float | None) -> int:
    if factor is None or math.isnan(factor) or factor <= 1:
        return limit
    return math.ceil(limit * min(factor, MAX_OVERSAMPLING))


def rescores_by_default(codec: str, bits: float | None = None) -> bool:
    return not (codec == "turbo" and bits == 4)


def training_sample(points: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Every max(1, n / size)-th row by offset."""
    stride = max(1, points.count() // size)
    return points.where(F.col("offset") % stride == 0)


# scalar


@dataclass(frozen=True)
class Scalar:
    low: float
    high: float

    @property
    def step(self) -> float:
        return (self.high - self.low) / 255 if self.high > self.low else 1.0

    def encode(self, v: Column) -> Column:
        """Codes 0..255, halves away from zero."""
        return F.transform(v, lambda x: F.least(F.greatest(F.round((x.cast("double") - self.low) / self.step), F.lit(0.0)), F.lit(255.0)).cast("smallint"))

    def scorer(self, metric: str, dim: int) -> Callable:
        return partial(ScalarCodes, self, metric, dim)

    def similarity(self, metric: str, a: Column, b: Column, dim: int) -> Column:
        """Of two codes, in integer sums."""
        term = {"dot": lambda x, y: x * y, "cosine": lambda x, y: x * y, "euclid": lambda x, y: (x - y) * (x - y), "manhattan": lambda x, y: F.abs(x - y)}[metric]
        pairs = F.zip_with(a, b, lambda x, y: term(x.cast("long"), y.cast("long")))
        total = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda s, x: s + x)
        both = total(pairs)
        if metric == "euclid":
            return -both * (self.step * self.step)
        if metric == "manhattan":
            return -both * self.step
        sums = total(F.transform(a, lambda x: x.cast("long"))) + total(F.transform(b, lambda x: x.cast("long")))
        return F.lit(dim * self.low * self.low) + sums * (self.low * self.step) + both * (self.step * self.step)


def fit_scalar(points: DataFrame, quantile: float = 1.0) -> Scalar:
    """Bounds from the order of all sampled components: extremes, or the ones that a quantile leaves inside."""
    if not 0.5 <= quantile <= 1:
        raise InvalidArgument("the quantile lies between 0.5 and 1")
    sample = training_sample(points)
    values = sample.select(F.explode("vector").alias("x")).select(F.col("x").cast("double").alias("x"))
    n, rows = values.count(), sample.count()
    cut = max(1, min((n - 1) // 2, int(n * (1 - quantile) / 2)))
    if rows < 127 or quantile >= 1 or n < 4:
        low, high = values.agg(F.min("x"), F.max("x")).first()
        return Scalar(float(low), float(high))
    # Two order statistics; the sample is bounded, and so is what is sorted for each.
    low = values.orderBy("x").limit(cut + 2).agg(F.max("x")).first()[0]
    high = values.orderBy(F.col("x").desc()).limit(cut + 1).agg(F.min("x")).first()[0]
    return Scalar(float(low), float(high))


# binary


def dimension_stats(points: DataFrame) -> DataFrame:
    """Mean and sample deviation of each dimension; the deviation of a single row is 0."""
    each = points.select(F.posexplode("vector").alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    return each.groupBy("dim").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))


def binary_bits(v: Column, bits: float = 1, mean: list[float] | None = None, std: list[float] | None = None) -> Column:
    """ARRAY<INT> of 0 and 1. One bit is the sign; two bits are 00, 10, 11 around a zero band of 2/3 deviations;
    with one and a half, two neighbours share their second bit."""
    if bits == 1:
        return F.transform(v, lambda x: (x.cast("double") > 0).cast("int"))
    if bits not in (1.5, 2):
        raise InvalidArgument("binary codes have 1, 1.5 or 2 bits")
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    z = F.transform(F.arrays_zip(v.alias("x"), m.alias("m"), s.alias("s")), lambda t: F.when(t["s"] > 0, (t["x"].cast("double") - t["m"]) / t["s"]).otherwise(F.lit(0.0)))
    first = F.transform(z, lambda x: (x > -2 / 3).cast("int"))
    second = F.transform(z, lambda x: (x > 2 / 3).cast("int"))
    if bits == 1.5:
        second = F.transform(F.sequence(F.lit(1), F.ceil(F.size(second) / 2).cast("int")), lambda i: F.greatest(second[2 * i - 2], F.coalesce(F.get(second, 2 * i - 1), F.lit(0))))
    return F.concat(first, second)


def packed(bits: Column) -> Column:
    """ARRAY<BIGINT> of 63 bits each."""
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 63).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 63 + 1, 63), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long")))


def binary_similarity(a: Column, b: Column, dim: int) -> Column:
    """dim - 2 * differing bits, for every metric."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.lit(dim) - 2 * differ).cast("double")


# product


@dataclass
class Product:
    books: np.ndarray  # parts x centroids x width

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        x = x.reshape(len(x), parts, width)
        return np.stack([nearest(x[:, p], self.books[p]) for p in range(parts)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The rows that codes stand for."""
        return np.concatenate([self.books[p][codes[:, p]] for p in range(len(self.books))], axis=1)

    def tables(self, q: np.ndarray, metric: str) -> np.ndarray:
        """The similarity of a query's part and each centroid: queries x parts x centroids."""
        q = q.reshape(len(q), self.books.shape[0], 1, -1)
        if metric in ("dot", "cosine"):
            return (q * self.books[None]).sum(axis=-1)
        d = q - self.books[None]
        return -(d * d).sum(axis=-1) if metric == "euclid" else -np.abs(d).sum(axis=-1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the closest centroid by squared distance; the lowest of equals.

    Products find it; where they leave more than one within rounding, the differences decide.
    """
    out = np.empty(len(x), np.int64)
    squares = (centroids * centroids).sum(axis=1)
    longest = math.sqrt(squares.max(initial=0))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = squares - 2 * (part @ centroids.T)
        error = (x.shape[1] + 4) * 2.0**-49 * (np.sqrt((part * part).sum(axis=1)) + longest) ** 2
        best = d.argmin(axis=1)
        close = np.flatnonzero(np.count_nonzero(~(d > (d[np.arange(len(d)), best] + error)[:, None]), axis=1) > 1)
        for c in np.array_split(close, max(1, len(close) * centroids.size // 4_000_000)):
            best[c] = ((part[c][:, None] - centroids[None]) ** 2).sum(axis=-1).argmin(axis=1)
        out[at : at + 4096] = best
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Lloyd's rounds from strided seeds; an empty centroid stays where it is."""
    n = len(x)
    centroids = x[[c * n // k % n for c in range(k)]].astype(np.float64)
    before = None
    for _ in range(rounds):
        at = nearest(x, centroids)
        if before is not None and (at == before).all():
            break
        before = at
        count = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def parts_for(dim: int, ratio: int) -> int:
    """Bytes per code for a compression ratio of 4 to 64, lowered until the dimensions divide."""
    if ratio not in (4, 8, 16, 32, 64):
        raise InvalidArgument("product codes compress 4, 8, 16, 32 or 64 times")
    m = max(1, 4 * dim // ratio)
    while dim % m:
        m -= 1
    return m


def _sample_matrix(points: DataFrame) -> np.ndarray:
    """The training rows by offset; their number is bounded by SAMPLE, times two at most."""
    rows = training_sample(points).select("offset", "vector").toPandas().sort_values("offset")
    return np.stack(rows["vector"].to_numpy()).astype(np.float64)


def fit_product(points: DataFrame, ratio: int = 16, centroids: int = 256) -> Product:
    x = _sample_matrix(points)
    m = parts_for(x.shape[1], ratio)
    return Product(np.stack([k_means(p, min(centroids, len(x))) for p in x.reshape(len(x), m, -1).transpose(1, 0, 2)]))


# rotation


@dataclass
class Rotation:
    """Signs and permutations between Walsh-Hadamard transforms spread a vector's energy evenly; levels suit a normal distribution."""

    dim: int
    bits: float
    permutations: list[np.ndarray]
    shift: np.ndarray
    scale: np.ndarray

    LEVELS = {
        1: [-0.7979, 0.7979],
        2: [-1.5104, -0.4528, 0.4528, 1.5104],
        4: [-2.7326, -2.0690, -1.6180, -1.2562, -0.9423, -0.6568, -0.3880, -0.1284, 0.1284, 0.3880, 0.6568, 0.9423, 1.2562, 1.6180, 2.0690, 2.7326],
    }

    @property
    def levels(self) -> np.ndarray:
        return np.array(self.LEVELS[2 if self.bits == 1.5 else int(self.bits)])

    def rotate(self, x: np.ndarray) -> np.ndarray:
        wide = 1 << max(0, (self.dim - 1).bit_length())
        y = np.zeros((len(x), wide))
        y[:, : self.dim] = x
        y = hadamard(y)
        for p in self.permutations:
            y = hadamard(y[:, p])
        return y

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level indexes, and the norm by which a row was divided."""
        norm = np.linalg.norm(x, axis=1)
        y = self.rotate(x / np.maximum(norm, 1e-30)[:, None])
        y = (y - self.shift) / self.scale
        return np.abs(y[:, :, None] - self.levels).argmin(axis=2), norm

    def decode(self, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The rotated vectors that codes stand for."""
        y = self.levels[codes] * self.scale + self.shift
        return y / np.maximum(np.linalg.norm(y, axis=1), 1e-30)[:, None] * norm[:, None]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows whose width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def fit_rotation(points: DataFrame, bits: float = 4, metric: str = "dot", seed: int = 42) -> Rotation:
    if metric == "manhattan":
        raise Unsupported("rotation codes with the manhattan metric")
    if bits not in (1, 1.5, 2, 4):
        raise InvalidArgument("rotation codes have 1, 1.5, 2 or 4 bits")
    x = _sample_matrix(points)
    dim = x.shape[1]
    wide = 1 << max(0, (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    r = Rotation(dim, bits, [rng.permutation(wide) for _ in range(3)], np.zeros(wide), np.full(wide, 1 / math.sqrt(wide)))
    y = r.rotate(x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None])
    r.shift, r.scale = y.mean(axis=0), np.maximum(y.std(axis=0), 1e-12)
    return r


# two stages


def rescored(candidates: DataFrame, points: DataFrame, queries: DataFrame, metric: str, limit: int, offset: int = 0) -> DataFrame:
    """Exact scores of (qid, offset) candidates, ranked."""
    rows = candidates.select("qid", "offset").join(points.select("offset", "vector"), "offset").join(queries.select("qid", "q"), "qid")
    rows = rows.select("qid", "offset", metrics.similarity(metric, F.col("vector"), F.col("q")).alias("sim"))
    page = rank_within(rows, "qid", [F.col("sim").desc(), F.col("offset").asc()], limit, offset)
    return page.select("qid", "rank", "offset", metrics.reported(metric, F.col("sim")).alias("score"))


def two_stage(coded: DataFrame, points: DataFrame, queries: DataFrame, scorer: Callable, metric: str = "dot", limit: int = 10, oversampling: float | None = None, ef: int = 0, rescore: bool = True) -> DataFrame:
    """coded is (offset, code), queries (qid, q, qcode); scorer is of code and qcode. The pool is max(limit * oversampling, ef)."""
    pool = max(oversampled(limit, oversampling), ef, limit) if rescore else limit
    found = best_pairs(coded.select("offset", "code"), queries.select("qid", "qcode"), scorer, pool)
    first = rank_within(found, "qid", [F.col("sim").desc(), F.col("offset").asc()], pool)
    if not rescore:
        return first.select("qid", "rank", "offset", F.col("sim").alias("score"))
    return rescored(first, points, queries, metric, limit)


class _Codes:
    """Scores of integer codes, which have no error; a pair with a code that is null or of another length has none."""

    def __init__(self, queries: pa.Table):
        column = queries.column("qcode")
        self.width = max((len(c) for c in column if c.is_valid), default=0)
        self.q, self.known = _code_matrix(column, self.width)

    def rows(self, batch: pa.RecordBatch):
        return _code_matrix(batch.column("code"), self.width)

    def rough(self, a: int, b: int, x) -> tuple[np.ndarray, float]:
        sim = self.pairs(self.q[a:b], x[0])
        sim[~self.known[a:b]] = -np.inf
        sim[:, ~x[1]] = -np.inf
        self.at, self.sim = a, sim
        return sim, 0.0

    def exact(self, qi: np.ndarray, xi: np.ndarray, x) -> np.ndarray:
        return self.sim[qi - self.at, xi].astype(np.float64)

    def allowed(self, a: int, b: int, x) -> None:
        return None


def _code_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    flat = column.filter(known).flatten()
    known, out = known.to_numpy(zero_copy_only=False), np.zeros((len(column), width), np.int64)
    out[known] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(-1, width)
    if flat.null_count:
        known[np.flatnonzero(known)[~flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)]] = False
    return out, known


class ScalarCodes(_Codes):
    """The same sums in the same order as Scalar.similarity."""

    def __init__(self, codec: Scalar, metric: str, dim: int, queries: pa.Table):
        super().__init__(queries)
        self.codec, self.metric, self.dim = codec, metric, dim

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step, low = self.codec.step, self.codec.low
        if self.metric == "manhattan":
            return np.stack([-np.abs(b - row).sum(axis=1) for row in a]).astype(np.float64) * step
        kind = np.float32 if a.shape[1] * 255 * 255 < 2**24 else np.float64  # whole numbers without rounding
        both = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
        if self.metric == "euclid":
            squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
            return (2 * both - squares) * (step * step)
        both *= step * step
        both += self.dim * low * low + (a.sum(axis=1)[:, None] + b.sum(axis=1)[None]) * (low * step)
        return both


class BinaryCodes(_Codes):
    """dim - 2 * differing bits, as binary_similarity."""

    def __init__(self, dim: int, queries: pa.Table):
        super().__init__(queries)
        self.dim = dim

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 5 else np.int32)
        for w in range(a.shape[1]):
            differ += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
        return self.dim - 2 * differ.astype(np.float32)


class ProductCodes(Exact):
    """Sums over a query's tables, as _look_up; rough scores of an inner product come from the rows that the codes stand for."""

    def __init__(self, model: Product, metric: str, queries: pa.Table):
        super().__init__(metric, queries)
        self.model = model

    def rows(self, batch: pa.RecordBatch):
        codes = self.model.encode(_dense(batch.column("vector"), self.dim))
        return codes, self.block(self.model.decode(codes))

    def rough(self, a: int, b: int, x) -> tuple[np.ndarray, np.ndarray]:
        self.at, self.tables = a, self.model.tables(self.q[a:b], self.metric)
        if self.metric in ("dot", "cosine"):
            return super().rough(a, b, x[1])
        return _look_up(x[0], self.tables), 0.0

    def exact(self, qi: np.ndarray, xi: np.ndarray, x) -> np.ndarray:
        return sum(self.tables[qi - self.at, p, x[0][xi, p]] for p in range(x[0].shape[1]))


class RotationCodes(Exact):
    """Queries stay exact, rows are decoded from their levels."""

    def __init__(self, model: Rotation, metric: str, queries: pa.Table):
        super().__init__(metric, queries, model.rotate)
        self.model = model

    def rows(self, batch: pa.RecordBatch):
        return self.block(self.model.decode(*self.model.encode(_dense(batch.column("vector"), self.dim))))


def product_search(points: DataFrame, queries: DataFrame, model: Product, metric: str = "dot", limit: int = 10, oversampling: float = 4.0) -> DataFrame:
    """Rows are coded by the batch and scored by table look-ups; the pool is rescored."""
    return _batch_search(points, queries, partial(ProductCodes, model, metric), metric, limit, oversampling)


def _look_up(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return sum(tables[:, p, :][:, codes[:, p]] for p in range(codes.shape[1]))


def rotation_search(points: DataFrame, queries: DataFrame, model: Rotation, metric: str = "dot", limit: int = 10, oversampling: float = 4.0) -> DataFrame:
    """Rows are decoded from their levels by the batch; the pool is rescored."""
    return _batch_search(points, queries, partial(RotationCodes, model, metric), metric, limit, oversampling)


def _batch_search(points, queries, scorer, metric, limit, oversampling):
    pool = oversampled(limit, oversampling)
    found = best_pairs(points.select("offset", "vector"), queries.select("qid", "q"), scorer, pool)
    return rescored(rank_within(found, "qid", [F.col("sim").desc(), F.col("offset").asc()], pool), points, queries, metric, limit)
