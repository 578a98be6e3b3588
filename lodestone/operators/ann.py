"""Approximate search by inverted lists: rows are assigned to centroids, a query probes the closest lists.

A filter works before the scores. Where the lists that a query probes hold fewer
than `limit` rows that pass, the query is answered exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import quantize, topk
from lodestone.operators.quantize import k_means, nearest

FULL_SCAN_KB = 10_000
REBUILD_RATIO = 0.10


@dataclass
class Lists:
    centroids: np.ndarray
    rows: DataFrame  # offset, vector, list, ...
    covered: int

    def assign(self, points: DataFrame) -> DataFrame:
        """Adds list, the closest centroid, to points."""
        centroids = self.centroids

        @F.pandas_udf("int")
        def closest(v: pd.Series) -> pd.Series:
            return pd.Series(nearest(np.stack(v.to_numpy()).astype(np.float64), centroids).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

        return points.withColumn("list", closest("vector"))


def build(points: DataFrame, lists: int = 16) -> Lists:
    """Centroids come from a strided sample of bounded size; every row gets a list."""
    x = quantize._sample_matrix(points)
    out = Lists(k_means(x, min(lists, len(x))), points, points.count())
    out.rows = out.assign(points)
    return out


def extend(index: Lists, new: DataFrame) -> tuple[Lists, bool]:
    """New rows go to the lists that are there; True if so many came that a rebuild is due."""
    pending = new.count()
    grown = Lists(index.centroids, index.rows.unionByName(index.assign(new)), index.covered)
    return grown, pending >= REBUILD_RATIO * index.covered


def search(index: Lists, queries: DataFrame, metric: str = "dot", limit: int = 10, probes: int = 4, where: Column | str | None = None) -> DataFrame:
    rows = index.rows
    if where is not None:
        rows = rows.where(F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False)))
    centroids = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)], "offset long, vector array<double>")
    near = topk.knn(centroids, queries, metric, min(probes, len(index.centroids)))
    probed = near.select("qid", F.col("offset").cast("int").alias("list"))
    # How many rows a query will find follows from the sizes of its lists.
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    asked = probed.join(sizes, "list", "left").groupBy("qid").agg(F.collect_set("list").alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    asked = queries.select("qid", "q").join(asked, "qid", "left")
    full, short = asked.where(F.col("n") >= limit), asked.where(F.coalesce(F.col("n") < limit, F.lit(True))).select("qid", "q")
    pairs = topk.best_pairs(rows.select("offset", "vector", "list"), full.select("qid", "q", "lists"), partial(Probed, metric, len(index.centroids)), limit)
    page = topk.rank_within(pairs, "qid", [F.col("sim").desc(), F.col("offset").asc()], limit)
    page = quantize.rescored(page, rows, queries, metric, limit)
    return page.unionByName(topk.knn(rows.select("offset", "vector"), short, metric, limit))


class Probed(topk.Exact):
    """Exact scores of the rows in the lists that a query probes."""

    def __init__(self, metric: str, count: int, queries: pa.Table):
        super().__init__(metric, queries)
        lists = queries.column("lists").to_pylist()
        self.probes = np.zeros((len(lists), count), bool)
        for i, probed in enumerate(lists):
            self.probes[i, probed] = True

    def rows(self, batch: pa.RecordBatch):
        return super().rows(batch), batch.column("list").to_numpy()

    def rough(self, a: int, b: int, x) -> tuple[np.ndarray, np.ndarray]:
        return super().rough(a, b, x[0])

    def exact(self, qi: np.ndarray, xi: np.ndarray, x) -> np.ndarray:
        return super().exact(qi, xi, x[0])

    def allowed(self, a: int, b: int, x) -> np.ndarray:
        return self.probes[a:b][:, x[1]]


def plan(points: DataFrame, dim: int, quantized: bool = False, exact: bool = False, threshold_kb: int = FULL_SCAN_KB, element_bytes: int = 4) -> str:
    """exact, lists or quantized: small collections are scanned, as are those for which it is asked."""
    if exact or points.count() < threshold_kb * 1024 // (dim * element_bytes):
        return "exact"
    return "quantized" if quantized else "lists"
