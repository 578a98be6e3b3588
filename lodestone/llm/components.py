"""Connected components of a graph given by its edges, with nothing on the driver but two numbers a round.

Up to ONE_TASK edges, a bound on what a task holds, are labelled in one task; more go through rounds of large-star and
small-star steps. Both name a component by its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import remove, written_at

#: Edges that one task labels: two nodes of some 16 bytes each, about 100 MB with its arrays.
ONE_TASK = 1_000_000


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges (a, b) among 0 .. n - 1: hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label, before):
            return label


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    edges = pa.Table.from_batches(parts)
    coded = pa.chunked_array([*edges.column("u").chunks, *edges.column("v").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    root = smallest_labels(code[: edges.num_rows], code[edges.num_rows :], len(order))
    moved = np.flatnonzero(root != np.arange(len(order)))
    names = coded.dictionary.take(order)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(root[moved]))], ["node", "root"])


def _star(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """One large-star and one small-star step over edges (u, v): each node moves to the smallest one it can see.

    The smallest ones are written before they are joined back, so that a node with very many edges can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, low_at = written_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low, small_at = written_at(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
    small = large.join(low, "u")
    moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), [low_at, small_at]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any orderable type to (node, root): the smallest node of its component, for each node but the roots."""
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    at, path = written_at(first, "edges")
    if at.count() <= ONE_TASK:
        kind = at.schema["u"].dataType.simpleString()
        return at.repartition(1).mapInArrow(_label, f"node {kind}, root {kind}")
    state = None
    while True:
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        (nearer, used), old = _star(at), path
        state, (at, path) = now, written_at(nearer, "edges")
        for p in (*used, old):
            remove(p)
