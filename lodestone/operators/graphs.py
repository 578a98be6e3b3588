"""Neighbour graphs as edge tables: reachability and what builds disagree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes u that can be reached from seeds (u) along edges (u, v), however far; plans are cut every four steps."""
    seen = seeds.select("u").distinct()
    frontier, checkpoints, steps = seen, bool(edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()), 0
    while not frontier.isEmpty():
        frontier = edges.join(frontier, "u").select(F.col("v").alias("u")).distinct().join(seen, "u", "left_anti")
        seen, steps = seen.unionByName(frontier), steps + 1
        if steps % 4 == 0 and checkpoints:
            frontier, seen = frontier.checkpoint(), seen.checkpoint()
    return seen


def worse_overlap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(build, qid, hits): how far the queries on which two builds fall short of the best are the same ones; 1 if none are."""
    best = rows.groupBy("qid").agg(F.max("hits").alias("best"))
    worse = rows.join(best, "qid").where(F.col("hits") < F.col("best")).groupBy("qid").agg(F.max((F.col("build") == a).cast("int")).alias("a"), F.max((F.col("build") == b).cast("int")).alias("b"))
    either, both = F.count_if((F.col("a") == 1) | (F.col("b") == 1)), F.count_if((F.col("a") == 1) & (F.col("b") == 1))
    return worse.agg(F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))
