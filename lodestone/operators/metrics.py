"""Similarity between two array columns, and how it is reported.

Ranking always uses a similarity (larger is better); euclid and manhattan
report a distance. Scores are computed in DOUBLE, left to right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("dot", "cosine", "euclid", "manhattan")


def _fold(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """The quantity to rank on. Cosine expects rows that were normalised at ingest."""
    if metric in ("dot", "cosine"):
        return _fold(a, b, lambda x, y: x * y)
    if metric == "euclid":
        return -_fold(a, b, lambda x, y: (x - y) * (x - y))
    if metric == "manhattan":
        return -_fold(a, b, lambda x, y: F.abs(x - y))
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def reported(metric: str, sim: Column) -> Column:
    """The score a caller sees: a distance for euclid and manhattan."""
    if metric == "euclid":
        return F.sqrt(F.abs(sim))
    if metric == "manhattan":
        return F.abs(sim)
    return sim


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def normalised(v: Column) -> Column:
    """Unit length, except where the squared norm is nearly 0 or nearly 1: those rows stay as they are."""
    n2 = squared_norm(v)
    stays = (n2 < F.lit(1.1920928955078125e-07)) | (F.abs(n2 - 1.0) <= 1e-6)
    return F.when(stays, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / F.sqrt(n2))
    )
