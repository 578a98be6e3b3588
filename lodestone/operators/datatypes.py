"""Storage types of vectors: float32, float16 and uint8, applied to stored rows and queries alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgument
from lodestone.operators import metrics

DATATYPES = ("float32", "float16", "uint8")


def stored(v: Column, datatype: str = "float32", metric: str = "dot") -> Column:
    """What a vector becomes at ingest: normalised for cosine (but never as uint8), then cast.

    uint8 cuts fractions, saturates at 0 and 255 and makes NaN 0; float16 rounds to half precision.
    """
    if datatype not in DATATYPES:
        raise InvalidArgument(f"unknown datatype {datatype!r}")
    if datatype == "uint8":
        return F.transform(v, lambda x: F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(255.0))).cast("int").cast("double"))
    out = metrics.normalised(v) if metric == "cosine" else v
    if datatype == "float16":

        @F.pandas_udf("array<double>")
        def half(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else np.asarray(x, np.float32).astype(np.float16).astype(np.float64))

        return half(out.cast("array<double>"))
    return out.cast("array<float>")


def uint8_cosine(a: Column, b: Column) -> Column:
    """dot / sqrt(|a|^2 |b|^2), 0 when either is the zero vector."""
    norms = metrics.squared_norm(a) * metrics.squared_norm(b)
    return F.when(norms > 0, metrics.similarity("dot", a, b) / F.sqrt(norms)).otherwise(F.lit(0.0))


def finite(v: Column) -> Column:
    """No null, NaN or infinite component."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
