"""Nearest-neighbour queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import topk


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("offset"), F.col("embedding").alias("vector"), "label")


def stated_queries(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50, searched for among all rows."""
    p = points(spark, sf_dir).where(F.col("offset") % 50 == 0)
    return p.select(F.col("offset").alias("qid"), F.transform("vector", lambda x: x.cast("double") * scale).alias("q"))


def _knn(metric: str, scale: float = 1.0, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = topk.knn(points(spark, sf_dir), stated_queries(spark, sf_dir, scale=scale), metric, 10, **options)
        return out.select("qid", "rank", "offset", F.round("score", 6).alias("score"))

    return run


_SIM = {
    "dot": "list_dot_product(p.v, q.v)",
    "cosine": "list_dot_product(p.v, list_transform(q.v, lambda x: x / sqrt(list_dot_product(q.v, q.v))))",
    "euclid": "-power(list_distance(p.v, q.v), 2)",
    "manhattan": "-list_sum(list_transform(list_zip(p.v, q.v), lambda z: abs(z[1] - z[2])))",
}
_SHOWN = {"dot": "sim", "cosine": "sim", "euclid": "sqrt(abs(sim))", "manhattan": "abs(sim)"}


def knn_sql(metric: str, scale: float = 1.0, where: str = "true", limit: int = 10, offset: int = 0, threshold: str = "true") -> str:
    return f"""
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS qid, list_transform(v, lambda x: x * {scale}::DOUBLE) AS v FROM p WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id AS "offset", {_SIM[metric]} AS sim FROM p, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, "offset") AS rn FROM s)
SELECT qid, (rn - {offset})::INTEGER AS rank, "offset", round({_SHOWN[metric]}, 6) AS score
FROM r WHERE rn > {offset} AND rn <= {offset + limit} AND {threshold}"""


def knn_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a query: one scan scores the whole batch."""
    p = points(spark, sf_dir)
    queries = p.select(F.col("offset").alias("qid"), F.col("vector").alias("q"))
    return topk.knn(p, queries, "dot", 3).select("qid", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    "knn_all_rows": knn_all_rows,
    "knn_dot": _knn("dot"),
    "knn_cosine": _knn("cosine", scale=2.5),
    "knn_euclid": _knn("euclid", scale=1.25),
    "knn_manhattan": _knn("manhattan", scale=1.25),
    "knn_filtered_label": _knn("dot", where="label = 3"),
    "knn_offset_page": _knn("dot", offset=7),
    "knn_threshold": _knn("dot", threshold=0.3),
}
ORACLES = {
    "knn_all_rows": """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, list_dot_product(p.v, q.v) AS sim FROM p, p q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC) AS rn FROM s) SELECT qid, rn::INTEGER AS rank, round(sim, 6) AS score FROM r WHERE rn <= 3""",
    "knn_dot": knn_sql("dot"),
    "knn_cosine": knn_sql("cosine", 2.5),
    "knn_euclid": knn_sql("euclid", 1.25),
    "knn_manhattan": knn_sql("manhattan", 1.25),
    "knn_filtered_label": knn_sql("dot", where="p.label = 3"),
    "knn_offset_page": knn_sql("dot", offset=7),
    "knn_threshold": knn_sql("dot", threshold="sim > 0.3"),
}
