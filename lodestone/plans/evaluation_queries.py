"""Evaluation of quantized search against exact search, and of BM25 against the quality labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import bm25, evaluate, topk
from lodestone.plans import code_queries, text_queries
from lodestone.plans.vector_queries import stated_queries, knn_sql, points


def _truth(spark, sf_dir, limit=10):
    out = topk.knn(points(spark, sf_dir), stated_queries(spark, sf_dir), "dot", limit)
    return out.select("qid", "rank", F.col("offset").alias("id"), F.round("score", 6).alias("score"))


def _coded(spark, sf_dir, name="binary_hamming_knn"):
    return code_queries.QUERIES[name](spark, sf_dir).select("qid", "rank", F.col("offset").alias("id"), "score")


def recall_at_k(spark, sf_dir):
    return evaluate.recall_per_query(_coded(spark, sf_dir).withColumn("score", F.lit(-9.0)), _truth(spark, sf_dir), 10).select("qid", "available", "hits", "impossible", F.round("recall", 9).alias("recall"))


def wilson_interval(spark, sf_dir):
    per = recall_at_k(spark, sf_dir)
    low, high = evaluate.wilson(F.sum("hits").cast("double"), F.sum("available").cast("double"))
    return per.agg(F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def mrde(spark, sf_dir):
    d = evaluate.distance_error(_coded(spark, sf_dir, "sq8_knn"), _truth(spark, sf_dir))
    return d.select("qid", F.round("mrde", 6).alias("mrde"))


def evaluate_summary(spark, sf_dir):
    s = evaluate.summary(_coded(spark, sf_dir).withColumn("score", F.lit(-9.0)), _truth(spark, sf_dir, 100), known=points(spark, sf_dir).select(F.col("offset").alias("id")))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes if c not in ("mrde",)])


def _judged(spark, sf_dir):
    """The first ten documents of each BM25 answer and grades from the labels, where a document has one."""
    found = bm25.search(bm25.index(text_queries.corpus(spark, sf_dir)), text_queries.passages(spark, sf_dir), 10)
    found = found.select("qid", "rank", F.col("offset").alias("id"), "score").cache()  # ten rows a passage, met two or three times; the search runs once
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"))
    return found, found.select("qid", "id").join(labels, "id").select("qid", "id", "grade")


def ndcg(spark, sf_dir):
    n = evaluate.ndcg(*_judged(spark, sf_dir))
    return n.select("qid", F.round("ndcg", 6).alias("ndcg"))


def reciprocal_rank(spark, sf_dir):
    return evaluate.reciprocal_rank(*_judged(spark, sf_dir)).select("qid", F.round("rr", 9).alias("rr"))


def kendall_tau(spark, sf_dir):
    return evaluate.kendall_tau(_truth(spark, sf_dir), _coded(spark, sf_dir)).select("qid", F.round("tau", 9).alias("tau"))


def rbo(spark, sf_dir):
    return evaluate.rank_biased_overlap(_truth(spark, sf_dir), _coded(spark, sf_dir)).select("qid", F.round("rbo", 9).alias("rbo"))


def list_overlap(spark, sf_dir):
    return evaluate.overlap(_truth(spark, sf_dir), _coded(spark, sf_dir))


def score_delta_dist(spark, sf_dir):
    d = evaluate.delta_distribution(evaluate.score_deltas(_truth(spark, sf_dir), _coded(spark, sf_dir, "sq8_knn")))
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in d.dtypes])


def tie_classes(spark, sf_dir):
    return evaluate.tie_classes(_coded(spark, sf_dir), 1.0).select("qid", "rank", "class")


def truth_diff(spark, sf_dir):
    return evaluate.truth_diff(_truth(spark, sf_dir), _coded(spark, sf_dir)).select("qid", "verdict", F.round("overlap", 9).alias("overlap"))


def cross_arm_spread(spark, sf_dir):
    a, b = _truth(spark, sf_dir).withColumn("arm", F.lit("a")), _coded(spark, sf_dir, "sq8_knn").withColumn("arm", F.lit("b"))
    return evaluate.cross_arm_spread(a.unionByName(b)).select("qid", "rank", F.round("spread", 6).alias("spread"))


def filtered_truth(spark, sf_dir):
    p, q = points(spark, sf_dir), stated_queries(spark, sf_dir)
    allowed = p.where("label % 5 = 2").select("offset").crossJoin(F.broadcast(q.select("qid")))
    t, n = evaluate.filtered_truth(p, q, allowed, "dot", 10)
    return t.join(n, "qid").select("qid", "rank", "id", F.round("score", 6).alias("score"), "n_matching")


def quantization_dominance(spark, sf_dir):
    truth, runs = _truth(spark, sf_dir), None
    for os in (1.0, 4.0, 16.0):
        found = code_queries._binary(oversampling=os)(spark, sf_dir).select("qid", "rank", F.col("offset").alias("id"), "score")
        one = evaluate.recall_per_query(found, truth, 10).agg(F.lit(os).alias("oversampling"), F.avg("recall").alias("recall"))
        runs = one if runs is None else runs.unionByName(one)
    return evaluate.dominance(runs)


def query_order_invariance(spark, sf_dir):
    """The same answers whatever order points come in."""
    p, q = points(spark, sf_dir), stated_queries(spark, sf_dir)
    a, b = (topk.knn(x, q, "dot", 10) for x in (p, p.repartition(5, "label").orderBy(F.col("offset").desc())))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differences"))


def prefix_property(spark, sf_dir):
    """The first five of ten are the five."""
    p, q = points(spark, sf_dir), stated_queries(spark, sf_dir)
    return topk.knn(p, q, "dot", 10).where("rank <= 5").exceptAll(topk.knn(p, q, "dot", 5)).agg(F.count("*").alias("differences"))


_T = f"""t AS (SELECT qid, rank, "offset" AS id, score FROM ({knn_sql('dot')}))"""
_B = f"""b AS (SELECT qid, rank, "offset" AS id, score FROM ({code_queries.ORACLES['binary_hamming_knn']}))"""
_S = f"""s AS (SELECT qid, rank, "offset" AS id, score FROM ({code_queries.ORACLES['sq8_knn']}))"""
_HITS = "h AS (SELECT t.qid, count(b.id) AS hits FROM t LEFT JOIN b USING (qid, id) GROUP BY t.qid)"
_J = f"""j AS (SELECT k.qid, k.rank, k."offset" AS id, quality AS grade FROM ({text_queries.ORACLES['bm25_topk']}) k JOIN labels ON doc_id = k."offset")"""
_RANKED = 'i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS ir FROM j)'
_P = "1.959963984540054::DOUBLE"

QUERIES = {
    f.__name__: f
    for f in (recall_at_k, wilson_interval, mrde, evaluate_summary, ndcg, reciprocal_rank, kendall_tau, rbo, list_overlap, score_delta_dist, tie_classes, truth_diff, cross_arm_spread, filtered_truth, quantization_dominance, query_order_invariance, prefix_property)
}
ORACLES = {
    "recall_at_k": f"WITH {_T}, {_B}, {_HITS} SELECT qid, 10::BIGINT AS available, hits, 0::BIGINT AS impossible, round(hits / 10.0::DOUBLE, 9) AS recall FROM h",
    "wilson_interval": f"""WITH {_T}, {_B}, {_HITS}, x AS (SELECT sum(hits) / (10.0::DOUBLE * count(*)) AS p, 10.0::DOUBLE * count(*) AS n FROM h),
y AS (SELECT (p + {_P} * {_P} / (2 * n)) / (1 + {_P} * {_P} / n) AS m, {_P} / (1 + {_P} * {_P} / n) * sqrt(p * (1 - p) / n + {_P} * {_P} / (4 * n * n)) AS h FROM x)
SELECT round(greatest(m - h, 0), 9) AS low, round(least(m + h, 1), 9) AS high FROM y""",
    "mrde": f"WITH {_T}, {_S} SELECT qid, round(avg(CASE WHEN abs(t.score) < 1e-12 THEN abs(s.score) ELSE abs(s.score - t.score) / abs(t.score) END), 6) AS mrde FROM t JOIN s USING (qid, rank) GROUP BY qid",
    "ndcg": f"""WITH {_J}, {_RANKED}, d AS (SELECT qid, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) AS dcg FROM j GROUP BY qid), e AS (SELECT qid, sum((2.0::DOUBLE ** grade - 1) / log2(ir + 1)) AS idcg FROM i WHERE ir <= 10 GROUP BY qid)
SELECT qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM e JOIN d USING (qid)""",
    "reciprocal_rank": f"WITH {_J} SELECT qid, round(coalesce(1.0::DOUBLE / min(rank) FILTER (grade > 0), 0), 9) AS rr FROM j GROUP BY qid",
    "kendall_tau": f"""WITH {_T}, {_B}, c AS (SELECT qid, id, t.rank AS ra, b.rank AS rb FROM t JOIN b USING (qid, id)), n AS (SELECT qid, count(*) AS n FROM c GROUP BY qid),
k AS (SELECT x.qid, sum(sign(y.rb - x.rb)) AS s FROM c x JOIN c y ON x.qid = y.qid AND y.ra > x.ra GROUP BY x.qid)
SELECT q.qid, CASE WHEN n >= 2 THEN round(coalesce(s, 0) / (n * (n - 1) / 2.0::DOUBLE), 9) END AS tau FROM (SELECT DISTINCT qid FROM t) q LEFT JOIN n USING (qid) LEFT JOIN k USING (qid)""",
    "rbo": f"""WITH {_T}, {_B}, c AS (SELECT t.qid, d, count(b.id) AS o FROM t CROSS JOIN range(1, 11) r(d) LEFT JOIN b ON b.qid = t.qid AND b.id = t.id AND b.rank <= d WHERE t.rank <= d GROUP BY ALL)
SELECT qid, round(0.1::DOUBLE * sum(o / d::DOUBLE * 0.9::DOUBLE ** (d - 1)) / (1 - 0.9::DOUBLE ** 10), 9) AS rbo FROM c GROUP BY qid""",
    "list_overlap": f"WITH {_T}, {_B} SELECT qid, count(b.id)::INTEGER AS n_common FROM t LEFT JOIN b USING (qid, id) GROUP BY qid",
    "score_delta_dist": f"""WITH {_T}, {_S}, d AS (SELECT abs(t.score - s.score) AS delta, abs(t.score - s.score) / greatest(1e-30, abs(t.score), abs(s.score)) AS rel FROM t JOIN s USING (qid, rank))
SELECT count(*) AS n, round(max(delta), 6) AS max, round(quantile_disc(delta, 0.999), 6) AS p999, round(quantile_disc(delta, 0.99), 6) AS p99, round(quantile_disc(delta, 0.5), 6) AS p50, round(avg(delta), 6) AS mean, round(max(rel), 6) AS max_relative, round(quantile_disc(rel, 0.99), 6) AS p99_relative FROM d""",
    "tie_classes": f"""WITH {_B}, n AS (SELECT *, CASE WHEN abs(score - lag(score) OVER (PARTITION BY qid ORDER BY rank)) <= 1 THEN 0 ELSE 1 END AS new FROM b) SELECT qid, rank, (sum(new) OVER (PARTITION BY qid ORDER BY rank))::INTEGER AS class FROM n""",
    "cross_arm_spread": f"WITH {_T}, {_S} SELECT qid, rank, round(abs(t.score - s.score), 6) AS spread FROM t JOIN s USING (qid, rank)",
    "filtered_truth": f"""SELECT qid, rank, "offset" AS id, score, (SELECT count(*) FROM embeddings WHERE label % 5 = 2) AS n_matching FROM ({knn_sql('dot', where='p.label % 5 = 2')})""",
    "query_order_invariance": "SELECT 0::BIGINT AS differences",
    "prefix_property": "SELECT 0::BIGINT AS differences",
    "quantization_dominance": "SELECT true AS dominates",
}
