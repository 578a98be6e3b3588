"""Calibration, agreement up to ties, parity and provenance: the laboratory's smaller computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import benchfold, evaluate, topk
from lodestone.plans.bench_queries import _FOLD, _passes
from lodestone.plans.evaluation_queries import _S, _T, _coded, _judged, _truth
from lodestone.plans.evaluation_queries import ORACLES as EVALUATION
from lodestone.plans.vector_queries import points, stated_queries

DIM = 64


def calibrated_epsilon(spark, sf_dir):
    """The tolerance that two arms of scores call for, from their spreads over repeated ranks."""
    a, b = _truth(spark, sf_dir).withColumn("arm", F.lit("a")), _coded(spark, sf_dir, "sq8_knn").withColumn("arm", F.lit("b"))
    spread = evaluate.cross_arm_spread(a.unionByName(b)).agg(F.max("spread").alias("s"))
    return spread.select(F.round(evaluate.calibrated_epsilon(F.col("s"), F.col("s"), DIM), 6).alias("epsilon"))


def tie_agreement(spark, sf_dir):
    """Whether two runs over differently dealt points agree up to ties."""
    p, q = points(spark, sf_dir), stated_queries(spark, sf_dir)
    a, b = (topk.knn(x, q, "dot", 10).withColumnRenamed("offset", "id") for x in (p, p.repartition(3, "label")))
    return evaluate.agree_up_to_ties(a, b, 1e-9)


def semantic_summary(spark, sf_dir):
    """Mean nDCG and mean reciprocal rank over the judged queries."""
    found, grades = _judged(spark, sf_dir)
    both = evaluate.ndcg(found, grades).join(evaluate.reciprocal_rank(found, grades), "qid")
    return both.agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"))


def provenance_digests(spark, sf_dir):
    """A digest per order, so that measurements can be tied to what they were made from."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", benchfold.provenance(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("digest"))


def parity_sides(spark, sf_dir):
    """Which side of its noise band each workload's ratio to a fixed arm lies on, over all its slots."""
    folded = benchfold.fold_passes(_passes(spark, sf_dir), ["workload", "slot"], 3)
    side = benchfold.parity_side(F.col("median") / 50.0, benchfold.noise_band(F.col("rsd")))
    return folded.withColumn("side", side).groupBy("workload").agg(F.count_if(F.col("side") > 0).alias("above"), F.count_if(F.col("side") < 0).alias("below"), F.count_if(F.col("side") == 0).alias("within"))


QUERIES = {f.__name__: f for f in (calibrated_epsilon, tie_agreement, semantic_summary, provenance_digests, parity_sides)}
_MEAN = "SELECT count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr FROM n JOIN m USING (qid)"
ORACLES = {
    "tie_agreement": "SELECT vec_id AS qid, true AS agrees FROM embeddings WHERE vec_id % 50 = 0",
    "semantic_summary": f"WITH n AS ({EVALUATION['ndcg']}), m AS ({EVALUATION['reciprocal_rank']}) {_MEAN}",
    "calibrated_epsilon": f"WITH {_T}, {_S} SELECT round(greatest(4 * max(abs(t.score - s.score)), log2(64) / 16777216.0::DOUBLE), 6) AS epsilon FROM t JOIN s USING (qid, rank)",
    "provenance_digests": "SELECT o_orderkey, sha256(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR) AS digest FROM orders",
    "parity_sides": f"""WITH {_FOLD}, b AS (SELECT workload, ln(median / 50.0::DOUBLE) AS r, ln(1 + greatest(sqrt(2.0::DOUBLE) * 3 * rsd, 0.02)) AS w FROM f)
SELECT workload, count(*) FILTER (r > w) AS above, count(*) FILTER (r < -w) AS below, count(*) FILTER (r BETWEEN -w AND w) AS within FROM b GROUP BY workload""",
}
