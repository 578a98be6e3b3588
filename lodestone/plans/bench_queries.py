"""Benchmark folding over measurements that are made from the events table, and over small fixed curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import benchfold


def _passes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy(F.col("event_type").alias("workload"), (F.col("user_id") % 5).alias("slot"), (F.col("event_id") % 3).alias("pass"))
    return rows.agg(F.round(F.avg("value"), 6).alias("value"))


def pass_median_rsd(spark, sf_dir):
    out = benchfold.fold_passes(_passes(spark, sf_dir), ["workload", "slot"], 3)
    return out.select("workload", "slot", F.round("median", 6).alias("median"), F.round("rsd", 6).alias("rsd"), "passes")


def pass_drift(spark, sf_dir):
    out = benchfold.drift(_passes(spark, sf_dir), ["workload", "slot"])
    return out.select("workload", "slot", "drifts", F.round("moved", 6).alias("moved"))


def noise_verdicts(spark, sf_dir):
    out = benchfold.fold_passes(_passes(spark, sf_dir), ["workload", "slot"], 3)
    band = benchfold.noise_band(F.col("rsd"))
    ratio = F.col("median") / 50.0
    return out.select("workload", "slot", F.round(band, 6).alias("band"), benchfold.verdict(ratio, band).alias("verdict"), benchfold.parity_side(ratio, band).alias("side"))


_A = [("d1", 0.91, 900.0, 0.004), ("d1", 0.955, 700.0, 0.004), ("d1", 0.999, 80.0, 0.002), ("d2", 0.8, 500.0, 0.01)]
_B = [("d1", 0.90, 1000.0), ("d1", 0.95, 600.0), ("d1", 0.99, 200.0), ("d2", 0.7, 900.0), ("d2", 0.9, 300.0)]


def frontier_interpolation(spark, sf_dir):
    a, b = spark.createDataFrame(_A, "dataset string, recall double, qps double, half_width double"), spark.createDataFrame(_B, "dataset string, recall double, qps double")
    out = benchfold.matched_recall(a, b, ["dataset"])
    return out.select("dataset", "recall", "qps", *[F.round(c, 6).alias(c) for c in ("qps_b", "ratio", "band")])


def write_window_qps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    done = e.where("event_type <> 'purchase'").select((F.col("user_id") % 6).alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("run", (F.col("us") / 1e6).alias("ts"))
    writes = e.where("event_type = 'purchase'").groupBy((F.col("user_id") % 6).alias("run")).agg((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("first"), (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("last"))
    out = benchfold.write_window_qps(done, writes, 2)
    return out.select("run", "n", F.round("qps", 9).alias("qps"))


def loglog_slope(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    rows = e.groupBy("event_type", (F.col("event_id") % 16 + 1).alias("x")).agg(F.round(F.sum("value"), 6).alias("y"))
    return rows.groupBy("event_type").agg(F.round(benchfold.loglog_slope(F.col("x").cast("double"), F.col("y")), 6).alias("slope"))


def break_even(spark, sf_dir):
    rows = [("d1", 16.0, 0.5), ("d1", 32.0, 0.8), ("d1", 64.0, 1.3), ("d2", 16.0, 1.2), ("d2", 64.0, 1.5), ("d3", 8.0, 2.0), ("d3", 128.0, 0.25)]
    return benchfold.break_even(spark.createDataFrame(rows, "dataset string, ef double, ratio double"), ["dataset"]).select("dataset", F.round("break_even", 6).alias("break_even"))


def arm_summary(spark, sf_dir):
    rows = _passes(spark, sf_dir).withColumn("arm", F.when(F.col("slot") % 2 == 0, "even").otherwise("odd"))
    out = benchfold.arm_summary(rows, ["workload"], ["even", "odd"])
    return out.select("workload", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


def _edges(spark, sf_dir, without):
    """One build's edges: those of all events but one type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") != without)
    return e.select((F.col("event_id") % 2).alias("level"), (F.col("user_id") % 40).alias("u"), (F.col("event_id") % 97).alias("v")).distinct()


def edge_jaccard(spark, sf_dir):
    out = benchfold.edge_jaccard(_edges(spark, sf_dir, "click"), _edges(spark, sf_dir, "view"))
    return out.select("level", "common", "only_a", "only_b", F.round("jaccard", 9).alias("jaccard"))


def edge_difference_histogram(spark, sf_dir):
    a, b = (_edges(spark, sf_dir, t).where("level = 0") for t in ("click", "view"))
    return benchfold.difference_histogram(a, b)


def loss_against_best(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy((F.col("event_id") % 3).alias("build"), F.col("user_id").alias("qid")).agg(F.count("*").alias("hits"))
    return benchfold.loss_against_best(rows)


def code_runs(spark, sf_dir):
    return benchfold.runs_of(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'"), "o_orderkey")


_PASSES = "m AS (SELECT event_type AS workload, user_id % 5 AS slot, event_id % 3 AS pass, round(avg(value), 6) AS value FROM events GROUP BY ALL)"
_FOLD = _PASSES + """, f AS (SELECT workload, slot, CASE WHEN count(value) = 3 THEN median(value) END AS median, CASE WHEN count(value) >= 3 AND avg(value) <> 0 THEN stddev_samp(value) / avg(value) END AS rsd, count(value) AS passes FROM m GROUP BY ALL)"""
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)
_EDGE = """a AS (SELECT DISTINCT event_id % 2 AS level, user_id % 40 AS u, event_id % 97 AS v FROM events WHERE event_type <> 'click'), b AS (SELECT DISTINCT event_id % 2 AS level, user_id % 40 AS u, event_id % 97 AS v FROM events WHERE event_type <> 'view'),
j AS (SELECT coalesce(a.level, b.level) AS level, coalesce(a.u, b.u) AS u, a.u IS NOT NULL AS ia, b.u IS NOT NULL AS ib FROM a FULL JOIN b ON a.level = b.level AND a.u = b.u AND a.v = b.v)"""

QUERIES = {
    f.__name__: f
    for f in (pass_median_rsd, pass_drift, noise_verdicts, frontier_interpolation, write_window_qps, loglog_slope, break_even, arm_summary, edge_jaccard, edge_difference_histogram, loss_against_best, code_runs)
}
ORACLES = {
    "pass_median_rsd": f"WITH {_FOLD} SELECT workload, slot, round(median, 6) AS median, round(rsd, 6) AS rsd, passes FROM f",
    "pass_drift": f"""WITH {_PASSES}, s AS (SELECT *, value - lag(value) OVER (PARTITION BY workload, slot ORDER BY pass) AS step FROM m),
g AS (SELECT workload, slot, coalesce(min(step) > 0 OR max(step) < 0, false) AS one, (arg_max(value, pass) - arg_min(value, pass)) / arg_min(value, pass) AS moved FROM s GROUP BY ALL)
SELECT workload, slot, one AND abs(moved) >= 0.05 AS drifts, round(moved, 6) AS moved FROM g""",
    "noise_verdicts": f"""WITH {_FOLD}, b AS (SELECT *, greatest(sqrt(2.0::DOUBLE) * 3 * rsd, 0.02) AS band, median / 50.0::DOUBLE AS ratio FROM f)
SELECT workload, slot, round(band, 6) AS band, CASE WHEN ratio IS NULL OR band IS NULL THEN 'unmeasured' WHEN band > 0.25 THEN 'too noisy' WHEN abs(ratio - 1) > band THEN 'clears' ELSE 'inconclusive' END AS verdict,
CASE WHEN ln(ratio) > ln(1 + band) THEN 1 WHEN ln(ratio) < -ln(1 + band) THEN -1 ELSE 0 END AS side FROM b""",
    "frontier_interpolation": f"""WITH a(dataset, recall, qps, hw) AS (VALUES {_VALUES(_A)}), b(dataset, recall, qps) AS (VALUES {_VALUES(_B)}),
s AS (SELECT dataset, recall AS lo, qps AS ql, lead(recall) OVER w AS hi, lead(qps) OVER w AS qh FROM b WINDOW w AS (PARTITION BY dataset ORDER BY recall)),
j AS (SELECT a.dataset, recall, qps, exp(ln(ql) + (ln(qh) - ln(ql)) / (hi - lo) * (recall - lo)) AS qb, exp(abs((ln(qh) - ln(ql)) / (hi - lo)) * hw) - 1 AS band FROM a JOIN s ON a.dataset = s.dataset AND recall BETWEEN lo AND hi)
SELECT dataset, recall, qps, round(qb, 6) AS qps_b, round(qps / qb, 6) AS ratio, round(band, 6) AS band FROM j""",
    "write_window_qps": """WITH w AS (SELECT user_id % 6 AS run, min(ts) AS f, max(ts) AS l FROM events WHERE event_type = 'purchase' GROUP BY ALL),
c AS (SELECT user_id % 6 AS run, ts FROM events WHERE event_type <> 'purchase'), j AS (SELECT run, epoch_us(ts) / 1e6::DOUBLE AS s FROM c JOIN w USING (run) WHERE ts BETWEEN f AND l)
SELECT run, count(*) AS n, CASE WHEN count(*) >= 2 AND max(s) > min(s) THEN round(2 * count(*) / (max(s) - min(s)), 9) END AS qps FROM j GROUP BY run""",
    "loglog_slope": """WITH r AS (SELECT event_type, event_id % 16 + 1 AS x, round(sum(value), 6) AS y FROM events WHERE value > 0 GROUP BY ALL) SELECT event_type, round(regr_slope(ln(y), ln(x)), 6) AS slope FROM r GROUP BY event_type""",
    "arm_summary": f"WITH {_PASSES} SELECT workload, round(median(value) FILTER (slot % 2 = 0), 6) AS even, round(median(value) FILTER (slot % 2 = 1), 6) AS odd FROM m GROUP BY workload",
    "edge_jaccard": f"WITH {_EDGE} SELECT level, count(*) FILTER (ia AND ib) AS common, count(*) FILTER (NOT ib) AS only_a, count(*) FILTER (NOT ia) AS only_b, round(count(*) FILTER (ia AND ib) / count(*), 9) AS jaccard FROM j GROUP BY level",
    "edge_difference_histogram": f"WITH {_EDGE}, d AS (SELECT u, count(*) FILTER (NOT (ia AND ib)) AS d FROM j WHERE level = 0 GROUP BY u) SELECT least(d, 32) AS bucket, count(*) AS nodes FROM d GROUP BY ALL",
    "loss_against_best": """WITH r AS (SELECT event_id % 3 AS build, user_id AS qid, count(*) AS hits FROM events GROUP BY ALL), x AS (SELECT *, max(hits) OVER (PARTITION BY qid) AS best FROM r)
SELECT build, count(*) FILTER (hits < best) AS worse, sum(best - hits)::BIGINT AS lost FROM x GROUP BY build""",
    "code_runs": """WITH x AS (SELECT DISTINCT o_orderkey AS x FROM orders WHERE o_orderstatus = 'F'), i AS (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM x) SELECT min(x) AS first, max(x) AS last FROM i GROUP BY g""",
}
