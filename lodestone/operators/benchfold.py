"""Folding of benchmark passes: medians, noise, verdicts, matched-recall comparison, throughput windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_passes(rows: DataFrame, keys: list[str], passes: int) -> DataFrame:
    """(keys, value) to the median over all passes; null if a pass lacks the value. rsd is null below three passes."""
    have = F.count("value")
    rsd = F.when((have >= 3) & (F.avg("value") != 0), F.stddev_samp("value") / F.avg("value"))
    return rows.groupBy(*keys).agg(F.when(have == passes, F.median("value")).alias("median"), rsd.alias("rsd"), have.alias("passes"))


def drift(rows: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """(keys, pass, value): whether the passes move one way only, and by a share of `least` or more."""
    w = Window.partitionBy(*keys).orderBy("pass")
    step = rows.withColumn("step", F.col("value") - F.lag("value").over(w))
    moved = (F.max_by("value", "pass") - F.min_by("value", "pass")) / F.min_by("value", "pass")
    one_way = F.coalesce((F.min("step") > 0) | (F.max("step") < 0), F.lit(False))
    return step.groupBy(*keys).agg(F.coalesce(one_way & (F.abs(moved) >= least), F.lit(False)).alias("drifts"), moved.alias("moved"))


def noise_band(rsd: Column, arms: int = 2, floor: float = 0.02) -> Column:
    return F.greatest(F.sqrt(F.lit(float(arms))) * 3 * rsd, F.lit(floor))


def verdict(ratio: Column, band: Column, too_noisy: float = 0.25) -> Column:
    """clears, inconclusive, too noisy or unmeasured, of a ratio that should be above 1."""
    return F.when(ratio.isNull() | band.isNull(), "unmeasured").when(band > too_noisy, "too noisy").when(F.abs(ratio - 1) > band, "clears").otherwise("inconclusive")


def parity_side(ratio: Column, band: Column) -> Column:
    """1, 0 or -1: on which side of parity a ratio lies, symmetric in its logarithm."""
    return F.when(F.log(ratio) > F.log1p(band), 1).when(F.log(ratio) < -F.log1p(band), -1).otherwise(0)


def parity_band(ratios: DataFrame, bands: DataFrame) -> DataFrame:
    """Ratios with the band that was measured for their data set, environment and engine; null where none fits."""
    return ratios.join(bands, ["dataset", "environment", "engine"], "left")


def segments(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recall, qps) to segments between neighbours by recall: low, high, qps_low, qps_high."""
    w = Window.partitionBy(*keys).orderBy("recall")
    rows = curve.withColumns({"high": F.lead("recall").over(w), "qps_high": F.lead("qps").over(w)})
    return rows.where(F.col("high") > F.col("recall")).select(*keys, F.col("recall").alias("low"), "high", F.col("qps").alias("qps_low"), "qps_high")


def matched_recall(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a (keys, recall, qps, half_width) against b's curve at the same recall, interpolated in log qps.

    ratio is a's qps over b's; band is exp(|slope| * half_width) - 1. Points beyond b's curve have none.
    """
    s = segments(b, keys)
    rows = a.join(s, keys).where(F.col("recall").between(F.col("low"), F.col("high")))
    slope = (F.log("qps_high") - F.log("qps_low")) / (F.col("high") - F.col("low"))
    at = F.exp(F.log("qps_low") + slope * (F.col("recall") - F.col("low")))
    rows = rows.select(*keys, "recall", "qps", at.alias("qps_b"), (F.exp(F.abs(slope) * F.col("half_width")) - 1).alias("band"), "low")
    first = F.row_number().over(Window.partitionBy(*keys, "recall", "qps").orderBy("low"))
    return rows.withColumn("n", first).where("n = 1").select(*keys, "recall", "qps", "qps_b", (F.col("qps") / F.col("qps_b")).alias("ratio"), "band")


def write_window_qps(completions: DataFrame, writers: DataFrame, batch: int = 1) -> DataFrame:
    """(run, ts) completions within each run's writing (run, first, last), in seconds: batch * n / span; null below two."""
    rows = completions.join(writers, "run").where(F.col("ts").between(F.col("first"), F.col("last")))
    n, span = F.count("*"), F.max("ts") - F.min("ts")
    return rows.groupBy("run").agg(n.alias("n"), F.when((n >= 2) & (span > 0), batch * n / span).alias("qps"))


def loglog_slope(x: Column, y: Column) -> Column:
    """The exponent of y ~ x^a; null below two points or without variance."""
    return F.when(F.count(x) >= 2, F.regr_slope(F.log(y), F.log(x)))


def break_even(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ef, ratio): the first ef at which the ratio crosses 1, interpolated in logarithms."""
    w = Window.partitionBy(*keys).orderBy("ef")
    r = rows.select(*keys, F.log("ef").alias("x"), F.log("ratio").alias("y"), "ef")
    r = r.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where((F.signum("y") != F.signum("y2")) & F.col("y2").isNotNull())
    r = r.withColumn("at", F.exp(F.col("x") - F.col("y") * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))))
    return r.groupBy(*keys).agg(F.min_by("at", "ef").alias("break_even"))


def arm_summary(rows: DataFrame, keys: list[str], arms: list[str]) -> DataFrame:
    """(keys, arm, value) to one column of medians per arm."""
    return rows.groupBy(*keys).pivot("arm", arms).agg(F.median("value"))


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, u, v) edges of two graphs: per level common, only_a, only_b and jaccard."""
    both = a.select("level", "u", "v", F.lit(1).alias("a")).join(b.select("level", "u", "v", F.lit(1).alias("b")), ["level", "u", "v"], "full")
    common, n = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count("*")
    return both.groupBy("level").agg(common.alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), (common / n).alias("jaccard"))


def difference_histogram(a: DataFrame, b: DataFrame, buckets: int = 33) -> DataFrame:
    """How many nodes have how many neighbours in one graph only, from 0 to buckets - 1 or more."""
    both = a.select("u", "v", F.lit(1).alias("a")).join(b.select("u", "v", F.lit(1).alias("b")), ["u", "v"], "full")
    per = both.groupBy("u").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("d"))
    return per.groupBy(F.least("d", F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("nodes"))


def loss_against_best(rows: DataFrame) -> DataFrame:
    """(build, qid, hits): per build how many queries do worse than the best build, and how many hits they lose."""
    best = rows.groupBy("qid").agg(F.max("hits").alias("best"))
    return rows.join(best, "qid").groupBy("build").agg(F.count_if(F.col("hits") < F.col("best")).alias("worse"), F.sum(F.col("best") - F.col("hits")).alias("lost"))


def in_degree_zero(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti").agg(F.count("*").alias("n"))


def runs_of(numbers: DataFrame, column: str) -> DataFrame:
    """Contiguous runs of distinct integers: first, last. Runs are found within ranges of 65,536 and joined at their borders."""
    n = F.col(column).cast("long")
    rows = numbers.select(n.alias("x")).distinct().withColumn("part", F.floor(F.col("x") / 65536))
    island = F.col("x") - F.row_number().over(Window.partitionBy("part").orderBy("x"))
    runs = rows.withColumn("island", island).groupBy("part", "island").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    w = Window.orderBy("first")  # one row per run
    runs = runs.withColumn("new", F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def provenance(row: Column) -> Column:
    """A digest of a row's values."""
    return F.sha2(F.to_json(row), 256)
