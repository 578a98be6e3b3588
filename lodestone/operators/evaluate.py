"""How good returned lists are: recall, distance error, relevance, rank agreement, intervals, tolerances.

Lists are rows (qid, rank, id, score), ranks from 1; truth has the same shape.
An absent row stands for a missing answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _tolerance(eps: float, relative: bool, at: Column) -> Column:
    return F.lit(eps) * F.greatest(F.lit(1.0), F.abs(at)) if relative else F.lit(eps)


def recall_per_query(returned: DataFrame, truth: DataFrame, k: int, eps: float = 0.0, relative: bool = False, distance: bool = False, matching: DataFrame | None = None) -> DataFrame:
    """qid, available, hits, impossible, recall for every query of the truth.

    available is min(k, depth of the truth, matching ids). An id is right if the
    truth holds it, or if its score lies within the tolerance of the k-th;
    repeated ids count once. A score that is not in the truth and beats the k-th
    by more is impossible and a miss. recall is null where nothing is available.
    """
    head = truth.where(F.col("rank") <= k)
    available = head.groupBy("qid").agg(F.count("*").alias("available"), F.max_by("score", "rank").alias("kth"))
    if matching is not None:
        available = available.join(matching.select("qid", "n_matching"), "qid", "left")
        available = available.withColumn("available", F.least("available", F.coalesce("n_matching", "available"))).drop("n_matching")
    got = returned.where(F.col("rank") <= k).groupBy("qid", "id").agg(F.first("score").alias("score"))
    rows = got.join(available, "qid").join(head.select("qid", "id", F.lit(True).alias("member")), ["qid", "id"], "left")
    gap = (F.col("kth") - F.col("score")) if distance else (F.col("score") - F.col("kth"))
    tol = _tolerance(eps, relative, F.col("kth"))
    member = F.coalesce("member", F.lit(False))
    sums = rows.groupBy("qid").agg(F.count_if(member | (F.abs(gap) <= tol)).alias("hits"), F.count_if(~member & (gap > tol)).alias("impossible"))
    out = available.join(sums, "qid", "left").na.fill(0, ["hits", "impossible"])
    hits = F.least("hits", "available")
    return out.select("qid", "available", hits.alias("hits"), "impossible", F.when(F.col("available") > 0, hits / F.col("available")).alias("recall"))


def distance_error(returned: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """qid, mrde: the mean of |got - want| / |want| by place over the first k; |got| where the wanted distance is 0."""
    rows = returned.select("qid", "rank", F.col("score").alias("got")).join(truth.select("qid", "rank", F.col("score").alias("want")), ["qid", "rank"]).where(F.col("rank") <= k)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where(finite(F.col("got")) & finite(F.col("want")))
    error = F.when(F.abs("want") < 1e-12, F.abs("got")).otherwise(F.abs(F.col("got") - F.col("want")) / F.abs("want"))
    return rows.groupBy("qid").agg(F.avg(error).alias("mrde"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share; null where n is 0."""
    p, z2 = successes / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(Z95) / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))


def intervals_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.coalesce((low_a <= high_b) & (low_b <= high_a), F.lit(False))


def summary(returned: DataFrame, truth: DataFrame, ks=(1, 10, 100), limit: int = 10, eps: float = 0.0, known: DataFrame | None = None) -> DataFrame:
    """One row: recall at each k that the limit covers, its interval at the limit, distance error, and what is wrong with the lists."""
    out = None
    for k in ks:
        per = recall_per_query(returned, truth, k, eps)
        value = F.avg("recall") if k <= limit else F.lit(None).cast("double")
        low, high = wilson(F.sum("hits").cast("double"), F.sum("available").cast("double"))
        cols = [value.alias(f"recall_{k}")]
        if k == limit:
            cols += [low.alias("low"), high.alias("high"), F.sum("impossible").alias("impossible_scores")]
        one = per.agg(*cols)
        out = one if out is None else out.crossJoin(one)  # one row each
    lists = truth.select("qid").distinct().join(returned.groupBy("qid").count(), "qid", "left").na.fill(0)
    out = out.crossJoin(lists.agg(F.count_if(F.col("count") < limit).alias("short_lists"), F.sum("count").alias("returned"), (F.count("*") * limit).alias("asked")))
    out = out.crossJoin(distance_error(returned, truth).agg(F.avg("mrde").alias("mrde")))
    unknown = returned.join(known, "id", "left_anti").agg(F.count("*").alias("unknown_ids")) if known is not None else returned.agg(F.lit(0).cast("long").alias("unknown_ids"))
    return out.crossJoin(unknown)


def ndcg(returned: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg for every judged query: gain 2^grade - 1, discount log2(rank + 1); 0 where nothing is relevant."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    rows = returned.where(F.col("rank") <= k).join(qrels, ["qid", "id"])
    dcg = rows.groupBy("qid").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "id"))).where(F.col("rank") <= k)
    ideal = ideal.groupBy("qid").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("idcg"))
    return ideal.join(dcg, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def reciprocal_rank(returned: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, rr for every judged query: 1 / the first relevant rank within k, or 0."""
    first = returned.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    return qrels.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def kendall_tau(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, tau over the ids that both lists hold; null with fewer than two. Lists are short pages."""
    both = a.select("qid", "id", F.col("rank").alias("ra")).join(b.select("qid", "id", F.col("rank").alias("rb")), ["qid", "id"])
    lists = both.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("l"))
    signs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y["ra"] > x["ra"]), lambda y: F.signum((y["rb"] - x["rb"]).cast("double")))))
    n = F.size("l")
    tau = F.aggregate(signs, F.lit(0.0), lambda s, x: s + x) / (n * (n - 1) / 2)
    return a.select("qid").distinct().join(lists, "qid", "left").select("qid", F.when(n >= 2, tau).alias("tau"))


def _lists(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))


def rank_biased_overlap(a: DataFrame, b: DataFrame, p: float = 0.9) -> DataFrame:
    """qid, rbo, over the depth of the longer list and normalised; 1 for two empty lists."""
    rows = _lists(a, "a").join(_lists(b, "b"), "qid", "full")
    empty = F.array().cast("array<long>")
    rows = rows.select("qid", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    depth = F.greatest(F.size("a"), F.size("b"))
    share = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda d: F.size(F.array_intersect(F.slice("a", 1, d), F.slice("b", 1, d))) / d * F.pow(F.lit(p), d - 1))
    total = F.aggregate(share, F.lit(0.0), lambda s, x: s + x)
    return rows.select("qid", F.when(depth == 0, 1.0).otherwise((1 - p) * total / (1 - F.pow(F.lit(p), depth))).alias("rbo"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, n_common of two lists."""
    return _lists(a, "a").join(_lists(b, "b"), "qid").select("qid", F.size(F.array_intersect("a", "b")).alias("n_common"))


def score_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, rank, delta, relative: absolute differences of scores by place."""
    rows = a.select("qid", "rank", F.col("score").alias("x")).join(b.select("qid", "rank", F.col("score").alias("y")), ["qid", "rank"])
    delta = F.abs(F.col("x") - F.col("y"))
    return rows.select("qid", "rank", delta.alias("delta"), (delta / F.greatest(F.lit(1e-30), F.abs("x"), F.abs("y"))).alias("relative"))


def nearest_rank(column: str, q: float) -> Column:
    """The smallest value that at least q of all values do not exceed."""
    return F.percentile_disc(column, q) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def delta_distribution(deltas: DataFrame) -> DataFrame:
    return deltas.agg(
        F.count("*").alias("n"), F.max("delta").alias("max"), nearest_rank("delta", 0.999).alias("p999"), nearest_rank("delta", 0.99).alias("p99"),
        nearest_rank("delta", 0.5).alias("p50"), F.avg("delta").alias("mean"), F.max("relative").alias("max_relative"), nearest_rank("relative", 0.99).alias("p99_relative"),
    )


def calibrated_epsilon(spread_a: Column, spread_b: Column, dim: int) -> Column:
    """Four times the larger spread of the two, and at least what rounding to single precision makes of dim additions."""
    import math

    return F.greatest(4 * F.greatest(spread_a, spread_b), F.lit(math.log2(dim) * 2.0**-24))


def cross_arm_spread(runs: DataFrame) -> DataFrame:
    """(arm, qid, rank, score) of two arms or more: the largest difference of scores at each place."""
    return runs.groupBy("qid", "rank").agg((F.max("score") - F.min("score")).alias("spread"), F.count_distinct("arm").alias("arms")).where("arms >= 2").drop("arms")


def tie_classes(lists: DataFrame, eps: float) -> DataFrame:
    """Adds class: neighbours whose scores differ by eps at most are in one class."""
    w = Window.partitionBy("qid").orderBy("rank")
    new = F.coalesce(F.abs(F.col("score") - F.lag("score").over(w)) > eps, F.lit(True)).cast("int")
    return lists.withColumn("new", new).withColumn("class", F.sum("new").over(w).cast("int")).drop("new")


def agree_up_to_ties(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """qid, agrees: the tie classes of a hold the same ids in b's same places; the last class may be cut off.

    Two lists of one length agree if every id that is in one only belongs to the last class, and the others stay within their class's places.
    """
    ca = tie_classes(a, eps)
    w = Window.partitionBy("qid", "class")
    ca = ca.withColumns({"first": F.min("rank").over(w), "last": F.max("rank").over(w), "final": F.col("class") == F.max("class").over(Window.partitionBy("qid"))})
    both = ca.select("qid", "id", "first", "last", "final").join(b.select("qid", "id", F.col("rank").alias("rb")), ["qid", "id"], "left")
    fine = F.when(F.col("rb").isNull(), F.col("final")).otherwise(F.col("rb").between(F.col("first"), F.col("last")))
    return both.groupBy("qid").agg(F.min(fine).alias("agrees"))


def truth_diff(a: DataFrame, b: DataFrame, eps: float = 0.0) -> DataFrame:
    """qid, verdict, overlap of two truths: identical, same_set, boundary (only ids that tie with the last differ) or interior."""
    la, lb = _lists(a, "a"), _lists(b, "b")
    edge = a.groupBy("qid").agg(F.max_by("score", "rank").alias("kth"))
    one_sided = a.join(b.select("qid", "id"), ["qid", "id"], "left_anti").join(edge, "qid")
    inner = one_sided.groupBy("qid").agg(F.count_if(F.abs(F.col("score") - F.col("kth")) > eps).alias("inner"))
    rows = la.join(lb, "qid").join(inner, "qid", "left")
    same = F.size(F.array_intersect("a", "b"))
    verdict = F.when(F.to_json("a") == F.to_json("b"), "identical").when(same == F.greatest(F.size("a"), F.size("b")), "same_set").when(F.coalesce("inner", F.lit(0)) == 0, "boundary").otherwise("interior")
    return rows.select("qid", verdict.alias("verdict"), (same / F.greatest(F.size("a"), F.lit(1))).alias("overlap"))


def dominance(runs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(oversampling, recall): True if recall never falls by more than the tolerance as oversampling rises."""
    w = Window.orderBy("oversampling")  # one row per setting
    step = runs.withColumn("fall", F.lag("recall").over(w) - F.col("recall"))
    return step.agg(F.coalesce(F.min(F.coalesce(F.col("fall") <= tolerance, F.lit(True))), F.lit(True)).alias("dominates"))


def filtered_truth(points: DataFrame, queries: DataFrame, allowed: DataFrame, metric: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact answers among allowed (qid, offset) ids, and how many each query has."""
    from lodestone.operators import metrics
    from lodestone.operators.topk import rank_within

    rows = allowed.join(points.select("offset", "vector"), "offset").join(queries, "qid")
    scored = rows.select("qid", "offset", metrics.similarity(metric, F.col("vector"), F.col("q")).alias("sim"))
    page = rank_within(scored, "qid", [F.col("sim").desc(), F.col("offset").asc()], k)
    return page.select("qid", "rank", F.col("offset").alias("id"), metrics.reported(metric, F.col("sim")).alias("score")), allowed.groupBy("qid").agg(F.count("*").alias("n_matching"))


def rescore(returned: DataFrame, points: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """Exact scores of arbitrary (qid, id); null for ids that are not there."""
    from lodestone.operators import metrics

    rows = returned.select("qid", "id").join(points.select(F.col("offset").alias("id"), "vector"), "id", "left").join(queries, "qid")
    sim = metrics.reported(metric, metrics.similarity(metric, F.col("vector"), F.col("q")))
    return rows.select("qid", "id", F.when(F.col("vector").isNotNull(), sim).alias("score"))


def shipped_truth_check(shipped: DataFrame, exact: DataFrame, eps: float) -> DataFrame:
    """qid, verdict of truths that came with a data set: exact, equal_under_ties or mismatch."""
    diff = truth_diff(shipped, exact, eps)
    ties = agree_up_to_ties(exact, shipped, eps)
    verdict = F.when(F.col("verdict") == "identical", "exact").when(F.coalesce("agrees", F.lit(False)), "equal_under_ties").otherwise("mismatch")
    return diff.join(ties, "qid", "left").select("qid", verdict.alias("verdict"))


def truth_from_tests(tests: DataFrame) -> DataFrame:
    """(qid, closest_ids, closest_scores) to truth rows."""
    each = tests.select("qid", F.posexplode(F.arrays_zip("closest_ids", "closest_scores")).alias("i", "t"))
    return each.select("qid", (F.col("i") + 1).alias("rank"), F.col("t.closest_ids").alias("id"), F.col("t.closest_scores").alias("score"))
