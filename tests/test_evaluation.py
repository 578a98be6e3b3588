import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions.porter2 import stem
from lodestone.functions.text import words
from lodestone.operators import ann, benchfold, evaluate, quantize, topk


def lists(spark, *answers):
    rows = [(q, r, i, s) for q, a in enumerate(answers) for r, (i, s) in enumerate(a, 1)]
    return spark.createDataFrame(rows, "qid long, rank int, id long, score double")


def test_recall(spark):
    truth = lists(spark, [(1, 0.9), (2, 0.8), (3, 0.7)], [(4, 0.5)])
    got = lists(spark, [(1, 0.9), (1, 0.9), (9, 0.7), (8, 0.95)], [])
    rows = {r["qid"]: r for r in evaluate.recall_per_query(got, truth, 3).collect()}
    assert (rows[0]["hits"], rows[0]["recall"], rows[0]["impossible"]) == (2, pytest.approx(2 / 3), 0)
    assert (rows[1]["available"], rows[1]["recall"]) == (1, 0.0)
    wide = {r["qid"]: r for r in evaluate.recall_per_query(got, truth, 4).collect()}
    assert wide[0]["impossible"] == 1


def test_relevance(spark):
    got = lists(spark, [(1, 3.0), (2, 2.0)], [(5, 1.0)])
    qrels = spark.createDataFrame([(0, 2, 1), (0, 3, 2), (1, 5, 0), (2, 7, 1)], "qid long, id long, grade int")
    n = {r["qid"]: r["ndcg"] for r in evaluate.ndcg(got, qrels).collect()}
    assert n[0] == pytest.approx((1 / np.log2(3)) / (3 + 1 / np.log2(3))) and n[1] == 0 and n[2] == 0
    assert {r["qid"]: r["rr"] for r in evaluate.reciprocal_rank(got, qrels).collect()} == {0: 0.5, 1: 0.0, 2: 0.0}


def test_rank_agreement(spark):
    a, b = lists(spark, [(1, 3.0), (2, 2.0), (3, 1.0)], [(1, 1.0)]), lists(spark, [(3, 3.0), (2, 2.0), (1, 1.0)], [(2, 1.0)])
    assert {r["qid"]: r["tau"] for r in evaluate.kendall_tau(a, b).collect()} == {0: -1.0, 1: None}
    rbo = {r["qid"]: r["rbo"] for r in evaluate.rank_biased_overlap(a, b).collect()}
    assert rbo[1] == 0 and 0 < rbo[0] < 1
    assert all(r["rbo"] == pytest.approx(1) for r in evaluate.rank_biased_overlap(a, a).collect())


def test_ties_and_truth_differences(spark):
    a = lists(spark, [(1, 1.0), (2, 0.5), (3, 0.5)], [(1, 1.0), (2, 0.5)])
    b = lists(spark, [(1, 1.0), (3, 0.5), (2, 0.5)], [(2, 1.0), (1, 0.5)])
    assert {r["qid"]: r["agrees"] for r in evaluate.agree_up_to_ties(a, b, 0.0).collect()} == {0: True, 1: False}
    assert {r["qid"]: r["verdict"] for r in evaluate.truth_diff(a, b).collect()} == {0: "same_set", 1: "same_set"}
    assert {r["qid"]: r["verdict"] for r in evaluate.shipped_truth_check(a, b, 0.0).collect()} == {0: "equal_under_ties", 1: "mismatch"}
    c = lists(spark, [(1, 1.0), (2, 0.5), (9, 0.5)], [(8, 1.0), (2, 0.5)])
    assert {r["qid"]: r["verdict"] for r in evaluate.truth_diff(a, c).collect()} == {0: "boundary", 1: "interior"}


def test_wilson(spark):
    low, high = evaluate.wilson(F.lit(8.0), F.lit(10.0))
    r = spark.range(1).select(low, high).first()
    assert r[0] == pytest.approx(0.4902, abs=1e-4) and r[1] == pytest.approx(0.9433, abs=1e-4)


def test_break_even(spark):
    df = spark.createDataFrame([("a", 16.0, 0.5), ("a", 64.0, 2.0), ("b", 16.0, 2.0), ("b", 64.0, 3.0)], "d string, ef double, ratio double")
    assert [tuple(r) for r in benchfold.break_even(df, ["d"]).collect()] == [("a", pytest.approx(32.0))]


def test_approximate_search_is_close_to_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)], "offset long, vector array<float>, label int").cache()
    q = points.where("offset < 20").select(F.col("offset").alias("qid"), F.col("vector").cast("array<double>").alias("q"))
    exact = topk.knn(points, q).withColumnRenamed("offset", "id")
    arms = {
        "product": quantize.product_search(points, q, quantize.fit_product(points, 4, 64), oversampling=8),
        "rotation 4": quantize.rotation_search(points, q, quantize.fit_rotation(points, 4), oversampling=4),
        "rotation 1": quantize.rotation_search(points, q, quantize.fit_rotation(points, 1), oversampling=16),
        "lists": ann.search(ann.build(points, 16), q, probes=14),
    }
    for name, got in arms.items():
        recall = evaluate.recall_per_query(got.withColumnRenamed("offset", "id"), exact, 10).agg(F.avg("recall")).first()[0]
        assert recall >= 0.9, (name, recall)
    few = ann.search(ann.build(points, 16), q, probes=1, limit=20, where="label = 2")
    assert few.groupBy("qid").count().where("count <> 20").count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_lists_query_is_close_to_exact(spark, sf):
    """With the query's own parameters, on the tables it runs on."""
    got, exact = (registry.QUERIES[q](spark, f"/root/testdata/{sf}").withColumnRenamed("offset", "id") for q in ("ivf_knn", "knn_dot"))
    assert evaluate.recall_per_query(got, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_coded_search_takes_any_number_of_queries(spark):
    """More than travel with one scan; the pool holds every row, so the answers are the exact ones."""
    x = np.random.default_rng(5).normal(size=(20, 8))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "offset long, vector array<double>").coalesce(1).cache()
    q = spark.range(quantize.BATCH_QUERIES + 500).select(F.col("id").alias("qid"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.sin(d * (F.col("id") + 1))).alias("q"))
    want = {(r["qid"], r["rank"], r["offset"]) for r in topk.knn(points, q, limit=3).collect()}
    assert len(want) == 3 * (quantize.BATCH_QUERIES + 500)
    for got in (quantize.product_search(points, q, quantize.fit_product(points, 16, 8), limit=3, oversampling=8), quantize.rotation_search(points, q, quantize.fit_rotation(points, 4), limit=3, oversampling=8)):
        assert {(r["qid"], r["rank"], r["offset"]) for r in got.collect()} == want
    none = q.where("qid < 0")
    assert quantize.product_search(points, none, quantize.fit_product(points, 16, 8)).count() == 0


def test_codes(spark):
    assert [quantize.oversampled(10, f) for f in (None, 1.0, float("nan"), 2.45)] == [10, 10, 10, 25]
    assert quantize.parts_for(128, 16) == 32 and quantize.parts_for(30, 16) == 6
    v = spark.createDataFrame([([-2.0, -0.5, 0.0, 3.0],)], "v array<double>")
    two = v.select(quantize.binary_bits(F.col("v"), 2, [0.0] * 4, [1.0] * 4), quantize.binary_bits(F.col("v"), 1.5, [0.0] * 4, [1.0] * 4), quantize.packed(quantize.binary_bits(F.col("v")))).first()
    assert two[0] == [0, 1, 1, 1, 0, 0, 0, 1] and two[1] == [0, 1, 1, 1, 0, 1] and two[2] == [1]
    x = np.random.default_rng(0).normal(size=(3, 16))
    assert np.allclose(quantize.hadamard(quantize.hadamard(x)), x)


def test_words_and_stems(spark):
    df = spark.createDataFrame([("Ünïcode wörds, 12a3 ½ — naïve_x ΣΑΣ",)], "t string")
    assert df.select(words(F.col("t"))).first()[0] == ["ünïcode", "wörds", "12a3", "½", "naïve", "x", "σας"]
    want = {"consigning": "consign", "knackeries": "knackeri", "generously": "generous", "communication": "communic", "happily": "happili", "hoping": "hope", "hopping": "hop", "relational": "relat", "skies": "sky", "dying": "die", "lying": "lie", "cries": "cri", "ties": "tie", "by": "by", "say": "say", "bed": "bed", "sensational": "sensat"}
    assert {w: stem(w) for w in want} == want


def test_the_vocabulary_is_of_all_languages(spark, tmp_path):
    spark.createDataFrame([(0, "hoping", "en"), (1, "perros", "es"), (2, "ties hoping", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["word"]: r["stem"] for r in registry.QUERIES["vocabulary_stems"](spark, str(tmp_path)).collect()} == {"hoping": "hope", "perros": stem("perros"), "ties": "tie"}
