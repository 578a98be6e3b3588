"""What a task may hold and what is scored where: searches whose queries and rows outgrow one scan."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import topk


def table(spark, n, dim=8, seed=1, parts=3):
    """Points with equal rows among them, on a few partitions."""
    x = np.random.default_rng(seed).normal(size=(n, dim)).round(1)
    x[n // 2 : n // 2 + n // 8] = x[0]
    rows = [(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "offset long, vector array<double>, label int").repartition(parts)


def ordered(x, q, metric="dot"):
    """All rows by similarity, then offset."""
    sim = topk._pairwise(metric, np.repeat(q[None], len(x), 0), x)
    return sorted(range(len(x)), key=lambda i: (-sim[i], i))


def answers(df):
    found = {}
    for r in df.orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["offset"])
    return found


def test_places_among_all_rows(spark):
    x, points = table(spark, 300)
    q = points.where("offset < 5").select(F.col("offset").alias("qid"), F.col("vector").alias("q"))
    targets = topk.knn(points, q, limit=40, where="label = 2").select("qid", "offset", F.col("score").alias("sim"))
    got = {(r["qid"], r["offset"]): r["place"] for r in topk.places(points, q, targets, "dot").collect()}
    want = {(i, o): place for i in range(5) for place, o in enumerate(ordered(x, x[i]), 1) if o % 5 == 2}
    assert len(got) == 5 * 40 and all(want[k] == v for k, v in got.items())


@pytest.mark.parametrize("metric", ["dot", "euclid", "manhattan"])
def test_a_task_keeps_no_more_than_the_answer(spark, monkeypatch, metric):
    """Before, every Arrow batch gave its own best rows, and a wide page was most of all pairs."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    x, points = table(spark, 600, parts=2)
    q = points.where("offset < 9").select(F.col("offset").alias("qid"), F.col("vector").alias("q"))
    kept = topk.best_pairs(points.select("offset", "vector"), q, partial(topk.Exact, metric), 50)
    assert kept.count() == 2 * 50 * 9
    assert answers(topk.knn(points, q, metric, 50)) == {i: ordered(x, x[i], metric)[:50] for i in range(9)}


@pytest.mark.parametrize("metric", ["dot", "euclid"])
def test_many_queries_meet_the_rows_in_groups(spark, monkeypatch, metric):
    """Before, more queries than travel met all rows in one task and in interpreted expressions."""
    x, points = table(spark, 90)
    q = points.where("offset < 40").select(F.col("offset").alias("qid"), F.col("vector").alias("q"))
    for name, value in {"BROADCAST_QUERIES": 7, "CELL_QUERIES": 9, "CELL_ROWS": 20}.items():
        monkeypatch.setattr(topk, name, value)
    found = topk.knn(points, q, metric, 3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    assert answers(found) == {i: ordered(x, x[i], metric)[:3] for i in range(40)}
    assert topk.knn(points.where("offset < 0"), q, metric, 3).count() == 0


def test_not_a_number_counts_as_the_largest(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [2.0, 0.0])], "offset long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, q array<double>")
    assert answers(topk.knn(points, q, "dot", 2)) == {0: [1, 2]}


def test_codes_score_as_their_expressions(spark, monkeypatch):
    """By the batch, in the same sums and order as the column expressions; before, all pairs went through those and a sort."""
    from lodestone.operators import quantize

    monkeypatch.setattr(topk, "BLOCK", 16)
    _, points = table(spark, 200)
    codec = quantize.Scalar(-2.0, 2.0)
    binary = lambda c: quantize.packed(quantize.binary_bits(F.concat(*[c] * 9)))  # noqa: E731  72 bits, two words
    arms = [(codec.encode, codec.scorer(m, 8), partial(lambda m, a, b: codec.similarity(m, a, b, 8), m)) for m in ("dot", "euclid", "manhattan")]
    arms.append((binary, partial(quantize.BinaryCodes, 72), lambda a, b: quantize.binary_similarity(a, b, 72)))
    spoiled = points.unionByName(spark.createDataFrame([(900, None, 0), (901, [1.0], 0)], points.schema))
    for encode, scorer, expression in arms:
        coded = spoiled.select("offset", encode(F.col("vector")).alias("code"))
        q = points.where("offset < 12").select(F.col("offset").alias("qid"), F.col("vector").alias("q"), encode(F.col("vector")).alias("qcode"))
        pairs = coded.crossJoin(q).select("qid", "offset", expression(F.col("code"), F.col("qcode")).alias("sim"))
        for keep in (7, 202):
            want = topk.rank_within(pairs, "qid", [F.col("sim").desc(), F.col("offset").asc()], keep).select("qid", "rank", "offset", F.col("sim").alias("score"))
            got = quantize.two_stage(coded, points, q, scorer, limit=keep, rescore=False)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
            assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_product_codes_score_by_their_tables(spark):
    from lodestone.operators import quantize

    x, points = table(spark, 300)
    model = quantize.fit_product(points, 16, 8)
    q = points.where("offset < 6").select(F.col("offset").alias("qid"), F.col("vector").alias("q"))
    for metric in ("dot", "euclid"):
        got = topk.best_pairs(points.coalesce(1).select("offset", "vector"), q, partial(quantize.ProductCodes, model, metric), 20)
        sim = quantize._look_up(model.encode(x), model.tables(x[:6], metric))
        want = {(i, int(o)): sim[i, o] for i in range(6) for o in np.lexsort((np.arange(300), -sim[i]))[:20]}
        assert {(r["qid"], r["offset"]): r["sim"] for r in got.collect()} == want


def test_lists_are_searched_without_all_pairs(spark):
    """Only rows of probed lists answer; a query whose lists hold too few is answered from all rows."""
    from lodestone.operators import ann
    from lodestone.operators.quantize import nearest

    x, points = table(spark, 240)
    index = ann.build(points, 6)
    q = points.where("offset < 8").select(F.col("offset").alias("qid"), F.col("vector").alias("q"))
    at = nearest(x, index.centroids)
    for probes, limit in ((2, 5), (1, 60)):
        got = answers(ann.search(index, q, "dot", limit, probes))
        for i in range(8):
            lists = sorted(range(6), key=lambda c: (-float(index.centroids[c] @ x[i]), c))[:probes]
            inside = [o for o in ordered(x, x[i]) if at[o] in lists]
            assert got[i] == (inside if len(inside) >= limit else ordered(x, x[i]))[:limit]


def test_bm25_by_batches_of_documents(spark, monkeypatch):
    """Ranks and scores as the general way has them, whatever is held at once; nothing but the best rows is shuffled."""
    from lodestone.operators import bm25

    rng = np.random.default_rng(2)
    text = [" ".join(f"w{int(w)}" for w in rng.zipf(1.6, 12) % 40) for _ in range(120)]
    docs = spark.createDataFrame([(i, t if i % 9 else None) for i, t in enumerate(text + text[:20])], "offset long, text string").repartition(2)
    q = spark.createDataFrame([(i, text[i * 7] + " w1 w1 unheard") for i in range(9)] + [(9, "")], "qid long, text string")
    for held in (2_000_000, 64):
        monkeypatch.setattr(bm25, "SCORES", held)
        for options in ({}, {"b": 0.0}):
            for allowed in (None, docs.where("offset % 3 = 1")):
                fast = bm25.search(bm25.index(docs), q, 5, allowed, **options)
                assert fast._jdf.queryExecution().toString().count("MapInArrow") and not fast._jdf.queryExecution().toString().count("Explode")
                every = bm25.scores(bm25.index(docs), q, **options)
                every = every if allowed is None else every.join(allowed, "offset", "left_semi")
                want = topk.rank_within(every, "qid", [F.round("score", 9).desc(), F.col("offset").asc()], 5)
                shown = lambda df: {(r["qid"], r["rank"]): (r["offset"], round(r["score"], 9)) for r in df.collect()}
                assert shown(fast) == shown(want) and len(shown(fast)) > 20
    some = bm25.scores(bm25.index(docs), q, only=docs.where("offset < 9"))
    assert {r["offset"] for r in some.collect()} <= set(range(9)) and some.count() == bm25.scores(bm25.index(docs), q).where("offset < 9").count()


def test_equal_offsets_are_one_document(spark):
    from lodestone.operators import bm25

    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a")], "offset long, text string")
    q = spark.createDataFrame([(0, "a b")], "qid long, text string")
    assert not bm25.index(docs).by_document and answers(bm25.search(bm25.index(docs), q)) == {0: [1, 2]}


def test_spark_rounds_halves_up():
    from lodestone.operators import bm25

    assert bm25._rounded(np.array([0.1234567885, 2.5e-10, 5e-10, 27.0])).tolist() == [0.123456789, 0.0, 1e-9, 27.0]
