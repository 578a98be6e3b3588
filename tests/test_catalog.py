import pytest
from pyspark.sql import functions as F

from lodestone.catalog import Catalog, Config
from lodestone.errors import AlreadyExists, InvalidArgument, NotFound, Unsupported
from lodestone.operators import datatypes, metrics, writes
from lodestone.operators import filters as C


def rows(spark, data):
    df = spark.createDataFrame([(n, i, v, p) for n, (i, v, p) in enumerate(data)], "nth long, point_id long, vector array<double>, p string")
    return df.withColumn("payload", F.parse_json("p")).drop("p")


def queries(spark, *vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "qid long, q array<double>")


@pytest.fixture
def catalog(spark):
    c = Catalog(spark)
    c.create("e", Config(2, "euclid"))
    c.upsert("e", rows(spark, [(7, [3.0, 4.0], '{"t":"alpha beta","k":1}'), (3, [1.0, 0.0], '{"t":"gamma"}'), (9, [6.0, 8.0], None), (5, [0.0, 1.0], '{"k":2}')]))
    return c


def found(df):
    return [(r["point_id"], round(r["score"], 6)) for r in df.orderBy("qid", "rank").collect()]


def test_search_paging_and_threshold(spark, catalog):
    q = queries(spark, [0.0, 0.0])
    assert found(catalog.query("e", q)) == [(3, 1.0), (5, 1.0), (7, 5.0), (9, 10.0)]
    assert found(catalog.query("e", q, limit=2, offset=1)) == [(5, 1.0), (7, 5.0)]
    assert found(catalog.query("e", q, threshold=5.0)) == [(3, 1.0), (5, 1.0)]
    assert found(catalog.query("e", q, where=C.match("k", 1))) == [(7, 5.0)]
    for limit, offset in ((0, 0), (4097, 0), (10, 4090)):
        with pytest.raises(ValueError):
            catalog.query("e", q, limit=limit, offset=offset)


def test_writes(spark, catalog):
    q = queries(spark, [0.0, 0.0])
    catalog.upsert("e", rows(spark, [(7, [0.5, 0.0], None), (1, [0.25, 0.0], '{"k":1}')]))
    assert found(catalog.query("e", q, limit=3)) == [(1, 0.25), (7, 0.5), (3, 1.0)]
    assert found(catalog.query("e", q, where=C.match("k", 1))) == [(1, 0.25)]
    first = {r["point_id"]: r["offset"] for r in catalog.get("e").points.collect()}
    assert first[7] == 0 and first[1] == max(first.values())
    catalog.delete("e", spark.createDataFrame([(3,), (77,)], "point_id long"))
    assert [r["point_id"] for r in catalog.scroll("e", 2).collect()] == [1, 5]
    assert catalog.info("e").first().asDict() == {"points_count": 4, "deleted_count": 1, "indexed_count": 5, "status": "green"}
    catalog.upsert("e", rows(spark, [(3, [2.0, 0.0], None)]))
    assert {r["point_id"]: r["offset"] for r in catalog.get("e").points.collect()}[3] == first[3]


def test_text(spark, catalog):
    q = spark.createDataFrame([(0, "alpha Alpha")], "qid long, text string")
    with pytest.raises(InvalidArgument):
        catalog.query_text("e", "t", q)
    catalog.create_index("e", "t", "text")
    assert found(catalog.query_text("e", "t", q)) == [(7, 0.609970)]
    with pytest.raises(InvalidArgument):
        catalog.create_index("e", "t", "keyword")
    with pytest.raises(Unsupported):
        catalog.create_index("e", "u", "text", tokenizer="prefix")


def test_scroll_cursor(spark, catalog):
    page = catalog.scroll("e", 2).orderBy("point_id").collect()
    assert [(r["point_id"], r["next"]) for r in page] == [(3, None), (5, 7)]
    assert [r["point_id"] for r in catalog.scroll("e", 10, cursor=7).collect()] == [7, 9]


def test_refusals(spark, catalog):
    q = queries(spark, [0.0, 0.0])
    with pytest.raises(AlreadyExists):
        catalog.create("e", Config(2))
    with pytest.raises(NotFound):
        catalog.get("none")
    assert catalog.drop("none") is False and catalog.exists("e")
    for options in ({"with_vectors": True}, {"recommend": 1}, {"prefetch": 1}):
        with pytest.raises(Unsupported):
            catalog.query("e", q, **options)
    for vector in ([1.0], [float("nan"), 0.0]):
        with pytest.raises(InvalidArgument):
            catalog.query("e", queries(spark, vector))
        with pytest.raises(InvalidArgument):
            catalog.upsert("e", rows(spark, [(1, vector, None)]))
    for bad in ({"dim": 0}, {"dim": 2, "metric": "x"}, {"dim": 20_000, "datatype": "uint8"}, {"dim": 2, "m": 3}, {"dim": 2, "quantile": 0.4}):
        with pytest.raises(InvalidArgument):
            Config(**bad)


def test_metrics_and_datatypes(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [300.9, -1.0, 1.9, float("nan")], [0.1, 1.0005])], "a array<double>, z array<double>, u array<double>, h array<double>")
    r = df.select(
        metrics.normalised(F.col("a")).alias("unit"), metrics.normalised(F.col("z")).alias("zero"), datatypes.stored(F.col("u"), "uint8").alias("u"), datatypes.stored(F.col("h"), "float16").alias("h"),
        datatypes.uint8_cosine(F.col("a"), F.col("z")).alias("c0"), datatypes.uint8_cosine(F.col("a"), F.col("a")).alias("c1"),
        *[metrics.reported(m, metrics.similarity(m, F.col("a"), F.col("z"))).alias(m) for m in ("dot", "euclid", "manhattan")],
    ).first()
    assert r["unit"] == pytest.approx([0.6, 0.8]) and r["zero"] == [0.0, 0.0]
    assert r["u"] == [255.0, 0.0, 1.0, 0.0] and r["h"] == [0.0999755859375, 1.0009765625]
    assert (r["c0"], r["c1"]) == (0.0, pytest.approx(1.0)) and (r["dot"], r["euclid"], r["manhattan"]) == (0.0, 5.0, 7.0)


def test_ids(spark):
    u = "12345678-9abc-def0-1234-56789abcdef0"
    texts = ["7", u.upper(), u.replace("-", ""), f"urn:uuid:{u}", "{" + u + "}", "18446744073709551615", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(writes.point_id(F.col("t"))).collect()]
    assert [g["uuid"] for g in got[1:5]] == [u] * 4 and int(got[5]["num"]) == 2**64 - 1 and got[6] is None and got[0]["kind"] == 0
