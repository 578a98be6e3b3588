"""Filters, writes and scrolling over payloads that are built from the events and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import filters as C
from lodestone.operators import writes

PAYLOAD = """concat('{"type":"', event_type, '","k":', event_id % 7, ',"x":', event_id % 11, '.5,"tags":["t', event_id % 3, '","t', event_id % 5, '"],"on":',
 CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"when":"2024-01-', lpad(CAST(1 + event_id % 28 AS VARCHAR(2)), 2, '0'), 'T10:00:00Z"',
 CASE event_id % 5 WHEN 0 THEN ',"opt":null' WHEN 1 THEN ',"opt":[]' WHEN 2 THEN ',"opt":"s"' WHEN 3 THEN ',"opt":[null,1]' ELSE '' END,
 ',"items":[{"p":', event_id % 4, '},{"p":', event_id % 6, '}]}')"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.parse_json(F.expr(PAYLOAD)).alias("payload"))


def _filtered(condition):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return event_points(spark, sf_dir).where(condition.column(F.col("payload"))).select("event_id")

    return run


def _sql(where: str) -> str:
    return f"""SELECT event_id FROM (SELECT event_id, {PAYLOAD}::JSON AS p FROM events) WHERE {where}"""


_OPT = "coalesce(json_type(p, '$.opt'), 'MISSING')"
_FILTERS = {
    "match_keyword": (C.match("type", "click"), "p->>'$.type' = 'click'"),
    "match_integer": (C.match("k", 3), "(p->>'$.k')::INT = 3"),
    "match_integer_not_double": (C.match("x", 3), "false"),
    "match_boolean": (C.match("on", True), "p->>'$.on' = 'true'"),
    "match_any_keywords": (C.match("type", "click", "purchase"), "p->>'$.type' IN ('click', 'purchase')"),
    "match_any_integers": (C.match("k", 1, 5), "(p->>'$.k')::INT IN (1, 5)"),
    "match_list_element": (C.match("tags", "t2"), "p->>'$.tags[0]' = 't2' OR p->>'$.tags[1]' = 't2'"),
    "match_wildcard_path": (C.match("items[].p", 3), "(p->>'$.items[0].p')::INT = 3 OR (p->>'$.items[1].p')::INT = 3"),
    "match_index_path": (C.match("items[1].p", 5), "(p->>'$.items[1].p')::INT = 5"),
    "range_numeric": (C.Range("x", gte=2.5, lt=7.0), "(p->>'$.x')::DOUBLE >= 2.5 AND (p->>'$.x')::DOUBLE < 7.0"),
    "range_integers": (C.Range("k", gt=2, lte=5), "(p->>'$.k')::INT > 2 AND (p->>'$.k')::INT <= 5"),
    "datetime_range": (C.DatetimeRange("when", gte="2024-01-10", lt="2024-01-20T12:00:00+02:00"), "(p->>'$.when')::TIMESTAMP >= '2024-01-10' AND (p->>'$.when')::TIMESTAMP < '2024-01-20 10:00:00'"),
    "values_count": (C.ValuesCount("opt", gte=1), f"{_OPT} = 'VARCHAR' OR ({_OPT} = 'ARRAY' AND json_array_length(p, '$.opt') >= 1)"),
    "field_empty": (C.FieldEmpty("opt"), f"{_OPT} IN ('MISSING', 'NULL') OR ({_OPT} = 'ARRAY' AND json_array_length(p, '$.opt') = 0)"),
    "is_empty": (C.IsEmpty("opt"), f"{_OPT} IN ('MISSING', 'NULL') OR ({_OPT} = 'ARRAY' AND json_array_length(p, '$.opt') = 0)"),
    "is_null": (C.IsNull("opt"), f"{_OPT} = 'NULL' OR ({_OPT} = 'ARRAY' AND coalesce(json_type(p, '$.opt[0]'), '') = 'NULL')"),
    "match_or_range": (C.Either(C.match("k", 0), C.Range("k", gt=4)), "(p->>'$.k')::INT = 0 OR (p->>'$.k')::INT > 4"),
    "must_should_not": (
        C.Filter(must=[C.match("type", "click", "view")], must_not=[C.match("k", 3)], should=[C.Range("x", lt=2), C.match("tags", "t4")]),
        "p->>'$.type' IN ('click', 'view') AND (p->>'$.k')::INT <> 3 AND ((p->>'$.x')::DOUBLE < 2 OR p->>'$.tags[0]' = 't4' OR p->>'$.tags[1]' = 't4')",
    ),
    "must_not_missing_key": (C.Filter(must_not=[C.match("absent", "a")], must=[C.match("k", 2)]), "(p->>'$.k')::INT = 2"),
    "condition_grammar": (
        C.from_json({"and": [{"type": {"match_any": {"any": ["click", "view"]}}}], "or": [{"k": {"range": {"gte": 5}}}, {"on": {"match": {"value": True}}}]}),
        "p->>'$.type' IN ('click', 'view') AND ((p->>'$.k')::INT >= 5 OR p->>'$.on' = 'true')",
    ),
}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("point_id"), "event_type", F.round("value", 4).alias("value"))


def upsert_last_write(spark, sf_dir):
    return writes.merge_log(event_log(spark, sf_dir)).select("point_id", "offset", "event_type", "value")


def upsert_over_existing(spark, sf_dir):
    log = event_log(spark, sf_dir)
    old = writes.delete(writes.merge_log(log.where("seq < 400")), log.where("point_id % 7 = 0"))
    return writes.upsert(old, log.where("seq >= 400")).select("point_id", "offset", "event_type", "value", "deleted")


def delete_tombstones(spark, sf_dir):
    points = writes.merge_log(event_log(spark, sf_dir))
    gone = points.where("point_id % 7 = 0").select("point_id")
    return writes.live(writes.delete(points, gone)).select("point_id", "offset")


def set_payload_merge(spark, sf_dir):
    points = writes.merge_log(event_log(spark, sf_dir))
    points = points.select("point_id", "deleted", F.create_map(F.lit("type"), "event_type", F.lit("v"), F.col("value").cast("string")).alias("payload"))
    changes = points.where("point_id % 3 = 0").select("point_id", F.create_map(F.lit("type"), F.lit("set"), F.lit("n"), F.lit("1")).alias("change"))
    out = writes.set_payload(points, changes)
    return out.select("point_id", F.col("payload")["type"].alias("type"), F.col("payload")["n"].alias("n"), F.col("payload")["v"].isNotNull().alias("has_v"))


def collection_info(spark, sf_dir):
    points = writes.merge_log(event_log(spark, sf_dir))
    return writes.info(writes.delete(points, points.where("point_id % 7 = 0")))


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("point_id"), "o_orderstatus", "o_totalprice")


def scroll_page(spark, sf_dir):
    return writes.scroll(_orders(spark, sf_dir), 25, cursor=100).select("point_id", "next")


def scroll_filtered(spark, sf_dir):
    return writes.scroll(_orders(spark, sf_dir), 20, cursor=50, where=F.expr("o_orderstatus = 'F' AND o_totalprice > 100000")).select("point_id", "next")


_LOG = "SELECT event_id AS seq, user_id AS point_id, event_type, round(value, 4) AS value FROM events"
_LAST = f"""WITH l AS ({_LOG}), r AS (SELECT *, min(seq) OVER (PARTITION BY point_id) AS "offset", row_number() OVER (PARTITION BY point_id ORDER BY seq DESC) AS n FROM l),
p AS (SELECT * FROM r WHERE n = 1)"""


def _scroll_sql(where: str, limit: int) -> str:
    return f"""WITH r AS (SELECT o_orderkey AS point_id, row_number() OVER (ORDER BY o_orderkey) AS n, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nx FROM orders WHERE {where})
SELECT point_id, CASE WHEN n = {limit} THEN nx END AS next FROM r WHERE n <= {limit}"""


QUERIES = {f"filter_{n}": _filtered(c) for n, (c, _) in _FILTERS.items()} | {
    f.__name__: f for f in (upsert_last_write, upsert_over_existing, delete_tombstones, set_payload_merge, collection_info, scroll_page, scroll_filtered)
}
ORACLES = {f"filter_{n}": _sql(w) for n, (_, w) in _FILTERS.items()} | {
    "upsert_last_write": _LAST + """ SELECT point_id, "offset", event_type, value FROM p""",
    "upsert_over_existing": _LAST + """ SELECT point_id, "offset", event_type, value, (point_id % 7 = 0 AND seq < 400) AS deleted FROM p""",
    "delete_tombstones": _LAST + """ SELECT point_id, "offset" FROM p WHERE point_id % 7 <> 0""",
    "set_payload_merge": _LAST + """ SELECT point_id, CASE WHEN point_id % 3 = 0 THEN 'set' ELSE event_type END AS type, CASE WHEN point_id % 3 = 0 THEN '1' END AS n, value IS NOT NULL AS has_v FROM p""",
    "collection_info": _LAST + """ SELECT count(*) FILTER (point_id % 7 <> 0) AS points_count, count(*) FILTER (point_id % 7 = 0) AS deleted_count, count(*) AS indexed_count, 'green' AS status FROM p""",
    "scroll_page": _scroll_sql("o_orderkey >= 100", 25),
    "scroll_filtered": _scroll_sql("o_orderkey >= 50 AND o_orderstatus = 'F' AND o_totalprice > 100000", 20),
}
