"""Continuous ingest of the events table, compared with its batch form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lodestone.streaming import ingest



def _scratch(spark) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp()).rstrip('/')}/lodestone-stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")


def streamed_upserts(spark, sf_dir):
    """The table after the stream has been drained equals the batch merge of the same log."""
    at = _scratch(spark)
    table = ingest.Table(spark, f"{at}/points")
    log = _stream(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("point_id"), "event_type", F.round("value", 4).alias("value"))
    ingest.upsert_stream(log, table, f"{at}/checkpoint").awaitTermination()
    return table.read().select("point_id", "offset", "event_type", "value")


def streamed_windows(spark, sf_dir):
    name = f"w{uuid.uuid4().hex}"
    out = ingest.windowed_throughput(_stream(spark, sf_dir), "1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def windowed_throughput(spark, sf_dir):
    return ingest.windowed_throughput(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")


def user_sessions(spark, sf_dir):
    return ingest.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (streamed_upserts, streamed_windows, windowed_throughput, user_sessions)}
ORACLES = {
    "streamed_upserts": """WITH l AS (SELECT event_id AS seq, user_id AS point_id, event_type, round(value, 4) AS value FROM events),
r AS (SELECT *, min(seq) OVER (PARTITION BY point_id) AS "offset", row_number() OVER (PARTITION BY point_id ORDER BY seq DESC) AS n FROM l) SELECT point_id, "offset", event_type, value FROM r WHERE n = 1""",
    "streamed_windows": _WINDOWS,
    "windowed_throughput": _WINDOWS,
    "user_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
}
