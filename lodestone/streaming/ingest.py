"""Continuous upserts: each micro-batch becomes a new version of the table of points, visible as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import writes


class Table:
    """Versions of points under one path. A version is written whole before the pointer to it moves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        done = self._fs.globStatus(self._path("v=*/_SUCCESS"))
        numbers = [int(s.getPath().getParent().getName()[2:]) for s in done or []]
        return max(numbers, default=None)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self) -> DataFrame | None:
        at = self.version()
        return None if at is None else self.spark.read.parquet(f"{self.path}/v={at}")

    def write(self, points: DataFrame, version: int) -> None:
        points.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def drop_before(self, version: int) -> None:
        for s in self._fs.globStatus(self._path("v=*")) or []:
            if int(s.getPath().getName()[2:]) < version:
                self._fs.delete(s.getPath(), True)


def upsert_stream(stream: DataFrame, table: Table, checkpoint: str):
    """A started query that merges (seq, point_id, ...) rows; version n + 1 is micro-batch n, so a replayed batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        if (table.version() or 0) > number:
            return
        old = table.read()
        merged = writes.merge_log(batch) if old is None else writes.upsert(old, batch)
        table.write(merged, number + 1)
        table.drop_before(number)  # the version before stays for readers that began on it

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(covered: int, pending: int, built: bool, ratio: float = 0.10) -> str:
    """green when empty or all is built and less than a tenth is pending; else yellow."""
    if covered + pending == 0:
        return "green"
    return "yellow" if not built or covered == 0 or pending / covered >= ratio else "green"


def windowed_throughput(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Completions and their values per event-time window and type; rows later than `late` are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no gap of that length."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
