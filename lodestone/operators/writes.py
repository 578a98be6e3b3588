"""Upserts, deletes and payload changes as pure functions of tables of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_log(log: DataFrame) -> DataFrame:
    """The points after a log of (seq, point_id, ...) upserts: the last write wins whole, the offset is that of the first arrival.

    Offsets are the smallest seq of each point, so they order points by arrival
    without numbering all of them in one task.
    """
    w = Window.partitionBy("point_id")
    last = log.withColumns({"offset": F.min("seq").over(w), "__n": F.row_number().over(w.orderBy(F.col("seq").desc()))})
    return last.where("__n = 1").drop("__n", "seq").withColumn("deleted", F.lit(False))


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (seq, point_id, ...) over points: offsets stay, rows are replaced whole, deleted points come back.

    seq must be above every offset of the points that are there.
    """
    old = points.withColumn("seq", F.lit(None).cast("long"))
    fresh = new.withColumns({"offset": F.col("seq").cast("long"), "deleted": F.lit(False)})
    w = Window.partitionBy("point_id")
    both = old.unionByName(fresh, allowMissingColumns=True)
    both = both.withColumns({"__first": F.min("offset").over(w), "__n": F.row_number().over(w.orderBy(F.col("seq").desc_nulls_last()))})
    return both.where("__n = 1").withColumn("offset", F.col("__first")).drop("__first", "__n", "seq")


def delete(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones for the ids; unknown ids do nothing."""
    gone = ids.select("point_id").distinct().withColumn("__gone", F.lit(True))
    out = points.join(gone, "point_id", "left")
    return out.withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def live(points: DataFrame) -> DataFrame:
    return points.where(~F.col("deleted"))


def set_payload(points: DataFrame, changes: DataFrame) -> DataFrame:
    """Top-level keys of changes (point_id, change map) over those of payload (a map); other keys survive.

    Deleted and unknown points are not changed; missing_targets() names them.
    """
    out = points.join(changes, "point_id", "left")
    kept = F.map_filter(F.col("payload"), lambda k, _: ~F.map_contains_key(F.col("change"), k))
    merged = F.when(F.col("change").isNotNull() & ~F.col("deleted"), F.map_concat(F.coalesce(kept, F.map_from_arrays(F.array(), F.array()).cast(points.schema["payload"].dataType)), F.col("change")))
    return out.withColumn("payload", F.coalesce(merged, F.col("payload"))).drop("change")


def missing_targets(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of a payload change that no live point has."""
    return ids.join(live(points), "point_id", "left_anti")


def info(points: DataFrame, indexed: int | None = None, rebuild_ratio: float = 0.10) -> DataFrame:
    """Counts and status: empty is green; not built, or a tenth or more of the covered points pending, is yellow."""
    total = F.count("*")
    alive = F.count_if(~F.col("deleted"))
    covered = F.lit(indexed) if indexed is not None else total
    status = F.when(total == 0, "green").when(covered == 0, "yellow").when((total - covered) / covered >= rebuild_ratio, "yellow").otherwise("green")
    return points.agg(alive.alias("points_count"), (total - alive).alias("deleted_count"), F.least(total, covered).alias("indexed_count"), status.alias("status"))


def scroll(points: DataFrame, limit: int = 10, cursor=None, where=None) -> DataFrame:
    """A page in id order with the id that the next page begins at, on its last row: point_id, next.

    Numbers come before UUIDs. point_id may be a number, or (kind, num, uuid).
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    limit = min(limit, 4096)
    rows = points if where is None else points.where(F.coalesce(where, F.lit(False)))
    if cursor is not None:
        rows = rows.where(F.col("point_id") >= F.lit(cursor))
    page = rows.orderBy("point_id").limit(limit + 1)
    page = page.withColumns({"__n": F.row_number().over(Window.orderBy("point_id")), "next": F.lead("point_id").over(Window.orderBy("point_id"))})
    return page.where(F.col("__n") <= limit).withColumn("next", F.when(F.col("__n") == limit, F.col("next"))).drop("__n")


def point_id(text: Column) -> Column:
    """STRUCT<kind, num, uuid> of an id in text: decimal digits, or a UUID in any of its four forms; null otherwise."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"^(urn:uuid:|\{)|\}$", ""), "-", ""))
    uuid = F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12))
    is_number, is_uuid = F.regexp_like(text, F.lit(r"^\d{1,20}$")), F.regexp_like(text, F.lit(r"^(urn:uuid:)?\{?([0-9A-Fa-f]{32}|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})\}?$"))
    number = F.struct(F.lit(0).cast("tinyint").alias("kind"), text.cast("decimal(20,0)").alias("num"), F.lit(None).cast("string").alias("uuid"))
    other = F.struct(F.lit(1).cast("tinyint").alias("kind"), F.lit(None).cast("decimal(20,0)").alias("num"), uuid.alias("uuid"))
    return F.when(is_number, number).when(is_uuid, other)
