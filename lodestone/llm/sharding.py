"""Shards of near-equal bytes by k-d tree partitioning. DataFrame functions only.

The root holds all documents and all shards. A node with s > 1 shards is split
along its widest metadata dimension (document number, size, source, language,
each scaled to 0..1 over the whole table) at the weighted quantile that leaves
floor(s/2)/s of its bytes on the left, until every leaf is one shard, that is,
until it has reached the target of total bytes / shards.

Medians are distributed: bytes are summed map-side into BINS bins per node, then
the one bin in which the quantile falls is cut again by a hash of the document,
so that ties (a hot source, a group of copies) are split as well. The driver
sees one row per node and level: 39 rows in all for 40 shards.

Null texts count 16 bytes, as every row does for its envelope. Rows that agree
in doc_id and text stay in one shard. Law: bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import remove, written_at

ENVELOPE = 16
BINS = 2048
SLICES = 64
DIMENSIONS = ("m_doc", "m_size", "m_source", "m_lang")


#: Where a node's rows all go left: it is one shard already, or it has no rows.
ALL_LEFT = (0, 0.0, 0.0, 1, 0)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h and the raw metadata dimensions."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ENVELOPE
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")).cast("double")
    base = docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("m_doc"), F.log(size.cast("double")).alias("m_size"),
        name("source").alias("m_source"), name("lang").alias("m_lang"),
    )
    return base.withColumn("h", F.xxhash64("doc_id", "text_crc32", F.lit(7)))


def _at(values: list, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def _binned(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """Adds bin and sub, by the dimension that the row's place is split along."""
    dimension = F.element_at(F.array(*DIMENSIONS), _at([d + 1 for d, *_ in splits], F.col("place")))
    low, width = _at([float(x[1]) for x in splits], F.col("place")), _at([float(x[2]) for x in splits], F.col("place"))
    b = F.when(F.col("width") > 0, F.least(F.floor((F.col("along") - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    rows = rows.withColumns({"along": dimension, "low": low, "width": width})
    return rows.withColumns({"bin": b, "sub": F.pmod(F.col("h"), F.lit(BINS))}).drop("along", "low", "width")


def placed(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """Moves each row's place one level down."""
    rows = _binned(rows, splits).withColumns({"at": _at([x[3] for x in splits], F.col("place")), "below": _at([x[4] for x in splits], F.col("place"))})
    left = (F.col("bin") < F.col("at")) | ((F.col("bin") == F.col("at")) & (F.col("sub") < F.col("below")))
    return rows.withColumn("place", F.col("place") * 2 + F.when(left, 0).otherwise(1)).drop("bin", "sub", "at", "below")


def _crossing(binned: DataFrame, want: list[float], column: str) -> dict[int, tuple]:
    """Per place, the bin in which the wanted bytes are reached: (bin, bytes before it, bytes in it)."""
    w = Window.partitionBy("place").orderBy(column)
    sums = binned.groupBy("place", column).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("want", _at([float(x) for x in want], F.col("place")))
    found = sums.where((F.col("before") <= F.col("want")) & (F.col("before") + F.col("n") > F.col("want")))
    return {r["place"]: (r[column], r["before"], r["n"]) for r in found.collect()}


def kd_leaves(base: DataFrame, shards: int) -> DataFrame:
    """Adds shard to described() rows. Per level one pass for the nodes' extents, two for their medians.

    A node is split as (dimension, low, width, bin, hash bin); a level has 2**i places.
    The slim rows are written once per level, so that no plan nests the whole tree.
    """
    (at, path), counts, whole = written_at(base.withColumn("place", F.lit(0)), "shard-rows"), [shards], None
    while max(counts) > 1:
        found = at.groupBy("place").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))])
        extents = {r["place"]: r for r in found.collect()}
        splits, want = [ALL_LEFT] * len(counts), [0.0] * len(counts)
        for i, n in enumerate(counts):
            if n < 2 or i not in extents:
                continue
            r = extents[i]
            widths = [r[f"high_{d}"] - r[f"low_{d}"] for d in DIMENSIONS]
            whole = whole or [max(x, 1e-300) for x in widths]
            d = max(range(len(widths)), key=lambda k: widths[k] / whole[k])
            splits[i], want[i] = (d, r[f"low_{DIMENSIONS[d]}"], widths[d], 0, 0), r["bytes"] * (n // 2) / n
        binned = _binned(at, splits)
        bins = _crossing(binned, want, "bin")
        inside = binned.where(F.col("bin") == _at([bins.get(i, (-1,))[0] for i in range(len(counts))], F.col("place")))
        subs = _crossing(inside, [want[i] - bins[i][1] if i in bins else 0.0 for i in range(len(counts))], "sub")
        for i, n in enumerate(counts):
            if n > 1 and i in extents:
                b, before, _ = bins[i]
                sub, first, here = subs[i]
                splits[i] = (*splits[i][:3], b, sub + int(want[i] - before - first > here / 2))
        above = path
        at, path = written_at(placed(at, splits), "shard-rows")
        remove(above)
        counts = [x for n in counts for x in ((n // 2, n - n // 2) if n > 1 else (n, 0))]
    return at.withColumn("shard", _at([sum(counts[:i]) for i in range(len(counts))], F.col("place")))


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps. No task sorts more than a slice of a shard."""
    rows = rows.withColumn("slice", F.pmod(F.shiftright(F.col("h"), 12), F.lit(SLICES)))
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("h", "doc_id", "size"))
    return rows.withColumn("own", own).join(F.broadcast(before), ["shard", "slice"]).withColumn("slot", F.col("before") + F.col("own") - 1)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard per document."""
    rows = with_slots(kd_leaves(described(docs), shards))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_kd_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
