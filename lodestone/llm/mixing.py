"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every source gets a share of all words by its weight; no target exceeds `most`
times the source's own words, and the excess goes to the others by weight.

1. A source whose target is r times its words takes floor(r) whole copies of each
   of its documents for certain. `rest` words are left to be sampled.
2. They are sampled with inclusion in proportion to size: p = min(1, rate * size),
   with the rate at which the expected words are `rest`. Documents with p = 1 are
   certain as well.
3. Documents are ranked by random odds u / (1 - u) divided by their inclusion odds
   p / (1 - p), and the first ones are taken until the words come nearest to `rest`.
4. What is still missing, or too much, is below half a document. REPAIRS times the
   one document that brings the source nearest to its target is added, or one that
   is not certain left out; of equal sizes the first by rank. That is the one departure from the
   order sample: at most REPAIRS documents a source.

The running sum over a source is not one sorted task: the rank is cut into BINS
bins and each into BINS again; sums per bin are counted map-side, and only the
cell in which the words are reached is put in order. Sources are numbered by
ranges of their names, and the common level of the targets is found by sums alone.

Null texts have no words and take none; a null source is a source of its own, the
last one. A row's random number comes from its doc_id and its text, so rows with
null or repeated doc_ids draw their own; rows that are equal in both are taken in
the order in which they were written. Reruns agree. An empty table gives an empty
one; other columns take no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BINS = 4096
REPAIRS = 2
SEED = "mix-1:"
#: Tables of up to this many rows of a few numbers each are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def source_key(source: Column) -> Column:
    """Never null, in the order of the source's code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1), from the first 52 bits of a digest of the id and the text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def small(table: DataFrame) -> DataFrame:
    """A written table, broadcast if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def numbered(per: DataFrame) -> DataFrame:
    """Adds place: the number of each key in order, from 0. The driver sees one count per range of keys."""
    ranges = written(per.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())
    before = [(F.lit(r), F.lit(sum(n for q, n in counts if q < r))) for r, _ in counts]
    offset = F.create_map(*[x for pair in before for x in pair])[F.col("range")] if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return ranges.withColumn("place", own + offset - 1).drop("range")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """key, source_size and target per source.

    A source below its ceiling gets weight times a common level. The level is what is left per weight once the others
    are at their ceilings; it can only rise as more of them are, so it is raised until no further one is.
    """
    per = numbered(sized.groupBy("key").agg(F.sum("size").alias("source_size")))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    per = written(per.withColumn("weight", cycle).withColumn("ceiling", F.col("source_size") * F.lit(most)), "mix-sources")
    level, at_ceiling = 0.0, None
    while True:
        full = F.col("ceiling") / F.col("weight") < F.lit(level)
        words, taken, weight, n = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("ceiling"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == at_ceiling or not weight:
            return per.select("key", "source_size", F.least(F.col("ceiling"), F.lit(level) * F.col("weight")).alias("target"))
        level, at_ceiling = (words - (taken or 0.0)) / weight, n


def inclusion_rates(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with whole, rest and rate. From counts per source and size: the largest size that is not certain sets the rate."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sizes = sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")).join(small(written(sources, "mix-rests")), "key").where("rest > 0")
    larger = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(0, Window.unboundedFollowing)
    square = F.col("size").cast("decimal(19,0)") * F.col("size") * F.col("n")
    certain = F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0))
    sizes = sizes.withColumn("rate", (F.col("rest") - certain) / F.sum(square.cast("decimal(38,0)")).over(others).cast("double"))
    found = sizes.where(F.col("rate") * F.col("size") <= 1).groupBy("key").agg(F.max_by("rate", "size").alias("rate"))
    return sources.join(found, "key", "left")


def _at_cut(rows: DataFrame, cell: str, cuts: DataFrame | None) -> DataFrame:
    """Per source the cell of the rank in which `rest` is reached, with the words before it."""
    rows = rows.where(F.col("odds").isNotNull())
    if cuts is not None:
        rows = rows.join(cuts, "key").where(F.col("bin") == F.col("cut_bin"))
    start = F.lit(0) if cuts is None else F.first("before_bin")
    sums = rows.groupBy("key", cell).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), start.alias("start"), *([] if cuts is None else [F.first("cut_bin").alias("cut_bin")]))
    before = F.col("start") + F.sum("n").over(Window.partitionBy("key").orderBy(cell)) - F.col("n")
    sums = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    keep = [F.col(cell).alias(f"cut_{cell}"), F.col("before").alias(f"before_{cell}"), *([] if cuts is None else ["cut_bin"])]
    return small(written(sums.select("key", *keep), "mix-cuts"))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, repairs: int = REPAIRS) -> DataFrame:
    """Adds source_size, target, copies and taken to the written rows of sized_rows()."""
    sources = small(written(inclusion_rates(sized, source_targets(sized, weights, most)), "mix-rates"))
    p = F.col("rate") * F.col("size")
    odds = F.when(p >= 1, F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    rows = sized.join(sources, "key").withColumn("odds", F.when((F.col("size") > 0) & (F.col("rest") > 0), odds))
    rank = F.col("odds") / (1 + F.col("odds")) * BINS
    rows = rows.withColumns({"bin": F.floor(rank), "cell": F.floor((rank - F.floor(rank)) * BINS)})
    cuts = _at_cut(rows, "cell", _at_cut(rows, "bin", None))
    rows = rows.join(cuts, "key", "left")
    inside = Window.partitionBy("key").orderBy("odds", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.where((F.col("bin") == F.col("cut_bin")) & (F.col("cell") == F.col("cut_cell")))
    reached = F.col("before_cell") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    last = here.withColumn("in", reached <= F.col("rest")).where("in").select("tie", F.lit(1).alias("more"))
    below = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("cell") < F.col("cut_cell")))
    rows = rows.join(small(written(last, "mix-last")), "tie", "left")
    rows = rows.withColumn("extra", F.coalesce(below, F.lit(False)).cast("int") + F.coalesce("more", F.lit(0))).drop("more", "bin", "cell", "cut_bin", "cut_cell", "before_cell")
    if repairs:
        turns = small(written(_repairs(rows, repairs), "mix-repairs"))
        rows = rows.join(turns, "tie", "left").withColumn("extra", F.when(F.col("turn"), 1 - F.col("extra")).otherwise(F.col("extra"))).drop("turn")
    return rows.withColumn("copies", F.col("whole") + F.col("extra")).withColumn("taken", F.col("copies") * F.col("size"))


def _repairs(rows: DataFrame, repairs: int) -> DataFrame:
    """(tie, turn) of the documents to add or to leave out. Sizes are chosen from counts, then the first documents of those sizes."""
    ranked = rows.where(F.col("odds").isNotNull()).withColumn("open", (F.col("extra") == 0) | (F.col("odds") > 0))
    sizes = written(ranked.groupBy("key", "size", "extra", "open").agg(F.count("*").alias("n"), F.first("rest").alias("rest")), "mix-sizes-taken")
    gaps = sizes.groupBy("key").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size") * F.col("n"))).alias("gap"))
    left, found = sizes.where("open").drop("rest", "open"), []
    change = F.when(F.col("extra") == 0, F.col("size")).otherwise(-F.col("size"))
    for _ in range(repairs):
        nearer = left.where("n > 0").join(gaps, "key").withColumn("off", F.abs(F.col("gap") - change)).where(F.col("off") < F.abs("gap"))
        best = nearer.groupBy("key").agg(F.min(F.struct("off", "extra", "size")).alias("best")).select("key", "best.extra", "best.size", F.lit(1).alias("used"))
        found.append(best)
        left = left.join(best, ["key", "size", "extra"], "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0))).drop("used")
        gaps = gaps.join(best, "key", "left").select("key", (F.col("gap") - F.when(F.col("used") == 1, change).otherwise(F.lit(0))).alias("gap"))
    wanted = reduce(DataFrame.unionByName, found).groupBy("key", "size", "extra").agg(F.sum("used").alias("used"))
    same = ranked.where("open").join(small(written(wanted, "mix-sizes-wanted")), ["key", "size", "extra"])
    first = F.row_number().over(Window.partitionBy("key", "size", "extra").orderBy("odds", "doc_id", "tie"))
    return same.withColumn("nth", first).where(F.col("nth") <= repairs).where(F.col("nth") <= F.col("used")).select("tie", F.lit(True).alias("turn"))


def sized_rows(docs: DataFrame, *carried: Column, seed: str = SEED) -> DataFrame:
    """doc_id, key, size, u and tie, a number of its own for each row that holds once the rows are written."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = docs.select("doc_id", source_key(F.col("source")).alias("key"), size.alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), *carried)
    return written(row.withColumn("tie", F.monotonically_increasing_id()), "mix-sizes")


def mix_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies per document."""
    return mix(sized_rows(docs, seed=seed), **options).select("doc_id", "size", "source_size", "target", "taken", "copies")


def repeat_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with its columns as they were."""
    rows = mix(sized_rows(docs, F.struct(*docs.columns).alias("row"), seed=seed), **options).where("taken > 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_pareto_mix(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(repairs: int = REPAIRS) -> str:
    """The query in SQL: all of a source's documents in one order, the rate from the documents themselves."""
    steps = []
    for i in range(repairs):
        steps.append(rf"""
g{i} AS (SELECT k, any_value(rest) - sum(extra * size) AS gap FROM x{i} WHERE rest > 0 GROUP BY k),
f{i} AS (SELECT r, k, abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END) AS off, row_number() OVER (PARTITION BY k ORDER BY abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END), extra, size, odds, doc_id) AS nth
    FROM x{i} JOIN g{i} USING (k) WHERE odds IS NOT NULL AND (extra = 0 OR odds > 0) AND abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END) < abs(gap)),
x{i + 1} AS (SELECT x{i}.* REPLACE (CASE WHEN f{i}.nth = 1 THEN 1 - extra ELSE extra END AS extra) FROM x{i} LEFT JOIN f{i} ON x{i}.r = f{i}.r AND f{i}.nth = 1),""")
    return (
        r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) AS place FROM d GROUP BY k),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS ceiling FROM s),
m AS (SELECT *, ceiling / weight AS meets FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY meets, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY meets, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM m),
c AS (SELECT *, max(level) OVER () AS common FROM l),
t AS (SELECT k, source_size, least(ceiling, common * weight) AS target FROM c),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM d JOIN t USING (k)),
h AS (SELECT *, target - whole * source_size AS rest FROM e),
i AS (SELECT k, size, (rest - coalesce(sum(size) OVER (PARTITION BY k ORDER BY size DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(size::HUGEINT * size) OVER (PARTITION BY k ORDER BY size DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM h WHERE size > 0 AND rest > 0),
j AS (SELECT k, arg_max(rate, size) AS rate FROM i WHERE rate * size <= 1 GROUP BY k),
o AS (SELECT h.*, CASE WHEN size > 0 AND rest > 0 THEN CASE WHEN rate * size >= 1 THEN 0 ELSE (u / (1 - u)) / ((rate * size) / (1 - rate * size)) END END AS odds FROM h LEFT JOIN j USING (k)),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY k, odds IS NULL ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
x0 AS (SELECT *, CASE WHEN odds IS NOT NULL AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS extra FROM q),"""
        + "".join(steps)
        + f"""
z AS (SELECT *, whole + extra AS copies FROM x{repairs})
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM z"""
    )
