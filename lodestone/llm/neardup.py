"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles of `words` words. Under each of
PERMUTATIONS hash permutations both the smallest and the largest value of the
set are kept: either agrees for two sets with the probability of their
similarity, so half the hash evaluations give a signature of the same length
with less variance. Signatures are cut into BANDS bands of ROWS values; sets that
agree in a band are candidates. At a similarity of 0.8 a pair is missed with a
probability of about 1e-7.

Equal sets are one class from the start. Classes that share a band form clusters
(connected components of class to the smallest class of its band, so no bucket
is expanded into pairs). Each cluster's full sets then meet in one task, which
confirms links exactly: a shingle index with prefix filtering finds every class
that can reach the threshold, and pairs that are in one component already are
not compared again. Clusters above BLOCK shingles are dealt in blocks, and every
pair of blocks is a task, so memory stays bounded and no link is lost. Components
of the confirmed links give the groups.

Texts are read whole, A-Z in lower case. With fewer words than a shingle has, the
whole sequence is one shingle; without words, or without text, a document's set
is empty and it is linked with nothing. Shingles are compared by 64-bit
fingerprints, sets by 128-bit ones. Null doc_ids are never a component's id
unless it has no other; in near_duplicates() rows that repeat a doc_id share its
decision. distinct_documents() decides by row instead: of each group one row
stays, and rows are told apart by all their columns, so neither null nor repeated
doc_ids make one document of several. Empty tables give empty ones; other
columns take no part, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import remove, small_batches, written, written_at
from lodestone.llm.components import components

WORDS, THRESHOLD = 5, 80
PERMUTATIONS, BANDS, ROWS = 100, 40, 5
BLOCK = 1_500_000  # shingles
SLICE = 1 << 20  # bytes hashed at once
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20240229)
_odd = lambda n: _random.integers(0, 2**64, n, np.uint64) | np.uint64(1)
_BYTE, _A, _B, _C = _odd(256), _odd(PERMUTATIONS), _odd(PERMUTATIONS), _odd(64)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_BLANK[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    # Each byte's place in its word; what stands before the first word counts as none.
    within = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    sizes = ends - starts
    power = _powers(int(sizes.max()) + 1)
    value = np.where(solid, _BYTE[raw] * power[np.minimum(within, len(power) - 1)], np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return starts, _mix((sums[ends] - sums[starts]) + sizes.astype(np.uint64) * _BASE)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of one text, in slices that end at blanks."""
    text, at, out = text.lower(), 0, []
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        out.append(_hash_words(text[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set_of(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h)
    if n == 0:
        return h
    if n < words:
        return _mix((h * _C[32 : 32 + n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    s = h[: n - words + 1] * _C[0]
    for k in range(1, words):
        s = s + h[k : n - words + 1 + k] * _C[k]
    return np.unique(_mix(s))


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group, size = [], 0
    for i, t in enumerate([*texts, None]):
        last = i == len(texts)
        if not last and t and len(t) >= SLICE:
            out[i] = _set_of(word_hashes(t), words)
            continue
        if not last and t:
            group.append(i)
            size += len(t)
        if group and (last or size >= SLICE):
            starts, h = _hash_words(b" ".join(texts[j] for j in group).lower())
            bounds = np.cumsum([0, *(len(texts[j]) + 1 for j in group)])
            cuts = np.searchsorted(starts, bounds)
            for j, a, b in zip(group, cuts, cuts[1:], strict=False):
                out[j] = _set_of(h[a:b], words)
            group, size = [], 0
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of the smallest value under each permutation, then the largest ones. No set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        h = flat * _A[k] + _B[k]
        out[:, k] = np.minimum.reduceat(h, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band. The bands of maxima are grouped one step off those of minima."""
    low, high = signature[:, :PERMUTATIONS], np.roll(signature[:, PERMUTATIONS:], 2, axis=1)
    parts = np.concatenate([low, high], axis=1).reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE
    for k in range(ROWS):
        key = _mix(key ^ parts[:, :, k]) * _C[k]
    return key.view(np.int64)


def set_ids(sets: list[np.ndarray]) -> list[bytes]:
    out = []
    for s in sets:
        a = (int(s.sum(dtype=np.uint64)) + len(s) * int(_BASE)) % 2**64
        b = int(_mix(s * _C[9]).sum(dtype=np.uint64))
        out.append(a.to_bytes(8, "big") + b.to_bytes(8, "big"))
    return out


def _row_keys(columns: list[str]) -> dict:
    """A 128-bit key of a row: two hashes of its values, of which nulls are told apart."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return {"__k1": F.xxhash64(F.lit(1), *values), "__k2": F.xxhash64(F.lit(2), *values)}


def _describe(words: int, batches):
    for batch in batches:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        sizes = [len(s) for s in sets]
        full = [i for i, n in enumerate(sizes) if n]
        keys: list = [None] * len(sets)
        if full:
            for i, k in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                keys[i] = k
        own = ["doc_id", "__k1", "__k2"]
        arrays = [*(batch.column(c) for c in own), pa.array(set_ids(sets), pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, [*own, "cid", "n", "bands"])


def _emit_sets(words: int, batches):
    for batch in batches:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cid", "shingles"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def link_sets(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that span every component of: 100 * intersection >= threshold * union."""
    m = len(sets)
    if m < 2:
        return []
    if m == 2:
        a, b = sets
        if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
            return []
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if 100 * both >= threshold * (len(a) + len(b) - both) else []
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(flat)
    posted = np.repeat(np.arange(m), sizes)[np.argsort(flat, kind="stable")]
    first = np.cumsum(df) - df
    comp, mark, links = np.arange(m), np.zeros(len(df), bool), []

    def probe(x: int) -> None:
        own, n = flat[begins[x] : ends[x]], int(sizes[x])
        # A partner shares ceil(threshold / 100 * n) of x's shingles, so one of the rarest that are left over by that.
        t = n - -(-threshold * n // 100) + 1
        rare = own[np.argpartition(df[own], t - 1)[:t]] if t < n else own
        rare = rare[df[rare] > 1]
        near = np.unique(posted[_ranges(first[rare], df[rare])])
        near = near[(comp[near] != comp[x]) & (100 * np.minimum(sizes[near], n) >= threshold * np.maximum(sizes[near], n))]
        mark[own] = True
        while len(near):
            part, near = near[:4096], near[4096:]
            both = np.add.reduceat(mark[flat[_ranges(begins[part], sizes[part])]].astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            hit = part[100 * both >= threshold * (sizes[part] + n - both)]
            labels, at = np.unique(comp[hit], return_index=True)
            links.extend((x, int(y)) for y, label in zip(hit[at], labels, strict=True) if label != comp[x])
            comp[np.isin(comp, labels)] = comp[x]
        mark[own] = False

    hub = int(np.argmax(np.add.reduceat(df[flat], begins) / sizes))
    probe(hub)
    # Pairs among the hub's links are in one component already; every other pair is seen from one of its ends.
    for x in np.flatnonzero(comp != comp[hub]):
        probe(int(x))
    return links


def _confirm(threshold: int, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
    if not table.num_rows:
        return schema.empty_table()
    cluster = np.array(table.column("cluster").to_pylist(), object)
    cid = table.column("cid").to_pylist()
    lists = table.column("shingles").combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    by: dict[bytes, list[int]] = {}
    for i, c in enumerate(cluster):
        by.setdefault(c, []).append(i)
    u, v = [], []
    for rows in by.values():
        for a, b in link_sets([values[offsets[i] : offsets[i + 1]] for i in rows], threshold):
            u.append(cid[rows[a]])
            v.append(cid[rows[b]])
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())}, schema)


def confirmed_links(source: DataFrame, rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """(u, v) links between classes, confirmed on full sets, that span every component."""
    keyed = rows.where("n > 0").select(F.explode("bands").alias("key"), "cid")
    # Written, so that the join below has an exchange on both sides and a key of very many rows can be split.
    shared = written(keyed.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub <> last").drop("last"), "near-hubs")
    edges = keyed.join(shared, "key").where("cid <> hub").select(F.col("cid").alias("u"), F.col("hub").alias("v")).distinct()
    roots = components(edges)
    clusters = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    picked = rows.where("n > 0").groupBy("cid").agg(F.min(F.struct("__k1", "__k2")).alias("rep"), F.first("n").alias("n"))
    picked = written(picked.join(clusters, F.col("cid") == F.col("node")).select("cid", "rep", F.col("root").alias("cluster"), "n"), "near-classes")
    weights = picked.groupBy("cluster").agg(F.sum("n").alias("n")).select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    total = picked.agg(F.sum("n")).first()[0] or 0
    deals = max(1, -(-2 * total // BLOCK))
    # Small clusters share a task by hash; a large one is every pair of its blocks.
    placed = picked.join(weights, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(deals)).cast("string"))).otherwise(
        F.concat_ws("-", F.hex("cluster"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    )
    placed = placed.select("cid", "cluster", task.alias("task"))
    reps = picked.select("rep.__k1", "rep.__k2")
    reps = F.broadcast(reps) if picked.count() <= BROADCAST_IDS else reps
    texts = source.join(reps, ["__k1", "__k2"], "left_semi").select("__k1", "__k2", "text")
    # Rows that repeat a whole row have one key; one of their sets is enough.
    sets = texts.select("text").mapInArrow(partial(_emit_sets, words), "cid binary, shingles array<long>").join(placed, "cid")
    return sets.groupBy("task").applyInArrow(lambda table: _confirm(threshold, table), "u binary, v binary")


def _classes(docs: DataFrame, columns: list[str], words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __k1, __k2, cid, n, bands) per row, and (node, root) of the classes that are linked to a smaller one."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.withColumns(_row_keys(columns)).select("doc_id", "__k1", "__k2", F.col("text").cast("binary").alias("text"))
    rows = written(source.mapInArrow(partial(_describe, words), f"doc_id {kind}, __k1 long, __k2 long, cid binary, n long, bands array<long>"), "near-rows")
    links, path = written_at(confirmed_links(source, rows, words, threshold), "near-links")
    roots = components(links)
    remove(path)
    return rows, roots


def _lowest(rows: DataFrame, roots: DataFrame, value: Column) -> DataFrame:
    """(cid, lowest) of each class that is not empty: the smallest value in its group."""
    classes = rows.where("n > 0").groupBy("cid").agg(F.min(value).alias("low"))
    classes = written(classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "low", F.coalesce("root", "cid").alias("root")), "near-roots")
    lows = written(classes.groupBy("root").agg(F.min("low").alias("of_group"), F.count("*").alias("n")).where("n > 1").drop("n"), "near-lows")
    return classes.join(lows, "root", "left").select("cid", F.when(F.col("of_group").isNull(), F.col("low")).otherwise(F.col("of_group")).alias("lowest"))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group) and kept, per document."""
    rows, roots = _classes(docs, ["doc_id", "text"], words, threshold)
    classes = _lowest(rows, roots, F.col("doc_id"))
    slim = rows.select("doc_id", "cid", F.col("n").alias("n_shingles"))
    out = slim.where("n_shingles > 0").join(classes, "cid").select("doc_id", "n_shingles", F.col("lowest").alias("component_id"))
    out = out.unionByName(slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group, the one of the smallest doc_id, and all rows without words, with the columns of docs.

    Where rows of a group share that doc_id, or have none, their keys decide; of rows that are equal in all columns one stays.
    """
    rows, roots = _classes(docs, docs.columns, words, threshold)
    key = ["__k1", "__k2"]
    classes = _lowest(rows, roots, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key))
    met = rows.where("n > 0").select("cid", *key).join(classes, "cid")
    stays = (F.col("__k1") == F.col("lowest.__k1")) & (F.col("__k2") == F.col("lowest.__k2"))
    decided = written(met.groupBy(*key).agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"), "near-decisions")
    beside = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    keyed = docs.withColumns(_row_keys(docs.columns))
    out = keyed.join(beside(decided.select(*key)), key, "left_anti").select(*docs.columns)
    again = decided.where("stays").select(*key)
    if again.isEmpty():
        return out
    first = keyed.join(beside(again), key, "left_semi").groupBy(*key).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op3_minmax_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 4 THEN list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.root AS component_id, w.doc_id = m.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)"""
