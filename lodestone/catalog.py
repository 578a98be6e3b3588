"""Collections by name: a configuration and a table of points that every write replaces by a new one.

Points are (point_id, offset, vector, payload, deleted). Tables are lazy; call
checkpointed() on a collection after many writes to cut their lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import AlreadyExists, InvalidArgument, NotFound, Unsupported
from lodestone.operators import bm25, datatypes, filters, metrics, topk, writes

FIELD_KINDS = ("keyword", "integer", "float", "bool", "datetime", "text")
QUANTIZATION = (None, "scalar", "binary", "product", "turbo")
REFUSED_QUERIES = ("recommend", "discover", "context", "order_by", "fusion", "sample", "formula", "mmr", "rrf", "feedback", "prefetch")


@dataclass(frozen=True)
class Config:
    dim: int
    metric: str = "dot"
    datatype: str = "float32"
    quantization: str | None = None
    quantile: float = 1.0
    m: int = 16
    ef_construct: int = 100
    full_scan_kb: int = 10_000

    def __post_init__(self) -> None:
        if self.metric not in metrics.METRICS:
            raise InvalidArgument(f"unknown metric {self.metric!r}")
        if self.datatype not in datatypes.DATATYPES:
            raise InvalidArgument(f"unknown datatype {self.datatype!r}")
        if not 1 <= self.dim <= 65_536 or (self.datatype != "float32" and self.dim > 16_384):
            raise InvalidArgument(f"{self.dim} dimensions")
        if self.quantization not in QUANTIZATION:
            raise InvalidArgument(f"unknown quantization {self.quantization!r}")
        if self.quantization == "turbo" and self.metric == "manhattan":
            raise Unsupported("rotation codes with the manhattan metric")
        if not 0.5 <= self.quantile <= 1:
            raise InvalidArgument("the quantile lies between 0.5 and 1")
        if not 4 <= self.m <= 512 or not 1 <= self.ef_construct <= 65_536:
            raise InvalidArgument("m is 4 to 512, ef_construct 1 to 65536")


@dataclass(frozen=True)
class Collection:
    config: Config
    points: DataFrame
    indexes: dict = field(default_factory=dict)
    seq: int = 0  # above every offset


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self._by_name = spark, {}

    def create(self, name: str, config: Config) -> None:
        if name in self._by_name:
            raise AlreadyExists(name)
        empty = self.spark.createDataFrame([], "point_id long, offset long, vector array<float>, payload variant, deleted boolean")
        self._by_name[name] = Collection(config, empty)

    def exists(self, name: str) -> bool:
        return name in self._by_name

    def drop(self, name: str) -> bool:
        """False if there was none."""
        return self._by_name.pop(name, None) is not None

    def get(self, name: str) -> Collection:
        if name not in self._by_name:
            raise NotFound(name)
        return self._by_name[name]

    def info(self, name: str) -> DataFrame:
        return writes.info(self.get(name).points)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """rows are (nth, point_id, vector, payload), nth from 0 in their order of arrival; payload may be null."""
        c = self.get(name)
        bad = rows.where(~datatypes.finite(F.col("vector")) | (F.size("vector") != c.config.dim)).limit(1)
        if bad.count():
            raise InvalidArgument(f"vectors have {c.config.dim} finite components")
        vector = datatypes.stored(F.col("vector"), c.config.datatype, c.config.metric).cast("array<float>")
        new = rows.select((F.col("nth") + c.seq).alias("seq"), "point_id", vector.alias("vector"), "payload")
        top = rows.agg(F.max("nth")).first()[0]
        self._by_name[name] = replace(c, points=writes.upsert(c.points, new), seq=c.seq + (0 if top is None else top + 1))

    def delete(self, name: str, ids: DataFrame) -> None:
        c = self.get(name)
        self._by_name[name] = replace(c, points=writes.delete(c.points, ids))

    def checkpointed(self, name: str) -> None:
        c = self.get(name)
        self._by_name[name] = replace(c, points=c.points.checkpoint())

    def create_index(self, name: str, path: str, kind: str, **options) -> None:
        """Field indexes never change results; a text index gives BM25 its analysis."""
        c = self.get(name)
        if kind not in FIELD_KINDS:
            raise InvalidArgument(f"unknown field kind {kind!r}")
        if set(options) - {"stopwords", "stemming"}:
            raise Unsupported(f"text index option {sorted(set(options) - {'stopwords', 'stemming'})[0]}")
        if c.indexes.get(path, (kind, options)) != (kind, options):
            raise InvalidArgument(f"field {path!r} has another index")
        self._by_name[name] = replace(c, indexes=c.indexes | {path: (kind, options)})

    def _live(self, c: Collection, where: filters.Filter | None) -> DataFrame:
        rows = writes.live(c.points)
        return rows if where is None else rows.where(F.coalesce(where.column(F.col("payload")), F.lit(False)))

    def query(self, name: str, queries: DataFrame, limit: int = 10, offset: int = 0, where: filters.Filter | None = None, threshold: float | None = None, with_payload: bool = False, with_vectors: bool = False, **other) -> DataFrame:
        """Nearest points of queries (qid, q): qid, rank, point_id, score, version and, if asked for, payload."""
        for kind in other:
            raise Unsupported(f"query {kind}" if kind in REFUSED_QUERIES else f"option {kind}")
        if with_vectors:
            raise Unsupported("with_vectors")
        c = self.get(name)
        bad = queries.where(~datatypes.finite(F.col("q")) | (F.size("q") != c.config.dim)).limit(1)
        if bad.count():
            raise InvalidArgument(f"queries have {c.config.dim} finite components")
        rows = self._live(c, where)
        if c.config.datatype != "float32":
            queries = queries.withColumn("q", datatypes.stored(F.col("q"), c.config.datatype, c.config.metric))
        found = topk.knn(rows, queries, c.config.metric, limit, offset, threshold=threshold)
        # Payloads join late, to the ranked rows alone.
        found = found.join(rows.select("offset", "point_id", "payload"), "offset")
        out = found.select("qid", "rank", "point_id", "score", F.lit(0).alias("version"), "payload")
        return out if with_payload else out.drop("payload")

    def query_text(self, name: str, path: str, queries: DataFrame, limit: int = 10, where: filters.Filter | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """BM25 over a text-indexed field: qid, rank, point_id, score. A filter leaves the statistics as they are."""
        c = self.get(name)
        kind, options = c.indexes.get(path, (None, {}))
        if kind != "text":
            raise InvalidArgument(f"field {path!r} has no text index")
        from lodestone.functions import paths

        strings = F.transform(F.filter(paths.leaves(paths.resolve(F.col("payload"), path)), lambda v: paths.kind(v) == "string"), lambda v: F.try_variant_get(v, "$", "string"))
        live = writes.live(c.points)
        ix = bm25.index(live.select("offset", strings.alias("values")), **options)
        allowed = self._live(c, where) if where is not None else None
        found = bm25.search(ix, queries, limit, allowed, k1=k1, b=b, **options)
        return found.join(live.select("offset", "point_id"), "offset").select("qid", "rank", "point_id", "score")

    def scroll(self, name: str, limit: int = 10, cursor=None, where: filters.Filter | None = None, with_payload: bool = True) -> DataFrame:
        c = self.get(name)
        page = writes.scroll(self._live(c, where).select("point_id", "payload"), limit, cursor)
        return page if with_payload else page.drop("payload")
