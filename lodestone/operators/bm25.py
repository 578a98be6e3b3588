"""BM25 over a table of postings.

A document without tokens is no document: it counts neither in N nor in the mean
length. Query terms count once each. A filter narrows the answers and leaves the
statistics as they are; ties go to the smaller offset.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgument
from lodestone.functions import text as T
from lodestone.operators.topk import BROADCAST_QUERIES, KEPT, Best, rank_within


#: Queries with up to this many distinct terms in all are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Offsets that pass a filter, up to this many, are broadcast.
BROADCAST_OFFSETS = 1_000_000
#: Scores of documents against queries, and postings of a query's term, that a task holds at once.
SCORES = 2_000_000


@dataclass(frozen=True)
class Index:
    tokens: DataFrame  # offset, len, term: a row per token
    totals: DataFrame  # one row: n_docs, n_tokens
    docs: DataFrame | None = None  # offset, tokens: a row per document
    ids: DataFrame | None = None  # offset of every document, with tokens or without

    @cached_property
    def by_document(self) -> bool:
        """Whether a row is a document; equal or null offsets are one, whose postings have to be added up."""
        return self.docs is not None and not self.ids.groupBy("offset").count().where("count > 1 OR offset IS NULL").limit(1).count()

    @property
    def postings(self) -> DataFrame:
        """term, offset, tf, len."""
        return self.tokens.groupBy("term", "offset").agg(F.count("*").alias("tf"), F.first("len").alias("len"))

    @property
    def terms(self) -> DataFrame:
        """term, df."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))


def index(docs: DataFrame, stopwords: bool = False, stemming: bool = False) -> Index:
    """docs is (offset, text) or (offset, values array<string>), whose tokens follow one another."""
    if "values" in docs.columns:
        tokens = F.flatten(F.transform("values", lambda t: T.words(t)))
        tokens = T.without_stopwords(tokens) if stopwords else tokens
        tokens = T.stemmed(tokens) if stemming else tokens
    else:
        tokens = T.analysed(F.col("text"), stopwords, stemming)
    rows = docs.select("offset", tokens.alias("tokens")).where(F.size("tokens") > 0)
    totals = rows.agg(F.count("*").alias("n_docs"), F.sum(F.size("tokens")).alias("n_tokens"))
    return Index(_exploded(rows), totals, rows, docs.select("offset"))


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("offset", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))


def statistics(ix: Index) -> DataFrame:
    return ix.totals.select("n_docs", "n_tokens", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))


def _terms(queries: DataFrame, stopwords: bool, stemming: bool) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(T.analysed(F.col("text"), stopwords, stemming))).alias("term"))


def _checked(k1: float, b: float) -> None:
    if k1 < 0 or not 0 <= b <= 1:
        raise InvalidArgument("k is at least 0, and b between 0 and 1")


def scores(ix: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75, stopwords: bool = False, stemming: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(qid, offset, score) of every document that holds a term of a query (qid, text); of those in `only` (offset), if it is given."""
    _checked(k1, b)
    terms = _terms(queries, stopwords, stemming)
    stats = ix.totals.select("n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(0.0))
    norm = F.lit(k1) * (1 - b + b * F.col("len") / F.col("avgdl")) if b > 0 else F.lit(float(k1))
    # Only the queries' terms leave the scan: they are met before anything is counted or shuffled.
    asked = terms.select("term").distinct()
    few = F.broadcast if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else lambda df: df
    here = Index(ix.tokens.join(few(asked), "term", "left_semi"), ix.totals)
    there = here
    if only is not None:
        tokens = _exploded(_narrowed(ix.docs, only)) if ix.docs is not None else _narrowed(ix.tokens, only)
        there = Index(tokens.join(few(asked), "term", "left_semi"), ix.totals)
    rows = there.postings.join(few(here.terms), "term").join(terms, "term").crossJoin(F.broadcast(stats))
    return rows.groupBy("qid", "offset").agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def _narrowed(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    allowed = allowed.select("offset").distinct()
    few = allowed.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS
    return rows.join(F.broadcast(allowed) if few else allowed, "offset", "left_semi")


def search(ix: Index, queries: DataFrame, limit: int = 10, allowed: DataFrame | None = None, **options) -> DataFrame:
    """qid, rank, offset, score. allowed holds the offsets that pass a filter."""
    # Sums over terms differ in their last bits with the order of addition; the order of results does not.
    order = [F.round("score", 9).desc(), F.col("offset").asc()]
    found = _best(ix, queries, limit, allowed, **options)
    if found is None:
        found = scores(ix, queries, **options)
        if allowed is not None:
            found = found.join(allowed.select("offset"), "offset", "left_semi")
    return rank_within(found, "qid", order, limit).select("qid", "rank", "offset", "score")


def _postings(batch: pa.RecordBatch, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of the asked terms in a batch of documents, by row and term."""
    tokens = batch.column("tokens")
    term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    key, tf = np.unique((row * len(asked) + term)[term >= 0], return_counts=True)
    return key // len(asked), key % len(asked), tf


def _frequencies(ix: Index, asked: pa.Array) -> np.ndarray:
    """In how many documents each asked term stands: one scan, a row per task and term."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            df += np.bincount(_postings(batch, asked)[1], minlength=len(asked))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["term", "df"])

    rows = ix.docs.select("tokens").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(asked), np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine places as Spark rounds, halves up in decimals."""
    out = np.round(x, 9)
    for i in np.flatnonzero(np.abs(np.abs(x * 1e9 - np.floor(x * 1e9)) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _best(ix: Index, queries: DataFrame, limit: int, allowed: DataFrame | None, k1: float = 1.2, b: float = 0.75, stopwords: bool = False, stemming: bool = False) -> DataFrame | None:
    """(qid, offset, score) among which are the best documents of each query; None where queries or documents call for the general way.

    The queries' terms travel with two scans: the first counts documents, the second adds up a batch of documents
    against all queries, and a task keeps the best so far.
    """
    _checked(k1, b)
    table = _terms(queries, stopwords, stemming).limit(BROADCAST_TERMS * 10 + 1).toArrow()
    if table.num_rows > BROADCAST_TERMS * 10 or not table.num_rows or table.column("qid").null_count or not ix.by_document:
        return None
    asked = pc.unique(table.column("term"))
    asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
    qids, at = np.unique(table.column("qid").to_numpy(), return_inverse=True)
    if len(asked) > BROADCAST_TERMS or len(qids) > min(BROADCAST_QUERIES, KEPT // limit):
        return None
    term = pc.index_in(table.column("term"), value_set=asked).to_numpy()
    pairs = np.unique(term * len(qids) + at)  # a repeated qid asks once for a term that it repeats
    if len(pairs) != len(term):
        return None
    of_term, starts = pairs % len(qids), np.searchsorted(pairs // len(qids), np.arange(len(asked) + 1))
    n_docs, n_tokens = ix.totals.first()
    df = _frequencies(ix, asked)
    idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5) + 1), 0.0)
    avgdl = (n_tokens or 0) / max(n_docs, 1)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, n = Best(len(qids), limit), len(qids)
        for whole in batches:
            for first in range(0, whole.num_rows, max(1, SCORES // n)):
                batch = whole.slice(first, max(1, SCORES // n))
                row, t, tf = _postings(batch, asked)
                length = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
                norm = k1 * (1 - b + b * length[row] / avgdl) if b > 0 else k1
                weight, times = idf[t] * tf * (k1 + 1) / (tf + norm), starts[t + 1] - starts[t]
                sums, held = np.zeros(batch.num_rows * n), np.zeros(batch.num_rows * n, bool)
                cuts = np.searchsorted(np.cumsum(times), np.arange(SCORES, times.sum(), SCORES), "right")
                for low, high in itertools.pairwise([0, *cuts, len(t)]):
                    r, m = times[low:high], int(times[low:high].sum())
                    place = np.arange(m) - np.repeat(np.cumsum(r) - r, r) + np.repeat(starts[t[low:high]], r)
                    pair = np.repeat(row[low:high], r) * n + of_term[place]
                    sums += np.bincount(pair, np.repeat(weight[low:high], r), len(sums))
                    held[pair] = True
                found = np.flatnonzero(held & (sums >= np.tile(best.floor, batch.num_rows) - 2e-9))
                offsets = batch.column("offset").to_numpy()
                best.add(found % n, _rounded(sums[found]), offsets[found // n], sums[found])
                best.settle()
        i, _, offset, value = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(qids[i], pa.int64()), pa.array(offset, pa.int64()), pa.array(value)], ["qid", "offset", "score"])

    docs = ix.docs if allowed is None else _narrowed(ix.docs, allowed)
    return docs.select("offset", "tokens").mapInArrow(score, "qid long, offset long, score double")
