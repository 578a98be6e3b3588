"""BM25 queries: documents ranked for benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("offset"), "text", "lang")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def _run(stopwords: bool = False, stemming: bool = False, lang: str | None = None, repeat: bool = False, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, queries = corpus(spark, sf_dir), passages(spark, sf_dir)
        if repeat:
            queries = queries.withColumn("text", F.concat_ws(" ", "text", "text"))
        allowed = docs.where(F.col("lang") == lang) if lang else None
        out = bm25.search(bm25.index(docs, stopwords, stemming), queries, 10, allowed, stopwords=stopwords, stemming=stemming, **options)
        return out.select("qid", "rank", "offset", F.round("score", 6).alias("score"))

    return run


def text_stats(spark, sf_dir):
    return bm25.statistics(bm25.index(corpus(spark, sf_dir))).select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


def document_frequencies(spark, sf_dir):
    return bm25.index(corpus(spark, sf_dir)).terms


def term_frequencies(spark, sf_dir):
    return bm25.index(corpus(spark, sf_dir)).postings.select("term", "offset", F.col("tf"), F.col("len").cast("long").alias("len"))


def vocabulary_stems(spark, sf_dir):
    """The distinct words of the corpus with their stems."""
    words = corpus(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.withColumn("stem", T.stemmed(F.array("word"))[0])


def folded_queries(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", T.folded(F.col("text")).alias("text"))


_W = r"[\p{L}\p{N}]+"


def _cte(stop: bool = False) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
    keep = f"WHERE term NOT IN ({listed})" if stop else ""
    return rf"""
WITH w AS (SELECT doc_id AS "offset", unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM documents),
k AS (SELECT * FROM w {keep}),
d AS (SELECT "offset", count(*) AS len FROM k GROUP BY ALL),
t AS (SELECT count(*) AS n_docs, sum(len)::BIGINT AS n_tokens FROM d),
p AS (SELECT term, "offset", count(*) AS tf FROM k GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def _sql(stop: bool = False, lang: str | None = None, k1: float = 1.2, b: float = 0.75) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
    keep = f"AND term NOT IN ({listed})" if stop else ""
    only = f"""WHERE "offset" IN (SELECT doc_id FROM documents WHERE lang = '{lang}')""" if lang else ""
    return _cte(stop) + rf""",
q AS (SELECT DISTINCT item_id AS qid, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM benchmark) WHERE true {keep}),
s AS (SELECT qid, p."offset", sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 0) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * len / (n_tokens / n_docs)))) AS score
    FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING ("offset"), t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, "offset") AS rank FROM s {only})
SELECT qid, rank::INTEGER AS rank, "offset", round(score, 6) AS score FROM r WHERE rank <= 10"""


QUERIES = {
    "bm25_topk": _run(),
    "bm25_repeated_terms": _run(repeat=True),
    "bm25_stopwords": _run(stopwords=True),
    "bm25_filtered_lang": _run(lang="fr"),
    "bm25_b_zero": _run(b=0.0),
    "bm25_k_zero": _run(k1=0.0),
    "bm25_porter2": _run(stopwords=True, stemming=True),
    "text_stats": text_stats,
    "document_frequencies": document_frequencies,
    "term_frequencies": term_frequencies,
    "vocabulary_stems": vocabulary_stems,
    "folded_queries": folded_queries,
}
ORACLES = {
    "bm25_topk": _sql(),
    "bm25_repeated_terms": _sql(),
    "bm25_stopwords": _sql(stop=True),
    "bm25_filtered_lang": _sql(lang="fr"),
    "bm25_b_zero": _sql(b=0.0),
    "bm25_k_zero": _sql(k1=0.0),
    "text_stats": _cte() + " SELECT n_docs, n_tokens, round(n_tokens / n_docs, 6) AS avgdl FROM t",
    "document_frequencies": _cte() + " SELECT term, df FROM f",
    "term_frequencies": _cte() + """ SELECT term, "offset", tf, len FROM p JOIN d USING ("offset")""",
    "folded_queries": r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark",
}
