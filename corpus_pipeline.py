"""From documents to packed training sequences: five stages, each written and read again before the next.

1 quality classifier: documents that it rejects go.
2 near-duplicates: one document of each group stays.
3 repeated passages: every byte that a repeated string of PASSAGE bytes or of WORDS words covers is cut out of the texts;
  characters stay whole. Words stand between ASCII white space; the operator's own query looks for longer passages.
4 mixing: every document stands as often as the mix takes it.
5 packing: the pieces of all documents with their sequences.

All but the last stage return the columns of documents, and those alone. A stage works on all
rows that its predecessor kept. n_chars follows the text where it is cut. A
document of which nothing stays keeps its row, with an empty text, until mixing
takes no words of it.

Rows are told apart by all their columns, so null and repeated doc_ids are documents
of their own. Null and empty texts pass the stages as they are and have no words.
Empty tables pass all of them.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import dedup_spans, mixing, neardup, packing, quality
from lodestone.llm.common import shared_path, small_batches
from lodestone.llm.dedup_spans import kept_text

# Executors need no copy of this module: its functions travel with the tasks.
register_pickle_by_value(sys.modules[__name__])

#: Bytes, and words: a passage of more than 50 words is repeated however short they are.
PASSAGE, WORDS = 250, 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = dedup_spans.with_spans(docs.select(*COLUMNS, F.col("text").isNull().alias("__none")), PASSAGE, WORDS)
    cut = F.pandas_udf(_cut, "string")
    text = F.when(F.col("__none"), F.lit(None)).when(F.col("spans").isNull(), F.col("text").cast("string")).otherwise(cut("text", "spans"))
    rows = rows.withColumn("__text", text)
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))
    return rows.withColumn("n_chars", n_chars).withColumn("text", F.col("__text")).select(*COLUMNS)


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([kept_text(t, None if s is None else [int(x) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The classifier and the tokenizer have no SQL twin; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
