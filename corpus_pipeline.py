"""The corpus pipeline: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.

1. quality: documents that the divergence rules reject go.
2. near_duplicates: of the documents that links of similar shingle sets connect, the one with the smallest doc_id stays;
   documents without a word are linked with nothing and stay.
3. repeated_passages: bytes of 100-byte strings that start earlier go from the texts, by whole characters, and n_chars is
   set anew; a document of which nothing is left goes.
4. packing: what remains, packed into sequences of 1024 tokens; one row per piece.

Null text: kept by no stage but as the quality rules say (no word: rejected). Of rows with one key and one text, stage 2 keeps one;
different texts under one key are documents of their own, as are texts without a key. Empty tables give empty tables. Extra columns are
kept up to stage 3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from releaselode.llm import jaccard, packing, quality, suffix
from releaselode.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # documents go by key and text, so that unrelated texts under one key are judged each by itself
    rows = suffix.keyed(docs)
    found = jaccard.near_duplicates(rows.select(F.col("_number").alias("doc_id"), "text"))
    gone = stored(found.where("doc_id != component_id").select(F.col("doc_id").alias("_number")).distinct(), "near-copies")
    kept = rows.join(jaccard.small(gone), "_number", "left_anti")
    # of rows that repeat key and text one stays, by the rest of its columns
    again = stored(kept.groupBy("_number").agg(F.count("*").alias("c")).where("c > 1").select("_number"), "repeated-rows")
    if not again.isEmpty():
        some = kept.join(jaccard.small(again), "_number", "left_semi")
        one = some.groupBy("_number").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
        return kept.join(jaccard.small(again), "_number", "left_anti").select(*docs.columns).union(one)
    return kept.select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix.cut_texts(docs).where(F.length("text") > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]

#: Near duplicates and repeated passages are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
