"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlode.llm import decontam, langid, minhash, packing, toxicity
from chartlode.llm.common import materialize

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows of a known language. A null text, or one without a letter, goes; so does every row where no language could be learned."""
    seen = langid.predict(docs, langid.train(docs), carry=True)
    return seen.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that are predicted toxic; the classifier is fit on those labelled among what is left. Each row has its own verdict, whatever its id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.train(docs, labels), carry=True).where("predicted = 0").select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: five words, a similarity of 0.8 or more; 30 bands miss a link of 0.8 with a probability of 1.5e-7.

    Rows are told apart by a number that is written with them, so repeated or null ids don't matter. A row without words is in no group and stays."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row_number"), F.struct("*").alias("row")), "numbered")
    texts = numbered.select("row_number", F.col("row.text").alias("text"))
    kept = minhash.near_duplicates(texts, "row_number", percent=80, bands=30).where("kept").select(F.col("doc_id").alias("row_number"))
    return numbered.join(kept, "row_number", "left_semi").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows in which no benchmark window occurs. A row without words has none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, benchmark, carry=True).where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; see packing.pack() for nulls, empty texts and repeated rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("toxicity", toxic), ("dedup", dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
