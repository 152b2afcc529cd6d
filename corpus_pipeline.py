"""A corpus from raw documents to packed training sequences.

Five stages; each gets all that the one before kept, written as Parquet and read
again. All but the last return the columns of ``documents``, of whatever names. Null
and empty texts: the first stage lets them go (no language can be told), the others take them as texts without
words, matches or spans. Null and repeated doc_ids: every row is judged by its own text; rows equal in
doc_id and text count as one in the second stage. An empty table stays empty. Texts are read whole, of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesia.llm import decontamination, langid, near_copies, packing, pii
from cohesia.session import Scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letters, or too far from every centroid) go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: covering SimHash tables and their exact completion at Jaccard 0.8 of 5-word shingles."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]

#: Fitted centroids, boosted trees, tokenisation and packing have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
