"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, jaccard, langid, linededup, packing
from folioflow.llm.common import documents, materialize
from folioflow.shipping import ship

#: A prediction with a smaller share of the probability is a rejection, where a text has words
#: enough to judge. Short texts of words that languages share stay.
LEAST_SCORE, LEAST_WORDS = 0.5, 20


def _renamed(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with other names for columns that an operator would replace, and all columns under their own."""
    own = {c: f"__kept{i}" for i, c in enumerate(docs.columns) if c in taken}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those of at least LEAST_WORDS words
    whose best language has under LEAST_SCORE of the probability. Repeated rows and ids all stay."""
    ship(spark)
    docs, columns = _renamed(docs, ("lang_pred", "score"))
    found = langid.identify(docs, langid.learn(docs))
    short = F.size(F.split(F.trim("text"), r"\s+", LEAST_WORDS)) < LEAST_WORDS
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (short | (F.col("score") >= LEAST_SCORE))).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines from the texts; n_chars follows the text. Every row stays, also with a null
    or repeated doc_id; a null text becomes empty."""
    ship(spark)
    docs, columns = _renamed(docs, ("n_lines", "n_dropped"))
    found = linededup.dedup_lines(docs).select(*columns)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in found.columns else found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (Jaccard similarity of five-word shingles 0.8
    or more, linked in chains): the one with the smallest doc_id, nulls last. Each row is judged by
    itself, also where ids are null or repeat; rows with equal doc_id and text become one."""
    ship(spark)
    return jaccard.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Each row is judged by itself, also where ids are
    null or repeat; a null or empty text holds nothing."""
    ship(spark)
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1,024. Every row is a document of its own; a null or
    empty text has the end id alone. Columns of documents other than doc_id and text are not read."""
    ship(spark)
    path = public_tokenizers.path
    found = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: Fingerprints, learned predictions and tokens are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
