"""The corpus pipeline: documents through five stages, each reading what the one before wrote.

Every stage takes (spark, docs, sf_dir) and gives the columns of documents, the last one also the
token ids. A stage judges only the documents it gets; benchmark and labels come from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.llm import bpe, contamination, linededup, similar, toxicity
from daytrace.llm.common import new_folder, salted_join, table
from daytrace.llm.queries import RANKS, toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; the verdict is made of the text, so it is joined by text."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines and sentences of windows that came earlier; n_chars follows the text."""
    text = linededup.dedup_lines(docs, carried=["lang", "source", "n_chars"], ends=linededup.SENTENCES)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return text.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts with a similarity of 0.8 or more.

    Candidates are the links of SimHash fingerprints (operator 8) and shared minhash keys; an exact check follows.
    """
    return similar.representatives(docs, fingerprints=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"), carried=["text", "lang", "source", "n_chars"])
    return found.where(~F.col("contaminated")).select("doc_id", "text", "lang", "source", "n_chars")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids, whose bytes are checked to decode to the text."""
    there = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return there.select("doc_id", "text", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_tokens"), same.alias("decodes"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("tokens", tokenized),
]
#: Toxicity, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
