"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

toxicity -> line dedup -> SimHash near-dedup -> benchmark decontamination -> SentencePiece.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_dedup, sentencepiece_bpe, simhash, toxicity
from lodestone.llm.common import give_back, shared_dir, sweep, table, written


#: Intermediate tables of the stage that ran last.
_behind: set[str] = set()


def _stage(run_stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """When a stage starts, the one before it has been written, so the tables that one made on its way can go."""

    @wraps(run_stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _behind)
        gc.collect()
        give_back()
        before = written()
        found = run_stage(spark, docs, sf_dir)
        _behind.clear()
        _behind.update(written() - before)
        return found

    return wrapped


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the corpus's own labelled documents and drop what scores 0.5 or more."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs across documents; n_chars follows the text."""
    return line_dedup.deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of near copies."""
    return simhash.deduplicate(docs)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak an item of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with an end id) and whether they decode to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = sentencepiece_bpe.round_trip(rows, model)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", tokenize),
]

#: Trained models, templates and merges are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before it wrote to the shared folder."""
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
