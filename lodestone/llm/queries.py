"""The registered queries: thin digests of what the operators return."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, html_extract, line_dedup, quality, sentencepiece_bpe, sharding, simhash, token_table, toxicity
from lodestone.llm.common import fold, shared_dir, table

#: A conversation whose texts hold another template's control strings.
PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(PROBE).alias("record"))
    probe = chat.turn_rows(chat.canonical_turns(probe, "record").select("conv_id", "turns"))
    rows = chat.turn_rows(table(spark, sf_dir, "conversations")).unionAll(probe)
    back = chat.read_back(chat.render(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    placed = sharding.shard_rows(docs, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_bpe.round_trip(docs, model).drop("text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op10_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-table-{uuid.uuid4().hex}"
    token_table.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_table.read(spark, path, token_table.crc_of, "long", "ids_crc32")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.add_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), name="score")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.add_ratios(quality.add_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    rules = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return docs.select("doc_id", *quality.STATISTICS, failed.alias("base_failed"), F.when(failed, False).otherwise(quality.verdict(rules) == 1).alias("kept"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate_lines(docs, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
