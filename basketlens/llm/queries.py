"""Registered queries of the text operators: each applies its operator to the
whole ``documents`` table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.lineage import checkpoint_root
from basketlens.llm import (conversation_repair, decontam, line_dedup, lm_scoring, oracle, order_minhash, packing, pii,
                            sharding, simhash, spelling, substring_dedup, token_files, toxicity)
from basketlens.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
PII_KEY = "key of the registered query"  # a real run passes its own secret
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)
    return made.select("row.doc_id", F.size("mentions").cast("long").alias("n_replaced"),
                       F.array_join(F.transform("mentions", lambda m: F.concat(m["kind"], F.lit(":"), m["surrogate"])),
                                    "\n").alias("surrogates"),
                       F.col("replaced").alias("text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", F.size("removed").cast("long").alias("n_runs_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, c: n + c["lines"]).alias("n_lines_removed"),
        F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"))
    body = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"),
                         F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprints_and_edits(table(spark, sf_dir, "documents"))

    def text(signature: str):
        return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")

    return found.select("doc_id", "n_chars", "edited_sha256", text("signature").alias("fingerprint"),
                        text("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, net, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         toxicity.predicted(F.col("score")).alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), damage=spelling.DAMAGE)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    edits = conversation_repair.repair_conversations(conversation_repair.damaged(rows), rows.select("conv_id"))
    return conversation_repair.digests(edits)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER))
    return token_files.checksums(token_files.read_tokens(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_decontamination, op3_pii, op4_line_dedup, op5_substring_dedup,
                            op6_sharding, op7_lm_scoring, op8_order_minhash, op9_simhash, op10_toxicity,
                            op11_spelling, op12_conversation_repair, op13_token_files)
}
ORACLE_SQL = oracle.SQL
