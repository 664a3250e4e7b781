"""From raw documents to packed sequences.

The stages run in order, each on all that the one before it kept: toxicity,
line dedup, near-duplicates, benchmark decontamination, packing.  Every stage's
result is written as a Parquet table in the shared folder and read again, so a
lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm import decontam, line_dedup, packing, simhash, toxicity
from basketlens.llm.common import quoted, table

TOKENIZER = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold (all, when nothing can be learned)."""
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, net, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*[quoted(c) for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated chunks; a document that loses all its
    text goes, one that was empty before stays."""
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.size("removed") == 0) | (F.length(F.regexp_replace("kept", r"\s", "")) > 0))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.size("removed") > 0, F.length("kept").cast(kind))
                           .otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col("row")[c].alias(c))
    return left.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained scores and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table_checkpoint(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
