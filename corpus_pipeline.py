"""The corpus pipeline: each stage's rows are written as Parquet and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riverglass.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from riverglass.llm.common import Saved

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("bpe_round_trip", bpe.stage),
]

#: SQL can express neither a trained classifier nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with n_tokens and ids_sha256 of their texts."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        kept = Saved(function(spark, docs, sf_dir), f"stage-{name}")
        docs = kept.df
        if before is not None:
            before.drop()  # its reader is done
        before = kept
    return docs
