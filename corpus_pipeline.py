"""Documents to packed training sequences: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import stages
from seriesloom.llm.common import cut, read_table

STAGES = [
    ("language_id", stages.identify_language),
    ("jaccard_join", stages.drop_near_copies),
    ("benchmark_decontamination", stages.decontaminate),
    ("pii_redaction", stages.redact_personal_data),
    ("best_fit_packing", stages.pack_sequences),
]

#: SQL can't express the stages; the tests run them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
