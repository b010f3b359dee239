"""The corpus pipeline: quality rules, language, near duplicates, source mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import stages
from geoloom.llm.common import cut, table

STAGES = stages.STAGES

#: SQL can't express the language and sketch stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
