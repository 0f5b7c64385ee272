"""Query of the personal-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.pii import detect
from cohortspark.sources.tables import table


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of the personal data in every document."""
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
