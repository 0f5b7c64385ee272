"""Query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.fingerprint import compare_versions
from cohortspark.sources.tables import table


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited version, and how alike they are."""
    return compare_versions(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprint": op8_fingerprint}
