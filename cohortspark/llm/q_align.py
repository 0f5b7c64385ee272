"""Query of the alignment of two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.align import align
from cohortspark.sources.tables import table


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers, and how common its links are in the corpus."""
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_align": op13_align}
