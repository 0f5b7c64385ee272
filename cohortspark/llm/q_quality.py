"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.quality import score, train
from cohortspark.sources.tables import table


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether to keep it."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality": op7_quality}
