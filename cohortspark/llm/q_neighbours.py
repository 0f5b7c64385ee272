"""Query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.neighbours import search
from cohortspark.sources.tables import table


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_neighbours": op6_neighbours}
