"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.mixing import mix
from cohortspark.sources.tables import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix 5 : 2 : 1 takes from every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op1_mixing": op1_mixing}
