"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.packing import pack
from cohortspark.sources.tables import table


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
