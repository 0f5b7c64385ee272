"""Query of byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.bpe import encode_digests
from cohortspark.sources.tables import table


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op12_bpe": op12_bpe}
