"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.langid import held_out, predict, train
from cohortspark.sources.tables import table


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_langid": op3_langid}
