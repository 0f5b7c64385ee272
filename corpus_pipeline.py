"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. ``run`` writes what a stage returns to the cluster's shared folder and reads it back for the next.

In every stage null text counts as empty, a null doc_id, source or lang is a value like others, extra columns of any name go
through unchanged, and an empty table gives an empty one. Empty texts are kept by stages two to four: they are never near
copies, hold no personal data, and are taken as often as the whole copies of their source; a sequence gets one closing id
for each. Equal rows share the first stage's decision, are one group in the second, and are packed each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.jaccard import keep_one
from cohortspark.llm.mixing import apply_mix
from cohortspark.llm.packing import pack
from cohortspark.llm.pii import mask
from cohortspark.llm.quality import keep_good, train
from cohortspark.sources.tables import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels of both kinds all stay."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays; a repeated id stays once."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; all documents stay."""
    return mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, taken once or left so that sources have their target shares."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a sequence."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express trained classifiers; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
