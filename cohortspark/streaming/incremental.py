"""A resumable job: new input files are processed once, rows already done under the same contract are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cohortspark.sources.files import unfinished


def resume(spark: SparkSession, source: str, schema, target: str, state: str, key: str, contract: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Runs ``work`` over what has arrived in ``source`` (Parquet) and appends to ``target``, partitioned by contract.

    Which files were seen is kept in ``state``. A batch that is repeated after a failure finds its rows in the
    target and leaves them out, so every row is there once.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates([key])
        try:
            rows = unfinished(rows, spark.read.parquet(target).select(key, "contract"), key, contract)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(rows).withColumn("contract", F.lit(contract)).write.mode("append").partitionBy("contract").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
