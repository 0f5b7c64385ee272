"""Reading the input tables, and scratch tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side that may be broadcast. Keys and a few numbers per row, so some tens of MB at most.
BROADCAST_ROWS = 1_000_000
TEXT_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cohortspark-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, has true sizes.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/cohortspark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new, empty folder among the scratch tables, for a job that writes several; it goes when the driver ends."""
    path = f"{scratch_root(spark).rstrip('/')}/cohortspark-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The narrow, written table ``df`` with a join hint: broadcast up to ``max_rows`` rows, sort-merge beyond.

    Of a table with texts or other values of no fixed size, the bytes of these count: ``TEXT_BYTES`` for all rows at most.
    """
    free = [F.length(c.name) for c in df.schema if isinstance(c.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType)) for c in df.schema):
        return df.hint("merge")
    size = F.sum(sum((F.coalesce(x, F.lit(0)) for x in free), F.lit(0)).cast("long"))
    rows, own = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and own <= TEXT_BYTES else df.hint("merge")
