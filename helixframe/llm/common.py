"""Shared storage and small frame helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors both see, below ``spark.checkpoint.dir``.

    Only a local master with nothing configured, as in tests, gets a scratch folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    root = root or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/helixframe-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write once in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone, so that no other column of the caller's table can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def task_count(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, which the caller sizes to the cluster and the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
