"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode (tests); an
    error on a cluster, whose machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ratewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """`df`, written to a fresh table of the shared folder and read again: later steps don't depend on its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ratewright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a scratch table of the shared folder, once nothing that isn't written yet reads it."""
    if not path.startswith(f"{shared_folder(spark)}/ratewright/"):
        raise ValueError(f"{path} is no scratch table")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
