"""Tables, and copies of intermediate results that outlive executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset in a local run."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="blockloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/blockloom/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: its rows, and any partition-dependent column, are fixed from here on.

    The copy is columnar, survives lost executors, and goes when the application ends. With `by`, each value of that column
    has a folder, and only the folders asked for are read.
    """
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
