"""Small helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a cluster's warehouse takes its place, unless it is on each machine's own disk, which is
    refused; only a session whose driver is its one executor, as in tests, takes a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace-shared"
        if not alone and found.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # the schema: an empty result may have no file
    out._millrace_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clashing(keep: list[str], own: list[str]) -> None:
    """Refuse columns to keep that would have the name of a result."""
    if both := sorted(set(keep) & set(own)):
        raise ValueError(f"columns to keep have names of results: {', '.join(both)}")


def remainder(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by
