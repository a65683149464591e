"""Where a session may put what its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh place in ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Where that is unset, a cluster's warehouse takes its place, unless it is on each machine's own disk, which is refused;
    only a session whose driver is its one executor takes a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        top = f"file://{tempfile.mkdtemp(prefix='millrace-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace-shared"
        if not alone and top.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
