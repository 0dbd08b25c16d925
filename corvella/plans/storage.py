"""Lineage cuts that survive lost executors: Parquet tables in the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local
(tests, notebooks) is a folder chosen here; on a cluster a missing setting is an error, as executors and
driver would not see each other's files. ``clear`` removes what a session wrote.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corvella-')}"
        sc.setCheckpointDir(found)
    found = found.rstrip("/")
    return found if ":" in found.split("/")[0] else f"file://{found}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: small numbers and blocks pack so well in files that Spark, which goes by their size, would send
    millions of rows through the driver."""
    return df.hint("merge")


def clear(spark: SparkSession) -> int:
    """Delete the tables and files that this application wrote; call it once their results are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(hadoop).delete(at, True)
    return len(paths)
