"""Tables that are computed once: written to the shared folder and read back, so lost executors and later actions do not compute them again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _own_dir(spark: SparkSession) -> str:
    """A temporary folder, one a session; only where driver and executors are one process."""
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_leafmill_dir"):
        sc._leafmill_dir = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return sc._leafmill_dir


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; a plain one is on the default file system."""
    if "://" not in path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given; a temporary one only where both are unset, in local mode."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = own.get() if own.isDefined() else None
    return qualified(spark, given or _own_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage, survives lost executors. Deleted when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    return out


def keep(df: DataFrame) -> DataFrame:
    """``materialise`` for what engines returned."""
    return materialise(df, "kept")


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing will read again."""
    for t in tables:
        path = getattr(t, "_leafmill_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
