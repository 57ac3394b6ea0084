"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one on a local
    master, and an error on a cluster, whose executors would not see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path, as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: a lost executor costs a re-read of it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from `written` that nothing will read again."""
    for t in tables:
        if path := _paths.pop(id(t), None):
            fs, p = hadoop_path(t.sparkSession, path)
            fs.delete(p, True)
