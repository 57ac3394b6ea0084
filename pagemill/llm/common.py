"""What the training-data operators share: tables, shared folders, components.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors see; lineage is
cut there, so a lost executor costs a re-read and not the work before it.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what is between runs of it is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one on a
    local master (tests), and an error on a cluster, whose executors would not see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs here deletes its shuffle files when it has ended: a written table needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows of df from a table written in the shared folder; cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _without_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from `written` that nothing will read again."""
    for t in tables:
        ref, path = _paths.pop(id(t), (lambda: None, ""))
        if ref() is t:
            drop_path(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_dirs(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Names of the folders in a folder that hold a file of this name; none where the folder is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), holding)))


def tidy() -> None:
    """Gives back what freed arrays have left with the allocators: a worker lives through many stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the
    smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which
    need O(log^2 n) rounds and at no time more edges than the input. Both steps
    are group-min joins, so a hub of any degree is pre-aggregated before the
    shuffle. Each round is written to the shared folder. Self loops and null
    ends are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a"), F.col("b")).where("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def signature(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(e)
    for _ in range(most_rounds):
        # large-star: every larger neighbour of u links to the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, written(small, name)
        discard(last)
        now = signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
