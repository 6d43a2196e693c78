"""Where tables are written: the folder that all executors of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_workers(spark: SparkSession) -> SparkSession:
    """The session, with this library on the import path of its Python workers."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. Only a local session without one gets a folder of its own; a cluster's must be named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "loomtext-checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return bool(fs.exists(p))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files at a path."""
    p, fs = file_system(spark, path)
    return fs.getContentSummary(p).getLength()


_WRITTEN: list[tuple[str, str]] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends there, and every executor can reread it.

    The files stay, as results that are yet to be computed read them; drop_intermediates() removes them once results are written.
    """
    path = fresh_path(df.sparkSession, tag)
    _WRITTEN.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables materialise() has written so far; a mark for drop_intermediates()."""
    return len(_WRITTEN)


def drop_intermediates(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> int:
    """Remove what materialise() has written in this application, after the mark `since` and but for tables that `keep` reads; returns how
    many tables that were."""
    held = keep.inputFiles() if keep is not None else []
    mine = [x for x in _WRITTEN[since:] if x[0] == spark.sparkContext.applicationId and not any(f"/{os.path.basename(x[1])}/" in f for f in held)]
    for entry in mine:
        path, fs = file_system(spark, entry[1])
        fs.delete(path, True)
        _WRITTEN.remove(entry)
    return len(mine)


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores, where it is read from fewer files than the session has cores: a file of one row group is read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
