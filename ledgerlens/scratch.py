"""Shared scratch tables: the only way in which stages of one job cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs on one machine, a
    temporary folder takes its place; it becomes the context's checkpoint folder, so that later calls agree.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in folders of ``by``, and read it again.

    What is read back has no lineage, so a lost executor costs the re-read of files only.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._ledgerlens_path = path
    return back


def together(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """What functions return that store tables and don't wait for each other. Their jobs run side by side, as each has stages that leave cores idle."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(own(m)) for m in makers]]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, whatever store holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` made, once all that was read from them is stored itself."""
    for t in tables:
        remove(t.sparkSession, t._ledgerlens_path)
