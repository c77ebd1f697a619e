"""Tables in the shared folder, and cutting lineage between the steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='marlstone-')}"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return f"{folder.rstrip('/')}/tables"


def forget_at_exit(spark: SparkSession, folder: str) -> None:
    """`folder` goes when the session's application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def done_with_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files removed once it stands in its folder: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` computed once into a table of its own in the shared folder, and read from there; the table goes with the application."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with done_with_shuffles(df.sparkSession):
        df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
