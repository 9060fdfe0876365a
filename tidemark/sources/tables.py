"""Tables in the folder that driver and executors share: they cut the lineage and outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set, on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_open: list[list[str]] = []


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that were written in it, but for the one last passed to the function that it gives."""
    _open.append([])
    last: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        last[:] = _open[-1][-1:]
        return df

    try:
        yield keep
    finally:
        paths = _open.pop()
        for p in paths:
            if p not in last:
                remove(spark, p)
        if _open:
            _open[-1].extend(last)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
