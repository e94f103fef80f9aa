"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without and then uses its temp folder."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.gettempdir() + f"/granula-{spark.sparkContext.applicationId}"
    return got.rstrip("/")


#: Folders of the open `scratch` blocks, innermost last.
_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what `durable` wrote inside: for work whose result is written by then."""
    path = f"{shared_dir(spark)}/granula/{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.remove(path)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder where Spark sees it, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def fresh(spark: SparkSession) -> str:
    """A new path in the innermost `scratch` block, or in the shared folder."""
    return f"{_SCRATCH[-1] if _SCRATCH else f'{shared_dir(spark)}/granula'}/{uuid.uuid4().hex}"


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, executors may go. path: one that
    `fresh` gave, for tables that are deleted on their own or outlive a `scratch` block."""
    path = fresh(df.sparkSession) if path is None else path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
