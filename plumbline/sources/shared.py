"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What the innermost scratch() of the running code has written so far; None outside of any.
_open: ContextVar[list[str] | None] = ContextVar("plumbline_scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local session (tests) gets a temporary folder; any other
    session has to name one, as a machine's own folder would be invisible to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there stays until the scratch() around it ends."""
    path = f"{shared_folder(spark)}/plumbline/{uuid.uuid4().hex}"
    if (own := _open.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe to reread
    after executors are lost. It stays until the scratch() around it ends."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 2)[-2] == "plumbline":
            _deleted(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what written() wrote inside, but for what goes through the function it gives: that is
    written for the code around it, and holds the result."""
    outer, own = _open.get(), []
    token = _open.set(own)

    def keep(df: DataFrame) -> DataFrame:
        inner = _open.set(outer)
        try:
            return written(df)
        finally:
            _open.reset(inner)

    try:
        yield keep
    finally:
        _open.reset(token)
        for path in own:
            _deleted(spark, path)
