"""Tables that a job writes for itself in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths written inside the temporary_tables() that is open in this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("temporary_tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what staged() wrote in between in this thread, unless it was to last."""
    paths: list[str] = []
    before = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that Spark hands to Python at once, and rows that its Parquet reader holds at once.
ARROW_ROWS, READER_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def batch_rows(spark: SparkSession, rows: int, read: int | None = None) -> Iterator[None]:
    """Rows that Spark hands to Python at once, and those it reads at once: what is planned in between holds fewer texts in memory."""
    with settings_kept(spark, ARROW_ROWS, READER_ROWS):
        spark.conf.set(ARROW_ROWS, str(rows))
        if read:
            spark.conf.set(READER_ROWS, str(read))
        yield


@contextmanager
def settings_kept(spark: SparkSession, *names: str) -> Iterator[None]:
    """Set these back at the end to what they were."""
    before = {name: spark.conf.get(name) for name in names}
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def staged(df: DataFrame, partition_by: tuple[str, ...] = (), lasting: bool = False) -> DataFrame:
    """Write df once to a new table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, and values that depend on how tasks were
    dealt (partition ids) stay what they were. Parquet keeps the table small.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None and not lasting:
        scope.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
