"""Keeping an index current from a stream of contents, beyond what the batch engine needs.

Each micro-batch is an upsert: of rows that name a path twice the newest counts, rows with a null
content remove their path, and only changed files are parsed. A batch that is run again finds its
files unchanged, so repeated delivery changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeweave.plans.engine import Engine

COLUMNS = ("repo_id", "path", "size", "modified_at_ms", "content")


def upsert(engine: Engine, batch: DataFrame) -> None:
    newest = Window.partitionBy("repo_id", "path").orderBy(F.desc("modified_at_ms"), F.desc("size"), F.desc("content"))
    rows = batch.select(*COLUMNS).withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
    before = engine.store.read()
    if before is not None:
        rest = before.files.select(*COLUMNS).join(rows.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        rows = rest.unionByName(rows)
    engine.index_contents(rows.filter("content is not null"))


def keep_current(contents: DataFrame, engine: Engine, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query that applies a stream of contents to the engine's index."""
    writer = contents.writeStream.foreachBatch(lambda batch, _: upsert(engine, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of changes by kind and window of a stream (ts, event_type); rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
