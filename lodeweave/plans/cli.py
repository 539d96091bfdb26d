"""Command line: index, ask, explain-selection, doctor and benchmark."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave import schemas
from lodeweave.operators import index as I
from lodeweave.plans.engine import Engine
from lodeweave.sources.repository import read_repository
from lodeweave.sources.store import ParquetStore, SessionLog

#: The tasks of the benchmark command.
BENCHMARK = ("fix authentication login regression", "refactor session handling", "update authentication documentation")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeweave", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--state", help="where the index and the session log are kept")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    for name in ("ask", "explain-selection"):
        s = sub.add_parser(name)
        s.add_argument("text")
        s.add_argument("--target", default="codex")
        s.add_argument("--pin", action="append", default=[])
        s.add_argument("--exclude", action="append", default=[])
    sub.add_parser("doctor")
    sub.add_parser("benchmark")
    return p


def _lines(df: DataFrame) -> str:
    return "\n".join("  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in df.toLocalIterator())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lodeweave").getOrCreate()
    root = os.path.abspath(a.root)
    state = a.state or os.path.join(root, ".lodeweave")
    engine = Engine(spark, ParquetStore(spark, f"{state}/index"), SessionLog(spark, f"{state}/sessions"))
    if a.command == "index" or (a.command in ("ask", "explain-selection") and engine.store.read() is None):
        engine.index_repository(root, root)
    if a.command == "index":
        return _lines(engine.metrics.join(I.breakdown_text(engine.store.read().files), "repo_id"))
    if a.command == "doctor":
        return _lines(engine.diagnostics()) if engine.store.read() is not None else "nothing is indexed yet"
    if a.command == "benchmark":
        tasks = spark.createDataFrame([(f"t{i}", root, t, "codex", [], []) for i, t in enumerate(BENCHMARK)], schemas.TASKS)
        return _lines(engine.benchmark(read_repository(spark, root, root), tasks))
    task = spark.createDataFrame([("task", root, a.text, a.target, a.pin, a.exclude)], schemas.TASKS)
    if a.command == "explain-selection":
        return _lines(engine.explain_selection(task).orderBy("rank"))
    return engine.format_for_target(engine.compile_tasks(task)).select(F.col("payload_text")).first()[0]


if __name__ == "__main__":
    print(main())
