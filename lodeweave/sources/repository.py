"""Scan of a directory tree as a table of contents, and reading of files again later.

Folders are listed by tasks, level by level: what one level finds is the next one's work, so the driver sees counts
only. Directories that are never indexed are not descended into, files are chosen by name before they are read, and
links are left out. The scan sees names that begin with a dot or an underscore, which Spark's own file sources
leave out. The tree must be visible to the executors; contents from other stores come as tables with the same columns.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave import schemas
from lodeweave.functions.text import IGNORED_DIRECTORIES, LANGUAGES, is_indexed
from lodeweave.sources.shared import staged

#: Files that a task reads, folders that it lists, and rows that it hands on at once.
BATCH, FOLDERS, ROWS = 256, 64, 1 << 14


def chosen(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in LANGUAGES or name == "Dockerfile" or name.endswith(".env.example")


def _lister(root: str, ignored: tuple[str, ...]):
    columns = ["path", "is_folder", "size", "modified_at_ms"]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for folder in (x for batch in batches for x in batch["path"]):
            with os.scandir(os.path.join(root, folder)) as entries:
                for e in entries:
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in ignored:
                            rows.append((path, True, 0, 0.0))
                    elif e.is_file(follow_symlinks=False) and chosen(e.name):
                        stat = e.stat(follow_symlinks=False)
                        rows.append((path, False, stat.st_size, stat.st_mtime_ns / 1e6))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return listed


def list_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> DataFrame:
    """path, size, modified_at_ms of the files under root that are chosen by name: a job for each level of folders."""
    level, number, found = spark.createDataFrame([("",)], "path string"), 1, []
    while number:
        dealt = level.repartition(-(-number // FOLDERS))
        rows = staged(dealt.mapInPandas(_lister(root, ignored), "path string, is_folder boolean, size bigint, modified_at_ms double"))
        found.append(rows.filter("not is_folder").drop("is_folder"))
        level = rows.filter("is_folder").select("path")
        number = level.count()
    files = found[0]
    for rows in found[1:]:
        files = files.unionByName(rows)
    return files


def _text(root: str, path: str) -> tuple[int, float, str]:
    full = os.path.join(root, path)
    with open(full, "rb") as f:
        stat = os.fstat(f.fileno())
        return stat.st_size, stat.st_mtime_ns / 1e6, f.read().decode("utf-8", "replace")


def read_repository(spark: SparkSession, root: str, repo_id: str | None = None, ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> DataFrame:
    """repo_id, path, size, modified_at_ms, content of a tree; ignored: names of directories that are never descended into."""
    root = os.path.abspath(root)
    repo = repo_id or root

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (x for batch in batches for x in batch["path"]):
            yield pd.DataFrame([(repo, path, *_text(root, path))], columns=["repo_id", "path", "size", "modified_at_ms", "content"])

    files = list_tree(spark, root, ignored)
    return files.select("path").repartition(max(1, -(-files.count() // BATCH))).mapInPandas(read, schemas.CONTENTS)


def contents_of(table: DataFrame, ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> DataFrame:
    """A table (repo_id, path, size, modified_at_ms, content) from any store, cut to what is indexed."""
    return table.filter(is_indexed(F.col("path"), ignored)).select(*[c.split()[0] for c in schemas.CONTENTS.split(", ")])


def read_again(files: DataFrame, roots: dict[str, str]) -> DataFrame:
    """files with the contents that they have now, and state: same, stale (read anew) or gone (content null).

    Executors look at a file's size and time; only one that differs from the index is read. Files of collections
    without a root stay as they are indexed.
    """
    columns = files.columns

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, states = [], []
            for row in batch.itertuples(index=False):
                content, state = row.content, "same"
                if row.repo_id in roots:
                    try:
                        stat = os.stat(os.path.join(roots[row.repo_id], row.path))
                        if (stat.st_size, stat.st_mtime_ns / 1e6) != (row.size, row.modified_at_ms):
                            content, state = _text(roots[row.repo_id], row.path)[2], "stale"
                    except FileNotFoundError:
                        content, state = None, "gone"
                contents.append(content)
                states.append(state)
            yield pd.DataFrame({"repo_id": batch["repo_id"], "path": batch["path"], "now": contents, "state": states})

    key = files.select("repo_id", "path", F.col("size").cast("long"), F.col("modified_at_ms").cast("double"), "content")
    found = key.mapInPandas(again, "repo_id string, path string, now string, state string")
    return files.join(found, ["repo_id", "path"]).select(*[F.col("now").alias(c) if c == "content" else c for c in columns], "state")
