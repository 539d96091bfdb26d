"""Where indexes and logs live: Parquet tables under one directory, JSON documents, or tables of one session."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave import schemas
from lodeweave.operators.sessions import retained
from lodeweave.sources.shared import staged


@dataclass
class Index:
    files: DataFrame
    chunks: DataFrame
    edges: DataFrame


TABLES = {"files": schemas.FILES, "chunks": schemas.CHUNKS, "edges": schemas.EDGES}


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


class ParquetStore:
    """Each write is a new version; a small table of versions names the current one, so a reader never sees half of one."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def _current(self) -> str | None:
        try:
            newest = self.spark.read.schema("at timestamp, version string").parquet(f"{self.directory}/versions").orderBy(F.desc("at")).first()
        except AnalysisException as error:
            if _missing(error):
                return None
            raise
        return newest and newest.version

    def read(self) -> Index | None:
        version = self._current()
        return version and Index(*[self.spark.read.schema(s).parquet(f"{self.directory}/{version}/{t}") for t, s in TABLES.items()])

    def write(self, index: Index) -> Index:
        version = f"v-{uuid.uuid4().hex}"
        for name in TABLES:
            getattr(index, name).write.parquet(f"{self.directory}/{version}/{name}")
        self.spark.sql(f"select current_timestamp() as at, '{version}' as version").write.mode("append").parquet(f"{self.directory}/versions")
        return self.read()


class MemoryStore:
    """The index of one session, as tables in the shared folder: an index has all texts twice, and persisted ones would fill the executors' memory as it grows."""

    def __init__(self):
        self.index: Index | None = None

    def read(self) -> Index | None:
        return self.index

    def write(self, index: Index) -> Index:
        self.index = Index(staged(index.files), staged(index.chunks), staged(index.edges))
        return self.index


SECTIONS = {"files": ("path",), "chunks": ("file_path", "start_line", "id"), "edges": ("src", "dst", "kind")}


def export_json(index: Index, path: str, parts: int | None = None) -> None:
    """A JSON document for each collection, {"repo_id", "files": [...], "chunks": [...], "edges": [...]}, in parts.

    Rows are dealt to the parts by ranges of their order, a line each, so a collection may be of any size; the
    parts one after another, in the order of their names, are the documents.
    """
    rows = None
    for n, (name, order) in enumerate(SECTIONS.items()):
        table = getattr(index, name)
        key = F.to_json(F.array(*[F.lpad(F.col(c).cast("string"), 10, "0") if c == "start_line" else F.col(c) for c in order]))
        own = table.select("repo_id", F.lit(2 * n + 1).alias("section"), key.alias("key"), F.to_json(F.struct("repo_id", *[c for c in table.columns if c != "repo_id"])).alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    rows = staged(rows)
    first = rows.groupBy("repo_id", "section").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))  # three a collection
    lines = rows.join(first, ["repo_id", "section", "key"], "left").withColumn("value", F.when(F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value"))).drop("first")
    head = F.to_json(F.struct("repo_id"))
    marks = [F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"files":[')), F.lit('],"chunks":['), F.lit('],"edges":['), F.lit("]}")]
    between = F.explode(F.array(*[F.struct(F.lit(2 * n).alias("section"), F.lit("").alias("key"), m.alias("value")) for n, m in enumerate(marks)]))
    framed = lines.unionByName(rows.select("repo_id").distinct().select("repo_id", between.alias("m")).select("repo_id", "m.*"))
    order = ("repo_id", "section", "key")
    dealt = framed.repartitionByRange(parts, *order) if parts else framed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def import_json(spark: SparkSession, path: str) -> Index | None:
    """The index in the parts that export_json wrote: each line is read by itself."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise
    own = F.ltrim(F.col("value"), F.lit(","))
    rows = lines.filter(~F.col("value").startswith("]") & ~F.col("value").endswith("[")).select(own.alias("value"))
    read = lambda ddl: rows.select(F.from_json("value", ddl).alias("x")).select("x.*")
    return Index(*[read(ddl).filter(F.col(SECTIONS[name][0]).isNotNull()) for name, ddl in TABLES.items()])


class SessionLog:
    """Appended rows of all collections; reading keeps the newest of each, `compact` drops the others."""

    def __init__(self, spark: SparkSession, directory: str | None = None):
        self.spark, self.directory = spark, directory and directory.rstrip("/")
        self.rows: DataFrame | None = None

    def read(self) -> DataFrame:
        if self.directory is None:
            return self.rows if self.rows is not None else self.spark.createDataFrame([], schemas.SESSIONS)
        try:
            return self.spark.read.schema(schemas.SESSIONS).parquet(self.directory)
        except AnalysisException as error:
            if _missing(error):
                return self.spark.createDataFrame([], schemas.SESSIONS)
            raise

    def next_seq(self) -> int:
        return (self.read().agg(F.max("seq")).first()[0] or 0) + 1

    def append(self, records: DataFrame) -> None:
        if self.directory is None:
            self.rows = self.read().unionByName(records).persist()
        else:
            records.write.mode("append").parquet(self.directory)

    def compact(self, directory: str) -> "SessionLog":
        """A new log elsewhere with the newest twenty rows of each collection."""
        retained(self.read()).write.parquet(directory)
        return SessionLog(self.spark, directory)
