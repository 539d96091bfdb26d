"""The engine: index collections, compile tasks, explain, diagnose and measure, as DataFrames."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import compile as C
from lodeweave.operators import fold, graph, index, pack, retrieve, sessions
from lodeweave.sources.repository import read_again, read_repository
from lodeweave.sources.shared import staged
from lodeweave.sources.store import Index, MemoryStore, SessionLog


@dataclass
class Providers:
    """Parts that a user can replace.

    parser: (path, content) columns to the parsed struct; matcher: (analysis, chunks) to chunk hits;
    summarizer: adds own_summary to ranked candidates; estimate: a text column to its tokens.
    """

    parser: Callable[[Column, Column], Column] | None = None
    matcher: Callable[[DataFrame, DataFrame], DataFrame] = retrieve.semantic_chunks
    summarizer: Callable[[DataFrame], DataFrame] | None = None
    estimate: Callable[[Column], Column] = T.token_estimate


@dataclass
class Compiled:
    prompts: DataFrame
    ranked: DataFrame
    items: DataFrame


@dataclass
class Engine:
    spark: SparkSession
    store: object = field(default_factory=MemoryStore)
    memory: SessionLog | None = None
    providers: Providers = field(default_factory=Providers)
    budget: dict | None = None
    reread: bool = False  # read files of candidates again, where their collection was indexed from a folder

    def __post_init__(self):
        self.memory = self.memory or SessionLog(self.spark)
        self.metrics: DataFrame | None = None
        self.roots: dict[str, str] = {}

    def _files(self, contents: DataFrame) -> DataFrame:
        files = index.file_records(contents)
        if self.providers.parser is None:
            return files
        return files.drop("imports", "symbols", "refs", "calls", "bindings").withColumn("p", self.providers.parser(F.col("path"), F.col("content"))).select("*", "p.*").drop("p")

    def index_contents(self, contents: DataFrame) -> Index:
        """Index contents (repo_id, path, size, modified_at_ms, content); what didn't change since the stored index is taken from it."""
        before = self.store.read()
        if before is None:
            files = self._files(contents)
            made = Index(files, index.chunk_files(files), graph.build_edges(files))
            changes = contents.select("repo_id", "path", F.lit("added").alias("change"))
            was_chunks, was_edges = made.chunks.limit(0), made.edges.limit(0)
        else:
            files, chunks, changes = index.refreshed(before.files, before.chunks, contents)
            made = Index(files, chunks, graph.refreshed_edges(before.files, files, before.edges, changes))
            was_chunks, was_edges = before.chunks, before.edges
        stored = self.store.write(made)
        self.metrics = index.index_metrics(changes, was_chunks, was_edges, stored.edges)
        return stored

    def index_repository(self, root: str, repo_id: str | None = None) -> Index:
        self.roots[repo_id or os.path.abspath(root)] = os.path.abspath(root)
        return self.index_contents(staged(read_repository(self.spark, root, repo_id)))  # of one moment, whatever is computed again later

    def candidate_files(self, ranked: DataFrame) -> DataFrame:
        """The files of ranked candidates, with state (same, stale, gone) and their contents of now."""
        files = self._stored().files.join(ranked.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        return read_again(files, self.roots)

    def _stored(self) -> Index:
        found = self.store.read()
        if found is None:
            raise LookupError("nothing is indexed yet")
        return found

    def _best(self, tasks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ranked candidates before overrides, and the facts and chunk lists of files."""
        own = self._stored()
        analysis, facts = retrieve.analyzed(tasks), retrieve.file_facts(own.files)
        lists = retrieve.chunk_lists(own.chunks)
        structural = retrieve.structural_candidates(analysis, facts, own.edges)
        semantic = retrieve.semantic_candidates(staged(self.providers.matcher(analysis, own.chunks)))
        best = staged(retrieve.reranked(retrieve.merged(structural, semantic, facts, lists)))  # a dozen rows a task
        self._reasons = retrieve.truncation_reasons(best)
        return best, facts, lists

    def _ranked(self, tasks: DataFrame) -> DataFrame:
        best, facts, lists = self._best(tasks)
        overrides = sessions.merged_overrides(tasks, sessions.memory_pins(self.memory.read()))
        return staged(retrieve.apply_overrides(best, overrides, facts, lists))

    def _described(self, ranked: DataFrame) -> DataFrame:
        files = self._stored().files
        if self.reread:  # once, so that all texts of a compile are of one moment
            files = staged(self.candidate_files(ranked).filter("state <> 'gone'")).drop("state")
        return pack.describe(self.providers.summarizer(ranked) if self.providers.summarizer else ranked, files.drop("language"))

    def _compiled(self, tasks: DataFrame, ranked: DataFrame, lines: DataFrame, remember: bool) -> Compiled:
        described = self._described(ranked)
        packed = pack.pack(described, self.budget)
        items = pack.context_items(described, packed)
        prompts = staged(C.compiled(tasks, ranked, packed, items, self._reasons, lines, self.providers.estimate))  # before the log grows: a cache would be made anew from the longer log
        if remember:
            self.memory.append(sessions.session_records(prompts, self.memory.next_seq()))
        return Compiled(prompts, ranked, items)

    def explain_selection(self, tasks: DataFrame) -> DataFrame:
        """What a compile would select and why; the session log stays as it is."""
        return self._ranked(tasks).select("task_id", "rank", "path", "score", "role", "stage", "source", "reason")

    def compile_tasks(self, tasks: DataFrame, remember: bool = True) -> Compiled:
        """Compile tasks (task_id, repo_id, text, target, pinned, excluded) at once: each sees the log as it is before the call."""
        ranked = self._ranked(tasks)
        return self._compiled(tasks, ranked, sessions.session_lines(tasks, self.memory.read()), remember)

    def compile_sequence(self, tasks: DataFrame, remember: bool = True) -> Compiled:
        """The same tasks in the order of their ids, each with the sessions of those before it in its collection, as one job."""
        best, facts, lists = self._best(tasks)
        fed = fold.fed(tasks, best, self.memory.read(), facts, lists, self._described, self.budget)
        ranked = staged(retrieve.apply_overrides(best, sessions.overrides_with(tasks.join(fed.select("task_id", "memory"), "task_id")), facts, lists))
        return self._compiled(tasks, ranked, fed.select("task_id", "lines"), remember)

    def compile_in_order(self, tasks: DataFrame) -> list[Compiled]:
        """One task after another, a job each, for short lists of tasks; compile_sequence does the same in one."""
        ids = [r.task_id for r in tasks.select("task_id").orderBy("task_id").collect()]
        return [self.compile_tasks(tasks.filter(F.col("task_id") == i)) for i in ids]

    def format_for_target(self, compiled: Compiled) -> DataFrame:
        return C.payloads(compiled.prompts)

    def diagnostics(self) -> DataFrame:
        own = self._stored()
        reused = F.lit(0) if self.metrics is None else F.coalesce("reused_chunks", F.lit(0))
        base = index.diagnostics(own.files, own.chunks, own.edges)
        if self.metrics is None:
            return base
        return base.drop("chunk_reuse_ratio").join(self.metrics.select("repo_id", "reused_chunks"), "repo_id", "left").withColumn("chunk_reuse_ratio", F.when(F.col("chunk_count") == 0, 0.0).otherwise(reused / F.col("chunk_count"))).drop("reused_chunks")

    def benchmark(self, contents: DataFrame, tasks: DataFrame) -> DataFrame:
        """Index once, compile the tasks in order, and report index time, average time of a task and the largest prompt."""
        began = time.perf_counter()
        self.index_contents(contents)
        index_ms = (time.perf_counter() - began) * 1e3
        runs = []
        ids = [r.task_id for r in tasks.select("task_id").orderBy("task_id").collect()]
        for i in ids:
            began = time.perf_counter()
            done = self.compile_tasks(tasks.filter(F.col("task_id") == i))
            tokens = done.prompts.agg(F.max("token_estimate")).first()[0]
            runs.append((i, (time.perf_counter() - began) * 1e3, tokens))
        return C.benchmark_report(self.spark.createDataFrame(runs, "task_id string, total_ms double, token_estimate long")).withColumn("index_ms", F.lit(index_ms))
