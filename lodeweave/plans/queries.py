"""Every operator as a query over the driver's tables, with equivalent SQL.

Documents stand in for files (one markdown file each), benchmark items and user turns for tasks,
conversations for sessions, events for logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.functions.parse import module_symbol
from lodeweave.operators import compile as C
from lodeweave.operators import graph, index, pack, retrieve, sessions
from lodeweave.plans.engine import Engine
from lodeweave.sources.shared import staged
from lodeweave.sources.store import Index
from lodeweave.streaming import state


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path() -> Column:
    part = lambda c: F.coalesce(c, F.lit("none"))
    return F.concat(F.lit("docs/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))


def files(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    x = _table(spark, d, "documents").select(F.lit("docs").alias("repo_id"), "doc_id", "lang", "source", _path().alias("path"), F.octet_length(text).cast("long").alias("size"), (F.lit(1.7e12) + F.col("doc_id") % 1000 * 3_600_000.0).alias("modified_at_ms"), text.alias("content"))
    none = F.array().cast("array<string>")
    return x.withColumns({"language": T.language(F.col("path")), "is_test": T.is_test(F.col("path")), "symbols": module_symbol(F.col("path")), "imports": none})


def tasks(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("review documentation of src"), F.col("item_id") % 20, F.lit(" "), F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.lit("docs").alias("repo_id"), text.alias("text"), F.when(F.col("item_id") % 2 == 0, "claude").otherwise("codex").alias("target"), none.alias("pinned"), none.alias("excluded"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each document imports the one whose id is a tenth of its own."""
    own = files(spark, d).select("doc_id", "path")
    up = own.filter("doc_id >= 10").select(F.floor(F.col("doc_id") / 10).alias("up"), F.col("path").alias("src")).join(own.select(F.col("doc_id").alias("up"), F.col("path").alias("dst")), "up")
    return graph.deduped(graph.import_edges(up.select(F.lit("docs").alias("repo_id"), "src", "dst", F.lit(False).alias("is_test"))))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.file_facts(files(spark, d))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_files(files(spark, d))


def file_records(spark: SparkSession, d: str) -> DataFrame:
    x = files(spark, d).select("path", "language", "size", "is_test", "modified_at_ms")
    return x.join(_facts(spark, d).select("path", F.round("recency_score", 6).alias("recency_score"), "file_importance_score", "token_cost"), "path")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", "file_path", "kind", "start_line", "end_line", "token_estimate", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _task_texts(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("task_id"), "text")
    b = _table(spark, d, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("task_id"), "text")
    return a.unionByName(b).select("task_id", F.coalesce("text", F.lit("")).alias("text"))


def task_intent(spark: SparkSession, d: str) -> DataFrame:
    return _task_texts(spark, d).select("task_id", T.intent(F.col("text")).alias("intent"))


def task_terms(spark: SparkSession, d: str) -> DataFrame:
    return _task_texts(spark, d).select("task_id", F.posexplode(T.query_terms(F.col("text"))).alias("ord", "term"))


def term_trigrams(spark: SparkSession, d: str) -> DataFrame:
    grams = _task_texts(spark, d).select("task_id", F.explode(T.term_trigrams(T.query_terms(F.col("text")))).alias("gram"))
    return grams.groupBy("task_id", "gram").agg(F.count(F.lit(1)).alias("n"))


def structural_seeds(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.structural_seeds(retrieve.analyzed(tasks(spark, d)), _facts(spark, d)).select("task_id", "path", "score", "reason", "seed_rank")


def expand_two_hops(spark: SparkSession, d: str) -> DataFrame:
    x = retrieve.structural_candidates(retrieve.analyzed(tasks(spark, d)), _facts(spark, d), edges(spark, d))
    return x.select("task_id", "path", "structural_score", "role", "stage", "dependency_distance")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.semantic_chunks(retrieve.analyzed(tasks(spark, d)), _chunks(spark, d))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("task_id", "id", F.round("score", 6).alias("score"), "rank")


def semantic_files(spark: SparkSession, d: str) -> DataFrame:
    x = retrieve.semantic_candidates(_hits(spark, d))
    return x.select("task_id", "path", F.round("semantic_score", 6).alias("semantic_score"), "reason", "role", "token_cost", "rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.retrieve(tasks(spark, d), files(spark, d), _chunks(spark, d), edges(spark, d))


def rerank_top12(spark: SparkSession, d: str) -> DataFrame:
    x = _ranked(spark, d)
    return x.select("task_id", "path", F.round("score", 6).alias("score"), "source", "role", "stage", "dependency_distance", "token_cost", F.size("chunk_ids").alias("n_chunks"), F.size("expansion_path").alias("n_path"), "rank")


def overrides_applied(spark: SparkSession, d: str) -> DataFrame:
    """Each task pins the document of its own number and one that it also excludes, and excludes the file ranked first."""
    best = staged(_ranked(spark, d))  # read three times
    own = files(spark, d).select(F.col("doc_id").alias("task_id"), F.col("path").alias("own"))
    first = best.filter("rank = 1").select("task_id", F.col("path").alias("first"))
    asked = tasks(spark, d).select("task_id", "repo_id").join(own, "task_id").join(first, "task_id", "left")
    overrides = asked.select("task_id", "repo_id", F.array_compact(F.array("own", "first")).alias("pinned"), F.array_compact(F.array("first")).alias("excluded"))
    x = retrieve.apply_overrides(best, overrides, _facts(spark, d), retrieve.chunk_lists(_chunks(spark, d)))
    return x.select("task_id", "path", F.round("score", 6).alias("score"), "source", "role", "stage", "rank")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """files with the path that each imports, as edges has it."""
    own = files(spark, d).drop("imports")
    up = own.select(F.col("doc_id").alias("up"), F.col("path").alias("imported"))
    found = own.join(up, F.when(F.col("doc_id") >= 10, F.floor(F.col("doc_id") / 10)) == F.col("up"), "left")
    return found.withColumn("imports", F.array_compact(F.array("imported"))).drop("up", "imported")


def _described(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ranked candidates, and the same with what a raw item and a summary of each say and cost."""
    best = staged(_ranked(spark, d))  # a dozen rows a task
    return best, pack.describe(best, _sources(spark, d).drop("language"))


def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(_described(spark, d)[1]).select("task_id", F.array_join(F.transform("items", lambda i: F.concat(i["path"], F.lit(":"), i["compression"])), ",").alias("items"), F.array_join("omitted", ",").alias("omitted"), "used_raw", "used_summary", "used_dependency", "used_tests", "used_total")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as a compile without overrides and sessions makes them."""
    best, described = _described(spark, d)
    packed = pack.pack(described)
    return C.compiled(tasks(spark, d), best, packed, pack.context_items(described, packed), retrieve.truncation_reasons(best))


def compiled_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d).select("task_id", "target", "prompt_id", "token_estimate", F.size("included_files").alias("n_included"), "used_dependency", "used_total")


def agent_payloads(spark: SparkSession, d: str) -> DataFrame:
    return C.payloads(_prompts(spark, d)).select("task_id", "target", F.md5(F.col("system").cast("binary")).alias("system_md5"), F.md5(F.col("user").cast("binary")).alias("user_md5"))


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    links = _table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages").select(F.lit("web").alias("repo_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"), F.lit("reference").alias("kind"), (F.col("page_id") % 4 + 2).cast("int").alias("weight"))
    return graph.deduped(pages).drop("repo_id")


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    have = files(spark, d)
    half = F.lpad(F.floor(F.col("doc_id") / 2).cast("string"), 9, "0")
    module = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../"), F.coalesce("lang", F.lit("none")), F.lit("/"), half, F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("./"), half)).otherwise(F.concat(F.lit("../../../"), half))
    return graph.resolve_modules(have.select("repo_id", F.col("path").alias("src"), module.alias("module")), have).select("src", "module", "dst")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    state = lambda e: e.groupBy(F.lit("users").alias("repo_id"), F.col("user_id").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("size"), (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1000).alias("modified_at_ms"))
    before = events.filter(F.col("event_id") % 3 != 0)
    return index.snapshot_changes(state(before), state(events.filter("event_type <> 'error'"))).drop("repo_id")


def index_metrics(spark: SparkSession, d: str) -> DataFrame:
    now = files(spark, d).select("repo_id", "doc_id", "path", "size", "modified_at_ms")
    before = now.filter("doc_id % 7 <> 0").withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    changes = index.snapshot_changes(before, now.filter("doc_id % 11 <> 0"))
    e = edges(spark, d)
    return index.index_metrics(changes, _chunks(spark, d).join(before.select(F.col("path").alias("file_path")), "file_path", "left_semi"), e, e.filter("kind <> 'caller'")).drop("repo_id")


def _session_log(spark: SparkSession, d: str) -> DataFrame:
    x = _table(spark, d, "conversations").filter("role = 'user'")
    return x.select(F.concat(F.lit("r"), F.col("conv_id") % 10).alias("repo_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.slice(T.query_terms(F.coalesce("text", F.lit(""))), 1, 3).alias("selected_files"))


def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recent_sessions(_session_log(spark, d)).select("repo_id", "seq", "recency", F.array_join("selected_files", ",").alias("files"))


def memory_pins(spark: SparkSession, d: str) -> DataFrame:
    return sessions.memory_pins(_session_log(spark, d)).select("repo_id", F.array_join("memory", ",").alias("memory"))


def session_retention(spark: SparkSession, d: str) -> DataFrame:
    return sessions.retained(_session_log(spark, d)).select("repo_id", "seq")


def handoff_history(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "events").select((F.col("user_id") % 50).alias("repo_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.col("event_id") % 3).alias("prompt_id"))
    return sessions.handoff_history(log).select("repo_id", "seq", "prompt_id", "position")


def _actions(events: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "pin").when(F.col("event_type") == "view", "exclude").otherwise("include")
    return events.select((F.col("user_id") % 50).alias("repo_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 11).alias("path"), action.alias("action"))


def override_state(spark: SparkSession, d: str) -> DataFrame:
    return sessions.override_state(_actions(_table(spark, d, "events")))


def override_stream(spark: SparkSession, d: str) -> DataFrame:
    """override_state, from the events as a stream with a state for each path."""
    events = spark.readStream.schema(_table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern may be a file, a path has to be a folder
    return state.latest(state.override_stream(_actions(events)), ("repo_id", "path")).drop("seq")


def session_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Tasks compiled in order, each with the sessions before it; the log begins with the users' turns, each on the document of its conversation."""
    turns = _table(spark, d, "conversations").filter("role = 'user'")
    chosen = files(spark, d).select(F.col("doc_id").alias("conv_id"), F.array("path").alias("selected_files"))
    none = F.lit(None)
    log = turns.join(chosen, "conv_id").select(F.lit("docs").alias("repo_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").cast("string").alias("task_id"), F.coalesce("text", F.lit("")).alias("text"), none.cast("string").alias("prompt_id"), "selected_files", F.array().cast("array<string>").alias("architecture_summary"), none.cast("timestamp").alias("created_at"))
    engine = Engine(spark)
    engine.store.write(Index(_sources(spark, d), _chunks(spark, d), edges(spark, d)))
    engine.memory.append(staged(sessions.retained(log)))
    done = engine.compile_sequence(tasks(spark, d), remember=False)
    pins = F.transform(F.filter("selection_reasons", lambda r: r["role"] == "manual"), lambda r: r["path"])
    return done.prompts.select("task_id", "prompt_id", F.array_join(F.array_sort(pins), ",").alias("pinned"), F.array_join("included_files", ",").alias("included"), "used_total")


def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    x = files(spark, d).withColumn("language", F.coalesce("lang", F.lit("none")))
    return index.language_breakdown(x).join(index.breakdown_text(x), "repo_id").drop("repo_id")


def index_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return index.diagnostics(files(spark, d), _chunks(spark, d), edges(spark, d)).drop("repo_id")


def dense_similarity(spark: SparkSession, d: str) -> DataFrame:
    x = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieve.dense_matches(x.filter("id % 20 = 0"), x).select("query_id", "vec_id", F.round("score", 5).alias("score"))


_ALL = (
    file_records, chunk_documents, task_intent, task_terms, term_trigrams, structural_seeds, expand_two_hops, semantic_chunks, semantic_files, rerank_top12, overrides_applied, budget_pack, compiled_prompts, agent_payloads,
    link_edges, edge_dedupe, import_resolution, snapshot_diff, index_metrics, recent_sessions, memory_pins, session_retention, handoff_history, override_state, override_stream, session_sequence, language_breakdown, index_diagnostics, dense_similarity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
