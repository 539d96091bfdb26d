"""The session log, its feedback into later tasks, and the logs of hand-offs and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is kept and what is used.
KEPT_SESSIONS, RECENT, MEMORY_PINS, KEPT_HANDOFFS, NOTED_FILES, ARCHITECTURE_NOTES = 20, 3, 4, 5, 5, 5


def recent_sessions(log: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest rows of each collection; log: repo_id, seq (grows) and what else it holds."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("seq"))
    return log.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= limit)


def retained(log: DataFrame, kept: int = KEPT_SESSIONS) -> DataFrame:
    return recent_sessions(log, kept).drop("recency")


def session_records(prompts: DataFrame, first_seq: int) -> DataFrame:
    """What a compile adds to the log, in the order of task ids."""
    w = Window.partitionBy("repo_id").orderBy("task_id")
    return prompts.select(
        "repo_id", (F.row_number().over(w) + (first_seq - 1)).cast("long").alias("seq"), "task_id", "text", "prompt_id", F.col("included_files").alias("selected_files"),
        F.slice("dependency_notes", 1, ARCHITECTURE_NOTES).alias("architecture_summary"), F.current_timestamp().alias("created_at"),
    )


def memory_pins(log: DataFrame) -> DataFrame:
    """repo_id, memory: up to four files of the newest three sessions, cut before repeats are dropped."""
    w = recent_sessions(log).groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("recency", "selected_files"))).alias("x"))
    return w.select("repo_id", F.array_distinct(F.slice(F.flatten(F.transform("x", lambda r: r["selected_files"])), 1, MEMORY_PINS)).alias("memory"))


def session_lines(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """task_id, lines: the newest sessions of the task's collection, `- text [first five files]`."""
    line = F.concat(F.lit("- "), "text", F.lit(" ["), F.array_join(F.slice("selected_files", 1, NOTED_FILES), ", "), F.lit("]"))
    x = recent_sessions(log).groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("recency", line.alias("line")))).alias("x"))
    return tasks.select("task_id", "repo_id").join(x, "repo_id").select("task_id", F.transform("x", lambda r: r["line"]).alias("lines"))


def merged_overrides(tasks: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """task_id, repo_id, pinned, excluded: a task's pins and those from memory, without what it excludes."""
    none = F.array().cast("array<string>")
    return overrides_with(tasks.join(memory, "repo_id", "left") if memory is not None else tasks.withColumn("memory", none))


def overrides_with(x: DataFrame) -> DataFrame:
    """The same where each task has pins from memory of its own; x: tasks with the column memory."""
    none = F.array().cast("array<string>")
    excluded = F.coalesce("excluded", none)
    pins = F.array_except(F.array_distinct(F.concat(F.coalesce("pinned", none), F.coalesce("memory", none))), excluded)
    return x.select("task_id", "repo_id", pins.alias("pinned"), excluded.alias("excluded"))


def override_state(actions: DataFrame) -> DataFrame:
    """repo_id, path, state (pinned, excluded, none) after all actions.

    actions: repo_id, seq, path, action. pin and exclude toggle and rule each other out; include
    lifts an exclusion and pins. Only the last run of equal actions counts: its length tells how a
    toggle ended, and an include before a run of pins had pinned the path already.
    """
    w = Window.partitionBy("repo_id", "path").orderBy("seq")
    marked = actions.withColumn("before", F.lag("action").over(w))
    marked = marked.withColumn("run", F.sum(F.when(F.col("action") == F.col("before"), 0).otherwise(1)).over(w))
    last = marked.withColumn("last_run", F.max("run").over(Window.partitionBy("repo_id", "path"))).filter("run = last_run")
    n = last.groupBy("repo_id", "path").agg(F.max("action").alias("action"), F.count(F.lit(1)).alias("n"), F.min_by("before", "seq").alias("before"))
    on = (F.col("n") + F.when((F.col("action") == "pin") & (F.col("before") == "include"), 1).otherwise(0)) % 2 == 1
    state = F.when(F.col("action") == "include", "pinned").when(on & (F.col("action") == "pin"), "pinned").when(on & (F.col("action") == "exclude"), "excluded").otherwise("none")
    return n.select("repo_id", "path", state.alias("state"))


def handoff_history(log: DataFrame, kept: int = KEPT_HANDOFFS) -> DataFrame:
    """The newest hand-off of each prompt, the newest five of them for each collection; log: repo_id, seq, prompt_id, target."""
    one = log.withColumn("n", F.row_number().over(Window.partitionBy("repo_id", "prompt_id").orderBy(F.desc("seq")))).filter("n = 1").drop("n")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("seq")))).filter(F.col("position") <= kept)


def pending_approval(compiles: DataFrame, handoffs: DataFrame) -> DataFrame:
    """repo_id, pending: whether the last compile has no hand-off after it; both have (repo_id, seq)."""
    a = compiles.groupBy("repo_id").agg(F.max("seq").alias("compiled"))
    b = handoffs.groupBy("repo_id").agg(F.max("seq").alias("approved"))
    return a.join(b, "repo_id", "left").select("repo_id", (F.coalesce("approved", F.lit(-1)) < F.col("compiled")).alias("pending"))
