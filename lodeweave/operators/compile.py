"""One deterministic text for each task, and the payloads made from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T

#: The sections, in order, and what they say when they are empty.
SECTIONS = (
    ("task", "Task", ""),
    ("constraints", "Operating Constraints", ""),
    ("retrieval", "Retrieval Rationale", "No retrieval rationale available."),
    ("raw", "Selected Raw Files", "No raw files included."),
    ("summaries", "Compressed Summaries", "No summaries generated."),
    ("dependencies", "Dependency Notes", "No dependency notes recorded."),
    ("tests", "Related Tests", "No related tests selected."),
    ("omissions", "Explicit Omissions", "No omissions recorded."),
    ("budget", "Token Accounting", ""),
)
CONSTRAINTS = "Use the compiled context first before relying on unstated repository assumptions.\nCall out omitted files if they block a safe change.\n"
#: The payloads' wording for each target.
SYSTEM = {
    "codex": "You are Codex working inside a repository-aware workflow. Use the provided compiled context first, preserve behavior unless the task requires change, and call out omitted files when blocked.",
    "claude": "You are Claude operating on a compiled engineering brief. Use the supplied repository context, explain your reasoning briefly, and avoid relying on files outside the provided scope.",
}


def _strings() -> Column:
    return F.array().cast("array<string>")


def _listed(df: DataFrame, name: str, *fields: Column | str) -> DataFrame:
    """task_id and the fields of its rows in order of rank, as an array of structs."""
    one = F.struct("rank", *fields)
    return df.groupBy("task_id").agg(F.sort_array(F.collect_list(one)).alias(name))


def _or(text: Column, empty: str) -> Column:
    return F.when(text.isNull() | (text == ""), empty).otherwise(text)


def compiled(
    tasks: DataFrame, ranked: DataFrame, packed: DataFrame, items: DataFrame, reasons: DataFrame, sessions: DataFrame | None = None, estimate: Callable[[Column], Column] = T.token_estimate
) -> DataFrame:
    """One row a task: prompt, its id, tokens, sections, and what went into it.

    tasks: task_id, repo_id, text, target; ranked: after overrides; packed and items: from the packing;
    reasons: task_id, truncation_reasons; sessions: task_id, lines (recent sessions as texts, newest first).
    """
    line = F.concat("path", F.lit(" ["), "role", F.lit("/"), "stage", F.lit("] score="), T.one_decimal(F.col("score")), F.lit(" reason="), "reason")
    rows = _listed(ranked, "c", "path", line.alias("line"), "reason", "score", "source", "role", "stage")
    fence = F.lit("\n```")
    raw_text = F.concat(F.lit("## "), "path", F.lit("\nPurpose: "), "purpose", F.lit("\nReason: "), "inclusion_reason", fence, F.lit("\n"), F.coalesce("content", F.lit("")), fence)
    api = _or(F.array_join("public_api", ", "), "None")
    short = F.concat(F.lit("- "), "path", F.lit(": "), "summary", F.lit(" Public API: "), api, F.lit(". Key invariants: "), F.array_join("key_invariants", " "))
    kept = _listed(items, "i", "path", "compression", F.when(F.col("compression") == "raw", raw_text).otherwise(short).alias("text"), "dependency_notes")
    x = tasks.select("task_id", "repo_id", "text", T.target(F.col("target")).alias("target")).join(packed, "task_id", "left").join(rows, "task_id", "left").join(kept, "task_id", "left").join(reasons, "task_id", "left")
    x = x.join(sessions, "task_id", "left") if sessions is not None else x.withColumn("lines", F.lit(None).cast("array<string>"))
    x = x.withColumns({
        "c": F.coalesce("c", F.filter(F.array(F.col("c")[0]), lambda s: F.lit(False))), "i": F.coalesce("i", F.filter(F.array(F.col("i")[0]), lambda s: F.lit(False))),
        "omitted": F.coalesce("omitted", _strings()), "truncation_reasons": F.coalesce("truncation_reasons", _strings()), "lines": F.coalesce("lines", _strings()),
    }).withColumns({
        "related_tests": F.transform(F.filter("c", lambda r: r["role"] == "test"), lambda r: r["path"]),
        "dependency_notes": F.array_distinct(F.flatten(F.transform("i", lambda r: r["dependency_notes"]))),
        "included_files": F.transform("i", lambda r: r["path"]),
        "retrieval_summary": F.transform("c", lambda r: r["line"]),
    })
    of = lambda kind: F.transform(F.filter("i", lambda r: r["compression"] == kind), lambda r: r["text"])
    used = lambda k: F.coalesce(f"used_{k}", F.lit(0)).cast("string")
    recent = F.when(F.size("lines") > 0, F.concat(F.lit("Recent session context:\n"), F.array_join("lines", "\n"))).otherwise("Recent session context: none")
    bodies = {
        "task": F.col("text"),
        "constraints": F.concat(F.lit(CONSTRAINTS), recent),
        "retrieval": F.array_join("retrieval_summary", "\n"),
        "raw": F.array_join(of("raw"), "\n\n"),
        "summaries": F.array_join(of("summary"), "\n"),
        "dependencies": F.array_join("dependency_notes", "\n"),
        "tests": F.array_join("related_tests", "\n"),
        "omissions": F.array_join(F.concat("omitted", "truncation_reasons"), "\n"),
        "budget": F.concat(F.lit("Usage: raw="), used("raw"), F.lit(", summaries="), used("summary"), F.lit(", dependencies="), used("dependency"), F.lit(", tests="), used("tests"), F.lit(", total="), used("total")),
    }
    sections = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("title"), (_or(bodies[k], e) if e else bodies[k]).alias("body")) for k, t, e in SECTIONS])
    x = x.withColumn("bodies", sections).withColumn("prompt", F.array_join(F.transform("bodies", lambda s: F.concat(F.lit("# "), s["title"], F.lit("\n"), s["body"])), "\n\n"))
    return x.select(
        "task_id", "repo_id", "text", "target", T.prompt_id(F.col("prompt")).alias("prompt_id"), "prompt", estimate(F.col("prompt")).alias("token_estimate"), "included_files", "related_tests", F.col("omitted").alias("omitted_paths"),
        F.col("truncation_reasons").alias("omission_reasons"), *[F.coalesce(f"used_{k}", F.lit(0).cast("long")).alias(f"used_{k}") for k in ("raw", "summary", "dependency", "tests", "total")],
        F.transform("c", lambda r: F.struct(r["path"].alias("path"), r["reason"].alias("reason"), r["score"].alias("score"), r["source"].alias("source"), r["role"].alias("role"), r["stage"].alias("stage"))).alias("selection_reasons"),
        "retrieval_summary", "dependency_notes", F.transform("bodies", lambda s: F.struct(s["key"].alias("key"), s["title"].alias("title"), estimate(s["body"]).alias("token_estimate"))).alias("sections"),
    )


def payloads(prompts: DataFrame) -> DataFrame:
    """task_id, target, system, user, metadata and the whole payload as one text."""
    codex = F.concat_ws("\n", F.lit("# Compiled Task"), "prompt", F.lit(""), F.lit("# Operating Notes"), F.concat(F.lit("Prompt ID: "), "prompt_id"), F.lit("Prefer editing the listed files directly."), F.lit("If context is omitted by budget, say so before making a risky change."))
    claude = F.concat_ws("\n", F.lit("Repository task brief:"), "prompt", F.lit(""), F.lit("Response expectations:"), F.concat(F.lit("- Prompt ID: "), "prompt_id"), F.lit("- Explain the plan briefly before major edits."), F.lit("- Note assumptions when context was omitted by budget."))
    is_claude = F.col("target") == "claude"
    x = prompts.select(
        "task_id", "target", "prompt_id", F.when(is_claude, SYSTEM["claude"]).otherwise(SYSTEM["codex"]).alias("system"), F.when(is_claude, claude).otherwise(codex).alias("user"),
        F.struct("prompt_id", "included_files", "related_tests", "omitted_paths", "token_estimate").alias("metadata"),
    )
    joined = lambda c: _or(F.array_join(F.col(f"metadata.{c}"), ", "), "None")
    whole = F.concat_ws(
        "\n", F.lit("# Target"), "target", F.lit(""), F.lit("# Prompt ID"), "prompt_id", F.lit(""), F.lit("# System"), "system", F.lit(""), F.lit("# User"), "user", F.lit(""), F.lit("# Metadata"),
        F.concat(F.lit("Included files: "), joined("included_files")), F.concat(F.lit("Related tests: "), joined("related_tests")), F.concat(F.lit("Omitted files: "), joined("omitted_paths")),
        F.concat(F.lit("Token estimate: "), F.col("metadata.token_estimate").cast("string")),
    )
    return x.withColumn("payload_text", whole)


def benchmark_report(runs: DataFrame) -> DataFrame:
    """n_tasks, average_total_ms, peak_tokens over runs(total_ms, token_estimate)."""
    return runs.agg(F.count(F.lit(1)).alias("n_tasks"), (F.coalesce(F.sum("total_ms"), F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("average_total_ms"), F.greatest(F.lit(0).cast("long"), F.coalesce(F.max("token_estimate"), F.lit(0).cast("long"))).alias("peak_tokens"))
