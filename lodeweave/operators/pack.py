"""Greedy packing of ranked candidates into four token budgets, one fold for each task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.schemas import BUDGET

ITEM = "struct<rank:int,path:string,compression:string,bucket:string,estimated_tokens:bigint>"


def budget_caps(budget: dict | None = None) -> dict[str, int]:
    b = BUDGET | (budget or {})
    return {k: math.floor(b["max"] * b[k]) for k in ("raw", "summary", "dependency", "tests")}


def _notes(imports: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(imports) > 0, F.array(F.concat(F.lit("Imports "), F.array_join(F.slice(imports, 1, 5), ", ")))).otherwise(none)


def describe(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with what a raw item and a summary item would say and cost.

    files: repo_id, path, language, symbols, imports, content; candidates whose file is gone have null costs.
    A column `own_summary` in ranked, from a provider, takes the place of the built summary.
    """
    own = F.col("own_summary") if "own_summary" in ranked.columns else F.lit(None).cast("string")
    #: Tokens are counted before the join: what asks for costs alone then shuffles no contents.
    have = files.select("repo_id", "path", "content", "imports", T.preserved_interfaces(F.col("symbols")).alias("api"), T.token_estimate(F.col("content")).alias("raw_tokens"), F.lit(True).alias("found"))
    x = ranked.join(have, ["repo_id", "path"], "left").withColumn("notes", _notes(F.col("imports")))
    has_api, names = F.size("api") > 0, F.array_join("api", ", ")
    #: The wording of raw items and summaries.
    purpose = (
        F.when(F.col("language") == "markdown", "Supporting documentation relevant to the task.")
        .when(F.col("role") == "dependency", "Dependency needed to understand or modify the primary target.")
        .when(F.col("role") == "test", "Test coverage related to the primary target.")
        .otherwise("Primary implementation context for the task.")
    )
    kept = F.when(has_api, F.concat(F.lit("Preserve exposed interfaces: "), names)).otherwise("Preserve observed behavior while editing this file.")
    raw_purpose = F.when(F.col("role").isin("primary", "manual"), "Raw implementation preserved because it is a high-priority editing surface.").otherwise("Raw source preserved because its implementation details are likely material.")
    raw_kept = F.when(has_api, F.concat(F.lit("Do not break "), names)).otherwise("Preserve implementation behavior.")
    none = F.lit("None detected")
    summary = F.concat_ws(
        " ", F.concat(F.lit("Purpose: "), purpose), F.concat(F.lit("Reason: "), "reason"), F.concat(F.lit("Public API: "), F.when(has_api, names).otherwise(none)),
        F.concat(F.lit("Key invariants: "), kept), F.concat(F.lit("Dependencies: "), F.when(F.size("notes") > 0, F.array_join("notes", "; ")).otherwise(none)),
    )
    summary = F.coalesce(own, summary)
    return x.select(
        *[c for c in ranked.columns if c != "own_summary"], F.coalesce("found", F.lit(False)).alias("found"), "content", "api", "notes",
        purpose.alias("summary_purpose"), kept.alias("summary_invariant"), summary.alias("summary_text"), T.token_estimate(summary).alias("summary_tokens"),
        raw_purpose.alias("raw_purpose"), raw_kept.alias("raw_invariant"), F.concat(raw_purpose, F.lit(" Reason: "), "reason").alias("raw_text"), "raw_tokens",
        T.keep_raw(F.col("role"), F.col("score")).alias("raw_preferred"), T.bucket(F.col("role")).alias("bucket"),
    )


def pack(described: DataFrame, budget: dict | None = None) -> DataFrame:
    """task_id, items, omitted, and tokens used of each budget.

    In order of rank: raw if preferred and the raw budget has room, else a summary if its bucket has
    room, else omitted; smaller items after one that didn't fit still may.
    """
    caps = budget_caps(budget)
    entry = F.struct("rank", "path", "found", "raw_preferred", "bucket", F.coalesce("raw_tokens", F.lit(0)).alias("raw_tokens"), F.coalesce("summary_tokens", F.lit(0)).alias("summary_tokens"))
    tasks = described.groupBy("task_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(k) for k in caps], F.array().cast(f"array<{ITEM}>").alias("items"), F.array().cast("array<string>").alias("omitted"))

    def fits(used: Column, tokens: Column, cap: int) -> Column:
        return (used + tokens <= cap) if cap > 0 else F.lit(False)

    def item(e: Column, compression: str, bucket: Column, tokens: Column) -> Column:
        return F.array(F.struct(e["rank"].alias("rank"), e["path"].alias("path"), F.lit(compression).alias("compression"), bucket.alias("bucket"), tokens.alias("estimated_tokens")).cast(ITEM))

    def step(s: Column, e: Column) -> Column:
        raw = e["found"] & e["raw_preferred"] & fits(s["raw"], e["raw_tokens"], caps["raw"])
        room = F.lit(False)
        for k in ("summary", "dependency", "tests"):
            room = room | ((e["bucket"] == k) & fits(s[k], e["summary_tokens"], caps[k]))
        short = e["found"] & ~raw & room
        used = [(s["raw"] + F.when(raw, e["raw_tokens"]).otherwise(0)).alias("raw")]
        used += [(s[k] + F.when(short & (e["bucket"] == k), e["summary_tokens"]).otherwise(0)).alias(k) for k in ("summary", "dependency", "tests")]
        items = F.when(raw, F.concat(s["items"], item(e, "raw", F.lit("raw"), e["raw_tokens"]))).when(short, F.concat(s["items"], item(e, "summary", e["bucket"], e["summary_tokens"]))).otherwise(s["items"])
        omitted = F.when(raw | short, s["omitted"]).otherwise(F.concat(s["omitted"], F.array(e["path"])))
        return F.struct(*used, items.alias("items"), omitted.alias("omitted"))

    packed = tasks.select("task_id", F.aggregate("entries", start, step).alias("s"))
    total = F.col("s.raw") + F.col("s.summary") + F.col("s.dependency") + F.col("s.tests")
    return packed.select("task_id", "s.items", "s.omitted", *[F.col(f"s.{k}").alias(f"used_{k}") for k in caps], total.alias("used_total"))


def context_items(described: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed items with their texts, a row each."""
    chosen = packed.select("task_id", F.explode("items").alias("i")).select("task_id", F.col("i.path").alias("path"), F.col("i.compression").alias("compression"), F.col("i.estimated_tokens").alias("estimated_tokens"))
    raw = F.col("compression") == "raw"
    pick = lambda a, b: F.when(raw, F.col(a)).otherwise(F.col(b))
    return described.join(chosen, ["task_id", "path"]).select(
        "task_id", "rank", "path", "compression", "estimated_tokens", pick("raw_text", "summary_text").alias("summary"), pick("raw_purpose", "summary_purpose").alias("purpose"), F.col("api").alias("public_api"),
        F.array(pick("raw_invariant", "summary_invariant")).alias("key_invariants"), F.col("notes").alias("dependency_notes"), F.col("reason").alias("inclusion_reason"), F.when(raw, F.coalesce("content", F.lit(""))).alias("content"), F.col("api").alias("preserved_interfaces"),
    )
