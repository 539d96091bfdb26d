"""Tasks of a collection one after another, each with the sessions of those before it, in one job.

What a task selects feeds the next one by two things only: up to four files that become its pins, and the texts of the
newest sessions. Ranking doesn't depend on either, so all tasks are ranked at once; then a fold in the order
of the tasks carries the newest sessions as its state and packs numbers (costs of each candidate as it is, raised
by a pin, and of a file inserted by one). It hands each task its pins and lines; overrides, packing and
texts are then made for all tasks at once by the operators that a single compile uses.

Collections are independent and dealt to tasks by their ids; rows come sorted, so a collection of any length needs the
memory of a few sessions. The tasks of one collection are looked at in order: that is what feedback means.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import pack, retrieve, sessions
from lodeweave.operators.graph import by_path
from lodeweave.sources.shared import batch_rows, staged

#: Tasks that go to Python at once: each has a few dozen candidates with their costs, many times as large there.
TASKS_AT_ONCE = 64
_COST = ("found", "raw_preferred", "bucket", "raw_tokens", "summary_tokens")


def _costs(described: DataFrame, name: str) -> DataFrame:
    cost = F.struct("found", "raw_preferred", "bucket", F.coalesce("raw_tokens", F.lit(0)).alias("raw_tokens"), F.coalesce("summary_tokens", F.lit(0)).alias("summary_tokens"))
    return described.select("task_id", "repo_id", "path", "score", cost.alias(name))


def pinned_costs(paths: DataFrame, like: DataFrame, facts: DataFrame, lists: DataFrame, describe) -> DataFrame:
    """repo_id, path, place, cost of files of paths(repo_id, path) as a pin inserts them; place is the order of paths."""
    pins = paths.select(F.col("repo_id").alias("task_id"), "repo_id", F.array("path").alias("pinned"), F.array().cast("array<string>").alias("excluded"))
    none = like.limit(0).withColumn("task_id", F.col("repo_id"))
    cost = _costs(describe(retrieve.apply_overrides(none, pins, facts, lists)), "cost").select("repo_id", "path", "cost")
    order = ("repo_id", by_path())
    return staged(cost.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))


def _fits(used: int, tokens: int, cap: int) -> bool:
    return cap > 0 and used + tokens <= cap


def packed_paths(candidates: list[tuple], caps: dict[str, int]) -> list:
    """The paths that the packing includes, in its order; candidates: (-score, place, path, cost)."""
    used, out = dict.fromkeys(caps, 0), []
    for _, _, path, c in sorted(candidates, key=lambda x: x[:2]):
        kind = "raw" if c["raw_preferred"] and _fits(used["raw"], c["raw_tokens"], caps["raw"]) else c["bucket"]
        tokens = c["raw_tokens"] if kind == "raw" else c["summary_tokens"]
        if c["found"] and kind in caps and _fits(used[kind], tokens, caps[kind]):
            used[kind] += tokens
            out.append(path)
    return out


def _folder(caps: dict[str, int]):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, newest = object(), deque()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["repo_id"] != repo:
                    repo, newest = row["repo_id"], deque(maxlen=sessions.RECENT)
                known = {p["path"]: (p["place"], p["cost"]) for p in row["known"] if p["cost"] is not None}
                if row["kind"] == 0:
                    selected = list(row["selected"])
                else:
                    flat = [p for _, paths, _ in newest for p in paths]
                    memory = list(dict.fromkeys(flat[: sessions.MEMORY_PINS]))
                    out.append((row["task_id"], memory, [line for line, *_ in newest]))
                    excluded = set(row["excluded"])
                    pins = [p for p in dict.fromkeys([*row["pinned"], *memory]) if p not in excluded]
                    entries = {e["path"]: e for e in row["entries"] if e["path"] not in excluded}
                    candidates = [(-max(e["score"], retrieve.PINNED_SCORE), e["place"], p, e["raised"]) if p in pins else (-e["score"], e["place"], p, e["plain"]) for p, e in entries.items()]
                    for _, _, carried in newest:
                        known = carried | known
                    candidates += [(-retrieve.PINNED_SCORE, known[p][0], p, known[p][1]) for p in pins if p not in entries and p in known]
                    selected = packed_paths(candidates, caps)
                line = f"- {row['text']} [{', '.join(selected[: sessions.NOTED_FILES])}]"
                newest.appendleft((line, selected[: sessions.MEMORY_PINS], {p: known[p] for p in selected[: sessions.MEMORY_PINS] if p in known}))
            yield pd.DataFrame(out, columns=["task_id", "memory", "lines"])

    return fold


def fed(tasks: DataFrame, best: DataFrame, log: DataFrame, facts: DataFrame, lists: DataFrame, describe, budget: dict | None = None) -> DataFrame:
    """task_id, memory, lines: what each task has from the log and from the tasks before it, in the order of task ids.

    best: the ranked candidates of all tasks, before overrides; describe adds what a candidate costs, as pack.describe does.
    """
    none = F.array().cast("array<string>")
    asked = tasks.select("task_id", "repo_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("pinned", none).alias("pinned"), F.coalesce("excluded", none).alias("excluded"))
    recent = sessions.recent_sessions(log).select("repo_id", F.col("seq"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("selected_files", none).alias("selected"))
    recent = staged(recent)  # three a collection
    named = lambda df, c: df.select("repo_id", F.explode(c).alias("path"))
    paths = best.select("repo_id", "path").unionByName(named(asked, "pinned")).unionByName(named(recent, "selected")).distinct()
    pins = pinned_costs(paths, best, facts, lists, describe)
    all_pinned = best.groupBy("task_id", "repo_id").agg(F.collect_list("path").alias("pinned")).withColumn("excluded", none)  # a dozen paths
    plain, raised = _costs(describe(best), "plain"), _costs(describe(retrieve.apply_overrides(best, all_pinned, facts, lists)), "raised").drop("score", "repo_id")
    entries = plain.join(raised, ["task_id", "path"]).join(pins, ["repo_id", "path"])
    known = F.struct("path", "place", "cost")
    of_best = entries.groupBy("task_id").agg(F.collect_list(F.struct("path", "place", "score", "plain", "raised")).alias("entries"), F.collect_list(known).alias("best_known"))
    of_pins = named(asked.withColumn("repo_id", F.struct("task_id", "repo_id")), "pinned").select("repo_id.*", "path").distinct().join(pins, ["repo_id", "path"]).groupBy("task_id").agg(F.collect_list(known).alias("pin_known"))
    rows = asked.join(of_best, "task_id", "left").join(of_pins, "task_id", "left")
    empty = lambda c: F.coalesce(c, F.filter(F.array(F.get(c, F.lit(0))), lambda x: F.lit(False)))
    rows = rows.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), "task_id", "repo_id", "text", "pinned", "excluded", none.alias("selected"), empty("entries").alias("entries"), F.concat(empty("best_known"), empty("pin_known")).alias("known"))
    held = named(recent.withColumn("repo_id", F.struct("repo_id", "seq")), "selected").select("repo_id.*", "path").distinct().join(pins, ["repo_id", "path"]).groupBy("repo_id", "seq").agg(F.collect_list(known).alias("known"))
    old = recent.join(held, ["repo_id", "seq"], "left").select(
        F.lit(0).alias("kind"), "seq", F.lit(None).cast(tasks.schema["task_id"].dataType).alias("task_id"), "repo_id", "text", none.alias("pinned"), none.alias("excluded"), "selected",
        F.lit(None).cast(rows.schema["entries"].dataType).alias("entries"), empty("known").alias("known"),
    )
    ordered = rows.unionByName(old).repartition("repo_id").sortWithinPartitions("repo_id", "kind", "seq", "task_id")
    kind = tasks.schema["task_id"].dataType.simpleString()
    with batch_rows(tasks.sparkSession, TASKS_AT_ONCE):
        return staged(ordered.mapInPandas(_folder(pack.budget_caps(budget)), f"task_id {kind}, memory array<string>, lines array<string>"))
