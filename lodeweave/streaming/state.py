"""Overrides and hand-offs kept up to date from streams of actions, with a state for each key.

A stream may deliver rows more than once: an action counts if its number (seq, which grows) is over the last that
counted for its key, so replays change nothing. Actions of a key have to arrive in order from one micro-batch to the
next; within one they are put in order. An older one that comes later is left out, as a toggle can't be slipped in.
Hand-offs are kept by largest numbers alone, so theirs may come in any order.

Both are `update` streams: a key's row comes again when it changes, and `latest` keeps the last of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave.operators.sessions import KEPT_HANDOFFS
from lodeweave.sources.shared import shared_dir


def toggled(state: str, action: str) -> str:
    """The state of a path after one more action."""
    if action == "include":
        return "pinned"
    made = {"pin": "pinned", "exclude": "excluded"}[action]
    return "none" if state == made else made


def _types(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _override(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, now = state.get if state.exists else (None, "none")
    rows = pd.concat([b[["seq", "action"]] for b in batches]).drop_duplicates("seq").sort_values("seq")
    if last is not None:
        rows = rows[rows["seq"] > last]
    for action in rows["action"]:
        now = toggled(now, action)
    if len(rows):
        state.update((int(rows["seq"].iloc[-1]), now))
        yield pd.DataFrame({"repo_id": [key[0]], "path": [key[1]], "state": [now], "seq": [int(rows["seq"].iloc[-1])]})


def override_stream(actions: DataFrame) -> DataFrame:
    """repo_id, path, state (pinned, excluded, none), seq: as sessions.override_state tells, row by row of a stream (repo_id, seq, path, action)."""
    out = f"{_types(actions, 'repo_id', 'path')}, state string, seq bigint"
    return actions.select("repo_id", "path", "seq", "action").groupBy("repo_id", "path").applyInPandasWithState(_override, out, "seq bigint, state string", "update", GroupStateTimeout.NoTimeout)


def _handoff(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    numbers, prompts, compiled = state.get if state.exists else ([], [], -1)
    newest, was = dict(zip(prompts, numbers)), (list(numbers), list(prompts), compiled)
    for rows in batches:
        for kind, prompt, seq in zip(rows["kind"], rows["prompt_id"], rows["seq"].tolist()):
            if kind == "compile":
                compiled = max(compiled, seq)
            else:
                newest[prompt] = max(newest.get(prompt, -1), seq)
        newest = dict(sorted(newest.items(), key=lambda x: -x[1])[:KEPT_HANDOFFS])  # one that falls out comes back by a larger number only
    now = (list(newest.values()), list(newest), compiled)
    if now != was:
        state.update(now)
        pending = compiled > max(now[0], default=-1)
        yield pd.DataFrame({"repo_id": [key[0]], "prompt_ids": [now[1]], "pending": [pending], "seq": [max([compiled, *now[0]])], "changes": [sum(now[0]) + compiled]})


def handoff_stream(log: DataFrame) -> DataFrame:
    """repo_id, prompt_ids (the newest hand-offs, as sessions.handoff_history lists them), pending, seq: of a stream (repo_id, seq, kind: compile or handoff, prompt_id)."""
    prompt = log.schema["prompt_id"].dataType.simpleString()
    out = f"{_types(log, 'repo_id')}, prompt_ids array<{prompt}>, pending boolean, seq bigint, changes bigint"
    return log.select("repo_id", "seq", "kind", "prompt_id").groupBy("repo_id").applyInPandasWithState(_handoff, out, f"seqs array<bigint>, prompts array<{prompt}>, compiled bigint", "update", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, keys: tuple[str, ...], order: str = "seq", folder: str | None = None) -> DataFrame:
    """Run an update stream over what is there now, and the last row of each key.

    folder keeps checkpoint and rows, so that a later call goes on from there; a batch that is run again replaces its rows.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    )
    query.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), order).alias("last"))
    return last.select(*keys, "last.*")
