import random

from pyspark.sql import functions as F

from lodeweave.operators import sessions
from lodeweave.streaming import state

ACTIONS = "repo_id string, seq long, path string, action string"
LOG = "repo_id string, seq long, kind string, prompt_id string"


def arriving(spark, folder, schema, parts):
    """A stream that reads one file at a time, in order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}")


def test_overrides_of_a_stream_equal_the_batch_however_often_rows_come(spark, tmp_path):
    rng = random.Random(3)
    rows = [("r" if i % 3 else "q", i, f"p{rng.randrange(6)}", rng.choice(["pin", "pin", "exclude", "include"])) for i in range(120)]
    parts = [rows[:50], rows[:50], rows[20:80] + rows[60:90], rows[90:]]  # delivered twice, and again within a batch
    got = state.latest(state.override_stream(arriving(spark, f"{tmp_path}/in", ACTIONS, parts)), ("repo_id", "path"), folder=f"{tmp_path}/out")
    want = sessions.override_state(spark.createDataFrame(rows, ACTIONS))
    assert sorted(map(tuple, got.drop("seq").collect())) == sorted(map(tuple, want.collect()))


def test_a_stopped_stream_goes_on_and_late_actions_stay_out(spark, tmp_path):
    source = arriving(spark, f"{tmp_path}/in", ACTIONS, [[("r", 5, "p", "pin")]])
    run = lambda: [(r.path, r.state) for r in state.latest(state.override_stream(source), ("repo_id", "path"), folder=f"{tmp_path}/out").collect()]
    assert run() == [("p", "pinned")]
    spark.createDataFrame([("r", 4, "p", "exclude"), ("r", 5, "p", "pin"), ("r", 6, "p", "pin")], ACTIONS).write.parquet(f"{tmp_path}/in/001")
    assert run() == [("p", "none")]
    assert run() == [("p", "none")]


def test_handoffs_of_a_stream_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    handoffs = [("r", i, "handoff", f"p{rng.randrange(9)}") for i in range(0, 60, 2)] + [("q", 3, "handoff", "a")]
    compiles = [("r", i, "compile", f"p{i}") for i in range(1, 60, 7)] + [("q", 2, "compile", "a"), ("s", 1, "compile", "b")]
    rows = handoffs + compiles
    rng.shuffle(rows)
    parts = [rows[:30], rows[10:], rows]
    got = {r.repo_id: r for r in state.latest(state.handoff_stream(arriving(spark, f"{tmp_path}/in", LOG, parts)), ("repo_id",), order="changes", folder=f"{tmp_path}/out").collect()}
    log = spark.createDataFrame(handoffs, LOG)
    want = {}
    for r in sessions.handoff_history(log).orderBy("position").collect():
        want.setdefault(r.repo_id, []).append(r.prompt_id)
    assert {k: v.prompt_ids for k, v in got.items()} == want | {"s": []}
    pending = {r.repo_id: r.pending for r in sessions.pending_approval(spark.createDataFrame(compiles, LOG), log).collect()}
    assert {k: v.pending for k, v in got.items()} == pending


def test_a_stream_without_rows(spark, tmp_path):
    source = arriving(spark, f"{tmp_path}/in", ACTIONS, [[]])
    assert state.latest(state.override_stream(source), ("repo_id", "path")).filter(F.lit(True)).count() == 0
