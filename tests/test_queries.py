import hashlib
import math

from lodeweave.plans import indexing, queries
from lodeweave.plans.engine import Engine
from lodeweave.schemas import BUDGET
from lodeweave.sources.store import Index

SF = "/root/testdata/sf0.001"


def tokens(text):
    return math.ceil(len(text.encode("utf-16-le")) / 2 / 4)


def described_by_hand(spark):
    """For each task its ranked files with the texts that a raw item and a summary of a document have."""
    content = {r.path: r.content for r in queries.files(spark, SF).collect()}
    parents = {e.src: e.dst for e in queries.edges(spark, SF).filter("kind = 'import'").collect()}
    symbols = {r.path: list(r.symbols) for r in queries.files(spark, SF).collect()}
    out = {}
    for r in sorted(queries._ranked(spark, SF).collect(), key=lambda r: (r.task_id, r.rank)):
        api = ", ".join(s["name"] for s in symbols[r.path] if s["kind"] in ("class", "function", "interface"))
        kept = f"Preserve exposed interfaces: {api}" if api else "Preserve observed behavior while editing this file."
        notes = f"Imports {parents[r.path]}" if r.path in parents else "None detected"
        short = f"Purpose: Supporting documentation relevant to the task. Reason: {r.reason} Public API: {api or 'None detected'} Key invariants: {kept} Dependencies: {notes}"
        out.setdefault(r.task_id, []).append((r.path, r.role, r.score, tokens(content[r.path]), tokens(short)))
    return out


def packed_by_hand(rows):
    caps = {k: math.floor(BUDGET["max"] * BUDGET[k]) for k in ("raw", "summary", "dependency", "tests")}
    used, items, omitted = dict.fromkeys(caps, 0), [], []
    for path, role, score, raw, short in rows:
        kind = "tests" if role == "test" else "dependency" if role in ("dependency", "semantic-support") else "summary"
        if (role in ("primary", "manual") or score >= 14) and used["raw"] + raw <= caps["raw"]:
            used["raw"] += raw
            items.append(f"{path}:raw")
        elif used[kind] + short <= caps[kind]:
            used[kind] += short
            items.append(f"{path}:summary")
        else:
            omitted.append(path)
    return ",".join(items), ",".join(omitted), *used.values(), sum(used.values())


def test_budget_pack_has_the_costs_of_the_texts(spark):
    got = {r.task_id: tuple(r)[1:] for r in queries.budget_pack(spark, SF).collect()}
    want = {t: packed_by_hand(rows) for t, rows in described_by_hand(spark).items()}
    assert got == want


def test_prompts_are_those_of_a_compile(spark):
    engine = Engine(spark)
    engine.store.write(Index(queries._sources(spark, SF), queries._chunks(spark, SF), queries.edges(spark, SF)))
    done = engine.compile_tasks(queries.tasks(spark, SF), remember=False)
    want = {r.task_id: r for r in done.prompts.collect()}
    got = {r.task_id: r for r in queries.compiled_prompts(spark, SF).collect()}
    assert {t: (r.prompt_id, r.used_total) for t, r in got.items()} == {t: (r.prompt_id, r.used_total) for t, r in want.items()}
    md5 = {r.task_id: hashlib.md5(r.user.encode()).hexdigest() for r in engine.format_for_target(done).collect()}
    assert {r.task_id: r.user_md5 for r in queries.agent_payloads(spark, SF).collect()} == md5
    texts = [r.prompt for r in want.values()]
    assert any("No raw files included." not in t for t in texts) and any("Imports docs/" in t for t in texts)
    assert any(r.used_raw for r in want.values()) and any(r.used_dependency for r in want.values())


def test_session_sequence_is_a_replay(spark):
    files = {r.path: r for r in queries._sources(spark, SF).collect()}
    caps = {k: math.floor(BUDGET["max"] * BUDGET[k]) for k in ("raw", "summary", "dependency", "tests")}
    best = {}
    for r in queries._ranked(spark, SF).collect():
        best.setdefault(r.task_id, []).append((r.score, r.path, r.role, r.reason))
    turns = [(r.conv_id * 1000 + r.turn, r.conv_id) for r in spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").collect()]
    of = {r.doc_id: r.path for r in files.values()}
    newest = [[of[c]] for _, c in sorted(turns, reverse=True) if c in of][:3]

    def cost(path, reason):
        api = ", ".join(s.name for s in files[path].symbols if s.kind in ("class", "function", "interface"))
        kept = f"Preserve exposed interfaces: {api}" if api else "Preserve observed behavior while editing this file."
        notes = f"Imports {files[path].imports[0]}" if files[path].imports else "None detected"
        return tokens(files[path].content), tokens(f"Purpose: Supporting documentation relevant to the task. Reason: {reason} Public API: {api or 'None detected'} Key invariants: {kept} Dependencies: {notes}")

    want = {}
    for task in sorted(r.task_id for r in queries.tasks(spark, SF).collect()):
        pins = list(dict.fromkeys([p for s in newest for p in s][:4]))
        rows = [(max(s, 1000.0), p, "manual", why if "Pinned by user" in why else f"{why}; Pinned by user") if p in pins else (s, p, role, why) for s, p, role, why in best.get(task, [])]
        rows += [(1000.0, p, "manual", "Pinned by user") for p in pins if p not in {r[1] for r in rows}]
        used, included = dict.fromkeys(caps, 0), []
        for score, path, role, why in sorted(rows, key=lambda r: (-r[0], r[1])):
            raw, short = cost(path, why)
            kind = "tests" if role == "test" else "dependency" if role in ("dependency", "semantic-support") else "summary"
            if (role in ("primary", "manual") or score >= 14) and used["raw"] + raw <= caps["raw"]:
                kind, short = "raw", raw
            if used[kind] + short <= caps[kind]:
                used[kind] += short
                included.append(path)
        want[task] = (",".join(sorted(pins)), ",".join(included), sum(used.values()))
        newest = [included, *newest][:3]
    got = {r.task_id: (r.pinned, r.included, r.used_total) for r in queries.session_sequence(spark, SF).collect()}
    assert got == want


def test_what_a_refresh_reuses_has_the_same_text(spark):
    key, stamp = ["path"], ["size", "modified_at_ms"]
    before, now = (indexing.contents(spark, SF, early) for early in (True, False))
    same = before.join(now, [*key, *stamp]).select(before["content"], now["content"]).collect()
    assert same and all(was == text for was, text in same)
    changed = before.join(now, key).filter((before["modified_at_ms"] != now["modified_at_ms"]) & (before["content"] != now["content"])).count()
    assert changed and before.join(now, key, "left_anti").count()
