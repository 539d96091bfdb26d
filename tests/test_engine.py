import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodeweave import schemas
from lodeweave.operators import compile as C
from lodeweave.operators import fold, graph, index, pack, retrieve, sessions
from lodeweave.plans import cli
from lodeweave.plans.engine import Engine, Providers
from lodeweave.sources.repository import contents_of, read_repository
from lodeweave.sources.store import Index, ParquetStore, SessionLog, export_json, import_json
from lodeweave.streaming.refresh import keep_current

TREE = {
    "src/auth.ts": "import { hashPassword } from './crypto';\n\nexport class AuthService {\n  run() { return loginUser(); }\n}\n\nexport function loginUser() {\n  return hashPassword('x');\n}\n",
    "src/crypto.ts": "export const hashPassword = async (value: string) => {\n  return value;\n};\n",
    "tests/auth.test.ts": "import { loginUser } from '../src/auth';\n\nloginUser();\n",
    "docs/auth.md": "# Auth\n\nLogin flow documentation.\n",
    "node_modules/ignored.ts": "export const no = 1;\n",
    ".github/ci.yml": "on: push\n",
    "__tests__/x.test.ts": "",
    "src/__init__.py": "def start():\n    return run()\n",
    ".env.example": "A=1\n",
    "image.png": "no",
}


@pytest.fixture
def tree(tmp_path):
    for path, text in TREE.items():
        os.makedirs(tmp_path / "r" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "r" / path).write_text(text)
    return str(tmp_path / "r")


def test_scan_sees_hidden_names_and_skips_others(spark, tree):
    got = {r.path: r for r in read_repository(spark, tree, "r").collect()}
    assert set(got) == set(TREE) - {"node_modules/ignored.ts", "image.png"}
    assert got["src/auth.ts"].content == TREE["src/auth.ts"] and got["src/auth.ts"].size == len(TREE["src/auth.ts"])
    table = spark.createDataFrame([("r", p, 1, 0.0, t) for p, t in TREE.items()], schemas.CONTENTS)
    assert {r.path for r in contents_of(table).collect()} == set(got)


def test_index_of_a_small_tree(spark, tree):
    e = Engine(spark)
    made = e.index_repository(tree, "r")
    files = {r.path: r for r in made.files.collect()}
    auth = files["src/auth.ts"]
    assert auth.language == "typescript" and not auth.is_test and auth.imports == ["./crypto"]
    assert [(s.name, s.kind) for s in auth.symbols] == [("auth.ts", "module"), ("AuthService", "class"), ("loginUser", "function")]
    assert [(s.name, s.kind, s.exported) for s in files["src/__init__.py"].symbols] == [("__init__.py", "module", True), ("start", "function", False)]
    edges = {(r.src, r.dst, r.kind): r.weight for r in made.edges.collect()}
    assert edges[("src/auth.ts", "src/crypto.ts", "import")] == 5 and edges[("src/auth.ts", "src/crypto.ts", "reference")] == 2
    assert edges[("src/auth.ts", "src/crypto.ts", "caller")] == 4 and edges[("tests/auth.test.ts", "src/auth.ts", "test")] == 4
    assert ("src/crypto.ts", "src/auth.ts", "caller") in edges
    m = e.metrics.first()
    assert (m.added_files, m.changed_files, m.removed_files, m.reused_files, m.reused_chunks, m.reused_edges) == (8, 0, 0, 0, 0, 0)
    d = e.diagnostics().first()
    assert d.file_count == 8 and d.test_count == 2 and d.edge_count == len(edges)
    assert "typescript:4" in index.breakdown_text(made.files).first().languages


def test_incremental_index(spark, tree, tmp_path):
    e = Engine(spark, ParquetStore(spark, f"{tmp_path}/state"))
    first = {r.path: r for r in e.index_repository(tree, "r").files.collect()}
    time.sleep(0.02)
    open(f"{tree}/src/auth.ts", "w").write("export const changed = 1;\n")
    os.remove(f"{tree}/docs/auth.md")
    again = e.index_repository(tree, "r")
    m = e.metrics.first()
    assert (m.added_files, m.changed_files, m.removed_files, m.reused_files) == (0, 1, 1, 6) and m.reused_chunks == 5
    now = {r.path: r for r in again.files.collect()}
    assert now["src/crypto.ts"] == first["src/crypto.ts"] and now["src/auth.ts"].imports == []
    assert again.edges.filter("src = 'src/auth.ts' and kind = 'import'").count() == 0


def symbol(path, name, kind):
    return (f"{path}#{'module' if kind == 'module' else kind + ':' + name}", name, kind, path, True)


def golden(spark):
    f = [
        ("src/auth.ts", "typescript", 100, False, [("auth.ts", "module"), ("AuthService", "class"), ("loginUser", "function")], "AuthService loginUser authentication flow hashPassword"),
        ("src/crypto.ts", "typescript", 50, False, [("crypto.ts", "module"), ("hashPassword", "function")], "hashPassword crypto dependency"),
        ("tests/auth.test.ts", "typescript", 40, True, [("auth.test.ts", "test")], "auth login test coverage"),
        ("docs/auth-architecture.md", "markdown", 120, False, [("auth-architecture.md", "module")], None),
    ]
    rows = [("r", p, lang, size, 1.0, test, text, [], [symbol(p, n, k) for n, k in syms], [], [], []) for p, lang, size, test, syms, text in f]
    files = spark.createDataFrame(rows, schemas.FILES)
    chunks = spark.createDataFrame([("r", f"{p}#1-{n}", p, kind, 1, n, t, text) for p, n, kind, t, text in [("src/auth.ts", 8, "code", 20, f[0][5]), ("src/crypto.ts", 4, "code", 12, f[1][5]), ("tests/auth.test.ts", 4, "test", 10, f[2][5])]], schemas.CHUNKS)
    edges = spark.createDataFrame([("r", "src/auth.ts", "src/crypto.ts", "import", 5), ("r", "tests/auth.test.ts", "src/auth.ts", "test", 4)], schemas.EDGES)
    return Index(files, chunks, edges)


def task(spark, text, pinned=(), excluded=(), target="codex", task_id="t", repo="r"):
    return spark.createDataFrame([(task_id, repo, text, target, list(pinned), list(excluded))], schemas.TASKS)


def test_golden_ranking(spark):
    g = golden(spark)
    a = retrieve.analyzed(task(spark, "refactor authentication login flow")).first()
    assert a.intent == "refactor" and a.terms == ["refactor", "authentication", "login"]
    got = retrieve.retrieve(task(spark, "refactor authentication login flow"), g.files, g.chunks, g.edges).orderBy("rank").collect()
    assert [(r.path, r.role, r.stage) for r in got] == [("src/crypto.ts", "dependency", "graph"), ("src/auth.ts", "primary", "seed"), ("tests/auth.test.ts", "test", "semantic")]
    assert [r.score for r in got] == pytest.approx([23.56, 18.744550473755904, 0.8370170592217174], abs=1e-12)
    assert "imported by" in got[0].reason and got[1].chunk_ids == ["src/auth.ts#1-8"]


def naive_expand(seeds, edges, tests):
    """A breadth-first search with replacement, one step after another."""
    out = {p: dict(score=float(s), reason=f"seed {p}", distance=0) for p, s in seeds}
    by = {}
    for e in sorted(edges, key=lambda e: (e[2], e[1])):
        by.setdefault(e[0], []).append(e)
    for seed, score in seeds:
        queue = [(seed, 0)]
        while queue:
            at, d = queue.pop(0)
            if d >= 2:
                continue
            for _, to, kind, weight in by.get(at, []):
                s = max(1.0, score - 2 * (d + 1) + weight)
                text = {"import": f"{to} imported by {at} from seed {seed}", "test": f"{to} is a related test for {at}", "reference": f"{to} referenced by {at} from seed {seed}", "caller": f"{to} calls or is called from {at}"}.get(kind, f"{to} reached through {kind} edge from {at}")
                if to not in out or out[to]["score"] < s:
                    out[to] = dict(score=s, reason=text, distance=d + 1)
                elif text not in out[to]["reason"]:
                    out[to]["reason"] += "; " + text
                queue.append((to, d + 1))
    return out


def test_expansion_equals_a_sequential_search(spark):
    rng = random.Random(11)
    seeds, edges, files, want = [], [], [], {}
    for g in range(60):
        names = [f"f{i}" for i in range(rng.randint(2, 7))]
        own = list({(a, b, k): (a, b, k, w) for a, b, k, w in ((rng.choice(names), rng.choice(names), rng.choice(["import", "caller", "callee", "reference", "test"]), rng.randint(2, 5)) for _ in range(rng.randint(1, 12)))}.values())
        start = sorted(((n, rng.randint(1, 12)) for n in rng.sample(names, min(len(names), rng.randint(1, 5)))), key=lambda x: (-x[1], x[0]))
        files += [(f"r{g}", n, False) for n in names]
        edges += [(f"r{g}", *e) for e in own]
        seeds += [(f"t{g}", f"r{g}", i + 1, n, float(s), f"seed {n}", "primary") for i, (n, s) in enumerate(start)]
        want |= {(f"t{g}", p): v for p, v in naive_expand(start, own, ()).items()}
    got = graph.expand_seeds(spark.createDataFrame(seeds, "task_id string, repo_id string, seed_rank int, path string, score double, reason string, role string"), spark.createDataFrame(edges, schemas.EDGES), spark.createDataFrame(files, "repo_id string, path string, is_test boolean")).collect()
    assert {(r.task_id, r.path): dict(score=r.structural_score, reason=r.reason, distance=r.dependency_distance) for r in got} == want


def test_documentation_hit_and_overrides(spark):
    rows = [("r", "docs/session-reliability.md", "markdown", 100, 1.0, False, "", [], [symbol("docs/session-reliability.md", "session-reliability.md", "module")], [], [], []), ("r", "src/auth.ts", "typescript", 80, 1.0, False, "", [], [symbol("src/auth.ts", "auth.ts", "module")], [], [], [])]
    files = spark.createDataFrame(rows, schemas.FILES)
    chunks = spark.createDataFrame([("r", "docs/session-reliability.md#1-4", "docs/session-reliability.md", "doc", 1, 4, 8, "session reliability notes")], schemas.CHUNKS)
    edges = spark.createDataFrame([], schemas.EDGES)
    t = task(spark, "improve session reliability documentation")
    best = retrieve.retrieve(t, files, chunks, edges)
    r = best.filter("path like 'docs%'").first()
    assert r.structural_score == 26 and r.role == "primary" and "Semantic vector match" in r.reason
    over = spark.createDataFrame([("t", "r", ["src/auth.ts", "gone.ts", "docs/session-reliability.md"], ["docs/session-reliability.md"])], "task_id string, repo_id string, pinned array<string>, excluded array<string>")
    got = retrieve.apply_overrides(best, over, retrieve.file_facts(files), retrieve.chunk_lists(chunks)).collect()
    assert [(r.path, r.source, r.role, r.stage, r.score) for r in got] == [("src/auth.ts", "manual", "manual", "override", 1000.0)]


def test_chunk_scores_match_a_naive_model(spark):
    rng = random.Random(5)
    words = ["fix", "bug", "login", "log", "session", "auth", "gin", "the", "a1", "zz", "authentication"]
    chunks = [("r", f"c{i}", f"src/{rng.choice(words)}{i}.ts", "code", 1, 2, 3, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(80)]
    tasks = [(f"t{i}", "r", " ".join(rng.choices(words, k=rng.randint(0, 6))), "codex", [], []) for i in range(12)]
    got = {}
    for r in retrieve.semantic_chunks(retrieve.analyzed(spark.createDataFrame(tasks, schemas.TASKS)), spark.createDataFrame(chunks, schemas.CHUNKS)).collect():
        got.setdefault(r.task_id, []).append((r.rank, r.id, r.score))
    stop = {"the", "and", "for", "with"}
    import re

    for t, _, text, *_ in tasks:
        terms = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 3 and w not in stop))
        grams = [g for w in terms for g in ([w] if len(w) < 4 else [w[i : i + 3] for i in range(len(w) - 2)])]
        scored = []
        for _, cid, path, *_, body in chunks:
            vec = {}
            for w in [w for w in re.split("[^a-z0-9]+", body.lower()) if len(w) >= 2] + grams:
                vec[w] = vec.get(w, 0) + 1
            norm = sum(v * v for v in vec.values()) ** 0.5
            cos = sum(vec.get(w, 0) for w in terms) / (len(terms) ** 0.5 * norm) if terms and norm else 0
            s = cos + 0.1 * sum(w in body.lower() or w in path.lower() for w in terms)
            if s > 0.18:
                scored.append((-round(s, 9), path, cid))
        want = [c for *_, c in sorted(scored)[:16]]
        assert [c for _, c, _ in sorted(got.get(t, []))] == want, t


def test_suffix_join_equals_a_scan(spark):
    rng = random.Random(9)
    part = lambda: "/".join(rng.choices(["a", "b", "src", "x"], k=rng.randint(1, 3)))
    paths = sorted({part() + rng.choice([".ts", ".md", "/index.ts", ""]) for _ in range(40)})
    imports = list({(rng.choice(paths), rng.choice(["./", "../", ""]) + part()) for _ in range(150)})
    got = {(r.src, r.module): r.dst for r in graph.resolve_modules(spark.createDataFrame([("r", *i) for i in imports], "repo_id string, src string, module string"), spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")).collect()}
    import posixpath
    import re

    norm = lambda p: re.sub(r"(?i)/index$", "", re.sub(r"(?i)\.(tsx?|jsx?|mjs|py|md|json)$", "", p))
    want = {}
    order = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(F.expr("p COLLATE UNICODE")).collect()
    for s, m in imports:
        i = norm(posixpath.normpath(posixpath.join(posixpath.dirname(s), m)))
        for (p,) in order:
            c = norm(p)
            if c == i or c.endswith("/" + i) or i.endswith("/" + c):
                want[(s, m)] = p
                break
    assert got == want


BUDGET = {"max": 80, "raw": 0.5, "summary": 0.2, "dependency": 0.2, "tests": 0.1}


def test_packing_under_a_small_budget(spark):
    names = [("src/auth.ts", 20.0, "primary", "x" * 44), ("src/session.ts", 15.0, "primary", "y" * 30), ("src/crypto.ts", 12.0, "dependency", "z"), ("tests/auth.test.ts", 10.0, "test", "w"), ("gone.ts", 9.0, "primary", None)]
    ranked = spark.createDataFrame([("t", "r", p, i + 1, s, role, "why", "typescript") for i, (p, s, role, _) in enumerate(names)], "task_id string, repo_id string, path string, rank int, score double, role string, reason string, language string")
    files = spark.createDataFrame([("r", p, c, ["./crypto"], [symbol(p, "f", "function")]) for p, _, _, c in names if c], f"repo_id string, path string, content string, imports array<string>, symbols array<{schemas.SYMBOL}>")
    described = pack.describe(ranked, files)
    got = pack.pack(described, BUDGET).first()
    assert [(i.path, i.compression, i.estimated_tokens) for i in got["items"]] == [("src/auth.ts", "raw", 11), ("src/session.ts", "raw", 8)]
    assert got.omitted == ["src/crypto.ts", "tests/auth.test.ts", "gone.ts"] and got.used_total == 19
    none = pack.pack(described, {"max": 0}).first()
    assert none["items"] == [] and len(none.omitted) == 5
    items = pack.context_items(described, pack.pack(described)).orderBy("rank").collect()
    assert items[0].content == "x" * 44 and items[2].summary.startswith("Purpose: Dependency needed") and "Dependencies: Imports ./crypto" in items[2].summary


def test_packing_equals_a_sequential_fold(spark):
    rng = random.Random(13)
    rows, want = [], {}
    caps = pack.budget_caps({"max": 200})
    for t in range(40):
        used, items, omitted = dict.fromkeys(caps, 0), [], []
        for k in range(rng.randint(0, 12)):
            e = dict(found=rng.random() > 0.1, raw=rng.random() > 0.5, bucket=rng.choice(["summary", "dependency", "tests"]), rt=rng.randint(0, 60), st=rng.randint(0, 30))
            rows.append((t, k + 1, f"p{k}", e["found"], e["raw"], e["bucket"], e["rt"], e["st"]))
            if e["found"] and e["raw"] and used["raw"] + e["rt"] <= caps["raw"]:
                used["raw"] += e["rt"]
                items.append((f"p{k}", "raw"))
            elif e["found"] and used[e["bucket"]] + e["st"] <= caps[e["bucket"]]:
                used[e["bucket"]] += e["st"]
                items.append((f"p{k}", "summary"))
            else:
                omitted.append(f"p{k}")
        if any(r[0] == t for r in rows):
            want[t] = (items, omitted, used)
    df = spark.createDataFrame(rows, "task_id int, rank int, path string, found boolean, raw_preferred boolean, bucket string, raw_tokens long, summary_tokens long")
    got = {r.task_id: ([(i.path, i.compression) for i in r["items"]], r.omitted, {k: r[f"used_{k}"] for k in caps}) for r in pack.pack(df, {"max": 200}).collect()}
    assert got == want


def test_compile_end_to_end(spark, tree, tmp_path):
    e = Engine(spark, ParquetStore(spark, f"{tmp_path}/i"), SessionLog(spark, f"{tmp_path}/s"))
    e.index_repository(tree, "r")
    two = task(spark, "fix authentication login", task_id="a").unionByName(task(spark, "update the auth documentation", target="claude", task_id="b", excluded=["src/crypto.ts"]))
    done = e.compile_tasks(two)
    rows = {r.task_id: r for r in done.prompts.collect()}
    assert rows["a"].prompt.startswith("# Task\nfix authentication login\n\n# Operating Constraints\n") and "Recent session context: none" in rows["a"].prompt
    assert [s.key for s in rows["a"].sections] == [k for k, *_ in C.SECTIONS]
    assert "src/auth.ts" in rows["a"].included_files and "src/crypto.ts" not in rows["b"].included_files
    assert all(len(r.prompt_id) == 12 for r in rows.values())
    pays = {r.task_id: r for r in e.format_for_target(done).collect()}
    assert pays["a"].system.startswith("You are Codex") and pays["b"].user.startswith("Repository task brief:") and f"Prompt ID: {rows['b'].prompt_id}" in pays["b"].user
    assert "# Metadata\nIncluded files: " in pays["a"].payload_text and "Omitted files: " in pays["a"].payload_text
    third = e.compile_tasks(task(spark, "something else", task_id="c")).prompts.first()
    assert "Recent session context:\n- update the auth documentation [" in third.prompt and third.selection_reasons[0].score == 1000
    assert e.explain_selection(task(spark, "x", task_id="d")).filter("role = 'manual'").count() > 0
    assert e.memory.read().count() == 3 and e.memory.compact(f"{tmp_path}/s2").read().count() == 3


def test_batch_equals_single_tasks(spark):
    g = golden(spark)
    texts = ["refactor authentication login flow", "fix hashPassword", "add docs", "nothing here", ""]
    every = spark.createDataFrame([(f"t{i}", "r", t, "codex", [], []) for i, t in enumerate(texts)], schemas.TASKS)
    e = Engine(spark)
    e.store.write(g)
    batch = {r.task_id: r.prompt_id for r in e.compile_tasks(every, remember=False).prompts.collect()}
    single = {f"t{i}": e.compile_tasks(every.filter(f"task_id = 't{i}'"), remember=False).prompts.first().prompt_id for i in range(len(texts))}
    assert batch == single


def test_providers_and_benchmark(spark, tree):
    e = Engine(spark, providers=Providers(summarizer=lambda d: d.withColumn("own_summary", F.lit("short")), estimate=F.length), budget={"raw": 0.0})
    report = e.benchmark(read_repository(spark, tree, "r"), task(spark, "fix login", task_id="a").unionByName(task(spark, "auth", task_id="b"))).first()
    assert report.n_tasks == 2 and report.peak_tokens > 500 and report.index_ms > 0
    assert "short Public API" in e.compile_in_order(task(spark, "auth login", task_id="z"))[0].prompts.first().prompt


def test_files_changed_after_indexing_are_read_again(spark, tree):
    old = Engine(spark)
    old.index_repository(tree, "r")
    new = Engine(spark, store=old.store, reread=True)
    new.roots = old.roots
    t = task(spark, "fix auth login crypto")
    with open(f"{tree}/src/auth.ts", "a") as f:
        f.write("// added later\n")
    os.remove(f"{tree}/src/crypto.ts")
    states = {r.path: r.state for r in new.candidate_files(new._ranked(t)).collect()}
    assert states["src/auth.ts"] == "stale" and states["src/crypto.ts"] == "gone" and states["tests/auth.test.ts"] == "same"
    before, after = (e.compile_tasks(t, remember=False).prompts.first() for e in (old, new))
    assert "added later" not in before.prompt and "added later" in after.prompt and after.used_raw > 0
    assert "src/crypto.ts" in before.included_files and "src/crypto.ts" in after.omitted_paths


def test_trees_are_listed_by_levels(spark, tmp_path):
    for n in range(40):
        os.makedirs(tmp_path / f"a{n % 5}/b{n}/c/node_modules")
        (tmp_path / f"a{n % 5}/b{n}/c/f{n}.ts").write_text("x" * n)
        (tmp_path / f"a{n % 5}/b{n}/c/node_modules/no.ts").write_text("")
    (tmp_path / "top.md").write_text("t")
    os.makedirs(tmp_path / "own")
    (tmp_path / "own/x.ts").write_text("")
    os.symlink(tmp_path / "top.md", tmp_path / "link.md")
    got = {r.path: r.size for r in read_repository(spark, str(tmp_path), "r").collect()}
    assert got == {f"a{n % 5}/b{n}/c/f{n}.ts": n for n in range(40)} | {"top.md": 1, "own/x.ts": 0}
    fewer = read_repository(spark, str(tmp_path), "r", ignored=("a0", "own", "node_modules"))
    assert fewer.count() == 33 and contents_of(fewer.select("*"), ignored=("a1",)).count() == 25


def test_json_round_trip(spark, tree, tmp_path):
    e = Engine(spark)
    made = e.index_repository(tree, "r")
    export_json(made, f"{tmp_path}/j", parts=5)
    parts = sorted(p for p in os.listdir(tmp_path / "j") if p.startswith("part-"))
    whole = json.loads("".join((tmp_path / "j" / p).read_text() for p in parts))
    assert len(parts) == 5 and whole["repo_id"] == "r" and [f["path"] for f in whole["files"]] == sorted(f["path"] for f in whole["files"])
    assert [len(whole[t]) for t in ("files", "chunks", "edges")] == [getattr(made, t).count() for t in ("files", "chunks", "edges")]
    back = import_json(spark, f"{tmp_path}/j")
    for t in ("files", "chunks", "edges"):
        a, b = getattr(made, t), getattr(back, t)
        assert sorted(map(str, b.select(*a.columns).collect())) == sorted(map(str, a.collect()))
    assert import_json(spark, f"{tmp_path}/none") is None and ParquetStore(spark, f"{tmp_path}/none").read() is None


def test_a_sequence_is_what_tasks_in_order_are(spark, tree):
    asked = [("a", "r", "fix login hash", [], []), ("b", "r", "session docs", ["src/__init__.py", "gone.ts"], ["src/auth.ts"]), ("c", "r", "crypto", [], ["docs/auth.md"])]
    tasks = spark.createDataFrame([(i, repo, text, "codex", pins, out) for i, repo, text, pins, out in asked], schemas.TASKS)
    done = []
    for way in ("compile_in_order", "compile_sequence"):
        e = Engine(spark, budget={"max": 240})
        e.index_repository(tree, "r")
        e.memory.append(spark.createDataFrame([("r", 1, "z", "before", "p", ["docs/auth.md", "src/crypto.ts", "left.ts"], [], None)], schemas.SESSIONS))
        made = getattr(e, way)(tasks)
        rows = [r for x in (made if isinstance(made, list) else [made]) for r in x.prompts.select("task_id", "prompt", "included_files", "omitted_paths").collect()]
        log = e.memory.read().orderBy("repo_id", "seq").select("repo_id", "task_id", "selected_files").collect()
        done.append((sorted(map(tuple, rows)), log))
    assert done[0] == done[1]
    assert len({tuple(r[2]) for r in done[0][0]}) > 1
    assert "- before [docs/auth.md, src/crypto.ts, left.ts]" in done[1][0][0][1]


def test_an_index_of_a_session_takes_no_memory_of_executors(spark, tree):
    e = Engine(spark)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    made = e.index_repository(tree, "r")
    assert made.files.count() and made.chunks.count() and made.edges.count()
    assert not any(t.storageLevel.useMemory for t in (made.files, made.chunks, made.edges))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_a_sequence_looks_at_a_few_tasks_at_once(spark, tree, monkeypatch):
    texts = ["fix login hash", "session docs", "crypto", "login", "auth session", "hash"]
    tasks = spark.createDataFrame([(f"t{i}", "r", text, "codex", [], []) for i, text in enumerate(texts)], schemas.TASKS)
    folder = fold._folder

    def watched(caps):
        own = folder(caps)

        def few(batches):
            def told(rows):
                for x in rows:
                    if len(x) > 2:
                        raise ValueError(f"{len(x)} tasks at once")
                    yield x

            return own(told(batches))

        return few

    done = []
    for some in (False, True):
        if some:
            monkeypatch.setattr(fold, "TASKS_AT_ONCE", 2)
            monkeypatch.setattr(fold, "_folder", watched)
        e = Engine(spark, budget={"max": 240})
        e.index_repository(tree, "r")
        done.append(sorted(map(tuple, e.compile_sequence(tasks).prompts.select("task_id", "prompt", "included_files").collect())))
    assert done[0] == done[1] and len(done[0]) == 6


def test_session_rules(spark):
    log = spark.createDataFrame([("r", i, f"text{i}", [f"f{i}", "same", f"g{i}"]) for i in range(1, 30)] + [("q", 1, "t", [])], "repo_id string, seq long, text string, selected_files array<string>")
    assert [r.seq for r in sessions.recent_sessions(log).filter("repo_id = 'r'").orderBy("recency").collect()] == [29, 28, 27]
    assert sessions.retained(log).filter("repo_id = 'r'").count() == 20
    assert {r.repo_id: r.memory for r in sessions.memory_pins(log).collect()} == {"r": ["f29", "same", "g29", "f28"], "q": []}
    t = task(spark, "x", pinned=["a", "b", "a"], excluded=["b", "f29"])
    assert sessions.merged_overrides(t, sessions.memory_pins(log)).first().pinned == ["a", "same", "g29", "f28"]
    assert sessions.session_lines(t, log).first().lines[0] == "- text29 [f29, same, g29]"


def test_override_actions_equal_a_replay(spark):
    rng = random.Random(3)
    rows, state = [], {}
    for i in range(600):
        p, a = f"p{rng.randrange(25)}", rng.choice(["pin", "pin", "exclude", "include"])
        rows.append(("r", i, p, a))
        s = state.get(p, "none")
        state[p] = "pinned" if a == "include" else {"pin": "none" if s == "pinned" else "pinned", "exclude": "none" if s == "excluded" else "excluded"}[a]
    got = sessions.override_state(spark.createDataFrame(rows, "repo_id string, seq long, path string, action string")).collect()
    assert {r.path: r.state for r in got} == state


def test_handoffs(spark):
    log = spark.createDataFrame([("r", i, f"p{i % 7}", "codex") for i in range(20)], "repo_id string, seq long, prompt_id string, target string")
    assert [r.prompt_id for r in sessions.handoff_history(log).orderBy("position").collect()] == ["p5", "p4", "p3", "p2", "p1"]
    compiles = spark.createDataFrame([("r", 25), ("q", 1)], "repo_id string, seq long")
    assert {r.repo_id: r.pending for r in sessions.pending_approval(compiles, log.filter("seq < 25")).collect()} == {"r": True, "q": True}


def test_chunks_at_the_edges(spark):
    cases = {"crlf.ts": "a\r\nb\r\n", "long.ts": "x\n" * 24, "empty.ts": "", "blank.md": "\n\n \n", "d.md": "\n".join(map(str, range(30))), "t.test.md": "\n".join(map(str, range(30)))}
    files = index.file_records(spark.createDataFrame([("r", p, len(t), 0.0, t) for p, t in cases.items()], schemas.CONTENTS))
    got = sorted((r.id, r.kind, r.text.count("\n") + 1) for r in index.chunk_files(files).collect())
    assert got == [("crlf.ts#1-3", "code", 2), ("d.md#1-12", "doc", 12), ("d.md#13-24", "doc", 12), ("d.md#25-30", "doc", 6), ("long.ts#1-24", "code", 24), ("t.test.md#1-24", "test", 24), ("t.test.md#25-30", "test", 6)]


def test_stream_keeps_the_index_current(spark, tmp_path):
    e = Engine(spark, ParquetStore(spark, f"{tmp_path}/i"))
    put = lambda rows: spark.createDataFrame(rows, schemas.CONTENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schemas.CONTENTS).parquet(f"{tmp_path}/in")
    put([("r", "a.ts", 1, 1.0, "export function a() {}"), ("r", "b.ts", 1, 1.0, "x")])
    assert keep_current(stream(), e, f"{tmp_path}/c", once=True).awaitTermination(120)
    put([("r", "a.ts", 2, 2.0, "export function b() {}"), ("r", "b.ts", 0, 2.0, None), ("r", "c.md", 1, 1.0, "# c")])
    assert keep_current(stream(), e, f"{tmp_path}/c", once=True).awaitTermination(120)
    got = {r.path: [s.name for s in r.symbols] for r in e.store.read().files.collect()}
    assert got == {"a.ts": ["a.ts", "b"], "c.md": ["c.md"]}


def test_command_line(spark, tree, tmp_path):
    at = ["--root", tree, "--state", f"{tmp_path}/state"]
    assert "nothing" in cli.main([*at, "doctor"], spark)
    assert "added_files=8" in cli.main([*at, "index"], spark)
    assert cli.main([*at, "ask", "fix login", "--target", "claude"], spark).startswith("# Target\nclaude")
    assert "path=src/crypto.ts" in cli.main([*at, "explain-selection", "login", "--pin", "src/crypto.ts"], spark)
    assert "file_count=8" in cli.main([*at, "doctor"], spark)
