"""The block index of chunks, trigram postings, walks as minima, and edges after a refresh, each against a naive version."""

import random
import re

import numpy as np

from pyspark.sql import functions as F

from lodeweave import schemas
from lodeweave.operators import dense, graph, index, retrieve, topk

WORDS = ["fix", "bug", "login", "log", "session", "auth", "gin", "a1", "zz", "authentication", "token", "ses", "ion"]


def naive(tasks, chunks):
    stop = {"the", "and", "for", "with"}
    out = {}
    for t, repo, text, *_ in tasks:
        terms = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 3 and w not in stop))
        grams = [g for w in terms for g in ([w] if len(w) < 4 else [w[i : i + 3] for i in range(len(w) - 2)])]
        scored = []
        for r, cid, path, _, line, _, _, body in chunks:
            vec = {}
            for w in [w for w in re.split("[^a-z0-9]+", body.lower()) if len(w) >= 2] + grams:
                vec[w] = vec.get(w, 0) + 1
            norm = sum(v * v for v in vec.values())
            boost = 0.0
            for w in terms:
                boost += 0.1 if w in body.lower() or w in path.lower() else 0.0
            score = sum(vec.get(w, 0) for w in terms) / (len(terms) ** 0.5 * norm**0.5) + boost if terms and norm else boost
            if r == repo and score > 0.18:
                scored.append((-round(score, 9), path, line, cid))
        if scored:
            out[t] = [c for *_, c in sorted(scored)[:16]]
    return out


def test_block_index_finds_what_all_pairs_find(spark, monkeypatch):
    rng = random.Random(5)
    chunks = [(f"r{i % 2}", f"c{i}", f"src/{rng.choice(WORDS)}{i // 3:03d}.ts", "code", i % 3 * 24 + 1, 2, 3, " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(240)]
    chunks += [("r0", f"same{i}", f"src/copy{i:03d}.ts", "code", 1, 2, 3, "login session") for i in range(60)]  # equal scores: the first paths count
    chunks += [("r1", "empty", "zz/!.ts", "code", 1, 1, 1, "..."), ("r1", "long", "zz/long.ts", "code", 1, 1, 1, "login " * 5000)]
    tasks = [(f"t{i}", f"r{i % 3}", " ".join(rng.choices(WORDS, k=rng.randint(0, 6))), "codex", [], []) for i in range(24)]
    want = naive(tasks, chunks)
    asked, table = retrieve.analyzed(spark.createDataFrame(tasks, schemas.TASKS)), spark.createDataFrame(chunks, schemas.CHUNKS).repartition(3)
    for block, passes in ((256, 2048), (7, 5)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "TASKS", passes)
        got = {}
        for r in retrieve.semantic_chunks(asked, table).collect():
            got.setdefault(r.task_id, []).append((r["rank"], r.id))
        assert {t: [c for _, c in sorted(x)] for t, x in got.items()} == want
    assert retrieve.semantic_chunks(asked, table.limit(0)).count() == 0
    rows = topk.best_chunks(asked, topk.block_index(table), 16, 0.18)
    parts = rows.withColumn("p", F.spark_partition_id()).groupBy("p", "task_id").count().agg(F.max("count")).first()[0]
    assert parts <= 16


def test_a_search_in_slices_of_tasks_and_small_reads_finds_the_same(spark, monkeypatch):
    rng = random.Random(8)
    chunks = [("r", f"c{i}", f"src/{rng.choice(WORDS)}{i:03d}.ts", "code", 1, 2, 3, " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in range(90)]
    tasks = [(f"t{i}", "r", " ".join(rng.choices(WORDS, k=rng.randint(1, 6))), "codex", [], []) for i in range(23)]
    for name, value in (("BLOCK", 8), ("BLOCKS_MADE", 1), ("BLOCKS_AT_ONCE", 2), ("TASKS_AT_ONCE", 5)):
        monkeypatch.setattr(topk, name, value)
    made = topk._blocks

    def watched(schema):
        blocks = made(schema)

        def small(batches):
            def told(rows):
                for x in rows:
                    if x.num_rows > 8:
                        raise ValueError(f"{x.num_rows} chunks at once")
                    yield x

            return blocks(told(batches))

        return small

    monkeypatch.setattr(topk, "_blocks", watched)
    got = {}
    for r in retrieve.semantic_chunks(retrieve.analyzed(spark.createDataFrame(tasks, schemas.TASKS)), spark.createDataFrame(chunks, schemas.CHUNKS)).collect():
        got.setdefault(r.task_id, []).append((r["rank"], r.id))
    assert {t: [c for _, c in sorted(x)] for t, x in got.items()} == naive(tasks, chunks)


def test_holders_are_the_tokens_that_contain_a_term(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc1") for _ in range(n))
    tokens = list({("r", word(rng.randint(1, 12))) for _ in range(300)} | {("s", "abcabc")})
    terms = list({("r", word(rng.randint(3, 5))) for _ in range(60)} | {("s", "zzz"), ("s", "bca")})
    got = retrieve.holders(spark.createDataFrame(tokens, "repo_id string, token string"), spark.createDataFrame(terms, "repo_id string, term string")).collect()
    assert sorted(map(tuple, got)) == sorted((r, t, m) for r, t in tokens for q, m in terms if q == r and m in t)


def walked(seeds, edges, tests):
    """Seeds and walks of one or two edges in the order of a breadth-first search, event by event."""
    steps = {}
    for src, dst, kind, weight in edges:
        steps.setdefault(src, []).append((kind, dst, weight))
    best = {}

    def event(path, score, role, distance, reason, trail):
        if path not in best:
            best[path] = [reason, score, role, distance, trail]
        elif score > best[path][1]:
            best[path] = [reason, score, role, distance, trail]
        elif reason not in best[path][0]:
            best[path][0] += "; " + reason

    def text(seed, kind, source, to):
        return {"import": f"{to} imported by {source} from seed {seed}", "test": f"{to} is a related test for {source}", "reference": f"{to} referenced by {source} from seed {seed}", "caller": f"{to} calls or is called from {source}"}.get(kind, f"{to} reached through {kind} edge from {source}")

    for path, score, reason, role in seeds:
        event(path, score, role, 0, reason, [path])
    for seed, score, *_ in seeds:
        first = sorted(steps.get(seed, []))
        for kind, dst, weight in first:
            event(dst, max(1, score - 2 + weight), "test" if kind == "test" or dst in tests else "dependency", 1, text(seed, kind, seed, dst), [seed, dst])
        for _, src, _ in first:
            for kind, dst, weight in sorted(steps.get(src, [])):
                event(dst, max(1, score - 4 + weight), "test" if kind == "test" or dst in tests else "semantic-support", 2, text(seed, kind, src, dst), [seed, src, dst])
    return sorted((p, *x) for p, x in best.items())


def expanded(spark, seeds, edges, tests):
    paths = sorted({p for s, d, *_ in edges for p in (s, d)} | {s[0] for s in seeds})
    files = spark.createDataFrame([("r", p, p in tests) for p in paths], "repo_id string, path string, is_test boolean")
    start = spark.createDataFrame([("t", "r", i + 1, p, float(s), why, role) for i, (p, s, why, role) in enumerate(seeds)], "task_id string, repo_id string, seed_rank int, path string, score double, reason string, role string")
    got = graph.expand_seeds(start, spark.createDataFrame([("r", *e) for e in edges], schemas.EDGES), files).collect()
    return sorted((r.path, r.reason, r.structural_score, r.role, r.dependency_distance, list(r.expansion_path)) for r in got)


def test_walks_are_those_of_a_search(spark):
    rng = random.Random(4)
    paths = [f"p{i:02d}" for i in range(14)]
    edges = list({(rng.choice(paths), rng.choice(paths), rng.choice(["import", "caller", "callee", "reference", "test"])): rng.randint(2, 5) for _ in range(70)}.items())
    edges = [(*k, w) for k, w in edges]
    seeds = [("p03", 9, "Path matches", "primary"), ("p07", 9, "Other", "test"), ("p01", 4, "Third", "primary")]
    assert expanded(spark, seeds, edges, {"p02", "p05"}) == walked(seeds, edges, {"p02", "p05"})


def test_a_hub_of_ten_thousand_edges(spark):
    edges = [e for i in range(10_000) for e in (("hub", f"n{i:05d}", "caller", 3), (f"n{i:05d}", "hub", "import", 5))]
    got = expanded(spark, [("hub", 20, "Seed", "primary")], edges, set())
    assert len(got) == 10_001
    hub = got[0]
    # the first walk back has a larger score than the seed, so its reason is the first
    assert hub[:3] == ("hub", "; ".join(f"hub imported by n{i:05d} from seed hub" for i in range(10_000)), 21.0)


FILE = "repo_id string, path string, size bigint, modified_at_ms double, is_test boolean, " + schemas.PARSED


def repository(rng, n):
    files = {}
    for i in range(n):
        files[f"src/{'ab'[i % 2]}/m{i:02d}.py"] = made(rng, f"src/{'ab'[i % 2]}/m{i:02d}.py", n)
    return files


def made(rng, path, n):
    names = [f"n{k}" for k in range(12)]
    target = lambda: rng.choice([f"../{rng.choice('ab')}/m{rng.randrange(n):02d}", f"./m{rng.randrange(n):02d}", f"m{rng.randrange(n):02d}.py"])
    symbols = [(f"{path}#m", path, "module", path, True)] + [(f"{path}#{x}", x, "function", path, False) for x in rng.sample(names, rng.randint(0, 3))]
    bindings = [(rng.choice(names), target()) for _ in range(rng.randint(0, 2))]
    return ("r", path, rng.randrange(10**9), 0.0, rng.random() < 0.2, [target() for _ in range(rng.randint(0, 2))], symbols, rng.sample(names, rng.randint(0, 4)), rng.sample(names, rng.randint(0, 4)), bindings)


def test_refreshed_edges_equal_a_full_build(spark):
    rng = random.Random(6)
    files = repository(rng, 24)
    now = spark.createDataFrame(list(files.values()), FILE)
    fixed = lambda e: spark.createDataFrame(e.collect(), schemas.EDGES)
    edges = fixed(graph.build_edges(now))
    for step in range(4):
        later = dict(files)
        for path in rng.sample(sorted(later), 3):  # change, remove, move
            kind = rng.choice(["change", "remove", "move"]) if step else "remove"
            old = later.pop(path)
            if kind == "change":
                later[path] = made(rng, path, 24)
            elif kind == "move":
                to = f"src/c/{path[-6:]}"
                later[to] = made(rng, to, 24)
        if step == 2:
            later["src/a/m00.py"], later["lib/n/m01.py"] = made(rng, "src/a/m00.py", 24), made(rng, "lib/n/m01.py", 24)
        before, before_edges = now, edges
        now = spark.createDataFrame(list(later.values()), FILE)
        changes = index.snapshot_changes(before, now)
        edges = fixed(graph.refreshed_edges(before, now, before_edges, changes))
        assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, graph.build_edges(now).collect())), step
        files = later


def test_a_refresh_looks_only_at_stale_files(spark):
    rng = random.Random(9)
    files = {f"p{i}.py": ("r", f"p{i}.py", i, 0.0, False, [f"./p{i + 1}"], [(f"p{i}#f{i}", f"f{i}", "function", f"p{i}.py", True)], [f"f{i + 1}"], [], []) for i in range(30)}
    before = spark.createDataFrame(list(files.values()), FILE)
    files["p7.py"] = ("r", "p7.py", 99, 0.0, False, [], [("p7#g", "g", "function", "p7.py", True)], [], [], [])
    now = spark.createDataFrame(rng.sample(list(files.values()), 30), FILE)
    stale = graph.stale_sources(before, now, index.snapshot_changes(before, now))
    assert {r.path for r in stale.collect()} == {"p7.py", "p6.py"}  # p6 used the name that is gone


def test_dense_index_finds_what_all_pairs_find(spark, monkeypatch):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 3
    x = np.round(np.concatenate([middles[i % 12] + rng.normal(size=16) * 0.4 for i in range(900)]).reshape(-1, 16), 3)
    x[100:160] = x[100]  # equal vectors: the smallest ids count
    x[7] = 0
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    u = dense.unit(x)
    score = np.round(u @ u.T, 10)
    np.fill_diagonal(score, -np.inf)
    want = sorted((i * 3, int(j) * 3, r + 1) for i in range(0, 900, 20) for r, j in enumerate(np.lexsort((np.arange(900), -score[i]))[:8]))
    monkeypatch.setattr(dense, "BLOCK", 32)
    monkeypatch.setattr(dense, "QUERY_BYTES", 4000)
    report = {}
    got = dense.nearest(vectors.filter("id % 60 = 0"), vectors, 8, report)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == want
    assert report["scanned"]() < 0.6
    assert dense.nearest(vectors.limit(0), vectors, 8).count() == 0 and dense.nearest(vectors.filter("id = 0"), vectors.limit(0), 8).count() == 0


def test_a_search_holds_few_blocks_and_no_lists_of_numbers(spark, monkeypatch):
    rows = [(f"r{i}", f"a{i}#1-1", f"a{i}.md", "doc", 1, 1, 3, f"alpha beta w{i}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "repo_id string, id string, file_path string, kind string, start_line int, end_line int, token_estimate long, text string")
    asked = spark.createDataFrame([(i, f"r{i}", ["alpha", "beta"]) for i in range(40)], "task_id long, repo_id string, terms array<string>")
    blocks = topk.block_index(chunks).coalesce(1)
    real, most = topk._searcher, topk.BLOCKS_AT_ONCE

    def watched(*given):
        search = real(*given)

        def checked(batches):
            def few():
                for batch in batches:
                    assert batch.num_rows <= most
                    yield batch

            return search(few())

        return checked

    monkeypatch.setattr(topk, "_searcher", watched)
    assert topk.best_chunks(asked, blocks, 16, 0.18).count() == 40
    batch = blocks.toArrow().to_batches()[0]
    assert all(isinstance(topk._row(batch, 0)[c], np.ndarray) for c in ("ends", "holders", "counts", "norms"))


def test_patterns_of_symbols_are_tried_once(spark):
    files = spark.createDataFrame([("r", "a.py", 1, 1.0, "def a(): b()\nclass b\ndef a()")], "repo_id string, path string, size long, modified_at_ms double, content string")
    found = index.file_records(files).select("symbols")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("def[") == 1
    assert [s.name for s in found.first().symbols] == ["a.py", "b", "a"]
