import random
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from lodeweave.llm import components, exact_dedup, simhash

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b "), (7, "Ab"), (8, "x" * 100_000), (9, "x" * 100_000), (4, "a b"), (None, "ab"), (10, " ab"), (None, "lonely")]


@given(st.sets(st.integers(0, 2**20 - 1), min_size=1))
def test_golomb_round_trip(values):
    own = np.array(sorted(values), np.int64)
    k, unary, rest = exact_dedup.golomb_encode(own, 2**20)
    assert exact_dedup.golomb_decode(len(own), k, unary, rest).tolist() == own.tolist()


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        text = text or ""
        groups["".join(c for c in text if c not in exact_dedup.BLANKS)].append((-len(text), doc is None, doc or 0, doc))
    out = {}
    for norm, own in groups.items():
        keep = min(own, key=lambda x: x[:3])[3]
        for x in own:
            out[(x[3], norm)] = (keep, len(own))
    return out


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, " ".join(rng.choice(["a", "b", "c "]) for _ in range(rng.randint(0, 6)))) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("doc_id", "text", "1 as block", "2 as digest")
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), str(k), n) for (d, _), (k, n) in brute_exact(rows).items())
    assert sorted({(str(r.doc_id), str(r.keep_id), r.group_size) for r in got}) == sorted(set(want))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_distinct_rows_keep_whole_rows(spark):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ODD)], "doc_id long, text string, block int")
    got = exact_dedup.distinct_rows(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len({"".join((r.text or "").split()) for r in rows if " " not in (r.text or "")}) == len(rows) - 1
    assert sorted(str(r.doc_id) for r in rows) == sorted(["3", "6", "7", "8", "10", "None"])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.distinct_rows(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text, words=3):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [w for w in parts.split(" ") if w]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_fingerprints_match_brute_force():
    for text in [None, "", " \n", "One", "one TWO", "Ä ä A a\x0bb", "a b c d e f g", "x " * 70_000, *(t for _, t in ODD)]:
        assert simhash.majority(simhash.shingle_hashes(text)) == brute_print(text), text


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for c in centres.tolist():  # dense groups, and a chain
        for _ in range(60):
            prints.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    chain = 5
    for b in range(0, 60, 3):
        chain ^= 7 << b
        prints.add(chain)
    prints = sorted(prints)
    want = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    for limit in (1024, 20, 4):
        at = {p: i for i, p in enumerate(prints)}
        got = roots(len(prints), [(at[r.a % 2**64], at[r.b % 2**64]) for r in simhash.close_links(df, limit=limit).collect()])
        assert got == want, limit


def test_near_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = list(ODD)
    for g in range(20):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(300)] = rng.choice(words)
            rows.append((1000 + g * 10 + k, " ".join(own)))
    prints = [brute_print(t) for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = defaultdict(list)
    for (d, _), r in zip(rows, want):
        least[r] += [] if d is None else [d]
    got = simhash.near_groups(spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as print", "2 as root")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(d), f"{p:016x}", str(min(least[r], default=None))) for (d, _), p, r in zip(rows, prints, want))
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(min(v, default=None)) for v in least.values())


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((50, 30), (200, 150)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)]
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = roots(n + 41, links)
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert got == {i: want[i] for i in linked}
