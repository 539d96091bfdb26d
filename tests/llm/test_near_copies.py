import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import exact_dedup, near_copies, simhash
from lodeweave.llm.common import table
from tests.llm.test_dedup import DOCS, ODD, roots


def grams(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def kept(rows):
    sets = [grams(t) for _, t in rows]
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    best = {}
    for (d, _), g in zip(rows, group):
        best[g] = min(best.get(g, (True, 0)), (d is None, d or 0))
    return sorted(str(None if none else d) for none, d in best.values())


def planted():
    rng = random.Random(11)
    words, rows = [f"w{i}" for i in range(300)], list(ODD)
    licence = [rng.choice(words) for _ in range(30)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 200]))]
        for k in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 + g * 20 + k, " ".join(own + licence * (g % 2))))
    return rows


def test_stage_matches_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as print", "2 as root", "3 as key")
    for steps in (32, 2):
        got = near_copies.one_of_each(df, steps)
        assert got.columns == df.columns
        assert sorted(str(r.doc_id) for r in got.collect()) == kept(rows), steps
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_clashing_names_ties_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, 1), (2, long + " end", 2), (3, "a b c", 3), (3, "a b c", 4), (None, "a b c", 5), (None, "q", 7), (None, "q", 6), (4, None, 8), (5, "", 9)]
    names = "`__print`", "`__ROOT`", "row", "id", "place", "size", "facts", "print", "bits", "n", "key", "of", "first", "root"
    df = spark.createDataFrame(rows, "doc_id long, text string, x long").selectExpr("*", *[f"x as {n}" for n in names], "map(x, x) as m")
    for stage in (near_copies.one_of_each, simhash.one_of_each, exact_dedup.distinct_rows):
        runs = [sorted((str(r.doc_id), r.x, r["__ROOT"], r.size) for r in stage(d).collect()) for d in (df, df.repartition(3), df.orderBy(F.desc("x")).coalesce(1))]
        assert runs[0] == runs[1] == runs[2]
        ids = [r[0] for r in runs[0]]
        assert ids == (["1", "3", "4", "None"] if stage != exact_dedup.distinct_rows else ["1", "2", "3", "4", "None"])
        assert stage(df).columns == df.columns


def test_pipeline_stage_finds_the_near_copies_of_the_documents(spark):
    docs = exact_dedup.distinct_rows(table(spark, "/root/testdata/sf0.01", "documents"))
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert sorted(map(str, got)) == kept([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert 2 in got and 56 not in got


def test_simhash_links_and_what_it_connects_is_not_met_again(spark, monkeypatch):
    met = []
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, texts, own=near_copies._verified: met.append({tuple(sorted((r.a, r.b))) for r in pairs.collect()}) or own(pairs, texts))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    copies = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in rng.sample(range(400), 12)]
    apart = [" ".join([f"v{g}x{i}" for i in range(60)] + base[g * 12 : g * 12 + 12]) for g in range(30)]  # share a passage with the others
    rows = list(enumerate([" ".join(base), *copies, *apart]))
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in got.collect()) == kept(rows)
    assert met[0] and not met[0] & met[1]
    assert len(met[0]) + len(met[1]) <= 40  # all pairs of copies would be 78


def made_by_pairs(spark, monkeypatch, rows):
    """What the stage keeps, and the rows of pairs that its tasks make."""
    made, docs = [], spark.createDataFrame(rows, "doc_id long, text string")
    own = type(docs).mapInPandas

    def counting(df, func, schema, *more):
        out = own(df, func, schema, *more)
        if schema.startswith("a long, b long, "):
            made.append(out.count())
        return out

    with monkeypatch.context() as here:
        here.setattr(type(docs), "mapInPandas", counting)
        got = sorted(str(r.doc_id) for r in near_copies.one_of_each(docs).collect())
    return got, sum(made)


def test_pairs_made_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]

    def copies(n):
        out = []
        for d in range(n):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append((d, " ".join(own)))
        return out

    for n in (100, 400):
        rows = copies(n)
        got, made = made_by_pairs(spark, monkeypatch, rows)
        assert got == kept(rows)
        assert made <= 10 * n, (n, made)


def test_long_texts_that_share_a_passage_are_not_all_verified(spark, monkeypatch):
    met = []
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, texts, own=near_copies._verified: met.append(pairs.count()) or own(pairs, texts))
    passage = [f"w{i}" for i in range(2000)]
    rows = [(d, " ".join(passage + [f"v{d}x{i}" for i in range(900)])) for d in range(12)] + [(100 + d, " ".join(passage + [f"u{d}x{i}" for i in range(60)])) for d in range(12)]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in got.collect()) == kept(rows) == sorted([*map(str, range(12)), "100"])
    assert sum(met) <= 40  # all pairs would be 276
