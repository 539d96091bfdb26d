import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodeweave.llm import phrases

DOCS = "text string, lang string"


def by_hand(rows, least=100, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = set()
    for lang, p in found:
        for q, b in found.items():
            if q[0] == lang and len(q[1]) > len(p) and b >= found[lang, p] and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))):
                inside.add((lang, p))
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(repr((lang, i + 1, p.decode(), -a, x, y, n[lang], -s)) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def got(df, **options):
    return sorted(repr((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score)) for r in phrases.collocations(df, **options).collect())


def planted(seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "New", "YORK", "city", "a.b", "straße", "ÉCOLE", "x y", "(z)", "a", "'s"]
    fixed = ["as a matter of fact", "New York City", "a a a a a a a", "in order to win the game", "straße der ÉCOLE"]
    rows = []
    for _ in range(900):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 9))]
        rows.append((rng.choice([" ", "\t ", ". ", ", ", "\n", "\r\n", "\x0b", "!"]).join(parts), rng.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), ("!?.", "de"), (" the of " * 20_000, "fr"), ("word " * 150_000, "fr")]


def test_collocations_match_brute_force(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as phrase", "2 as n", "3 as k", "4 as total")
    want = by_hand(rows)
    assert len(want) > 25 and any("matter of fact" in x for x in want)
    assert got(df) == want
    monkeypatch.setattr(phrases, "CHUNK", 300)  # texts are looked at in parts
    assert got(df) == want
    assert got(df, top=3, most_bits=19) == by_hand(rows, top=3)
    assert got(df, longest=3, least=20) == by_hand(rows, 20, 3)
    assert got(df.limit(0)) == []


def test_counts_do_not_depend_on_what_the_map_lets_through(spark, monkeypatch):
    rows = planted(5)
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(phrases, "bit_map", lambda frequent, bits: __import__("numpy").full(1 << max(bits, phrases.SEGMENT) - 3, 255, "uint8"))
    assert got(df) == by_hand(rows)


def test_products_beyond_64_bits_are_exact(spark):
    n, a, x, y = 9_999_999_999_989, 99_999_999_977, 1_234_567_890_123, 987_654_321_987
    counts = spark.createDataFrame([("en", "x", 1, x), ("en", "y", 1, y), ("en", "x y", 2, a)], "lang string, phrase string, k int, n long")
    row = phrases.scored(counts, spark.createDataFrame([("en", n)], "lang string, total long")).first()
    assert (row.score, row.l, row.r) == (1000 * a * n // (x * y), x, y)


def test_rank_is_cut_in_two_steps(spark):
    rows = [(f"w{i} v{i}. " * (2 + i % 3), "en") for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    assert got(df, least=2, top=50) == by_hand(rows, 2, 5, 50)
    assert phrases.collocations(df.withColumn("lang", F.lit(None).cast("string")), least=2, top=1).first().lang == "und"
