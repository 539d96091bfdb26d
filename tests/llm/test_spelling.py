import random
import re
import zlib
from collections import Counter

from lodeweave.llm import spelling

DOCS = "doc_id long, text string"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, noise=31, least=7):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= 2}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(others[w]), n.get(form.get(w))))
    return sorted(map(repr, out))


def got(df, **options):
    return sorted(repr((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in spelling.variants(df, **options).collect())


def planted(seed=3):
    rng = random.Random(seed)
    base = ["government", "Regierungs", "francçais", "abcdefg", "aaaaaaaa", "Éléments", "cafeteria×x", "internationalization"]
    letters = "abcdefgxyzéÉ÷ß"
    rows = []
    for d in range(150):
        words = []
        for w in base:
            words += [w] * rng.choice([0, 2, 9])
            for _ in range(rng.randrange(3)):
                v = list(w)
                for _ in range(rng.choice([1, 1, 2])):
                    i = rng.randrange(len(v))
                    v[i : i + 1] = rng.choice([[], [rng.choice(letters)], [v[i], rng.choice(letters)]])
                words += ["".join(v)] * rng.choice([1, 2])
        rng.shuffle(words)
        rows.append((d, " ".join(words) + ". Short, ab1cdefgh_WORDWORD"))
    chain = {"wordsalad": 2000, "wordsalat": 180, "wortsalat": 15, "wortsalaat": 2}  # forms of forms
    rows.append((900, " ".join(w for w, c in chain.items() for _ in range(c))))
    return rows + [(901, None), (902, ""), (None, "government " * 40), (None, "government " * 40), (3, "x" * 60_000), (4, "x" * 60_000 + " " + "x" * 59_999), (5, "x" * 59_999)]


def test_variants_match_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as word", "2 as n", "3 as id")
    want = by_hand(rows)
    assert got(df, noise=31) == want
    assert got(df, noise=31, bucket=3) == want  # nearly every bucket is split by the edit
    assert got(df, noise=0) == by_hand(rows, noise=0)
    assert got(df.limit(0)) == []


def test_chains_end_at_their_roots(spark):
    rows = [(1, " ".join(["abcdefgh"] * 5000 + ["abcdefgx"] * 400 + ["abcdefyx"] * 30 + ["abcdezyx"] * 2))]
    found = {r.word: r.root for r in spelling.variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(found.values()) == {"abcdefgh"}


def test_a_stem_with_many_endings_is_split(spark):
    rng = random.Random(8)
    stem = "internatio"
    words = {stem + "".join(rng.choice("abcd") for _ in range(4)) + tail for tail in ("", "a", "b") for _ in range(150)}
    rows = [(d, " ".join(words)) for d in range(2)]
    df = spark.createDataFrame(rows, DOCS)
    assert got(df, bucket=64) == by_hand(rows, noise=0)
