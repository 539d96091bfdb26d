"""op6 and op7 against plain versions: loops over characters, dictionaries of counts, sums of look-ups."""

import bisect
import math
import zlib

import numpy as np

from lodeweave.llm import language, quality
from lodeweave.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, " \n "), (9004, "Été 2024! | $$ x\nx\n\nX"), (9005, "ab " * 20_000), (9006, "日本語 テスト"), (9007, "1234 5678"), (9004, "again the same id")]


def fold(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def grams(text):
    """Buckets of the letter trigrams, and of word ends, one character after another."""
    low, out = (text or "").lower(), []
    for i, c in enumerate(low):
        if c.isalpha():
            a, d = (low[j] if 0 <= j < len(low) and low[j].isalpha() else "\0" for j in (i - 1, i + 1))
            h = (ord(a) * 0x9E3779B97F4A7C15 + ord(c) * 0xC2B2AE3D27D4EB4F + ord(d) * 0x165667B19E3779F9) % (1 << 64)
            out.append(h >> 48)
    return out


def mixture(p, n):
    """Expectation-maximisation over rows of likelihoods."""
    share, total = [1 / len(p)] * len(p), sum(n)
    for _ in range(language.STEPS):
        new = [0.0] * len(p)
        for g, times in enumerate(n):
            whole = sum(s * q[g] for s, q in zip(share, p))
            for k, q in enumerate(p):
                new[k] += times * share[k] * q[g] / whole / total
        done = max(abs(a - b) for a, b in zip(share, new)) < 1e-4
        share = new
        if done:
            break
    return share, sum(times * math.log(sum(s * q[g] for s, q in zip(share, p))) for g, times in enumerate(n))


def predicted(text, likelihood):
    counts = {}
    for g in grams(text):
        counts[g] = counts.get(g, 0) + 1
    if not counts:
        return "und", 0.0
    p = {x: [f(g) for g in counts] for x, f in likelihood.items()}
    n = list(counts.values())
    alone = {x: sum(c * math.log(v) for c, v in zip(n, q)) for x, q in p.items()}
    chosen = [max(sorted(alone), key=lambda x: alone[x])]
    share, like, penalty = [1.0], alone[chosen[0]], 0.5 * math.log(sum(n) + 1)
    while len(chosen) < len(p):
        mixed = [sum(s * p[x][g] for s, x in zip(share, chosen)) for g in range(len(n))]
        slopes = {x: sum(c * q / m for c, q, m in zip(n, p[x], mixed)) / sum(n) - 1 for x in sorted(p) if x not in chosen}
        best = max(slopes, key=lambda x: slopes[x])
        if slopes[best] <= 0:
            break
        new, better = mixture([p[x] for x in [*chosen, best]], n)
        if better - like <= penalty:
            break
        chosen, share, like = [*chosen, best], new, better
    score, lang = max(zip(share, chosen), key=lambda x: x[0])
    return lang, min(1.0, score)


def test_languages_match_a_plain_mixture(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(d, t, None) for d, t in ODD], "doc_id long, text string, lang string"))
    rows, counts = docs.collect(), {}
    for r in rows:
        if fold(r.doc_id, 4) != 2 and r.lang is not None and r.text is not None:
            own = counts.setdefault(r.lang, {})
            for g in grams(r.text):
                own[g] = own.get(g, 0) + 1
    size = {x: sum(own.values()) for x, own in counts.items()}
    likelihood = {x: (lambda g, own=own, x=x: float(np.float32((own.get(g, 0) + 0.5) / (size[x] + 0.5 * 65536)))) for x, own in counts.items()}
    got = {}
    for r in language.predict_languages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 5), r.held_out))
    short = [r for r in rows if len(r.text or "") < 3000][:60] + [r for r in rows if r.doc_id > 9000]
    for r in short:
        lang, score = predicted(r.text, likelihood)
        assert any(x == lang and abs(s - score) < 1e-4 and h == (fold(r.doc_id, 4) == 2) for x, s, h in got[r.doc_id]), r.doc_id


def features(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 18
    share = lambda signs: sum(c in signs for c in raw) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / len(words), math.log1p(max(map(len, words))), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#$%&*+/<=>@\\^_`{}~[]"), share(b".,;:?"), share(b"!"),
        share(b" \t\n\r\x0b\x0c"), sum(c > 127 for c in raw) / len(raw), raw.count(b"\n") / len(words), len(set(words)) / len(words), max(words.count(w) for w in set(words)) / len(words) if len(words) < 5000 else words.count(words[0]) / len(words),
        1 - len(set(lines)) / len(lines), sum(len(w) <= 3 for w in words) / len(words), sum(w[-1:] in (b"#", b"$", b"%", b"&", b"*", b"!", b"|") for w in words) / len(words), share(b"|"),
    ]


def test_quality_scores_are_sums_of_look_ups(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = table(spark, SF, "labels")
    learnt = sorted((tuple(quality.text_features(text[r.doc_id])), float(r.quality)) for r in labels.collect() if r.quality is not None and fold(r.doc_id, 3) != 1 and r.doc_id in text)
    model = quality.fit(np.array([x for x, _ in learnt]), np.array([y for _, y in learnt]))
    want = []
    for r in docs.collect():
        x, at = features(r.text), model.bias
        assert np.allclose(x, quality.text_features(r.text), rtol=0, atol=1e-12)
        x = quality.text_features(r.text)
        for k, (edges, own) in enumerate(zip(model.edges, model.tables)):
            at += own[bisect.bisect_right(edges.tolist(), x[k])]
        for i, j, left, right, own in model.pairs:
            at += own[bisect.bisect_right(left.tolist(), x[i])][bisect.bisect_right(right.tolist(), x[j])]
        score = 1 / (1 + math.exp(-min(30, max(-30, at))))
        want.append((r.doc_id, fold(r.doc_id, 3) == 1, round(score, 9), int(score >= 0.5)))
    got = [(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in quality.quality_scores(docs, labels).collect()]
    assert sorted(got) == sorted(want)
