import random

import numpy as np
import pytest
import xxhash

from lodeweave.llm import decontaminate as d


def naive_print(words, size):
    codes = [int(d.shingle_codes(np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words[i : i + size]], np.uint64), size)[0]) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


@pytest.mark.parametrize("n", [5, 6, 7, 20, 61, 300])
def test_every_window_has_the_fingerprint_of_a_naive_count(n):
    rng = random.Random(n)
    words = [f"w{rng.randrange(60)}" for _ in range(420)]
    codes = d.shingle_codes(np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64), 5)
    got = d.window_prints(d.bit_sums(codes, n), n - 4)
    assert len(got) == 420 - n + 1
    for s in list(range(0, len(got), 37)) + [len(got) - 1]:
        assert int(got[s]) == naive_print(words[s : s + n], 5)


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(10**9)}"] * rng.randint(0, 1)
    return out


def test_recall_on_edited_passages_in_texts_longer_than_a_chunk():
    """Against an exact search of all windows; one text is longer than what is fingerprinted at once."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(15, 63)))) for i in range(150)]
    body = []
    for i, text in items:
        body += [f"w{rng.randrange(5000)}" for _ in range(40)] + edited(rng, text.split())
    body += [f"w{rng.randrange(5000)}" for _ in range(d.CHUNK)]
    texts = [" ".join(body), None, "", items[7][1]]
    got = list(d.Items(items).matches(texts))
    assert got[1:3] == [[], []] and [m[0] for m in got[3]] == [7]
    want = {}
    every = d.shingles(body, 5)
    codes = np.array(list(map(hash, every)))
    for item, text in items:
        target = d.shingles(text.split(), 5)
        held = np.concatenate([[0], np.cumsum(np.isin(codes, list(map(hash, set(target)))))])
        n = len(target)
        likes = [d.similarity(every[s : s + n], target) for s in np.flatnonzero(held[n:] - held[:-n] >= 0.8 * n - 1e-9).tolist()]
        if likes and max(likes) >= d.SIMILARITY - 1e-12:
            want[item] = round(max(likes), 9)
    have = {m[0]: round(m[3], 9) for m in got[0]}
    assert len(want) > 30 and have.items() <= want.items()
    assert len(have) >= 0.9 * len(want)


def test_only_windows_that_can_be_alike_are_fingerprinted(monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 60)))) for i in range(40)]
    text = " ".join([*(f"x{i}" for i in range(9000)), items[3][1], *(f"y{i}" for i in range(9000))])
    known, made, prints = d.Items(items), [], d.window_prints
    monkeypatch.setattr(d, "window_prints", lambda *a: made.append(prints(*a)) or made[-1])
    assert [[m[:4] for m in ms] for ms in known.matches([text, None, items[8][1]])] == [[(3, 9000, len(items[3][1].split()), 1.0)], [], [(8, 0, len(items[8][1].split()), 1.0)]]
    assert 0 < sum(map(len, made)) < 5000


def test_windows_of_texts_around_a_chunk_against_all_windows(monkeypatch):
    """Texts of one chunk, one less and one more, texts shorter than an item, items of one to 300 words: what every window gives."""
    monkeypatch.setattr(d, "CHUNK", 64)
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 20, 30, 63, 64, 68, 255, 259, 300])]
    texts = []
    for _, item in items:
        words = item.split()
        texts += [item, " ".join(words[: len(words) * 9 // 10]), say(40) + " " + item + " " + say(rng.randrange(70)), say(63 - len(words) % 64) + " " + item]
    texts += [say(n) + " " + items[6][1] for n in (43, 44, 45, 47, 48, 49, 63, 64)] + [None, ""]
    for text, found in zip(texts, d.Items(items).matches(texts)):
        words, want = d.words_of(text), {}
        for item, other in items:
            target = other.split()
            size = min(5, len(target))
            n = min(len(target), len(words))
            for s in range(len(words) - n + 1 if n >= size else 0):
                like = d.similarity(d.shingles(words[s : s + n], size), d.shingles(target, size))
                if like >= 0.8 - 1e-12 and like > want.get(item, (0,))[0]:
                    want[item] = (like, s, n)
        assert {m[0]: (m[3], m[1], m[2]) for m in found} == want
