"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, each window of a document with as many words is fingerprinted: a bit is
set if it is set in over half of the hashes of the window's shingles. Sums of bits up to each place
are kept, so a window's counts are one difference: the entering shingles less the leaving ones.

A fingerprint is a candidate if it differs from an item's in at most RADIUS bits. Multi-index blocks
find them: fingerprints within RADIUS = 4 * 5 + 3 agree up to five bits in one of four blocks of 16,
so a table of the values near each item's block says which windows may be close, and no pair within
the radius is lost. Only windows with enough shingles that occur in some item are fingerprinted: the others
can't be at 0.8 of any, so this order of the two tests changes no result. A candidate's distance to each item
is counted, and the exact similarity decides: the sum of minima over the sum of maxima of the shingles' numbers
of occurrences (five words, 0.8).

With equal sizes a similarity of 0.8 turns about ten bits (sd 3), so 23 covers it; what the
fingerprint of a pair at 0.8 or more lies beyond, the method doesn't see.

Words are lower-cased runs of letters and digits. Items come in blocks of bounded bytes, one pass over the documents each.

Defined cases: null texts are empty; an item without words matches nothing; an item of fewer than
five words is one shingle of all its words; a document shorter than an item is one window; items
with equal text each report; of equal windows the first counts; repeated rows and rows with null ids
report each; texts of any length are read whole, CHUNK places at a time; an empty table on either
side gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
#: Each of four blocks of 16 bits finds pairs that differ in up to NEAR bits there.
NEAR = 5
#: Benchmark text that is held in memory at once; more items make more passes.
BLOCK_BYTES = 1 << 20
#: Windows fingerprinted at once, and shingles of documents gathered for it.
CHUNK = 1 << 13
GATHERED = 1 << 16
REMEMBERED = 1 << 17
#: First bits of a shingle's hash that are looked up in a map of 1 MB before the hash itself.
MAP_BITS = 20
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, differing_bits int"
_WORD = re.compile(r"[^\W_]+")
_BLOCK = np.arange(1 << 16, dtype=np.uint16)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], size: int) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(max(0, len(words) - size + 1))]


def similarity(a: list[str], b: list[str]) -> float:
    x, y = Counter(a), Counter(b)
    least = sum((x & y).values())
    return least / (len(a) + len(b) - least) if a or b else 0.0


class _Hashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return value


def shingle_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, mixed from the words' hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : len(hashes) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def bit_sums(codes: np.ndarray, most: int) -> np.ndarray:
    """How many codes before each place have each bit, modulo a power of two over `most`."""
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    sums = np.zeros((len(codes) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def window_prints(sums: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The fingerprint of each window of n codes (at: of those that begin there), from bit_sums of at least that bound."""
    counts = sums[n:] - sums[: len(sums) - n] if at is None else sums[at + n] - sums[at]
    return np.packbits((counts > sums.dtype.type(n // 2)).ravel(), bitorder="little").view("<u8")


def possible_windows(runs: np.ndarray, n: int, least: float) -> np.ndarray:
    """The starts of the windows of n shingles of which `least` at least are shingles of items; runs: how many such come before each place."""
    return np.flatnonzero(runs[n:] - runs[: len(runs) - n] >= math.ceil(least - 1e-9))


class _Group:
    """Items of one length: their fingerprints and which values of each block are near one of them."""

    def __init__(self, words: int, size: int):
        self.words, self.size, self.n = words, size, words - size + 1
        self.items: list[tuple[int, list[str]]] = []
        self.prints: list[int] = []
        self.near: list[np.ndarray] | None = None

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """Whether a block of each fingerprint is near that of an item."""
        if self.near is None:  # in each worker, when first asked for
            blocks = np.array(self.prints, np.uint64).view(np.uint16).reshape(-1, 4)
            near = [np.logical_or.reduce([np.bitwise_count(_BLOCK ^ v) <= NEAR for v in np.unique(blocks[:, k])]) for k in range(4)]
            self.near = [np.packbits(x, bitorder="little") for x in near]  # 8 KB each
        parts = prints.view(np.uint16).reshape(-1, 4)
        found = np.zeros(len(prints), np.uint8)
        for k in range(4):
            part = np.ascontiguousarray(parts[:, k])
            found |= self.near[k].take((part >> 3).astype(np.intp), mode="clip") >> (part & 7).astype(np.uint8)
        return (found & 1).astype(bool)

    def within(self, prints: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
        """(place, item, differing bits) of the fingerprints within the radius of an item."""
        bits = np.bitwise_count(prints[:, None] ^ np.array(self.prints, np.uint64))
        place, item = np.nonzero(bits <= radius)
        return list(zip(place.tolist(), item.tolist(), bits[place, item].tolist()))


class Items:
    def __init__(self, items: list[tuple[int, str]]):
        groups: dict[int, _Group] = {}
        known: dict[int, list[np.ndarray]] = {}
        self.hashes = _Hashes()
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(WORDS, len(words))
            group = groups.setdefault(len(words), _Group(len(words), size))
            codes = shingle_codes(self._hashed(words), size)
            group.items.append((item_id, shingles(words, size)))
            group.prints.append(int(window_prints(bit_sums(codes, len(codes)), len(codes))[0]))
            known.setdefault(size, []).append(codes)
        self.codes = {size: np.unique(np.concatenate(parts)) for size, parts in known.items()}
        self.maps = {size: np.zeros(1 << MAP_BITS, bool) for size in self.codes}
        for size, codes in self.codes.items():
            self.maps[size][codes >> np.uint64(64 - MAP_BITS)] = True
        self.groups = {size: sorted((g for g in groups.values() if g.size == size), key=lambda g: g.words) for size in self.codes}

    def _hashed(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def _known(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Whether each code is a shingle of some item: few pass the map by their first bits, those are looked up."""
        found = self.maps[size].take((codes >> np.uint64(64 - MAP_BITS)).astype(np.intp))
        some = np.flatnonzero(found)
        at = np.searchsorted(self.codes[size], codes[some])
        found[some] = self.codes[size].take(at, mode="clip") == codes[some]
        return found

    def _gathered(self, texts: list[str | None], least: float, radius: int) -> list[list[tuple[int, int, int, float, int]]]:
        words = [words_of(t) for t in texts]
        hashed = [self._hashed(w) for w in words]
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in texts]

        def judge(g: _Group, k: int, doc: int, start: int, n: int, bits: int) -> None:
            item_id, other = g.items[k]
            like = similarity(shingles(words[doc][start : start + n + g.size - 1], g.size), other)
            if like >= least - 1e-12 and (item_id not in best[doc] or like > best[doc][item_id][0]):
                best[doc][item_id] = (like, start, n + g.size - 1, bits)

        for size, groups in self.groups.items():
            own = [shingle_codes(h, size) for h in hashed]
            length = np.array([len(c) for c in own])
            known = self._known(np.concatenate(own), size)
            total = np.concatenate([[0], np.cumsum(known)])
            stop = np.cumsum(length)
            most = max(g.n for g in groups)
            held = total[stop] - total[stop - length]
            for doc in np.flatnonzero((length > 0) & (held >= math.ceil(least * groups[0].n - 1e-9))).tolist():
                codes, end = own[doc], int(stop[doc])
                runs = total[end - len(codes) : end + 1]  # shingles of items before each place
                for chunk in range(0, len(codes), CHUNK):  # windows that begin in it
                    sums: dict[bool, np.ndarray] = {}
                    for g in groups:
                        n = min(g.n, len(codes))  # a shorter text is one window
                        if chunk + n > len(codes):
                            break
                        at = possible_windows(runs[chunk : chunk + CHUNK + n], n, least * g.n)
                        if not len(at):
                            continue
                        wide = n > 255
                        if wide not in sums:
                            sums[wide] = bit_sums(codes[chunk : chunk + CHUNK + (most if wide else min(most, 255)) - 1], most if wide else 255)
                        prints = window_prints(sums[wide], n, at)
                        near = np.flatnonzero(g.candidates(prints))
                        for i, k, bits in g.within(prints[near], radius) if len(near) else ():
                            judge(g, k, doc, chunk + int(at[near[i]]), n, bits)
        return [[(item, s, n, like, bits) for item, (like, s, n, bits) in sorted(b.items())] for b in best]

    def matches(self, texts, least: float = SIMILARITY, radius: int = RADIUS) -> Iterator[list[tuple[int, int, int, float, int]]]:
        """For each text (item_id, first word, words, similarity, differing bits) of the best window for each item found."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "") // 6 + 1
            if size >= GATHERED:
                yield from self._gathered(held, least, radius)
                held, size = [], 0
        if held:
            yield from self._gathered(held, least, radius)


def _matcher(items, least: float, radius: int):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(doc, *m) for doc, ms in zip(batch["doc_id"], items.value.matches(batch["text"], least, radius)) for m in ms]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "start_word", "n_words", "similarity", "differing_bits"])

    return match


def _cleaner(items, least: float, radius: int):
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not found for found in items.value.matches(texts, least, radius)], dtype=bool)

    return clean


def _blocks(benchmark: DataFrame, radius: int, block_bytes: int) -> Iterator:
    """The items as broadcast blocks of about block_bytes."""
    if radius > 4 * NEAR + 3:
        raise ValueError(f"four blocks of {NEAR} differing bits find up to {4 * NEAR + 3}")
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # at most about block_bytes
        yield benchmark.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best matching window for each pair of a document and an item that has one."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return reduce(DataFrame.unionByName, [own.mapInPandas(_matcher(block, least, radius), SCHEMA) for block in _blocks(benchmark, radius, block_bytes)])


def clean_rows(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark, each judged by its own text, whatever its id."""
    for block in _blocks(benchmark, radius, block_bytes):
        docs = docs.filter(F.pandas_udf(_cleaner(block, least, radius), "boolean")(F.col("text").cast("string")))
    return docs
