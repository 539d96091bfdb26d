"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token that may hide a word (digits or signs among letters or at their edge, equal letters in a
row, single letters or signs spaced or dotted out) becomes a lattice: each sign may stand for itself, for the letters it
looks like, or for nothing. Viterbi finds the likeliest letters under a character language model
(four characters, counted over all documents). Other tokens have one path, so they stay. A logistic
regression over words and word beginnings, picked by their G statistic, scores the restored text.

The labelled sample is bounded (SAMPLE rows with the smallest hashes of their ids), as is the list
of words (FEATURES); the language model's counts cover every document.

Defined cases: null text is empty; an empty text scores the model's bias; with one label only, or none, each
score is the smoothed share of label 1; repeated rows score alike; a document with several labels
takes part once for each; texts of any length are read whole; an empty table gives no rows; further columns are
ignored (by clean_rows: carried), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import crc_bucket, kept_in_worker, staged

SAMPLE = 20_000
FEATURES = 384
LEAST_DOCS = 3
ORDER = 4
#: Symbols of the language model: 0 a boundary, 1..26 the letters, 27 any other sign.
SYMBOLS, OTHER = 28, 27
#: What signs are used to stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_EDGE = ".,;:?!\"'`()[]{}<>#%&*-_~=/\\^|…«»„“”‘’"
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1")
#: Edge signs that stand for no letter.
_BARE = "".join(c for c in _EDGE if c not in LOOKS_LIKE and c != "*")
_ONE = "(?:[^\\W_]|[" + re.escape("".join(c for c in LOOKS_LIKE if not c.isalnum()) + "*") + "])"
_GAP = r"(?:[.\-_'/,]*\s+(?:[.\-_'/,]+\s+)*)"
_SPACED = re.compile(rf"(?<![^\s\"'(\[{{<]){_ONE}(?:{_GAP}{_ONE}){{2,}}(?=[{re.escape(_EDGE)}]*(?:\s|\Z))")
#: What every such run begins with, looked for first: two single signs with gaps.
_SINGLES = re.compile(rf"[\s\"'(\[{{<]\S{_GAP}\S{_GAP}")
_GAPS = re.compile(r"[\s.\-_'/,]+")
_TOKEN = re.compile(r"\S+")
_DOTTED = re.compile(r"[^\W_](?:[.\-_*'/][^\W_]){2,}")
_SIGNS = frozenset([*LOOKS_LIKE, "*"])
_BYTE = np.full(256, OTHER, np.int32)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BYTE[97:123] = np.arange(1, 27)
for _accented, _letter in ACCENTS.items():
    _BYTE[_accented] = ord(_letter) - 96 if isinstance(_letter, str) else _letter - 96
REMEMBERED = 100_000
CHUNK = 1 << 18


def symbol_codes(text: str) -> np.ndarray:
    raw = text.lower().encode("latin-1", "replace")
    return _BYTE[np.frombuffer(raw, np.uint8)]


def gram_counts(texts) -> np.ndarray:
    """How often each run of ORDER symbols occurs; a text begins and ends with boundaries."""
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    gap, held, size = " " * (ORDER - 1), [], 0

    def add() -> None:
        c = symbol_codes(gap + gap.join(held) + " ")
        code = np.zeros(len(c) - ORDER + 1, np.int32)
        for k in range(ORDER):
            code *= SYMBOLS
            code += c[k : k + len(code)]
        counts[:] += np.bincount(code, minlength=len(counts))

    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > CHUNK:
            add()
            held, size = [], 0
    if held:
        add()
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        counts += gram_counts(t.as_py() for t in batch.column("text"))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probability of each symbol after each three; counts are over all documents, the table has 28^4 cells."""
    grams = docs.select(F.col("text").cast("string")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[grams["gram"].to_numpy(np.int64)] = grams["n"].to_numpy(float)
    table = counts.reshape(-1, SYMBOLS)
    below = table.reshape(SYMBOLS, -1, SYMBOLS).sum(0)  # after two symbols
    below = (below + 0.1) / (below.sum(1, keepdims=True) + 0.1 * SYMBOLS)
    smooth = 5.0 * np.tile(below, (SYMBOLS, 1))
    return np.log((table + smooth) / (table.sum(1, keepdims=True) + 5.0)).astype(np.float32).ravel()


#: Log-costs of the channel: a sign that stands for a letter, for any letter ('*'), for itself, or for nothing;
#: a letter that is there twice, once more than that, or a sign repeated.
LETTER, ANY, ITSELF, GONE, BLANK, TWICE, AGAIN = -1.0, -3.0, -3.0, -0.2, -2.0, -3.0, -0.7
#: A sign at a word's edge that is mere punctuation: before a word, after it.
EDGES = {"(": (-2.0, -2.0), "<": (-2.0, -2.0), "!": (-6.0, -0.5), "|": (-6.0, -2.0), "*": (-2.0, -0.2)}


def _shows(c: str) -> list[tuple[str, int | None, float]]:
    plain = c.translate(ACCENTS)
    if "a" <= plain <= "z":
        return [(c, ord(plain) - 96, 0.0)]
    if c == " ":
        return [(" ", 0, BLANK)]
    ways = [(c, OTHER, ITSELF if c in LOOKS_LIKE else LETTER)] + [(x, ord(x) - 96, LETTER) for x in LOOKS_LIKE.get(c, "")]
    return ways + [(chr(96 + k), k, ANY) for k in range(1, 27)] if c == "*" else ways


class Restorer:
    """Finds the likeliest letters of tokens under a language model of four symbols."""

    def __init__(self, model: np.ndarray):
        self.model = memoryview(model.astype(float))
        self.most = model.reshape(-1, SYMBOLS).max(0).tolist()  # no context gives a symbol more
        self.ways = {c: _shows(c) for c in map(chr, range(256))}
        self.symbol = {c: ways[0][1] for c, ways in self.ways.items() if ways[0][2] == 0}
        self.seen: dict[str, str] = {}

    def lattice(self, token: str) -> list[list[tuple[str, int | None, float]]]:
        """For each sign what it may show, as which symbol (None: nothing at all), at what cost."""
        core = token.strip(_EDGE)
        first = token.find(core) if core else 0
        last, before, out = first + len(core), "", []
        for i, c in enumerate(token):
            ways = self.ways.get(c) or _shows(c)
            if core and c in EDGES and not first <= i < last:
                ways = [*ways, ("", None, EDGES[c][i >= last])]
            elif c in " .-_'/*":
                ways = [*ways, ("", None, GONE)]
            elif c == before:
                ways = [*ways, ("", None, TWICE if c.isalpha() and (i < 2 or c != token[i - 2]) else AGAIN)]
            before = c
            out.append(ways)
        return out

    def _ahead(self, steps: list) -> list[float]:
        """What the signs after each can add at most."""
        rest = [self.most[0]]
        for ways in reversed(steps[1:]):
            rest.append(rest[-1] + max(cost + (0.0 if symbol is None else self.most[symbol]) for _, symbol, cost in ways))
        return rest[::-1]

    def _search(self, steps: list, least: float = -math.inf) -> tuple[float, str]:
        """The best path; states that can't come to `least` any more are left out, which loses no such path."""
        model, wrap = self.model, SYMBOLS ** (ORDER - 1)
        ahead = self._ahead(steps) if least > -math.inf else None
        states = {0: (0.0, "")}
        for i, ways in enumerate(steps):
            new: dict[int, tuple[float, str]] = {}
            for state, (score, text) in states.items():
                for shown, symbol, cost in ways:
                    if symbol is None:
                        to, way = state, (score + cost, text)
                    else:
                        code = state * SYMBOLS + symbol
                        to, way = code % wrap, (score + cost + model[code], text + shown)
                    if to not in new or way > new[to]:
                        new[to] = way
            if ahead:
                floor = least - ahead[i] - 1e-6
                new = {state: way for state, way in new.items() if way[0] >= floor}
            states = new
        return max(((score + model[state * SYMBOLS], text) for state, (score, text) in states.items()), default=(-math.inf, ""))

    def _twice(self, token: str, at: int) -> tuple[float, str] | None:
        """The better of a word with one doubled letter and the same with it once; None if the search must find it."""
        best = None
        for text, score in ((token, 0.0), (token[:at] + token[at + 1 :], TWICE)):
            state = 0
            for c in text:
                symbol = self.symbol.get(c)
                if symbol is None:
                    return None
                code = state * SYMBOLS + symbol
                score += self.model[code]
                state = code % (SYMBOLS ** (ORDER - 1))
            way = (score + self.model[state * SYMBOLS], text)
            best = max(best, way) if best else way
        return best

    def _best(self, token: str) -> tuple[float, str]:
        doubles = _DOUBLE.findall(token) if token.isalpha() else ()
        if len(doubles) == 1 and not _TRIPLE.search(token) and (best := self._twice(token, token.index(doubles[0] * 2))):
            return best
        steps = self.lattice(token)
        if "*" not in token:
            return self._search(steps)
        fewer = [[w for w in ways if w[2] != ANY or w[1] == OTHER] for ways in steps]
        return self._search(steps, self._search(fewer)[0])

    def decode(self, token: str) -> str:
        """The likeliest letters for a token (of equal paths the last text); blanks in it may be nothing or a word's end.

        The lattice without the letters of '*' gives a score that the best path has at least; it bounds the search.
        """
        best = self.seen.get(token)
        if best is None:
            best = self._best(token)[1]
            if len(token) <= 64:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[token] = best
        return best

    def _shown(self, token: str) -> str:
        """A token without blanks, decoded if it may hide a word; edge signs that can be no letter stay as they are."""
        core, whole = token.strip(_EDGE), token.strip(_BARE)
        if core.isalpha():
            hides = core != whole or _DOUBLE.search(core)
        else:
            hides = any(c.isalpha() for c in core) and (_DOTTED.fullmatch(core) or not _SIGNS.isdisjoint(whole))
        return token.replace(whole, self.decode(whole), 1) if hides else token

    def _unspaced(self, text: str | None) -> str:
        text = (text or "").lower()
        return _SPACED.sub(lambda m: self.decode(_GAPS.sub(" ", m[0])), text) if _SINGLES.search(" " + text) else text

    def restore(self, text: str | None) -> str:
        """The whole text in lower case with the tokens that may hide words decoded."""
        return _TOKEN.sub(lambda m: self._shown(m[0]), self._unspaced(text))

    def words(self, text: str | None) -> set[str]:
        """The different words of the restored text, and of words with only a doubled letter or edge signs those as written.

        No language model of a corpus tells a rare word in brackets or with a doubled letter from a disguise, so both count.
        """
        tokens = set(self._unspaced(text).split())
        plain = [t for t in tokens if t.isalpha()]  # only a doubled letter can hide something here
        out = set()
        for token in tokens.difference(plain):
            core = token.strip(_EDGE)
            if core.isalpha():
                plain.append(core)
                if core == token.strip(_BARE):
                    continue
            out.update(_LETTERS.findall(self._shown(token)))
        joined = " ".join(plain)
        signs = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        twice = signs[1:] == signs[:-1]
        end = 0
        for at in np.flatnonzero(twice).tolist():
            if at >= end:
                end = joined.find(" ", at)
                end = len(joined) if end < 0 else end
                out.update(_LETTERS.findall(self.decode(joined[joined.rfind(" ", 0, at) + 1 : end])))
        out.update(w for w in plain if not _TRIPLE.search(w)) if (twice[1:] & twice[:-1]).any() else out.update(plain)
        return out


def features_of(words: set[str]) -> set[str]:
    """Words, and beginnings of four and five letters of longer ones (marked by a hyphen)."""
    out = set(words)
    for w in words:
        if len(w) > 4:
            out.add(w[:4] + "-")
            if len(w) > 5:
                out.add(w[:5] + "-")
    return out


def _restorer(model) -> Restorer:
    """One for each broadcast model in a worker."""
    return kept_in_worker(model.value, Restorer)


def _feature_counter(model):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, seen = _restorer(model), {}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for f in features_of(restorer.words(text)):
                    docs, hits = seen.get(f, (0, 0))
                    seen[f] = (docs + 1, hits + toxic)
                if len(seen) > REMEMBERED:
                    yield _counted(seen)
                    seen = {}
        yield _counted(seen)

    return count


def _counted(seen: dict[str, tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"f": list(seen), "docs": [d for d, _ in seen.values()], "hits": [h for _, h in seen.values()]}).astype({"f": str, "docs": "int64", "hits": "int64"})


def _feature_rows(model, at: dict[str, int]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = _restorer(model)
        for batch in batches:
            found = [sorted(at[f] for f in features_of(restorer.words(t)) & at.keys()) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "f": found})

    return rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = SAMPLE) -> DataFrame:
    """text and label of at most `rows` labelled training rows, those with the smallest hashes of their ids."""
    some = labels.filter(train & F.col(label).isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "__label").limit(rows)  # the documented bound of the fit
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(some), own["doc_id"] == some["__id"]).select("text", F.col("__label").alias(label))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights, the bias last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """Weights of features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        begun = [f[:-1] for f in weights if f.endswith("-")]
        self.begun = {n: {w for w in begun if len(w) == n} for n in (4, 5)}

    def score(self, words: set[str]) -> float:
        """words and their beginnings have weights as features_of names them."""
        found = words & self.weights.keys()
        for n, begun in self.begun.items():
            if begun:
                found |= {w + "-" for w in {w[:n] for w in words if len(w) > n} & begun}
        at = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, train: Column, model) -> Scorer:
    """Learn from the labelled sample; model: the broadcast language model."""
    sample = staged(labelled_sample(docs, labels, "toxic", train))
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (ones + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < ones < n:
        return Scorer({}, bias)
    counts = sample.mapInPandas(_feature_counter(model), "f string, docs long, hits long").groupBy("f").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))
    # G statistic of the word against the label, for words that are likelier with label 1.
    a, b = F.col("hits") + 0.5, F.col("docs") - F.col("hits") + 0.5
    g = a * F.log(a / ((a + b) * prior)) + b * F.log(b / ((a + b) * (1 - prior)))
    best = counts.filter(f"docs >= {LEAST_DOCS} and hits > docs * {prior}").select("f", g.alias("g")).orderBy(F.desc("g"), "f").limit(FEATURES)
    names = [r.f for r in best.collect()]  # at most FEATURES
    at = {f: i for i, f in enumerate(names)}
    rows = sample.mapInPandas(_feature_rows(model, at), "toxic int, f array<int>").groupBy("toxic", "f").count().collect()  # at most SAMPLE
    x, y, times = np.zeros((len(rows), len(names)), np.float32), np.zeros(len(rows)), np.zeros(len(rows))
    for i, r in enumerate(rows):
        x[i, list(r.f)] = 1
        y[i], times[i] = r.toxic, r["count"]
    order = np.repeat(np.arange(len(rows)), times.astype(int))
    w = logistic(x[order].astype(float), y[order])
    return Scorer(dict(zip(names, w[:-1].tolist())), float(w[-1]))


def _scorer(model, scorer: Scorer):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(model)
        for batch in batches:
            scores = [scorer.score(restorer.words(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return score


def held_out(column: str = "doc_id") -> Column:
    return crc_bucket(column, 5) == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(language_model(docs))
    scorer = fit(docs, labels, ~held_out(), model)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = own.mapInArrow(_scorer(model, scorer), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the documents that score `least` or more; all of them stay if the labels teach nothing."""
    model = docs.sparkSession.sparkContext.broadcast(language_model(docs))
    scorer = fit(docs, labels, ~held_out(), model)
    if not scorer.weights:
        return docs

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:  # one text at a time becomes a Python object
        restorer = _restorer(model)
        return pa.array([scorer.score(restorer.words(t.as_py())) for t in texts], pa.float64())

    return docs.filter(score(F.col("text").cast("string")) < least)
