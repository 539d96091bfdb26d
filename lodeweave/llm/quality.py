"""Quality: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, one feature after another, on binned numeric features of a text;
what they learn adds up to one look-up table a feature. The pairs of features that explain most of
the rest get two-way tables in the same manner. A score is a sum of look-ups, for all rows of a batch at once.

The fit uses a bounded sample of labelled rows (SAMPLE); scoring reads every whole text.

Defined cases: null text is empty, and its features are zero; with one label only, or none, each
score is the smoothed share of label 1; repeated rows score alike; an empty table gives no rows;
further columns are ignored; texts of any length are read whole, one at a time; a score of exactly 0.5 counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import crc_bucket
from lodeweave.llm.toxicity import labelled_sample

SAMPLE = 20_000
BINS = 64
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.15
LEAVES = 3
LEAST_ROWS = 20

FEATURES = ["log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "sentence_mark", "exclamation", "space", "non_ascii", "lines_a_word", "different_words", "commonest_word", "repeated_lines", "short_words", "edge_signs", "pipes"]

_CLASS = np.zeros(256, np.int64)  # 0 letters and the rest, then as named below
for _k, _signs in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@\\^_`{}~[]", b".,;:?", b"!", b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b"|"), 1):
    _CLASS[list(_signs)] = _k


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    edge = sum(w[-1] in _EDGE_SIGNS for w in words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(sizes.mean()), np.log1p(sizes.max()), n[1], n[2], n[3], n[4], n[5], n[6], n[7],
        raw.count(b"\n") / len(words), len(kinds) / len(words), max(kinds.values()) / len(words), 1 - len(set(lines)) / len(lines), float((sizes <= 3).mean()), edge / len(words), n[8],
    ]


_EDGE_SIGNS = frozenset(b"#$%&*!|")


@dataclass
class Additive:
    """Bin edges of each feature, a table each, and (i, j, edges, edges, table) of pairs."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            at += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, left, right, table in self.pairs:
            at += table[np.searchsorted(left, x[:, i], "right"), np.searchsorted(right, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """A step table over ordered bins: split greedily where the gain is largest, up to `leaves` parts."""
    parts = [(0, len(g))]
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        k = k[(cn[k] - cn[a] >= LEAST_ROWS) & (cn[b] - cn[k] >= LEAST_ROWS)]
        if not len(k):
            return 0.0, -1
        part = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1.0)
        gain = part(a, k) + part(k, b) - part(a, b)
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    while len(parts) < leaves:
        tried = [(*best(a, b), p) for p, (a, b) in enumerate(parts)]
        gain, k, p = max(tried)
        if k < 0 or gain <= 1e-9:
            break
        a, b = parts.pop(p)
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of both features into four cells, as a two-way table, and its gain."""
    quad = lambda m: m.cumsum(0).cumsum(1)
    cg, ch = quad(g), quad(h)
    best, table = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            cells = []
            for c in (cg, ch):
                lt, rt, lb = c[a - 1, b - 1], c[a - 1, -1], c[-1, b - 1]
                cells.append((lt, rt - lt, lb - lt, c[-1, -1] - rt - lb + lt))
            gain = sum(x * x / (y + 1.0) for x, y in zip(*cells))
            if gain > best:
                best = gain
                v = [_leaf(x, y) for x, y in zip(*cells)]
                table = np.empty_like(g)
                table[:a, :b], table[:a, b:], table[a:, :b], table[a:, b:] = v
    return table, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    at = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-at))
            step = RATE * _tree(np.bincount(b, y - p, len(sizes[k])), np.bincount(b, p * (1 - p), len(sizes[k])), sizes[k], LEAVES)
            model.tables[k] += step
            at += step[b]
    edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        w = len(edges[j]) + 1
        return np.bincount(bins[i] * w + bins[j], v, (len(edges[i]) + 1) * w).reshape(-1, w)

    p = 1 / (1 + np.exp(-at))
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            gains.append((_pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)))[1], i, j))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]
    tables = [np.zeros((len(edges[i]) + 1, len(edges[j]) + 1)) for _, i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for t, (_, i, j) in zip(tables, chosen):
            p = 1 / (1 + np.exp(-at))
            step = RATE * _pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)))[0]
            t += step
            at += step[bins[i], bins[j]]
    model.pairs = [(i, j, edges[i], edges[j], t) for t, (_, i, j) in zip(tables, chosen)]
    return model


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"quality": batch["quality"], "x": [text_features(t) for t in batch["text"]]})


def _scorer(model: Additive):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([text_features(t) for t in batch["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(x)})

    return score


def held_out(column: str = "doc_id") -> Column:
    return crc_bucket(column, 3) == 1


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    sample = labelled_sample(docs, labels, "quality", ~held_out(), rows)
    learnt = sample.mapInPandas(_measured, "quality int, x array<double>").toPandas()  # at most `rows`, 18 numbers each
    learnt = learnt.assign(key=[tuple(x) for x in learnt["x"]]).sort_values(["key", "quality"])  # the fit doesn't depend on the order of rows
    model = fit(np.array(learnt["x"].tolist(), float).reshape(-1, len(FEATURES)), learnt["quality"].to_numpy(float))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = own.mapInPandas(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
