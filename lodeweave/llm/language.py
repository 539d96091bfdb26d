"""Language identification as inference in a mixture of languages.

Each language has a table of letter trigram likelihoods, counted over all training documents. A
document's trigrams are a mixture of languages; expectation-maximisation estimates the proportions.
The set of languages grows one by one while the likelihood gains more than the penalty (half the
logarithm of the number of trigrams for each further language). The largest proportion is the prediction.

Defined cases: null text, or one without a letter, is `und` with score 0, as is every text if
nothing could be learnt; ties go to the language first in order; repeated rows are alike; an empty
table gives no rows; further columns are ignored; texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import crc_bucket

BUCKETS = 1 << 16
SMOOTH = 0.5
STEPS = 30
CHUNK = 1 << 18
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams of a text; other characters are word ends, and each word has both ends."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + d * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)
    return h[b != 0].astype(np.int64)  # the middle one is a letter


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held, size = [], 0
            for text in texts:
                held.append(trigrams(text))
                size += len(held[-1])
                if size > CHUNK:
                    own += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                own += np.bincount(np.concatenate(held), minlength=BUCKETS)
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "gram": some, "n": own[some]})


def likelihoods(docs: DataFrame, train: Column) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the probability of each trigram bucket in each."""
    own = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    grams = own.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages times 65,536 cells at most
    names = sorted(grams["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    at = {x: i for i, x in enumerate(names)}
    counts[grams["lang"].map(at).to_numpy(int), grams["gram"].to_numpy(int)] = grams["n"].to_numpy(float)
    return names, ((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)


def _mix(p: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of languages p (languages x grams) for grams seen n times, and the log-likelihood."""
    share = np.full(len(p), 1 / len(p))
    for _ in range(steps):
        joint = share[:, None] * p
        new = (joint / joint.sum(0)) @ n / n.sum()
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(np.log(share @ p) @ n)


def proportions(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The share of each language in a text with these trigrams."""
    some, n = np.unique(grams, return_counts=True)
    p, n = table[:, some].astype(float), n.astype(float)
    alone = np.log(p) @ n
    chosen = [int(np.argmax(alone))]
    share, like = np.ones(1), float(alone[chosen[0]])
    penalty = 0.5 * np.log(n.sum() + 1)
    left = [k for k in range(len(table)) if k not in chosen]
    while left:
        # A language can only help if some weight moved to it raises the likelihood from where it is.
        mixed = share @ p[chosen]
        slope = (p[left] / mixed) @ n / n.sum() - 1
        k = left[int(np.argmax(slope))]
        if slope.max() <= 0:
            break
        new, better = _mix(p[[*chosen, k]], n, STEPS)
        if better - like <= penalty:
            break
        chosen.append(k)
        left.remove(k)
        share, like = new, better
    out = np.zeros(len(table))
    out[chosen] = share
    return out


def _predictor(names: list[str], table):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores, sets = [], [], []
            for text in batch["text"]:
                grams = trigrams(text)
                if not len(grams) or not names:
                    langs.append(UNKNOWN), scores.append(0.0), sets.append([])
                    continue
                share = proportions(table.value, grams)
                k = int(np.argmax(share))
                langs.append(names[k]), scores.append(float(min(1.0, share[k])))
                sets.append([names[i] for i in np.flatnonzero(share > 0)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": langs, "score": scores, "languages": sets})

    return predict


def held_out(column: str = "doc_id") -> Column:
    return crc_bucket(column, 4) == 2


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: a row for each row of docs."""
    names, table = likelihoods(docs, ~held_out())
    sent = docs.sparkSession.sparkContext.broadcast(table)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = own.mapInPandas(_predictor(names, sent), "doc_id long, lang_pred string, score double, languages array<string>")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
