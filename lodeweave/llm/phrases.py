"""Collocations: phrases whose words stand together far more often than their parts would by chance.

1. Explode. Texts are cut into pieces and words in tasks; the n-grams of a length become rows (lang, phrase, n),
   counted in the task first, and are summed for each language by a hash aggregate. Lengths are taken in turn:
   an n-gram becomes a row only where both of its parts that are one word shorter are frequent, as no
   other can be. Which are, tasks learn from a map of bits, sized by their number (16 bits each) and 32 MB at
   most; a bit set by another phrase, or a full map, only lets more rows through, and the counts stay exact.
2. Score. Each cut of a candidate joins the counts of its two parts; floor(1000 a n / (l r)) in Decimal(38); the
   lowest cut counts.
3. Drop candidates that a longer one holds as often: an anti-join with one-word extensions. (A longer one with
   the same count makes all between them candidates with that count, so one word more is enough.)
4. Rank. The first `top` of each language: the first of each of SLICES slices, then of what they leave.

Defined cases: null text is empty; null lang is `und`; ties go to the smaller cut, then to the smaller phrase in
byte order; repeated rows count again; texts of any length are read whole (a task looks at about CHUNK bytes
at a time); an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import staged

LONGEST, LEAST, TOP = 5, 100, 2000
SLICES = 32
#: Bytes of text that a task looks at together, and phrases whose counts it holds.
CHUNK, HELD = 1 << 20, 1 << 19
MOST_BITS, BITS_EACH, SEGMENT = 28, 16, 19
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end between blanks, tabs and line ends, and a hash of each."""
    gap = (data == 32) | (data == 9) | (data == 10)
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    powers = np.cumprod(np.full(int(size.max()), STEP, np.uint64))
    inside = (data[~gap].astype(np.uint64) + np.uint64(1)) * powers[np.arange(int(size.sum())) - np.repeat(first, size)]
    return starts, ends, np.add.reduceat(inside, first)


def _windows(data: bytes, k: int) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes; each begins with the last k - 1 words of the one before."""
    before = lambda at: max(data.rfind(c, 0, at) for c in (b" ", b"\t", b"\n"))
    begin = end = 0
    while end < len(data):
        end = max(begin + CHUNK, end + 1)
        after = [at for at in (data.find(c, end) for c in (b" ", b"\t", b"\n")) if at >= 0]
        end = min(after, default=len(data))
        yield data[begin:end]
        begin = end
        for _ in range(k - 1):
            while begin > 0 and data[begin - 1] in b" \t\n":
                begin -= 1
            begin = before(begin) + 1


def _mixed(columns: list[np.ndarray], langs: np.ndarray) -> np.ndarray:
    """A hash of n-grams of a language, from their words' hashes in order."""
    total = langs.copy()
    for column in columns:
        total = total * STEP + column
    total ^= total >> np.uint64(32)
    return total * MIX


def _gram_hashes(words: np.ndarray, langs: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on."""
    n = max(0, len(words) - k + 1)
    return _mixed([words[j : j + n] for j in range(k)], langs[:n])


def _rows(held: dict[str, Counter]) -> pa.RecordBatch:
    lang = [x for x, own in held.items() for _ in own]
    phrase = [p for own in held.values() for p in own]
    n = [c for own in held.values() for c in own.values()]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _exploder(k: int, bits: int, frequent):
    """n-grams of k words with their counts; of k = 1 also each language's number of words, under a null phrase."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        parts: list[bytes] = []
        langs: list[str] = []
        size = 0

        def look(parts: list[bytes], langs: list[str]) -> None:
            """Count the n-grams of some texts that can be frequent."""
            text = b"\n".join(parts)
            data = np.frombuffer(text, np.uint8)
            starts, ends, words = _words(data)
            n = len(starts) - k + 1
            if n <= 0:
                return
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            lang = number[np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, side="right")]
            seeds = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
            place = _gram_hashes(words, seeds[lang], k - 1) >> np.uint64(64 - bits)
            known = (frequent.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            piece = np.searchsorted(np.flatnonzero(data == 10), starts)
            begin = np.flatnonzero(known[:-1] & known[1:] & (piece[:n] == piece[k - 1 :]))
            wide = np.cumsum(np.concatenate([[0], (starts[1:] - ends[:-1] > 1) | (data[ends[:-1]] == 9)]))  # not one blank between words
            odd = wide[begin + k - 1] > wide[begin]
            for x, name in enumerate(names):
                own = held.setdefault(name, Counter())
                mine = lang[begin] == x
                at = begin[mine & ~odd]
                own.update([text[a:b] for a, b in zip(starts[at].tolist(), ends[at + k - 1].tolist())])
                at = begin[mine & odd]
                own.update([b" ".join(text[a:b].split()) for a, b in zip(starts[at].tolist(), ends[at + k - 1].tolist())])

        for batch in batches:
            for lang, x in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = x.as_py().encode().lower().translate(ENDS)
                if k == 1:
                    own = held.setdefault(lang, Counter())
                    found = text.split()
                    own.update(found)
                    if found:
                        own[None] += len(found)
                elif len(text) >= CHUNK:
                    for window in _windows(text, k):
                        look([window], [lang])
                else:
                    parts.append(text)
                    langs.append(lang)
                    size += len(text)
                    if size >= CHUNK:
                        look(parts, langs)
                        parts, langs, size = [], [], 0
                if sum(map(len, held.values())) >= HELD:
                    yield _rows(held)
                    held.clear()
        if parts:
            look(parts, langs)
        if held:
            yield _rows(held)

    return explode


def _places(bits: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = _words(np.frombuffer(b"\n".join(batch.column("phrase").to_pylist()), np.uint8))[2].reshape(batch.num_rows, -1)
                langs = np.array([xxhash.xxh64_intdigest(x) for x in batch.column("lang").to_pylist()], np.uint64)
                place = _mixed(list(words.T), langs) >> np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(SEGMENT)).astype(np.int32)), pa.array((place & np.uint64((1 << SEGMENT) - 1)).astype(np.int32))], names=["segment", "at"])

    return places


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    own = np.zeros(1 << SEGMENT, bool)
    own[rows["at"].to_numpy(np.int64)] = True
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(own, bitorder="little").tobytes()]})


def bit_map(phrases: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^bits bits (32 MB at most) in which the places of phrases(lang, phrase), all of one length, are set."""
    rows = phrases.select("lang", "phrase").mapInArrow(_places(bits), "segment int, at int").distinct()
    found = np.zeros((1 << max(0, bits - SEGMENT), 1 << (SEGMENT - 3)), np.uint8)
    for segment, own in rows.groupBy("segment").applyInPandas(_packed, "segment int, bits binary").toPandas().itertuples(index=False):
        found[segment] = np.frombuffer(own, np.uint8)
    return found.ravel()


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase as UTF-8, k, n) of all phrases of 1 to `longest` words found `least` times, and (lang, total) words."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "lang string, phrase binary, n long"
    often = (F.col("n") >= least) | F.col("phrase").isNull()
    sums = staged(own.mapInArrow(_exploder(1, 0, None), schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(often))
    levels = [sums.filter("phrase is not null").withColumn("k", F.lit(1))]
    for k in range(2, longest + 1):
        number = levels[-1].count()
        if not number:
            break
        bits = min(most_bits, max(SEGMENT, (number * BITS_EACH).bit_length()))
        frequent = spark.sparkContext.broadcast(bit_map(levels[-1], bits))
        rows = own.mapInArrow(_exploder(k, bits, frequent), schema)
        levels.append(staged(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(often)).withColumn("k", F.lit(k)))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, sums.filter("phrase is null").select("lang", F.col("n").alias("total"))


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of each phrase of two words or more, by its lowest cut."""
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cuts = counts.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    joined = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals.withColumnRenamed("total", "n"), "lang")
    exact = F.expr("CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = joined.withColumn("score", exact).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "k", "a", "low.l", "low.r", "n", "low.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = 100, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language of docs(text, lang).

    share: a candidate goes if a longer one that holds it has this percentage of its count.
    """
    counts, totals = phrase_counts(docs, longest, least, most_bits)
    counts = staged(counts.withColumn("phrase", F.col("phrase").cast("string")))
    found = scored(counts, totals)
    words = F.split("phrase", " ")
    longer = counts.filter("k > 2").select("lang", "n", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("k") - 1), " "), F.array_join(F.slice(words, 2, F.col("k") - 1), " "))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("n").alias("inside")).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "inside")
    alone = found.join(held, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")) & (100 * F.col("inside") >= share * F.col("a")), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = alone
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
