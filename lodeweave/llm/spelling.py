"""Spelling variants of a corpus: words one edit apart, grouped under the form that is much commoner.

1. Count. Tasks count runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, lower-case A-Z and send
   each word once for every HELD distinct ones; words of fewer than LEAST_LETTERS letters or found once go.
2. Masks. Each of the 90 letters has a bit: set if the word holds the letter an odd number of times. An inserted or
   deleted letter flips one bit, a replaced one two, so of three bands of 30 bits (letter i in band i mod 3,
   which deals common letters evenly) one stays equal.
3. Join. Words meet where a band is equal, the lengths suit (the shorter one's length is part of the key, with
   which a word enters as itself and as the longer one) and the half of the word that the edit leaves alone is equal:
   it lies in one half, so the first or the last half is shared. The half is what keeps buckets small, as a
   band alone has the parities of a few common letters. A pair is taken in its first such bucket only.
4. Buckets of over BUCKET words (a stem with very many endings) are split by the edit itself: their words enter
   once for each letter that could be the changed one, without it. At most 90 words share such a key, whatever the bucket.
5. Verify. Masks one or two bits apart, then the edit distance in code points.

Forms and roots: a word's form is its near word of largest count if that is RATIO times its own. Counts rise
along forms, so chains are short (logarithm of the largest count) and pointer doubling finds their ends.

Defined cases: null and empty texts have no words; a null id counts as an empty one where misspellings are
made; ties of count go to the smallest word in code-point order; repeated rows count again; words of any
length are kept whole; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import small_enough, staged

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
BUCKET = 1024
BANDS = 3
#: Distinct words that a task holds before it sends their counts.
HELD = 1 << 18


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _counter(least: int, noise: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = runs.findall(text.as_py().encode().lower().decode())
                if noise:
                    begin = zlib.crc32(f"{doc}:".encode())
                    for i, run in enumerate(found):
                        h = zlib.crc32(run.encode(), begin)
                        if h % noise == 0:
                            k = h % len(run)
                            found[i] = run[:k] + run[k + 1 :]
                held.update(found)
                if len(held) >= HELD:
                    yield _counts(held)
                    held.clear()
        if held:
            yield _counts(held)

    return count


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_COUNT, noise: int = 0) -> DataFrame:
    """(word, n) of docs(doc_id, text). noise: of runs whose crc32 with the id it divides, a letter is deleted (0: none)."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string")).filter("text is not null")
    rows = own.mapInArrow(_counter(least, noise), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= times) & (F.length("word") >= least))


def _masks(words: pa.Array) -> pa.Array:
    """The three bands of each word's letter parities."""
    names = [f"m{k}" for k in range(BANDS)]
    if not len(words):
        return pa.StructArray.from_arrays([pa.array([], pa.int32())] * BANDS, names)
    texts = words.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(points < 128, points - ord("a"), points - 0xC0 + 26)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    bits = [np.bitwise_xor.reduceat(np.where(letter % BANDS == k, 1 << letter // BANDS, 0), starts) for k in range(BANDS)]
    return pa.StructArray.from_arrays([pa.array(b.astype(np.int32)) for b in bits], names)


def _half(side: int, l: Column) -> Column:
    """The first half of a word of length l, or as much at the end as it leaves: one edit spares one of them."""
    first = F.floor(l / 2).cast("int")
    return F.substring(F.col("word"), F.lit(1), first) if side == 0 else F.right("word", l - first)


def _dealt(facts: DataFrame, longer: bool) -> DataFrame:
    """Facts once for each band and half, with the bucket's key; longer: as the longer word of a pair too."""
    size = F.length("word")
    places = [
        F.struct(F.lit(band).alias("band"), F.lit(side).alias("side"), (size - less).alias("l"), F.xxhash64(F.lit(band), f"m{band}", F.lit(side), size - less, _half(side, size - less)).alias("key"))
        for less in ((0, 1) if longer else (0,))
        for band in range(BANDS)
        for side in (0, 1)
    ]
    return facts.select("*", F.explode(F.array(*places)).alias("at")).select(*facts.columns, "at.*")


def _near(a: str, b: str) -> Column:
    """One edit apart, a not the longer one."""
    col = lambda side, name: F.col(f"{side}.{name}")
    flips = sum((F.bit_count(col(a, f"m{k}").bitwiseXOR(col(b, f"m{k}"))) for k in range(BANDS)), F.lit(0))
    more = F.length(col(b, "word")) - F.length(col(a, "word"))
    ordered = ((more == 0) & (col(a, "word") < col(b, "word")) & (flips == 2)) | ((more == 1) & (flips == 1))
    return ordered & (F.levenshtein(col(a, "word"), col(b, "word"), 1) == 1)


def _first_bucket(a: str, b: str) -> Column:
    """Whether the bucket is the first that the pair shares, so that each pair is taken once."""
    col = lambda side, name: F.col(f"{side}.{name}")
    equal = [col(a, f"m{k}") == col(b, f"m{k}") for k in range(BANDS)]
    first_band = F.when(equal[0], 0).when(equal[1], 1).otherwise(2)
    half = F.floor(col(a, "l") / 2).cast("int")
    first_side = F.when(F.substring(col(a, "word"), F.lit(1), half) == F.substring(col(b, "word"), F.lit(1), half), 0).otherwise(1)
    return (col(a, "band") == first_band) & (col(a, "side") == first_side)


def _without_one(rows: DataFrame) -> DataFrame:
    """Rows of large buckets once for each letter, keyed by the word without it; a shorter word also as it is."""
    at = F.col("i")
    rest = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    inside = cut.filter("length(word) = l").select(*rows.columns, F.xxhash64("key", "i", rest).alias("cut"))
    longer = cut.filter("length(word) > l").select(*rows.columns, F.xxhash64("key", F.lit(-1), rest).alias("cut"))
    whole = rows.filter("length(word) = l").select("*", F.xxhash64("key", F.lit(-1), "word").alias("cut"))
    return inside.unionByName(longer).unionByName(whole)


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words(word, n) that are one edit apart, once; a is the shorter or smaller one."""
    facts = staged(words.select("word", "n", F.arrow_udf(_masks, "struct<m0:int,m1:int,m2:int>")("word").alias("m")).select("word", "n", "m.*"))
    shorter, either = _dealt(facts, False), _dealt(facts, True)
    large = staged(either.groupBy("key").count().filter(F.col("count") > bucket).select("key"))
    number = large.count()
    taken = [F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")]
    if not number:
        return shorter.alias("a").join(either.alias("b"), (F.col("a.key") == F.col("b.key")) & _near("a", "b") & _first_bucket("a", "b")).select(*taken)
    large = F.broadcast(large) if small_enough(number, 16) else large
    one, other = (x.join(large, "key", "left_anti") for x in (shorter, either))
    small = one.alias("a").join(other.alias("b"), (F.col("a.key") == F.col("b.key")) & _near("a", "b") & _first_bucket("a", "b")).select(*taken)
    split = _without_one(either.join(large, "key", "left_semi"))
    held = split.filter("length(word) = l").alias("a").join(split.alias("b"), (F.col("a.cut") == F.col("b.cut")) & _near("a", "b") & _first_bucket("a", "b")).select(*taken)
    return small.unionByName(held.distinct())


def roots_of(forms: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(word, root): the end of the chain of forms(word, form) from each word."""
    roots = staged(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")
    raise RuntimeError(f"chains longer than 2^{max_rounds}")


def variants(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_COUNT, ratio: int = RATIO, noise: int = 0, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of docs."""
    words = staged(word_counts(docs, least, times, noise))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = near_pairs(words, bucket).select(F.explode(both).alias("x")).select("x.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    found = staged(
        words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))
    )
    roots = roots_of(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
