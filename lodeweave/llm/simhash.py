"""Near-dedup by SimHash fingerprints and pigeonhole blocks.

Fingerprint: lower-case A-Z, words between ASCII blanks, shingles of three words with repeats, XXH64
(seed 42) of each; a bit is set if it is set in over half of the hashes.

Links: two fingerprints that differ in at most three bits agree on one of four blocks of their bits.
Distinct fingerprints are dealt by (block, value) and compared inside such a bucket only. A bucket
with over BUCKET fingerprints is split again: its remaining bits are cut in four blocks, of which
close pairs share one too. No pair is lost, and once 12 bits are left a bucket has 4,096
fingerprints at most. Each bucket returns a spanning forest of its close pairs, not the pairs.

Defined cases: null or blank text has fingerprint zero and links like any other; fewer than three
words are one shingle; rows with equal fingerprints are one class whatever their number; repeated
rows stay repeated; a class whose ids are all null has a null component id; an empty table gives an
empty result; further columns of the input are ignored by `near_groups` and carried by `one_of_each`,
whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import join_often, row_order, small_enough, staged
from lodeweave.llm.components import connected_components

RADIUS = 3
BUCKET = 1024
LEAST_BITS = 12
CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = (ends - size)[:n]
    stops = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n)


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The fingerprint of hashes: bits that are set in over half of them (of their weight)."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[k : k + CHUNK].astype(np.int64) @ bits
    n = len(hashes) if weights is None else int(weights.sum())
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((majority(shingle_hashes(x.as_py())) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, print long")


def _cut(rows: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """Each row dealt to four buckets by another block of its remaining bits; the bits that then remain."""
    width = -(-bits // 4)
    parts = []
    for k in range(4):
        at = k * width
        block = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << at) - 1))
        high = F.shiftrightunsigned("rest", at + width) if at + width < 64 else F.lit(0).cast("long")
        parts.append(F.struct((F.col("path") * 4 + k + 1).alias("path"), F.shiftleft("value", width).bitwiseOR(block).alias("value"), F.shiftleft(high, at).bitwiseOR(low).alias("rest")))
    return rows.select("print", F.explode(F.array(*parts)).alias("x")).select("print", "x.*"), 4 * width - width


def buckets(prints: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(path, value, print): distinct fingerprints dealt to buckets of at most `limit`, or of the last few bits."""
    rows, bits = _cut(prints.select("print", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("value"), F.col("print").alias("rest")), 64)
    done = None
    while True:
        heavy = rows.groupBy("path", "value").count().filter(F.col("count") > limit).select("path", "value")
        if bits <= LEAST_BITS or heavy.isEmpty():
            break
        heavy = staged(heavy)
        light = rows.join(heavy, ["path", "value"], "left_anti").select("path", "value", "print")
        done = light if done is None else done.unionByName(light)
        rows, bits = _cut(rows.join(heavy, ["path", "value"], "left_semi"), bits)
        rows = staged(rows)
    rows = rows.select("path", "value", "print")
    return rows if done is None else done.unionByName(rows)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _linker(radius: int):
    def close(group: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        at, step, a, b = np.arange(len(prints)), 1, [], []
        while True:
            at = at[at + step < len(prints)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
            a.append(near)
            b.append(near + step)
            step += 1
        label = forest(len(prints), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(prints))
        moved = np.flatnonzero(label != np.arange(len(prints)))
        return pd.DataFrame({"a": prints[moved].view(np.int64), "b": prints[label[moved]].view(np.int64)})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets come sorted; the last bucket of a batch may go on in the next one."""
        left = None
        for rows in batches:
            rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
            path, value = rows["path"].to_numpy(), rows["value"].to_numpy()
            group = np.cumsum(np.concatenate([[0], (path[1:] != path[:-1]) | (value[1:] != value[:-1])])) if len(rows) else np.empty(0, int)
            last = int(np.searchsorted(group, group[-1])) if len(rows) else 0
            yield close(group[:last], rows["print"].to_numpy(np.int64)[:last].view(np.uint64))
            left = rows.iloc[last:]
        if left is not None and len(left):
            yield close(np.zeros(len(left), int), left["print"].to_numpy(np.int64).view(np.uint64))

    return link


def close_links(prints: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """(a, b): links that connect what pairs of distinct fingerprints within the radius (three at most) connect."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("four blocks find up to three differing bits")
    dealt = buckets(prints, limit).repartition("path", "value").sortWithinPartitions("path", "value")
    return dealt.select("path", "value", "print").mapInPandas(_linker(radius), "a long, b long")


def classes_of(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """print, n (its rows), root (the class's own print), component_id, class_rows: a row for each fingerprint of prints(doc_id, print).

    links gives the links (a, b) of the distinct fingerprints (print, n rows).
    """
    own = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = staged(connected_components(links(own.select("print", "n"))))
    rooted = own.join(roots, own["print"] == roots["node"], "left").select("print", "first", "n", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("class_rows"))
    return rooted.join(least, "root").select("print", "n", "root", "component_id", "class_rows")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    return classes_of(prints, lambda own: close_links(own.select("print"), radius))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that links reach): a row for each row."""
    prints = staged(fingerprints(docs))
    named = staged(_classes(prints, radius).select("print", "component_id", "n"))
    return join_often(prints, named, "print", "n").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _print_of(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((majority(shingle_hashes(x.as_py())) for x in texts), np.uint64, len(texts)).view(np.int64))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (a null id after all others; of rows that share it, one)."""
    own = staged(packed_rows(docs).withColumn("print", F.arrow_udf(_print_of, "long")(F.col("row.text").cast("string"))))
    classes = _classes(own.select(F.col("id").alias("doc_id"), "print"), radius)
    return first_of_each(own, classes)


def packed_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), id, size (of the text), place: whatever docs' columns are called, they can't clash with names of ours."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("id"), F.length(F.col("text").cast("string")).alias("size"), row_order(docs).alias("place"))


def first_of_each(own: DataFrame, classes: DataFrame) -> DataFrame:
    """The columns in own.row for one row of each class; own: row, id, size, place, print."""
    many = staged(classes.filter("class_rows > 1").select(F.col("print").alias("of"), "root", F.col("component_id").alias("first")))
    if small_enough(many.count(), 48):
        many = F.broadcast(many)
    shared = own["print"] == many["of"]
    single = own.join(many, shared, "left_anti").select("row.*")
    firsts = own.join(many, shared & own["id"].eqNullSafe(many["first"]))
    kept = firsts.groupBy("root").agg(F.min_by("row", F.struct("print", "size", "place")).alias("row")).select("row.*")
    return single.unionByName(kept)
