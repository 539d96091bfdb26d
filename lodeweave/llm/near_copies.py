"""Near-dedup of texts at 0.8 of their five-word shingles: SimHash first, then shared shingles for what it can't reach, exact similarity.

Similarity: shared shingles over all shingles of two texts (Jaccard), each shingle once; words as
op8 cuts them.

1. SimHash: texts whose fingerprints are equal or differ in three bits at most meet by op8's blocks; of
   fingerprints, a spanning forest is looked at. What the exact similarity confirms is linked. A similarity of
   0.8 turns about ten bits of 64 (sd 3), and a radius that covers it (23, as in op1) holds one in sixty of
   all pairs, so blocks of bits would compare all texts with all. Shingles are the blocks for the rest:
2. Prefixes: in any one order of all shingles, two sets at 0.8 share one of the first
   n - ceil(0.8 n) + 1 of each. The order puts shingles first whose cell of 65,536 is rare, so that what
   many texts hold is hardly ever in a prefix. Most prefix shingles are of one text only: tasks send
   owners sorted lists of four bytes for a shingle and each of two size classes (texts at 0.8 share a class),
   and owners give back a bit map of fixed size of what two texts have. Only shingles of set bits become rows,
   so none that two texts of like size share is lost. Texts that share
   a prefix shingle, are of like size, can still reach 0.8 from its places, whose sketches allow it and that aren't linked
   by step 1 are candidates. A sketch has the parities of SKETCH cells of all of a text's shingles: two sketches differ in no
   more bits than the texts have shingles apart, so the bound is exact. It says little of texts of over LONG shingles
   together; those pairs meet by longer sketches first (_possible). A pair is looked at where the first of its two first
   shingles that both have meet, not again for each shingle they share.
3. The exact similarity decides on every candidate. (Their texts meet, as they pack better than eight bytes a shingle.)
   radius, if it is given, drops pairs of LEAST_BITS_N shingles or more whose SimHashes differ in more
   bits first: that can lose pairs (at 23 bits about one in 100,000 at 0.8), so nothing here gives it.

Crowds: in a group of over WHOLE texts each hands on one candidate, the nearest by sketch of the next STEPS, and of the next
STEPS * STEPS where these links leave it apart. As each has one after it in the group, that connects copies of one text by as many
pairs as there are texts. Then all texts of these groups that the links do not connect are compared with each other: by sketches
in the task, so only pairs that may be close become rows. No pair of two components is left out.

Shingles of all texts are cut again wherever they are needed: kept on disk they would take more than the texts.

Defined cases: texts without words are one class; fewer than five words are one shingle; equal sets of shingles
are one class. Shingles and sets are told apart by 64-bit hashes. Further columns are carried whatever their
names; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import join_often, nothing_kept_in_worker, small_enough, staged
from lodeweave.llm.components import connected_components
from lodeweave.llm.simhash import classes_of, close_links, first_of_each, majority, packed_rows, shingle_hashes
from lodeweave.sources.shared import batch_rows

WORDS = 5
CELLS = 1 << 16
STEPS, WHOLE = 32, 4
#: Bits of a sketch that goes with each shingle, and shingles of two texts beyond which it says little.
SKETCH, LONG = 512, 1024
LEAST_BITS_N = 32
LOW = np.uint64(48)
LOW_BITS = np.uint64((1 << 48) - 1)
#: The map of shared shingles (16 MB), and shingles that a task lists at once.
MAP_BITS, LISTED = 27, 1 << 18
#: Pairs that a task holds before it hands them on.
HELD = 1 << 16
#: Rows without texts that go to Python at once.
NUMBERS_AT_ONCE = 10_000


def _close(shared, n, m):
    """0.8 in whole numbers: shared / (n + m - shared) >= 4 / 5."""
    return 9 * shared >= 4 * (n + m)


def _set_of(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def _sketch(own: np.ndarray, bits: int) -> bytes:
    """The parity of a set's hashes in each of `bits` cells; cells are low bits, so halves of a sketch xor to the next shorter one."""
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def _facts(texts: pa.Array) -> pa.Array:
    """A hash of each text's set, its SimHash and its size."""
    nothing_kept_in_worker()  # an earlier stage's language model
    out = []
    for x in texts:
        own = _set_of(x.as_py())
        out.append((xxhash.xxh64_intdigest(own.tobytes()), majority(own), len(own)))
    prints, bits, sizes = np.array(out, np.uint64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(prints.view(np.int64)), pa.array(bits.view(np.int64)), pa.array(sizes.astype(np.int32))], ["print", "bits", "n"])


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        held, size = [], 0
        for x in batch.column("text"):
            held.append(_set_of(x.as_py()) >> LOW)
            size += len(held[-1])
            if size > CELLS:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=CELLS)
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=CELLS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["cell", "n"])


def cell_ranks(texts: DataFrame) -> np.ndarray:
    """The place of each cell, the rarest first."""
    rows = texts.select("text").mapInArrow(_count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS
    counts = np.zeros(CELLS, np.int64)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    ranks = np.empty(CELLS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(CELLS, dtype=np.uint64)
    return ranks


def _prefix(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a text's set in the order of all shingles; the low 48 bits are the hash's own."""
    return np.sort(ranks[h >> LOW] << LOW | h & LOW_BITS)[: len(h) - (4 * len(h) + 4) // 5 + 1]


def _mixed(prefix: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """48 bits for each shingle and each of two size classes of its text's n shingles; texts whose sizes differ by a quarter at most share a class."""
    size = np.floor(np.log(np.atleast_1d(n)) / np.log(1.26)).astype(np.uint64)
    one, other = ((prefix ^ (size + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) for k in (0, 1))
    return one >> np.uint64(16), other >> np.uint64(16)


def _lists(ranks, bits: int):
    def sent(held: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        own = _mixed(np.concatenate(held), np.repeat(sizes, [len(h) for h in held]))
        x = np.sort(np.concatenate(own)) >> np.uint64(16 - bits)  # the owner's bits and 32 more
        x = x[np.concatenate([x[:2] >= 0, x[2:] != x[:-2]])]  # two of each tell as much as more
        owner = (x >> np.uint64(32)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        values = [part.astype(np.uint32).tobytes() for part in np.split(x, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(owner[begin]), pa.array(values, pa.binary())], names=["owner", "shingles"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, size = [], [], 0
        for batch in batches:
            for x, n in zip(batch.column("text"), batch.column("n").to_pylist()):
                held.append(_prefix(_set_of(x.as_py()), ranks.value))
                sizes.append(n)
                size += len(held[-1])
                if size >= LISTED:
                    yield sent(held, sizes)
                    held, sizes, size = [], [], 0
        if size:
            yield sent(held, sizes)

    return lists


def _repeated(bits: int):
    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.concatenate([np.frombuffer(v, np.uint32) for v in rows["shingles"]]))
        segment = np.zeros(1 << (MAP_BITS - bits), bool)
        segment[x[1:][x[1:] == x[:-1]] >> np.uint32(32 + bits - MAP_BITS)] = True
        return pd.DataFrame({"owner": [int(rows["owner"].iloc[0])], "segment": [np.packbits(segment, bitorder="little").tobytes()]})

    return repeated


def shared_shingles(texts: DataFrame, ranks) -> np.ndarray:
    """A map of 2^MAP_BITS bits: set where a prefix shingle of two texts falls."""
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 5
    bits = min(16, max(6, (total // LISTED).bit_length() + 1))  # owners: about half of LISTED shingles each
    rows = texts.filter("n > 0").select("text", "n").mapInArrow(_lists(ranks, bits), "owner int, shingles binary")
    rows = rows.groupBy("owner").applyInPandas(_repeated(bits), "owner int, segment binary")
    found = np.zeros((1 << bits, 1 << (MAP_BITS - bits - 3)), np.uint8)
    for owner, segment in rows.toPandas().itertuples(index=False):  # the map in parts
        found[owner] = np.frombuffer(segment, np.uint8)
    return found.ravel()


_ROW = "token long, key long, bits long, n int, sketch binary, lead long, second long, place int"


def _prefixes(ranks, shared):
    """A row for each prefix shingle that others may share; lead, second: the text's first two of them (one alone: twice)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, sketches, leads = [], [], [], []
            for x, n in zip(batch.column("text"), batch.column("n").to_pylist()):
                whole = _set_of(x.as_py())
                own = _prefix(whole, ranks.value)
                found = np.zeros(len(own), np.uint8)
                for mixed in _mixed(own, n):
                    bit = mixed >> np.uint64(48 - MAP_BITS)
                    found |= shared.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                place = np.flatnonzero(found)
                tokens.append(own[place].view(np.int64))
                places.append(place.astype(np.int32))
                sketches.append(_sketch(whole, SKETCH) if len(place) else b"")
                leads.append((tokens[-1][0], tokens[-1][min(1, len(place) - 1)]) if len(place) else (0, 0))
            if tokens:
                at = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
                again = [batch.column(c).take(pa.array(at)) for c in ("key", "bits", "n")] + [pa.array(sketches, pa.binary()).take(pa.array(at))]
                lead, second = np.array(leads, np.int64)[at].T
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *again, pa.array(lead), pa.array(second), pa.array(np.concatenate(places))], names=["token", "key", "bits", "n", "sketch", "lead", "second", "place"])

    return prefixes


_PAIRS = "a long, b long, total long"


def _pairs(steps: int | None, radius: int | None):
    """Pairs of one group that can be close and have different roots, with the shingles of both texts.

    steps: in groups of over WHOLE rows, each row's nearest of the next `steps`; none: all pairs.
    """

    def counted(found: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b", "total"]).drop_duplicates(["a", "b"])

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        token, key, bits, n, place, root, lead, second = (rows[c].to_numpy(np.int64) for c in ("token", "key", "bits", "n", "place", "root", "lead", "second"))
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(-1, SKETCH // 64)
        _, group, size = np.unique(token, return_inverse=True, return_counts=True)
        whole = np.ones(len(rows), bool) if steps is None else (size <= _whole(steps))[group]
        nearest, least = np.full(len(rows), -1), np.full(len(rows), SKETCH + 1)
        rows_of = lambda x, y: np.array([np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), n[x] + n[y]])
        at, step, found, held = np.arange(len(rows)), 1, [], 0
        while steps is None or step <= steps:
            at = at[at + step < len(rows)]
            to = at + step
            at = at[(token[at] == token[to]) & (5 * n[at] >= 4 * n[to])]  # sizes rise in a group
            if not len(at):
                break
            x = at[root[at] != root[at + step]]
            y = x + step
            most = np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y])
            # the first of either's first two shingles that both have: there they meet
            first = np.where((lead[x] == lead[y]) | (lead[x] == second[y]), lead[x], np.where((second[x] == lead[y]) | (second[x] == second[y]), second[x], token[x]))
            ok = _close(most, n[x], n[y]) & (first == token[x])
            if radius is not None:
                ok &= (n[x] < LEAST_BITS_N) | (np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)) <= radius)
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
            ok = _near(apart, n[x] + n[y])
            x, y, apart = x[ok], y[ok], apart[ok]
            found.append(rows_of(x[whole[x]], y[whole[x]]))
            held += found[-1].shape[1]
            better = ~whole[x] & (apart < least[x])
            nearest[x[better]], least[x[better]] = y[better], apart[better]
            if held > HELD:
                yield counted(found)
                found, held = [], 0
            step += 1
        x = np.flatnonzero(nearest >= 0)
        if held or len(x):
            yield counted([*found, rows_of(x, nearest[x])])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come sorted; the last group of a batch may go on in the next one."""
        left = None
        for rows in batches:
            rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
            if len(rows):
                token = rows["token"].to_numpy(np.int64)
                last_group = int(np.searchsorted(token, token[-1]))
                yield from pairs(rows.iloc[:last_group])
                rows = rows.iloc[last_group:]
            left = rows
        if left is not None and len(left):
            yield from pairs(left)

    return find


def _whole(steps: int) -> int:
    """Rows of a group in which all pairs are looked at first."""
    return min(WHOLE, steps + 1)


def _near(apart, total):
    """0.8 by the shingles that one of two texts has alone, or fewer: (total - apart) / 2 shared ones are close."""
    return 9 * apart <= total


def _found(rows: DataFrame, steps: int | None, radius: int | None) -> DataFrame:
    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "key")
    with batch_rows(rows.sparkSession, NUMBERS_AT_ONCE):
        return staged(dealt.mapInPandas(_pairs(steps, radius), _PAIRS).groupBy("a", "b").agg(F.first("total").alias("total")))


def _long_sketches(texts: pa.Array) -> pa.Array:
    """Sketches of two to four bits a shingle."""
    out = []
    for x in texts:
        own = _set_of(x.as_py())
        out.append(_sketch(own, max(SKETCH, 2 << len(own).bit_length())))
    return pa.array(out, pa.binary())


def _allowed(a: pa.Array, b: pa.Array, total: pa.Array) -> pa.Array:
    out = []
    for x, y, n in zip(a, b, total):
        x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
        size = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
        out.append(bool(_near(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)), n.as_py())))
    return pa.array(out, pa.bool_())


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """key and text of both ends of the pairs."""
    keys = staged(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    return texts.join(F.broadcast(keys) if small_enough(keys.count(), 24) else keys, "key", "left_semi").select("key", "text")


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs that can be close: long texts by longer sketches."""
    long = pairs.filter(F.col("total") > LONG)
    if long.isEmpty():
        return pairs.select("a", "b")
    own = staged(_texts_of(long, texts).select("key", F.arrow_udf(_long_sketches, "binary")("text").alias("sketch")))
    one, other = own.select(F.col("key").alias("a"), F.col("sketch").alias("x")), own.select(F.col("key").alias("b"), F.col("sketch").alias("y"))
    long = long.join(one, "a").join(other, "b").filter(F.arrow_udf(_allowed, "boolean")("x", "y", "total"))
    return staged(pairs.filter(F.col("total") <= LONG).select("a", "b").unionByName(long.select("a", "b")))


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of texts(key, bits, n) by equal fingerprints and fingerprints within three bits, without pairs whose sizes forbid 0.8."""
    own = texts.filter("n > 0").select("key", "bits", "n")
    firsts = staged(own.groupBy("bits").agg(F.min(F.struct("key", "n")).alias("first"), F.count(F.lit(1)).alias("rows")))
    equal = join_often(own, firsts.filter("rows > 1"), "bits", "rows").select("first", F.struct("key", "n").alias("other"))
    ends = lambda name, end: firsts.select(F.col("bits").alias(name), F.col("first").alias(end))
    near = close_links(firsts.select(F.col("bits").alias("print"))).join(ends("a", "first"), "a").join(ends("b", "other"), "b").select("first", "other")
    both = equal.unionByName(near).filter("first.key <> other.key and 5 * least(first.n, other.n) >= 4 * greatest(first.n, other.n)")
    return staged(both.select(F.least("first.key", "other.key").alias("a"), F.greatest("first.key", "other.key").alias("b")).distinct())


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the root that links connect each key with."""
    roots = staged(connected_components(links))
    if small_enough(roots.count(), 16):
        roots = F.broadcast(roots)
    return rows.join(roots, rows["key"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "key").alias("root"))


def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        x, y = _set_of(x.as_py()), _set_of(y.as_py())
        out.append(bool(_close(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
    return pa.array(out, pa.bool_())


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are close."""
    own = staged(_texts_of(pairs, texts))
    one, other = own.select(F.col("key").alias("a"), F.col("text").alias("x")), own.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return staged(pairs.join(one, "a").join(other, "b").filter(F.arrow_udf(_similar, "boolean")("x", "y")).select("a", "b"))


def similar_links(texts: DataFrame, steps: int = STEPS, radius: int | None = None) -> DataFrame:
    """(a, b): links that connect what the pairs of texts(key, text, bits, n), one for each set, at 0.8 or more connect."""
    send = texts.sparkSession.sparkContext.broadcast
    ranks = send(cell_ranks(texts))
    shared = send(shared_shingles(texts, ranks))
    rows = staged(texts.filter("n > 0").select("key", "text", "bits", "n").mapInArrow(_prefixes(ranks, shared), _ROW))
    links = _verified(simhash_pairs(texts), texts)
    tried = _found(_rooted(rows, links), steps, radius)
    links = links.unionByName(_verified(_possible(tried, texts), texts))
    heavy = staged(rows.groupBy("token").count().filter(F.col("count") > _whole(steps)).select("token"))
    many = heavy.count()
    if not many:
        return links
    crowd = staged(rows.join(F.broadcast(heavy) if small_enough(many, 16) else heavy, "token", "left_semi"))
    for further in (steps * steps, None):
        rooted = staged(_rooted(crowd, links))
        mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
        more = staged(_found(rooted.join(mixed, "token", "left_semi"), further, radius).join(tried, ["a", "b"], "left_anti"))
        links = links.unionByName(_verified(_possible(more, texts), texts))
        tried = tried.unionByName(more)
    return links


def one_of_each(docs: DataFrame, steps: int = STEPS, radius: int | None = None) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (a null id after all others; of rows that share it, one)."""
    text = F.col("row.text").cast("string")
    own = packed_rows(docs).withColumn("facts", F.arrow_udf(_facts, "struct<print:long,bits:long,n:int>")(text))
    own = staged(own.select("row", "id", "size", "place", "facts.*"))

    def links(prints: DataFrame) -> DataFrame:
        texts = own.select(F.col("print").alias("key"), text.alias("text"), "bits", "n")
        again = staged(prints.filter("n > 1").select(F.col("print").alias("key")))
        if small_enough(again.count(), 16):
            again = F.broadcast(again)
        repeated = staged(texts.join(again, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"), F.min("bits").alias("bits"), F.min("n").alias("n")))
        return similar_links(texts.join(again, "key", "left_anti").unionByName(repeated), steps, radius)

    classes = classes_of(own.select(F.col("id").alias("doc_id"), "print"), links)
    return first_of_each(own, classes)
