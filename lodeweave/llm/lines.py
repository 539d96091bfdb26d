"""Line dedup that can be taken back: exact reference counts of lines, and cuckoo filters of the repeated ones.

A line's key is the line without ASCII blanks at both ends and with A-Z lower-cased; keys of at least LEAST_CHARS
code points count. A key that LEAST_DOCS documents hold is repeated, and its lines go everywhere but in the
document with the largest id that holds it.

The index is a folder of versions, v<number>-<bits>; each has three tables, cut in 2^bits shards by the first bits of the key:

* refs (shard, hi, lo, doc_id): which document holds which key, each pair once;
* counts (shard, hi, lo, n, last): the exact number of documents of each key and the largest id of them;
* filters (shard, size, slots): a cuckoo filter of the shard's repeated keys, 16 bits a key.

An update changes the counts of the keys that come or go (the largest id of a key is sought again only for keys of
documents that go) and copies the others; keys that became repeated are put into their shard's filter, keys that
no longer are are taken out. A filter that is full is built again from the counts, with twice the room. Shards
split as keys grow: their number is set so that one holds about SHARD_KEYS keys. A version counts once it is marked as
done, so a lost executor, or an update that fails, leaves the last version as it was.

Looking up: tasks ask the filters (broadcast below a checked size; else every key is a hit) and send only hits to the
exact counts, which drop what the filter let through by chance. Documents without a hit are never shuffled.

Keys are told apart by 128 bits (XXH3). Defined cases: null and empty texts are one empty line; a document is a
doc_id, so rows that share one count once; a null id is one more document, below all others; a document that the index holds
is not inserted again; ids that it doesn't hold are not deleted; repeated lines of the document that keeps a
key all stay; texts of any length are read whole, one at a time; an empty table gives an empty result; further
columns are carried by `without_repeated_lines` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import BROADCAST_BYTES, folder_names, make_folder, shared_dir, small_enough, staged
from lodeweave.sources.shared import batch_rows

LEAST_CHARS, LEAST_DOCS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 20
SLOTS, ROUNDS, LOAD = 4, 64, 0.85
#: Rows with whole texts that go to Python at once.
TEXTS_AT_ONCE = 1000
REFS, COUNTS, FILTERS = "shard int, hi long, lo long, doc_id long", "shard int, hi long, lo long, n long, last long", "shard int, size int, slots binary"


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of four 16-bit fingerprints, each hash in one of two buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS), 0: free

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, math.ceil(math.log2(max(1, n) / (SLOTS * LOAD)))), SLOTS), np.uint16))

    @classmethod
    def load(cls, slots: bytes) -> Cuckoo:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype(np.int64) * 0x5BD1E995 & len(self.slots) - 1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        bucket = (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, bucket, self._other(bucket, mark)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, other = self._places(hashes)
        return ((self.slots[one] == mark[:, None]) | (self.slots[other] == mark[:, None])).any(axis=1)

    def _put(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fill free slots of the buckets; which marks found none."""
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.searchsorted(bucket, bucket)
        nth = np.arange(len(bucket)) - first
        free = self.slots[bucket] == 0
        rank = np.cumsum(free, axis=1) - 1
        slot = np.argmax(free & (rank == nth[:, None]), axis=1)
        fits = nth < free.sum(axis=1)
        self.slots[bucket[fits], slot[fits]] = mark[order][fits]
        left = np.ones(len(mark), bool)
        left[order[fits]] = False
        return left

    def add(self, hashes: np.ndarray) -> bool:
        """Put distinct keys in; False: it is full, and has to be built anew."""
        mark, bucket, other = self._places(hashes)
        left = self._put(mark, bucket)
        mark, bucket = mark[left], other[left]
        for k in range(ROUNDS * 8):
            left = self._put(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return True
            turn = np.unique(bucket, return_index=True)[1]  # one of each full bucket takes a slot, and its mark moves on
            slot = (turn + k) % SLOTS
            moved = self.slots[bucket[turn], slot]
            self.slots[bucket[turn], slot] = mark[turn]
            mark[turn], bucket[turn] = moved, self._other(bucket[turn], moved)
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Take out keys that were put in, one mark for each."""
        mark, bucket, other = self._places(hashes)
        waiting = np.arange(len(mark))
        while len(waiting):
            now = waiting[np.unique(np.minimum(bucket, other)[waiting], return_index=True)[1]]  # one of each pair of buckets at a time
            for at in (bucket, other):
                found = self.slots[at[now]] == mark[now, None]
                hit = found.any(axis=1)
                self.slots[at[now[hit]], np.argmax(found[hit], axis=1)] = 0
                now = now[~hit]
            waiting = np.setdiff1d(waiting, waiting[np.unique(np.minimum(bucket, other)[waiting], return_index=True)[1]], assume_unique=True)


def _keys(text: str, least: int) -> list[bytes | None]:
    """The key of each line; None where it is too short to count."""
    out: list[bytes | None] = []
    for line in text.split("\n"):
        line = line.strip(BLANKS)
        out.append(line.encode().lower() if len(line) >= least else None)
    return out


def _hashes(text: str, least: int) -> list[tuple[int, int]]:
    """Both halves of each different key's hash."""
    whole = {xxhash.xxh3_128_intdigest(k) for k in _keys(text, least) if k is not None}
    return [(h >> 64, h & (1 << 64) - 1) for h in whole]


def _lister(least: int):
    def keys(texts: pa.Array) -> pa.Array:
        sizes, hi, lo = [0], [], []
        for x in texts:
            own = _hashes(x.as_py() or "", least)
            hi += [h for h, _ in own]
            lo += [h for _, h in own]
            sizes.append(len(hi))
        values = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (hi, lo)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(values, ["hi", "lo"]))

    return keys


def keys_of(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(hi, lo, doc_id): each document's keys once."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.arrow_udf(_lister(least), "array<struct<hi:long,lo:long>>")(F.col("text").cast("string"))).alias("key"))
    return own.select("key.*", "doc_id").distinct()


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


def _filter_update(key: tuple, changes: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter with the keys in that became repeated, and those out that no longer are."""
    if not len(changes):
        return old[["shard", "size", "slots"]]
    value = lambda rows: rows["lo"].to_numpy(np.int64).view(np.uint64)
    own = Cuckoo.load(old["slots"].iloc[0]) if len(old) else Cuckoo.for_keys(len(changes))
    size = (int(old["size"].iloc[0]) if len(old) else 0) + int(changes["change"].sum())
    own.remove(value(changes[changes["change"] < 0]))
    full = size > LOAD * own.slots.size or not own.add(value(changes[changes["change"] > 0]))
    return pd.DataFrame({"shard": [int(key[0])], "size": [size], "slots": [b"" if full else own.slots.tobytes()]})


def _filter_builder(key: tuple, repeated: pd.DataFrame) -> pd.DataFrame:
    values = repeated["lo"].to_numpy(np.int64).view(np.uint64)
    room = 2 * len(values)
    while not (own := Cuckoo.for_keys(room)).add(values):
        room *= 2
    return pd.DataFrame({"shard": [int(key[0])], "size": [len(values)], "slots": [own.slots.tobytes()]})


class LineIndex:
    """Reference counts and filters of the lines of the documents inserted and not deleted, in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.least_chars, self.least_docs, self.shard_keys = spark, path.rstrip("/"), least_chars, least_docs, shard_keys

    def version(self) -> tuple[int, int]:
        """Number and bits of the last version that is done; (0, 0) before the first."""
        found = [tuple(map(int, m.groups())) for m in map(re.compile(r"done-v(\d+)-(\d+)").fullmatch, folder_names(self.spark, self.path)) if m]
        return max(found, default=(0, 0))

    def _folder(self, version: int, bits: int) -> str:
        return f"{self.path}/v{version}-{bits}"

    def _read(self, name: str, schema: str) -> DataFrame:
        version, bits = self.version()
        return self.spark.read.schema(schema).parquet(f"{self._folder(version, bits)}/{name}") if version else self.spark.createDataFrame([], schema)

    def refs(self) -> DataFrame:
        return self._read("refs", REFS)

    def counts(self) -> DataFrame:
        return self._read("counts", COUNTS)

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    def insert(self, docs: DataFrame) -> None:
        """Add the documents of docs(doc_id, text) that the index doesn't hold."""
        new = keys_of(docs, self.least_chars)
        if self.version()[0]:
            ids = docs.select(F.col("doc_id").cast("long").alias("known")).distinct()
            known = self.refs().join(ids, F.col("doc_id").eqNullSafe(F.col("known")), "left_semi").select(F.col("doc_id").alias("known")).distinct()
            new = new.join(known, F.col("doc_id").eqNullSafe(F.col("known")), "left_anti")
        self._update(staged(new), None)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents of ids(doc_id): the index is then as if they had never been inserted."""
        gone = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        out = self.refs().join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("hi", "lo", "doc_id")
        self._update(None, staged(out))

    def _update(self, new: DataFrame | None, gone: DataFrame | None) -> None:
        (before, bits_before), old = self.version(), self.counts()
        held = self.refs().select("hi", "lo", "doc_id")
        if gone is not None:
            of = gone.select(F.col("hi").alias("g_hi"), F.col("lo").alias("g_lo"), F.col("doc_id").alias("g_id"))
            held = held.join(of, (F.col("hi") == F.col("g_hi")) & (F.col("lo") == F.col("g_lo")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left_anti")
        if new is not None:
            held = held.unionByName(new) if before else new
        keys = old.count() + (new.agg(F.approx_count_distinct("hi")).first()[0] if new is not None else 0)
        bits = max(bits_before, min(20, math.ceil(math.log2(max(1, keys) / self.shard_keys))))
        to = self._folder(before + 1, bits)
        held.select(_shard(bits).alias("shard"), "hi", "lo", "doc_id").write.mode("overwrite").parquet(f"{to}/refs")
        held = self.spark.read.schema(REFS).parquet(f"{to}/refs")
        counted = lambda rows: rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        if before == 0:
            now = counted(held)
        elif gone is None:  # counts add up, and so do largest ids
            both = old.select("hi", "lo", "n", "last").unionByName(counted(new))
            now = both.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        else:  # the largest id may have gone: count the touched keys again
            touched = staged(gone.select("hi", "lo").distinct())
            now = old.join(touched, ["hi", "lo"], "left_anti").select("hi", "lo", "n", "last").unionByName(counted(held.join(touched, ["hi", "lo"], "left_semi")))
        now.select(_shard(bits).alias("shard"), "hi", "lo", "n", "last").write.mode("overwrite").parquet(f"{to}/counts")
        now = self.spark.read.schema(COUNTS).parquet(f"{to}/counts")
        self._update_filters(to, old if before and bits == bits_before else None, now)
        make_folder(self.spark, f"{self.path}/done-v{before + 1}-{bits}")

    def _update_filters(self, to: str, old: DataFrame | None, now: DataFrame) -> None:
        """Change the filters by the keys that crossed the limit; build those anew that are full, or whose shards were cut anew."""
        repeated = now.filter(F.col("n") >= self.least_docs).select("shard", "hi", "lo")
        filters = self.filters()
        if old is None:
            repeated.groupBy("shard").applyInPandas(_filter_builder, FILTERS).write.mode("overwrite").parquet(f"{to}/filters")
            return
        was = old.filter(F.col("n") >= self.least_docs).select("shard", "hi", "lo")
        changes = repeated.withColumn("change", F.lit(1)).unionByName(was.withColumn("change", F.lit(-1)))
        changes = changes.groupBy("shard", "hi", "lo").agg(F.sum("change").cast("int").alias("change")).filter("change <> 0")
        changed = staged(changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_filter_update, FILTERS))
        full = changed.filter("length(slots) = 0").select("shard")
        again = repeated.join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInPandas(_filter_builder, FILTERS)  # at most 2^20 shards
        changed.filter("length(slots) > 0").unionByName(again).write.mode("overwrite").parquet(f"{to}/filters")

    def _probed(self, docs: DataFrame) -> DataFrame:
        """docs' rows (whole, in `row`) with the keys that the filters hold."""
        filters = self.filters()
        size = filters.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        top = None
        if size <= BROADCAST_BYTES:
            held = {r.shard: r.slots for r in filters.collect()}  # at most BROADCAST_BYTES
            top = (self.version()[1], self.spark.sparkContext.broadcast(held))
        probe = F.arrow_udf(_prober(self.least_chars, top), "array<struct<hi:long,lo:long>>")
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), probe(F.col("text").cast("string")).alias("hits"))

    def repeated_lines(self, docs: DataFrame) -> DataFrame:
        """(row, drop): each row of docs with the keys of the lines that it loses, as an array of 16 bytes each."""
        probed = self._probed(docs)
        hits = staged(probed.select("id", F.explode("hits").alias("key")).select("id", "key.*").distinct())
        exact = self.counts().filter(F.col("n") >= self.least_docs).select("hi", "lo", "last")
        drops = hits.join(exact, ["hi", "lo"]).filter(~F.col("id").eqNullSafe(F.col("last")))
        code = F.concat(F.unhex(F.lpad(F.hex("hi"), 16, "0")), F.unhex(F.lpad(F.hex("lo"), 16, "0")))
        drops = staged(drops.groupBy("id").agg(F.collect_list(code).alias("drop")).withColumnRenamed("id", "of"))  # a document's own keys
        some = drops.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
        drops = F.broadcast(drops) if small_enough(some[0] + some[1], 32) else drops
        held = F.size("hits") > 0
        changed = probed.filter(held).join(drops, F.col("id").eqNullSafe(F.col("of")), "left").select("row", "drop")
        return probed.filter(~held).select("row", F.lit(None).cast("array<binary>").alias("drop")).unionByName(changed)


def _prober(least: int, top):
    def probe(texts: pa.Array) -> pa.Array:
        found = _lister(least)(texts)
        if top is None:
            return found
        bits, held = top
        own = _loaded(held)
        hi, lo = (found.values.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        shard = (hi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)
        keep = np.zeros(len(hi), bool)
        for s in np.unique(shard).tolist():
            if s in own:
                at = np.flatnonzero(shard == s)
                keep[at] = own[s].has(lo[at])
        ends = np.concatenate([[0], np.cumsum(keep)])[found.offsets.to_numpy()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.values.filter(pa.array(keep)))

    return probe


#: The filters that this worker loaded last, with the broadcast they are from.
_LOADED: dict = {}


def _loaded(held) -> dict[int, Cuckoo]:
    if _LOADED.get("of") is not held:
        _LOADED.clear()
        _LOADED.update({"of": held, "filters": {s: Cuckoo.load(x) for s, x in held.value.items()}})
    return _LOADED["filters"]


def _kept(least: int):
    def kept(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for x, drop in zip(texts, drops):
            text = x.as_py() or ""
            lines = text.split("\n")
            gone = set(drop.as_py() or ())
            left = lines
            if gone:
                left = [line for line, k in zip(lines, _keys(text, least)) if k is None or xxhash.xxh3_128_digest(k) not in gone]
            out.append((len(lines), len(lines) - len(left), "\n".join(left) if len(left) < len(lines) else text))
        n, dropped, text = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(text, pa.string())], ["n_lines", "n_dropped", "text"])

    return kept


def _digest(least: int):
    def digest(texts: pa.Array, drops: pa.Array) -> pa.Array:
        n, dropped, text = _kept(least)(texts, drops).flatten()
        return pa.StructArray.from_arrays([n, dropped, pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for t in text], pa.string())], ["n_lines", "n_dropped", "kept_sha256"])

    return digest


def without_repeated_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with the repeated lines of the index left out of their texts; rows whose text is null stay as they are."""
    rows = index.repeated_lines(docs)
    kept = F.arrow_udf(_kept(index.least_chars), "struct<n_lines:long,n_dropped:long,text:string>")(F.col("row.text").cast("string"), "drop")
    rows = rows.select("row", kept.alias("kept"))
    columns = [F.when(F.col("kept.n_dropped") > 0, F.col("kept.text")).otherwise(F.col("row.text")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns)


def line_digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of docs against an index of their own lines."""
    spark = docs.sparkSession
    index = LineIndex(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", least_chars, least_docs)
    facts = F.arrow_udf(_digest(least_chars), "struct<n_lines:long,n_dropped:long,kept_sha256:string>")(F.col("row.text").cast("string"), "drop")
    with batch_rows(spark, TEXTS_AT_ONCE):
        index.insert(docs.select("doc_id", "text"))
        rows = index.repeated_lines(docs.select("doc_id", "text"))
        return staged(rows.select(F.col("row.doc_id").alias("doc_id"), facts.alias("x")).select("doc_id", "x.*"))
