"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. The task that reads an input block hashes its normalised texts to short fingerprints and sends
   every owner of a hash range one sorted, Golomb-Rice-coded list, each value once.
2. Owners decode, see which values came from more than one block and answer each list with a bitmap.
   A block's rows (id, digest, value: no text) meet its bitmaps by one shuffle on the block.
3. Rows whose bit is set, or whose value occurs twice in its own block, are suspects. Only their
   texts are shuffled, grouped by the bytes of the text with map-side combine, so a group with a
   third of all rows reaches its reducer as one row a task.

Fingerprints have log2(rows) + 10 bits: about one clean row in a thousand is checked in vain, and
no equal pair is missed, as equal texts have equal fingerprints.

Defined cases: null text is empty; all empty (or all-blank) texts are one group; of equal texts the
one with the most code points stays, then the smallest doc_id (a null id after all others); rows
that repeat an id count in group_size, and `distinct_rows` keeps one of them (by a hash of their plain
columns); texts of any length are hashed and compared whole; an empty table gives an empty result;
further columns are carried by `distinct_rows` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import join_often, keep_ids, row_order, spread, staged, text_of

SPARE_BITS = 10
OWNER_ROWS = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and fixed-width remainders of the gaps of sorted values in [0, span)."""
    gaps = np.diff(values, prepend=0).astype(np.int64)
    k = max(0, int(math.log2(max(1, span // max(1, len(values))))))
    stops = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(k)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum((quotients << k) + low)


KINDS = "kind string, block int, doc_id long, digest binary, value long, owner int, n int, k int, unary binary, rest binary"


def _batch(size: int, **columns) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("value", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _sender(bits: int, owners: int):
    """Rows with their values and, at the end of an input block, its list for each owner: both leave the task that hashed them."""
    width = math.ceil((1 << bits) / owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), []
        for batch in batches:
            seen.append((batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            size = batch.num_rows
            yield _batch(size, kind=pa.array(["row"] * size), block=pa.array([block] * size), doc_id=batch.column("doc_id"), digest=batch.column("digest"), value=pa.array(seen[-1]))
        values = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        if len(values):
            cuts = np.flatnonzero(np.diff(values // width, prepend=-1))
            out = []
            for part in np.split(values, cuts[1:]):
                o = int(part[0] // width)
                out.append((o, len(part), *golomb_encode(part - o * width, width)))
            columns = dict(zip(("owner", "n", "k", "unary", "rest"), map(pa.array, zip(*out))))
            yield _batch(len(out), kind=pa.array(["list"] * len(out)), block=pa.array([block] * len(out)), **columns)

    return send


def _answer(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
    """For each list that an owner got, a bitmap of the values that another block sent too."""
    decoded = [golomb_decode(x.n, x.k, x.unary, x.rest) for x in lists.itertuples()]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    shared = values[counts > 1]
    maps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in decoded]
    return pd.DataFrame({"block": lists["block"], "owner": lists["owner"], "bitmap": maps})


def _marker(bits: int, owners: int):
    width = math.ceil((1 << bits) / owners)

    def mark(key: tuple, rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        values, index, counts = np.unique(rows["value"].to_numpy(np.int64), return_inverse=True, return_counts=True)
        owner = values // width
        suspect = counts > 1
        for x in maps.itertuples():
            own = np.flatnonzero(owner == x.owner)
            suspect[own] |= np.unpackbits(np.frombuffer(x.bitmap, np.uint8))[: len(own)].astype(bool)
        return pd.DataFrame({"doc_id": rows["doc_id"], "digest": rows["digest"], "suspect": suspect[index]})

    return mark


def mark_suspects(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, suspect) for each row of docs."""
    rows = docs.count()
    bits = max(12, min(52, math.ceil(math.log2(rows + 2)) + SPARE_BITS))
    owners = spread(docs.sparkSession, rows, OWNER_ROWS)
    norm = normalised(text_of())
    hashed = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.xxhash64(norm).alias("hash"))
    sent = staged(hashed.mapInArrow(_sender(bits, owners), KINDS), ("kind",))
    bitmaps = sent.filter("kind = 'list'").select("block", "owner", "n", "k", "unary", "rest").groupBy("owner").applyInPandas(_answer, "block int, owner int, bitmap binary")
    values = sent.filter("kind = 'row'").select("doc_id", "digest", "block", "value")
    return values.groupBy("block").cogroup(bitmaps.groupBy("block")).applyInPandas(_marker(bits, owners), "doc_id long, digest binary, suspect boolean")


def _suspects(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """All rows marked, the rows whose id is suspect, and how many ids that are."""
    marked = staged(mark_suspects(docs))
    ids = marked.filter("suspect").select("doc_id").distinct()
    return marked, ids, ids.count()


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs (doc_id, text)."""
    marked, ids, n = _suspects(docs)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    best = F.struct(-F.length(text_of()), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"))
    groups = (
        keep_ids(own, ids, "doc_id", n)
        .groupBy(normalised(text_of()).alias("norm"))
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.col("best.doc_id").alias("keep_id"), "group_size")
    )
    single = marked.filter("not suspect").select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    grouped = join_often(marked.filter("suspect").select("digest", "doc_id"), staged(groups), "digest", "group_size")
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """docs with one whole row of each group of equal texts, by the same rule."""
    _, ids, n = _suspects(docs)
    clean = keep_ids(docs, ids, "doc_id", n, "left_anti")
    best = F.struct(-F.length(text_of()), F.col("doc_id").isNull(), F.col("doc_id"), row_order(docs))
    kept = (
        keep_ids(docs, ids, "doc_id", n)
        .groupBy(normalised(text_of()).alias("__norm"))
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), best).alias("__row"))
        .select("__row.*")
    )
    return clean.unionByName(kept)
