"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a 60-bit hash of the row's key. Bytes are summed once
for fine cells of the hash; every depth of the directory is a roll-up of those cells. A bucket is a
shard if its bytes fit and its parent's don't: only oversized buckets split on another bit. Cells
that are oversized themselves are counted again with more bits, from their rows alone.

A shard's id is its bits as text ("" is the whole table). Defined cases: a null text has no bytes; a
null key is a key of its own; rows that share a key share a hash, so no bit of it splits them: where
such rows are over the limit, a directory of their own over a hash of the row splits them in the
same way (named key bits#row bits), whatever share of the table they are; a single row over the
limit is a shard alone; repeated rows are rows like others; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import small_enough, staged

HASH_BITS = 60
SHARD_BYTES = 64 << 20
#: A cell holds about a 1/CELLS of a shard at first; each round that looks closer adds STEP bits.
CELLS = 256
STEP = 10


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(hash, {HASH_BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col("hash"), F.lit(HASH_BITS) - depth)


def _bits_text(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """space, depth, bucket, shard_bytes: buckets of low..high bits that fit, of cells (prefixes of `high` bits), and whose parent doesn't."""
    at = cells.select("space", "cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    bucket = F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth"))
    sums = at.groupBy("space", "depth", bucket.alias("bucket")).agg(F.sum("bytes").alias("shard_bytes"))
    parent = sums.filter(F.col("shard_bytes") > limit).select(F.col("space").alias("in"), (F.col("depth") + 1).alias("under"), F.col("bucket").alias("over"))
    here = sums.filter(F.col("shard_bytes") <= limit)
    inside = (here["space"] == parent["in"]) & (here["depth"] == parent["under"]) & (F.shiftright("bucket", 1) == parent["over"])
    split = here.filter(F.col("depth") > low).join(parent, inside, "left_semi")
    return here.filter(F.col("depth") == low).unionByName(split).select("space", "depth", "bucket", "shard_bytes")


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """space, depth, bucket, shard_bytes: the shards of sizes(space, hash, bytes), each space apart. Depth 60 may hold shards over the limit."""
    most = sizes.groupBy("space").agg(F.sum("bytes").alias("bytes")).agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    low, high = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, most / limit)))) + int(math.log2(CELLS)))
    found, rows = None, sizes
    while True:
        cells = staged(rows.groupBy("space", _prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes")))
        leaves = _leaves(cells, low, high, limit)
        over = cells.filter(F.col("bytes") > limit).select("space", "cell", "bytes")
        more = not over.isEmpty()
        if more and high == HASH_BITS:
            leaves = leaves.unionByName(over.select("space", F.lit(high).alias("depth"), F.col("cell").alias("bucket"), F.col("bytes").alias("shard_bytes")))
            more = False
        found = leaves if found is None else found.unionByName(leaves)
        if not more:
            return staged(found)
        rows = staged(rows.withColumn("cell", _prefix(high)).join(over.select("space", "cell"), ["space", "cell"], "left_semi").drop("cell"))
        low, high = high + 1, min(HASH_BITS, high + STEP)


def _placed(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """sizes with its bits, depth and shard_bytes in the directory: a row's shard is the only one of its hash's prefixes that is there."""
    counts = found.groupBy("depth").count().collect()  # at most 61 rows
    depths = sorted(r.depth for r in counts)
    if small_enough(sum(r["count"] for r in counts), 32):
        found = F.broadcast(found)
    tried = sizes.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths or [0]])))
    return tried.withColumn("bucket", _prefix(F.col("depth"))).join(found, ["space", "depth", "bucket"]).withColumn("bits", _bits_text(F.col("bucket"), F.col("depth")))


def assign_shards(rows: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """key, n_bytes, shard, depth (bits of the key), shard_bytes: the shard of every row."""
    row_hash = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)  # staged, so it stays what it is
    sizes = staged(rows.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.lit(0).cast("long").alias("space"), key_hash(F.col(key)).alias("hash"), row_hash.alias("row_hash")))
    found = directory(sizes, limit)
    own = _placed(sizes, found)
    over = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    out = own.filter(~over).select("key", "bytes", F.col("bits").alias("shard"), "depth", "shard_bytes")
    if not found.filter(over).isEmpty():
        hot = staged(own.filter(over).select("key", "bytes", F.col("hash").alias("space"), F.col("row_hash").alias("hash"), F.col("bits").alias("key_bits")))
        cut = _placed(hot, directory(hot, limit))
        out = out.unionByName(cut.select("key", "bytes", F.concat("key_bits", F.lit("#"), "bits").alias("shard"), F.lit(HASH_BITS).alias("depth"), "shard_bytes"))
    return out.select(F.col("key").alias(key), F.col("bytes").alias("n_bytes"), "shard", "depth", "shard_bytes")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write rows by shard; key must be unique and not null."""
    shards = assign_shards(rows.select(key, text), key, text, limit).select(key, F.concat(F.lit("s"), F.col("shard")).alias("shard"))
    rows.join(shards, key).repartition("shard").write.partitionBy("shard").parquet(path)
