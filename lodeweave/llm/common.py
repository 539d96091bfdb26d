"""Helpers that the corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodeweave.sources.shared import shared_dir, staged

__all__ = ["crc_bucket", "folder_names", "join_often", "keep_ids", "kept_in_worker", "make_folder", "nothing_kept_in_worker", "row_order", "shared_dir", "small_enough", "spread", "staged", "table", "text_of"]

#: A side is broadcast when rows times bytes a row stay under this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if there is no such folder."""
    system, where = _folder(spark, path)
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _folder(spark, path)
    system.mkdirs(where)


def small_enough(rows: int, bytes_a_row: int) -> bool:
    return rows * bytes_a_row <= BROADCAST_BYTES


def keep_ids(df: DataFrame, ids: DataFrame, column: str, rows: int, how: str = "left_semi") -> DataFrame:
    """Rows of df whose column is (left_semi) or isn't (left_anti) in ids; null equals null.

    ids has `rows` rows, counted by the caller: few enough are broadcast, else both sides shuffle.
    """
    other = ids.select(F.col(column).alias("__id"))
    if small_enough(rows, 24):
        other = F.broadcast(other)
    return df.join(other, df[column].eqNullSafe(other["__id"]), how)


#: Rows of one key that make it a hot one.
OFTEN = 1 << 17


def join_often(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join on a key that keyed has once, with the number of its rows in column n.

    Hot keys, of which there are at most all rows / OFTEN, are broadcast, so their rows aren't shuffled to one task.
    """
    often = F.broadcast(keyed.filter(F.col(n) > OFTEN))
    rest = rows.join(often.select(key), key, "left_anti").join(keyed.filter(F.col(n) <= OFTEN), key)
    return rows.join(often, key).unionByName(rest)


def row_order(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A number that tells rows apart by their plain columns, so that ties have one order."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, AtomicType) and (columns is None or f.name in columns)]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spread(spark: SparkSession, rows: int, rows_a_part: int) -> int:
    """Partitions for `rows` rows: what the session asks for, or more where the data need more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_a_part))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fixed folds of the held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


#: What this worker keeps between tasks, and what it was made of: held, so that nothing else can have its identity.
_KEPT: list = []


def nothing_kept_in_worker() -> None:
    """For what needs the memory and keeps nothing itself."""
    _KEPT.clear()


def kept_in_worker(source, make):
    """make(source), made once for each source. One thing at a time: a later stage's takes the place of an earlier one's."""
    if not _KEPT or _KEPT[0] is not source:
        _KEPT.clear()
        _KEPT.extend((source, make(source)))
    return _KEPT[1]
