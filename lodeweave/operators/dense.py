"""Nearest vectors by cosine from an index in blocks with centres and radii: all that is left out is proven too far.

Index: a few centres are fitted on a sample of SAMPLE vectors; every vector goes to the nearest one, and each task cuts its
own rows by centre in blocks of up to BLOCK with a mean and a radius of their own (no shuffle, so no centre can be too
popular). With q of length one, q.v is at most q.mean + radius for every v of a block.

Search: the queries are a stated set and meet the index in parts of QUERY_BYTES. A first pass looks at the blocks of
the NEAREST centres of each query; the last of what it finds there bounds what can still matter, and a second
pass looks only at the other blocks whose bound reaches it. A task passes on `limit` rows a query at most.
The sample decides how much is looked at, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators.topk import _Best
from lodeweave.sources.shared import staged

#: Vectors of a query part, of a block, of the sample, and of the rows that a task cuts together.
QUERY_BYTES, BLOCK, SAMPLE, ROWS = 4 << 20, 512, 20_000, 1 << 14
MOST_CENTRES, ROUNDS, NEAREST = 256, 6, 3
#: Scores are rounded to so many decimals; bounds leave room for that.
DECIMALS, SLACK = 10, 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return unit(np.array(vectors.tolist(), float).reshape(-1, width))


def fitted_centres(vectors: DataFrame, width: int) -> np.ndarray:
    """Centres of a bounded sample: those with the smallest hashes of their ids, some rounds of means on the sphere."""
    x = _matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()["embedding"], width)
    centres = x[: max(1, min(MOST_CENTRES, len(x) // 32))].copy() if len(x) else np.zeros((1, width))
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where((total * total).sum(1, keepdims=True) > 0, unit(total), centres)
    return centres


def _blocks(sent, width: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut(rows: pd.DataFrame) -> pd.DataFrame:
            x, ids = _matrix(rows["embedding"], width), rows["id"].to_numpy(np.int64)
            near = (x @ sent.value.T).argmax(1)
            far = ((x - sent.value[near]) ** 2).sum(1)
            order = np.lexsort((far, near))
            out = []
            begins = np.flatnonzero(np.diff(near[order], prepend=-1))
            for begin, end in zip(begins, [*begins[1:], len(order)]):
                for k in range(begin, end, BLOCK):
                    at = order[k : min(k + BLOCK, end)]
                    mean = x[at].mean(0)
                    out.append((int(near[at[0]]), mean.tolist(), float(np.sqrt(((x[at] - mean) ** 2).sum(1).max())), ids[at].tolist(), x[at].tobytes()))
            return pd.DataFrame(out, columns=["centre", "mean", "radius", "ids", "vectors"])

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                yield cut(pd.concat(held))
                held = []
        if held and sum(map(len, held)):
            yield cut(pd.concat(held))

    return blocks


def dense_index(vectors: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """The blocks of vectors(id, embedding), and the centres."""
    centres = fitted_centres(vectors, width)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = vectors.select("id", "embedding").mapInPandas(_blocks(sent, width), "centre int, mean array<double>, radius double, ids array<bigint>, vectors binary")
    return staged(rows), centres


def _search(sent, width: int, limit: int, looked):
    """sent: ids, vectors, the centres of each query's first pass, and what a score has to reach (None: this is the first pass)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, block, near, least = sent.value
        best = _Best(len(ids), limit, -np.inf)
        for batch in batches:
            for row in batch.itertuples():
                here = (near == row.centre).any(1)
                if least is not None:
                    here = ~here & (block @ np.asarray(row.mean) + row.radius + SLACK >= np.maximum(least, best.score[:, -1]))
                tasks = np.flatnonzero(here)
                if len(tasks):
                    own = np.asarray(row.ids)
                    score = np.round(block[tasks] @ np.frombuffer(row.vectors).reshape(-1, width).T, DECIMALS)
                    score[own[None, :] == ids[tasks, None]] = -np.inf
                    looked.add(len(tasks) * len(own))
                    best.add(tasks, score, own)
        query, k = np.nonzero(best.score > -np.inf)
        yield pd.DataFrame({"query_id": ids[query], "vec_id": best.place[query, k], "score": best.score[query, k]})

    return search


def nearest(queries: DataFrame, vectors: DataFrame, limit: int, report: dict | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the nearest vectors by cosine; both tables have (id, embedding), ids are unique.

    Vectors without a direction score 0; a null vector is left out; vectors must have one length. report gets the
    share of all pairs that was looked at (`scanned`, once the result has been computed).
    """
    spark = vectors.sparkSession
    queries, vectors = queries.filter("embedding is not null"), vectors.filter("embedding is not null")
    (n, own), (rows, wide) = (x.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first() for x in (queries, vectors))
    width = max(own, wide)
    index, centres = dense_index(vectors, width)
    parts = max(1, -(-n * width * 8 // QUERY_BYTES))
    looked, all_pairs = spark.sparkContext.accumulator(0), n * rows
    first = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= limit)
    columns, found = "query_id bigint, vec_id bigint, score double", []
    for k in range(parts):
        asked = queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("id", "embedding").toPandas()  # about QUERY_BYTES
        ids, block = asked["id"].to_numpy(np.int64), _matrix(asked["embedding"], width)
        near = np.argsort(-(block @ centres.T), axis=1)[:, :NEAREST]
        begun = staged(first(index.mapInPandas(_search(spark.sparkContext.broadcast((ids, block, near, None)), width, limit, looked), columns)))
        reached = begun.filter(F.col("rank") == limit).select("query_id", "score").toPandas()  # a row for each query of the part
        least = np.full(len(ids), -np.inf)
        at = pd.Series(np.arange(len(ids)), index=ids)
        least[at[reached["query_id"].to_numpy(np.int64)].to_numpy(np.int64)] = reached["score"].to_numpy(float)
        found += [begun.drop("rank"), index.mapInPandas(_search(spark.sparkContext.broadcast((ids, block, near, least)), width, limit, looked), columns)]
    if report is not None:
        report["scanned"] = lambda: looked.value / max(1, all_pairs)
    return first(reduce(DataFrame.unionByName, found))
