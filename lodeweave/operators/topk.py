"""The best chunks of each task from an index in blocks: posting lists, upper bounds, and few rows between tasks.

Index: chunks in their order (path, line), in blocks of up to BLOCK chunks of one collection. A block's row
has its distinct tokens, and for each the chunks that hold it and how often (a posting list), the chunks' norms
and what a hit reports of a chunk. It is made once and can be kept.

Search: the tasks are a stated set and meet the index in blocks of TASKS, one pass each. For a block of chunks,
the largest count of each token and the smallest norm bound every score of a task there; tasks whose bound
can't reach their 16th best so far in this partition (or the least score) leave the block out. No score is
rounded differently by that, as the bound is made of the same operations on larger numbers. A Spark task passes
on 16 rows of each task at most, so what is shuffled grows with tasks times partitions, whatever words are common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators.graph import by_path
from lodeweave.sources.shared import batch_rows, staged

#: Chunks of a block, and tasks of a pass.
BLOCK, TASKS = 256, 2048
#: Blocks that Spark reads and hands to Python at once, blocks made at once, tasks scored at once, and tokens whose terms a search remembers.
BLOCKS_AT_ONCE, BLOCKS_MADE, TASKS_AT_ONCE, SEEN = 16, 4, 256, 1 << 16
_META = ("id", "file_path", "kind", "start_line", "end_line", "token_estimate")
_TYPES = ("string", "string", "string", "int", "int", "bigint")
_INDEX = "repo_id string, place bigint, " + ", ".join(f"{n} array<{t}>" for n, t in zip(_META, _TYPES)) + ", norms array<bigint>, tokens array<string>, ends array<int>, holders array<int>, counts array<bigint>"


def _block(rows: pa.RecordBatch) -> list:
    """The index row of some chunks of one collection."""
    n = rows.num_rows
    values, chunk, one = [], [], []
    for name, weight in (("words", 1), ("names", 0)):
        lists = rows.column(name)
        values.append(lists.flatten())
        chunk.append(np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False)))
        one.append(np.full(len(chunk[-1]), weight))
    coded = pa.concat_arrays(values).dictionary_encode()
    pairs, inverse = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.concatenate(chunk), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate(one), minlength=len(pairs)).astype(np.int64)
    holders = pairs % n
    norms = np.bincount(holders, weights=counts * counts, minlength=n).astype(np.int64)
    ends = np.searchsorted(pairs // n, np.arange(len(coded.dictionary)), side="right")
    listed = lambda x: pa.array([x])
    meta = [listed(rows.column(c).to_pylist()) for c in _META]
    return [listed(rows.column("repo_id")[0].as_py()), listed(rows.column("place")[0].as_py()), *meta, listed(norms), listed(coded.dictionary.to_pylist()), listed(ends), listed(holders), listed(counts)]


def _blocks(schema: pa.Schema):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repos = np.array(batch.column("repo_id").to_pylist(), object)
            begins = np.flatnonzero(np.concatenate([[True], repos[1:] != repos[:-1]])) if len(repos) else []
            for begin, end in zip(begins, [*begins[1:], len(repos)]):
                for k in range(begin, end, BLOCK):
                    made = _block(batch.slice(k, min(BLOCK, end - k)))
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema)], schema=schema)

    return blocks


def block_index(chunks: DataFrame) -> DataFrame:
    """The index of chunks(repo_id, id, file_path, kind, start_line, end_line, token_estimate, text), in the order of paths and lines."""
    names = F.filter(F.split(F.lower("file_path"), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    order = ("repo_id", by_path("file_path"), "start_line", "id")
    placed = chunks.select("repo_id", *_META, "text").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    own = placed.select("repo_id", "place", *_META, T.embedding_tokens(F.col("text")).alias("words"), names.alias("names"))  # after the sort: words take several times the memory of their text
    list_of = lambda t: pa.list_(t)
    of = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([("repo_id", pa.string()), ("place", pa.int64()), *[(n, list_of(of[t])) for n, t in zip(_META, _TYPES)], ("norms", list_of(pa.int64())), ("tokens", list_of(pa.string())), ("ends", list_of(pa.int32())), ("holders", list_of(pa.int32())), ("counts", list_of(pa.int64()))])
    with batch_rows(chunks.sparkSession, BLOCK * BLOCKS_MADE):
        return staged(own.mapInArrow(_blocks(schema), _INDEX))


class _Words:
    """Numbers of the words that tasks ask for, and which task asks for which, with a weight."""

    def __init__(self, words: list[dict]):
        self.number: dict[str, int] = {}
        self.begins = np.concatenate([[0], np.cumsum([len(own) for own in words])]).astype(int)
        self.asked = np.array([self.number.setdefault(w, len(self.number)) for own in words for w in own], int)
        self.weight = np.array([m for own in words for m in own.values()], float)

    def matrix(self, begin: int, end: int, numbers: list[int]) -> np.ndarray:
        """Tasks begin to end x numbers: the weights of some of the words."""
        column = np.full(len(self.number), -1)
        column[numbers] = np.arange(len(numbers))
        own = slice(self.begins[begin], self.begins[end])
        at = column[self.asked[own]]
        task = np.repeat(np.arange(end - begin), np.diff(self.begins[begin : end + 1]))
        out = np.zeros((end - begin, len(numbers)))
        out[task[at >= 0], at[at >= 0]] = self.weight[own][at >= 0]
        return out


class _Asked:
    """The tasks of one collection: which terms and trigrams they ask for, and what of a score is theirs alone."""

    def __init__(self, rows: list):
        self.ids = [r[0] for r in rows]
        grams = [Counter(r[3]) for r in rows]
        self.root = np.sqrt(np.array([len(r[2]) for r in rows], float))
        self.gram_norm = np.array([sum(m * m for m in g.values()) for g in grams], float)
        self.dot_grams = np.array([sum(g[w] for w in r[2]) for r, g in zip(rows, grams)], float)
        self.terms, self.grams = _Words([dict.fromkeys(r[2], 1) for r in rows]), _Words(grams)
        self.within = ahocorasick.Automaton()
        for word, k in self.terms.number.items():
            self.within.add_word(word, k)
        self.within.make_automaton()
        self.seen: dict[str, tuple[int, ...]] = {}
        self.boost = np.cumsum(np.concatenate([[0.0], np.full(max(len(r[2]) for r in rows), 0.1)]))

    def terms_in(self, token: str) -> tuple[int, ...]:
        """Numbers of the terms that a token holds; of SEEN tokens it is remembered."""
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            found = self.seen[token] = tuple({k for _, k in self.within.iter(token)})
        return found


class _Best:
    """The first `limit` chunks of each task so far: larger scores first, of equal ones the earlier place."""

    def __init__(self, tasks: int, limit: int, least: float):
        self.score = np.full((tasks, limit), -np.inf)
        self.place = np.full((tasks, limit), np.iinfo(np.int64).max)
        self.limit, self.least = limit, least

    def possible(self, tasks: np.ndarray | slice, score: np.ndarray) -> np.ndarray:
        """Whether scores (a row for each task) can be among the first; equal ones may be by their place."""
        return (score > self.least) & (score >= self.score[tasks, -1:])

    def add(self, tasks: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        ok = self.possible(tasks, score)
        some = np.flatnonzero(ok.any(axis=1))
        tasks = tasks[some]
        joined = np.concatenate([self.score[tasks], np.where(ok, score, -np.inf)[some]], axis=1)
        places = np.concatenate([self.place[tasks], np.broadcast_to(place, (len(tasks), len(place)))], axis=1)
        order = np.lexsort((places, -joined), axis=-1)[:, : self.limit]
        self.score[tasks], self.place[tasks] = np.take_along_axis(joined, order, axis=1), np.take_along_axis(places, order, axis=1)


def _score(asked: _Asked, best: _Best, row: dict) -> None:
    tokens, ends, holders, counts, norms = (row[c] for c in ("tokens", "ends", "holders", "counts", "norms"))
    n = len(norms)
    begins = np.concatenate([[0], ends[:-1]])
    places: dict[int, int] = {}
    held, dot = [], []
    grams, cross = [], []
    for t, token in enumerate(tokens):
        at = slice(begins[t], ends[t])
        for k in asked.terms_in(token):
            p = places.setdefault(k, len(places))
            if p == len(held):
                held.append(np.zeros(n))
                dot.append(np.zeros(n))
            held[p][holders[at]] = 1
        if token in asked.terms.number:
            dot[places[asked.terms.number[token]]][holders[at]] = counts[at]
        if token in asked.grams.number:
            grams.append(asked.grams.number[token])
            cross.append(np.zeros(n))
            cross[-1][holders[at]] = counts[at]
    held, dot, cross = (np.array(x).reshape(-1, n) for x in (held, dot, cross))
    most_held, most_dot, least_norm = held.max(axis=1, initial=0), dot.max(axis=1, initial=0), norms.min()
    for begin in range(0, len(asked.ids), TASKS_AT_ONCE):
        end = min(begin + TASKS_AT_ONCE, len(asked.ids))
        root, gram_norm, dot_grams = (x[begin:end] for x in (asked.root, asked.gram_norm, asked.dot_grams))
        terms = asked.terms.matrix(begin, end, list(places))
        most = (terms @ most_dot + dot_grams) / (root * np.sqrt(least_norm + gram_norm)) + asked.boost[(terms @ most_held).astype(int)]
        some = np.flatnonzero(best.possible(slice(begin, end), most[:, None]))
        if len(some):
            own = terms[some]
            norm = norms[None, :] + gram_norm[some, None] + 2 * (asked.grams.matrix(begin, end, grams)[some] @ cross)
            cosine = (own @ dot + dot_grams[some, None]) / (root[some, None] * np.sqrt(norm))
            best.add(begin + some, cosine + asked.boost[(own @ held).astype(int)], row["place"] + np.arange(n))


def _row(batch: pa.RecordBatch, at: int) -> dict:
    """One block of a batch; its numbers stay arrays, as lists of Python's numbers would take many times the memory."""
    listed = {c: batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("ends", "holders", "counts", "norms")}
    return {"at": at, **{c: batch.column(c)[at].as_py() for c in ("repo_id", "place", "tokens")}, **listed}


def _searcher(sent, limit: int, least: float, schema: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[_Asked, _Best, dict]] = {}
        for batch in batches:
            for row in map(partial(_row, batch), range(batch.num_rows)):
                if row["repo_id"] not in sent.value:
                    continue
                if row["repo_id"] not in state:
                    own = _Asked(sent.value[row["repo_id"]])
                    state[row["repo_id"]] = (own, _Best(len(own.ids), limit, least), {})
                asked, best, kept = state[row["repo_id"]]
                _score(asked, best, row)
                kept[row["place"]] = [values.take(pa.array(range(len(values)))) for values in (batch.column(c)[row["at"]].values for c in _META)]  # copies: the batch goes
                if len(kept) % 64 == 0:  # keep what hits report of the blocks that still have one
                    live = np.unique(best.place[best.score > -np.inf])
                    begins = np.array(sorted(kept))
                    live = set(begins[np.searchsorted(begins, live, side="right") - 1].tolist())
                    for place in kept.keys() - live:
                        del kept[place]
        for repo, (asked, best, kept) in state.items():
            begins, found = np.array(sorted(kept)), []
            for t, k in zip(*np.nonzero(best.score > -np.inf)):
                place = int(best.place[t, k])
                begin = int(begins[np.searchsorted(begins, place, side="right") - 1])
                found.append((asked.ids[t], repo, float(best.score[t, k]), place, *[m[place - begin].as_py() for m in kept[begin]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return search


def best_chunks(analysis: DataFrame, index: DataFrame, limit: int, least: float) -> DataFrame:
    """task_id, repo_id, score, place and what a hit reports: for each task and partition of the index its first `limit` chunks over the least score.

    Score: cosine of token counts plus 0.1 for each term that the text or path holds; a chunk's vector has the
    trigrams of the task's terms too, the task's own vector has not. Ties go to the earlier place.
    """
    spark = analysis.sparkSession
    asked = staged(analysis.select("task_id", "repo_id", "terms", T.term_trigrams(F.col("terms")).alias("grams")).filter("size(terms) > 0"))
    passes = max(1, -(-asked.count() // TASKS))
    kind = analysis.schema["task_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    of = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([("task_id", arrow), ("repo_id", pa.string()), ("score", pa.float64()), ("place", pa.int64()), *[(n, of[t]) for n, t in zip(_META, _TYPES)]])
    columns = f"task_id {kind}, repo_id string, score double, place bigint, " + ", ".join(f"{n} {t}" for n, t in zip(_META, _TYPES))
    found = []
    for k in range(passes):
        repos: dict[str, list] = {}
        for r in asked.filter(F.pmod(F.xxhash64("task_id"), F.lit(passes)) == k).collect():  # about TASKS rows
            repos.setdefault(r.repo_id, []).append(tuple(r))
        sent = spark.sparkContext.broadcast(repos)
        with batch_rows(spark, BLOCKS_AT_ONCE, BLOCKS_AT_ONCE):
            found.append(staged(index.mapInArrow(_searcher(sent, limit, least, schema), columns)))  # planned here; a few rows for each task and partition
    return reduce(DataFrame.unionByName, found)
