import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lodeweave.llm import lines

DOCS = "doc_id long, text string"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    line = line.strip(BLANKS)
    return line.encode().lower() if len(line) >= 20 else None


def by_hand(rows):
    """{row number: (id, lines, dropped, text)} by the rule, over lists."""
    held = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                held.setdefault(key(line), set()).add(d)
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if key(x) not in last or last[key(x)] == d]
        out.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(map(repr, out))


def planted(seed, n=60):
    rng = random.Random(seed)
    common = [f"this line is shared by many documents {k}" for k in range(12)]
    rows = []
    for d in range(n):
        own = [f"line {rng.randrange(10**9)} of a document alone" for _ in range(rng.randrange(4))] + [rng.choice(common) for _ in range(rng.randrange(5))]
        own += rng.choice([[], ["short"], [""], ["  THIS line is SHARED by many documents 3\t"], ["ÄÖÜ die gemeinsame Zeile mit Umlauten"]])
        rng.shuffle(own)
        rows.append((d, "\n".join(own)))
    return rows


def digests(rows):
    return sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in rows.collect())


ODD = [(100, None), (101, ""), (None, "this line is shared by many documents 1\nx"), (None, "this line is shared by many documents 1"), (7, "this line is shared by many documents 1"), (102, "this line is shared by many documents 2\n" * 3000), (103, "ä" * 19), (104, "ä" * 20)]


def test_digests_match_brute_force(spark):
    rows = planted(1) + ODD + [(105, "ä" * 20), (106, "Ä" * 20), (107, "ä" * 20), (108, "x" * 200_000 + "\n" + "ä" * 20)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert digests(lines.line_digests(df)) == by_hand(rows)
    assert lines.line_digests(df.limit(0)).count() == 0


def state(index):
    counts = sorted(map(tuple, index.counts().select("hi", "lo", "n", "last").collect()))
    refs = sorted(map(repr, index.refs().select("hi", "lo", "doc_id").collect()))
    held = {r.shard: lines.Cuckoo.load(r.slots) for r in index.filters().collect()}
    repeated = index.counts().filter("n >= 3").collect()
    assert all(held[r.shard].has(np.array([r.lo], np.int64).view(np.uint64))[0] for r in repeated)
    sizes = {r.shard: r.size for r in index.filters().collect()}
    assert sum(sizes.values()) == len(repeated)
    assert all((own.slots > 0).sum() == sizes[s] for s, own in held.items())
    return counts, refs


def test_inserts_and_deletions_leave_what_one_build_makes(spark, tmp_path):
    rows = planted(2, 90) + ODD
    df = spark.createDataFrame(rows, DOCS)
    whole = lines.LineIndex(spark, f"file://{tmp_path}/whole", shard_keys=16)
    whole.insert(df)
    parts = lines.LineIndex(spark, f"file://{tmp_path}/parts", shard_keys=16)
    parts.insert(df.filter("doc_id % 3 = 0"))
    parts.insert(df.filter("doc_id % 3 = 1 or doc_id is null or doc_id = 6"))  # 6 is there already
    before = state(parts)
    parts.insert(df.filter("doc_id % 3 = 2"))
    assert state(parts) == state(whole)
    assert digests(lines_of(parts, df)) == by_hand(rows)
    parts.delete(df.filter("doc_id % 3 = 2").select("doc_id").unionByName(spark.createDataFrame([(5000,)], "doc_id long")))
    assert state(parts) == before
    parts.delete(df.select("doc_id"))
    assert state(parts) == ([], [])
    assert parts.version()[0] == 5


def lines_of(index, df):
    facts = F.arrow_udf(lines._digest(20), "struct<n_lines:long,n_dropped:long,kept_sha256:string>")
    return index.repeated_lines(df).select("row.doc_id", facts(F.col("row.text"), "drop").alias("x")).select("doc_id", "x.*")


def test_without_filters_in_memory_the_exact_counts_decide(spark, tmp_path, monkeypatch):
    rows = planted(3)
    df = spark.createDataFrame(rows, DOCS)
    index = lines.LineIndex(spark, f"file://{tmp_path}/x")
    index.insert(df)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    assert digests(lines_of(index, df)) == by_hand(rows)


def test_texts_keep_their_columns(spark, tmp_path):
    df = spark.createDataFrame(planted(4) + ODD, DOCS).selectExpr("*", "doc_id as row", "1 as id", "2 as hits", "3 as `drop`", "4 as of", "5 as kept", "6 as `a.b`")
    index = lines.LineIndex(spark, f"file://{tmp_path}/x")
    index.insert(df)
    got = lines.without_repeated_lines(df, index)
    assert got.columns == df.columns and got.count() == df.count()
    assert got.filter("doc_id = 100 and text is null").count() == 1
    again = sorted(repr((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())) for r in got.collect())
    assert again == sorted(repr((r[0], r[3])) for r in map(eval, by_hand(planted(4) + ODD)))


def test_cuckoo_filter_holds_what_was_put_in_and_not_taken_out():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.int64)).view(np.uint64)
    own = lines.Cuckoo.for_keys(len(keys))
    assert own.add(keys[:9000]) and own.add(keys[9000:])
    assert own.has(keys).all()
    own.remove(keys[::2])
    assert own.has(keys[1::2]).all() and (own.slots > 0).sum() == len(keys[1::2])
    assert own.has(rng.integers(0, 1 << 63, 100_000, dtype=np.int64).view(np.uint64)).mean() < 0.001
    tiny = lines.Cuckoo.for_keys(1)
    assert not tiny.add(keys[:100])  # full: to be built anew
