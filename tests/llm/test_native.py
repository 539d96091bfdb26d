import hashlib
import itertools

import pytest

from lodeweave.llm import chat, sharding, warc

PAGES = "page_id long, url string, html string"
BIG = "<html>" + "é" * 100 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "'y' as payload")


def test_archive_keeps_every_record(spark, tmp_path):
    rows = [(5, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (9, None, BIG), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "z" * 200_000), (2, "http://b2/", BIG)]
    got = sorted(warc.archived_pages(pages(spark, rows), f"file://{tmp_path}/a").collect())
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        first[raw] = min(first.get(raw, page), page)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first[raw] != page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    assert [tuple(r) for r in got] == sorted(want)
    kept = spark.read.parquet(f"file://{tmp_path}/a/payloads")
    assert kept.count() == len({(h or "").encode() for _, _, h in rows})
    records = warc.original_records(warc.read_archive(spark, f"file://{tmp_path}/a")).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        assert rest[size:] == b"\r\n\r\n"
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(rest[:size]).hexdigest() == fields["WARC-Payload-Digest"]


def test_tampered_payload_is_found(spark, tmp_path):
    warc.write_archive(pages(spark, [(1, "u", BIG)]), f"file://{tmp_path}/a")
    spark.sql(f"select '{hashlib.sha256(BIG.encode()).hexdigest()}' as digest, binary('wrong') as payload").write.mode("overwrite").parquet(f"file://{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="doesn't have digest"):
        warc.read_archive(spark, f"file://{tmp_path}/a").collect()


def test_pages_without_an_id_revisit_the_smallest_one(spark, tmp_path):
    rows = [(None, "http://a/", BIG), (5, "http://b/", BIG), (2, "http://c/", BIG), (None, "u", "y" * 150), (None, "v", "y" * 150), (None, "w", None)]
    got = ((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages(spark, rows), f"file://{tmp_path}/a").collect())
    size = len(BIG.encode())
    want = [("None", size, "revisit", 2), ("5", size, "revisit", 2), ("2", size, "response", None), *[("None", 150, "response", None)] * 2, ("None", 0, "response", None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_archive(spark, tmp_path):
    assert warc.archived_pages(pages(spark, []), f"file://{tmp_path}/a").count() == 0


DOCS = "doc_id long, text string"


def test_shards_fit_and_only_oversized_buckets_split(spark):
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(10_000, "y" * 5000), (10_001, None), (None, "q")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as hash", "2 as bytes", "3 as shard_bytes")
    got = sharding.assign_shards(df, limit=2000).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(d), len(t or "")) for d, t in rows)
    sizes, counts = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        counts[r.shard] = counts.get(r.shard, 0) + 1
        assert r.depth == len(r.shard.split("#")[0])
    assert all(r.shard_bytes == sizes[r.shard] for r in got)
    for s, b in sizes.items():
        assert b <= 2000 or (b == 5000 and s.count("#") == 1), (s, b)
        parent = s.split("#")[0][:-1]
        if s and "#" not in s:  # the parent was over the limit
            assert sum(v for k, v in sizes.items() if k.startswith(parent)) > 2000
        assert not any(k != s and k.split("#")[0] != s.split("#")[0] and k.startswith(s.split("#")[0]) for k in sizes)


def test_one_shard_if_all_fits_and_none_if_empty(spark):
    assert {r.shard for r in sharding.assign_shards(spark.createDataFrame([(1, "a"), (2, "b")], DOCS)).collect()} == {""}
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_of_one_key_are_cut(spark):
    got = sharding.assign_shards(spark.createDataFrame([(7, "z" * 30)] * 500 + [(8, "a")], DOCS), limit=1000).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    assert len(got) == 501 and max(sizes.values()) <= 1000 and sum(sizes.values()) == 15_001


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(200)], DOCS)
    sharding.write_shards(df, f"{tmp_path}/s", limit=1000)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 200


TURNS = "conv_id long, turn long, role string, text string"
ODD = ["", None, "\\", "###", "####", "#####", "\\### Assistant: </turn> ok", "</turn>", "</part>", "<", "\\b\\h\\l", "</turn</turn>>", "x\n### user: y</turn>\n", "é😀", "#" * 7 + "\\" * 3, "</part></turn>\n### a: b"]


def brute(turns):
    own = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
    loss = "".join(t or "" for _, r, t in own if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(own), sha(whole), len(loss), sha(loss)


def test_formatting_is_reversible(spark):
    convs = {}
    roles = ["user", "assistant", "assistant", "system", None, "a: b", "x\ny", "\\c"]
    for k, (a, b) in enumerate(itertools.product(ODD, ODD)):
        convs[k] = [(0, roles[k % 8], a), (1, roles[(k // 3) % 8], b), (2, "assistant", a)]
    convs[None] = [(None, "user", "x"), (3, "assistant", "y"), (3, "assistant", "y")]
    convs[-1] = [(i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]
    rows = [(c, *t) for c, ts in convs.items() for t in ts]
    df = spark.createDataFrame(rows, TURNS).repartition(4).selectExpr("*", "1 as run", "2 as turns")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert got.keys() == convs.keys()
    for c, ts in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(ts), (c, ts)
    for r in made.filter("conv_id = 0").collect():
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.endswith(chat.TURN_END)


def test_adjacent_turns_of_a_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], TURNS)
    assert chat.format_conversations(df).first().formatted == "### user: a</part>b</turn>\n### assistant: c</turn>\n"
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
