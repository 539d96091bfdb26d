import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lodeweave.llm import decontaminate, language, quality, queries, sentencepiece_bpe, toxicity
from lodeweave.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = ["", None, "  a   b  ", " \n\n x", "héllo\x00x", "▁a▁▁b", "日本語 テスト 𝒳 a", "﻿a ①Å", "a" * 300, "the      cat    ", " " * 50 + "x", "�", "\t\tif (x) {\n}\n", "<s></s><unk><0x0A>", "😀👍🏽", "ab" * 2000, "x"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.Model(sentencepiece_bpe.load(queries.tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_encoding_equals_the_library(model, library):
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("aetnhio rsd▁\n.éß日", k=rng.randint(1, 60))) for _ in range(2000)]
    for t in texts:
        assert model.encode(t) == library.encode(t, add_bos=True, add_eos=True), t


def test_decoding_equals_the_library(model, library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = rng.choices([*range(300), *range(28_000, 32_000)], k=rng.randint(0, 9))
        assert model.decode(ids) == library.decode(ids), ids


def test_encoded_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, "again")]
    got = sentencepiece_bpe.encode_documents(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as ids"), queries.tokenizer_path()).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert sentencepiece_bpe.encode_documents(spark.createDataFrame([], DOCS), queries.tokenizer_path()).count() == 0


def brute_matches(text, items, least=0.8):
    words, out = decontaminate.words_of(text), {}
    for item, other in items:
        own = decontaminate.words_of(other)
        if not own:
            continue
        size = min(5, len(own))
        target = decontaminate.shingles(own, size)
        n = min(len(own), len(words))
        for s in range(len(words) - n + 1):
            if n >= size:
                like = decontaminate.similarity(decontaminate.shingles(words[s : s + n], size), target)
                if like >= least - 1e-12 and like > out.get(item, (0,))[0]:
                    out[item] = (like, s, n)
    return out


def planted():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(20, 60)))) for i in range(30)] + [(30, "one two"), (31, ""), (32, None), (33, "same words here and there"), (34, "same words here and there")]
    docs = []
    for d in range(160):
        body = rng.choices(words, k=rng.randint(0, 300))
        if d % 2:
            own = (items[d % 30][1]).split()
            for _ in range(d % 3):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((d, " ".join(body).upper() if d % 4 == 1 else ", ".join(body)))
    return items, docs + [(500, None), (501, ""), (502, "Same words: here and THERE!"), (503, "one two"), (504, items[0][1]), (504, items[0][1]), (None, items[1][1])]


def test_contamination_matches_brute_force(spark):
    items, docs = planted()
    want = sorted((str(d), i, round(v[0], 9), v[1], v[2]) for d, t in docs for i, v in brute_matches(t, items).items())
    assert len(want) > 40
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    for block in (1 << 20, 500):
        got = decontaminate.contaminated(df, bench, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in got) == want
        assert all(r.differing_bits <= decontaminate.RADIUS for r in got)


def test_clean_rows_are_judged_by_their_own_text(spark):
    items, docs = planted()
    rows = docs + [(105, "another text with the id of a contaminated one"), (None, "a clean text without an id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str(r) for r in rows if not brute_matches(r[1], items))
    for block in (1 << 20, 500):
        assert sorted(str(tuple(r)) for r in decontaminate.clean_rows(spark.createDataFrame(rows, DOCS), bench, block_bytes=block).collect()) == want


def test_nothing_to_match(spark):
    items, docs = planted()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, DOCS)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.clean_rows(df, bench).filter("doc_id in (502, 503, 504)").count() == 0


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.language_model(table(spark, SF, "documents")))


def test_disguised_words_are_restored(restorer):
    for word, disguises in {"idiot": ["1d1ot", "i d i o t", "i.d.i.o.t", "id1ooot", "!diot", "idi0t"], "stupid": ["5tupid", "stuuupid", "$tup1d", "s-t-u-p-i-d"], "moron": ["m0r0n", "m o r o n", "mor0n"], "scum": ["$cum", "s c u m"]}.items():
        for d in disguises:
            assert word in restorer.words(f"The {d} of it."), d
    assert restorer.words("plain words, only 12 of them") == {"plain", "words", "only", "of", "them"}
    assert restorer.restore("an 1d1ot here") == "an idiot here"


def scored(spark, f, labels, column):
    got = f(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    held = got.merge(table(spark, SF, "labels").toPandas(), on="doc_id").query("held_out")
    return (held["predicted"] == held[column]).mean()


def test_toxicity_on_held_out_rows(spark):
    assert scored(spark, toxicity.toxicity_scores, "labels", "toxic") >= 0.93


def test_quality_on_held_out_rows(spark):
    assert scored(spark, quality.quality_scores, "labels", "quality") >= 0.95


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores_of_odd_tables(spark, score):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "a"), (4, "a"), (4, "a"), (5, "  ")], DOCS).selectExpr("*", "1 as toxic", "2 as quality", "3 as score")
    labels = spark.createDataFrame([(1, 1, 1), (4, None, None), (3, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = score(docs, own).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), labels).count() == 0


def test_languages_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = language.predict_languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.query("held_out")["lang_pred"] == got.query("held_out")["lang"]).mean() >= 0.99


def test_mixed_text_has_both_languages(spark):
    docs = table(spark, SF, "documents")
    names, probabilities = language.likelihoods(docs, ~language.held_out())
    long = {r.lang: r.text for r in docs.filter("length(text) > 1500").collect()}
    share = language.proportions(probabilities, np.concatenate([language.trigrams(long["en"][:1500]), language.trigrams(long["fr"][:750])]))
    assert names[int(np.argmax(share))] == "en" and 0.2 < share[names.index("fr")] < 0.5


def test_languages_of_odd_tables(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "hello there", "en"), (5, "guten tag", "de"), (6, "x" * 100_000, None), (4, "hello there", "en"), (None, "hello", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as gram", "2 as n")
    got = {r.doc_id: r for r in language.predict_languages(df).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und"
    assert language.predict_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predict_languages(df.withColumn("lang", df["lang"].substr(9, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    fitted = quality.fit(x, y)
    assert {(i, j) for i, j, *_ in fitted.pairs} >= {(0, 1)}
    assert ((fitted.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_each_model_has_a_restorer_of_its_own():
    class Sent:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(3)
    for _ in range(20):  # tables come and go, and may take each other's place in memory
        table_ = rng.random((toxicity.SYMBOLS**3, toxicity.SYMBOLS))
        first = toxicity._restorer(Sent(table_))
        assert toxicity._restorer(Sent(table_)) is first
        assert np.array_equal(np.asarray(first.model).ravel(), table_.ravel())
        del table_
