import corpus_pipeline
from lodeweave.llm.common import staged, table
from tests.llm.test_dedup import brute_exact
from tests.llm.test_models import brute_matches
from tests.llm.test_near_copies import kept

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, rows, seen = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        seen[name] = sorted(tuple(r) for r in docs.select("doc_id", *(["text"] if "text" in docs.columns else [])).collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    assert len({d for d, _ in seen["toxicity"]} & toxic) <= 0.3 * len(toxic) and len(seen["toxicity"]) >= 0.8 * len(rows)
    keep = {k for k, _ in brute_exact(seen["toxicity"]).values()}
    assert {d for d, _ in seen["exact dedup"]} == keep
    own = seen["exact dedup"]
    kept_ids = set(kept(own))  # all pairs, five-word shingles, similarity 0.8
    assert seen["simhash near-dedup"] == [x for x in own if str(x[0]) in kept_ids]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert seen["benchmark decontamination"] == [x for x in seen["simhash near-dedup"] if not brute_matches(x[1], items)]
    assert [d for d, in seen["sentencepiece"]] == [d for d, _ in seen["benchmark decontamination"]]


def test_pipeline_of_odd_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, None, None), (2, "", "x"), (3, " ", "x"), (4, "a b c", None), (4, "a b c", None), (None, "q", "x")], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, d).collect()) == ["3", "4", "None"]
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{d}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{d}/e/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{d}/e").count() == 0


def test_stages_called_one_by_one_hold_few_texts_at_once(spark):
    """Their results are planned by the caller, so what a stage sets must still hold then; a whole run leaves the session as it was."""
    before = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": "4096"}
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        for name, rows in before.items():
            spark.conf.set(name, rows)
        stage(spark, docs.limit(20), SF)
        assert [int(spark.conf.get(name)) for name in before] == [1000, 512]
    for name, rows in before.items():
        spark.conf.set(name, rows)
    corpus_pipeline.run(spark, SF)
    assert {name: spark.conf.get(name) for name in before} == before
