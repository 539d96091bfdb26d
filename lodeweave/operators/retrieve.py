"""Task analysis, structural and semantic scores, merge, rerank and overrides, for any number of tasks at once.

A term consists of letters and digits, so a text holds it exactly if one of the text's tokens does. Which
tokens of paths and names hold which terms is found over the distinct tokens, by postings of their trigrams. Chunks
are searched by the block index of `topk`: no pair of a task and a chunk becomes a row but the first few
of each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators.graph import by_path, expand_seeds
from lodeweave.operators.dense import nearest
from lodeweave.operators.topk import best_chunks, block_index
from lodeweave.sources.shared import staged

#: Cuts of the ranking.
SEEDS, CHUNK_HITS, CHUNKS_A_FILE, SEMANTIC_FILES, RANKED = 5, 16, 3, 8, 12
LEAST_SCORE = 0.18
#: Weights of the rerank.
WEIGHTS = {"structural": 1.4, "semantic": 1.1, "distance": -1.1, "recency": 0.4, "importance": 0.5, "token_cost": -0.08, "markdown": -1.0}
PINNED_SCORE = 1000.0
TRUNCATED = f"Ranked candidate set truncated to the top {RANKED} files."


def analyzed(tasks: DataFrame) -> DataFrame:
    """task_id, repo_id, text, normalized, intent, terms."""
    return tasks.select("task_id", "repo_id", "text", F.lower(T.trimmed(F.col("text"))).alias("normalized"), T.intent(F.col("text")).alias("intent"), T.query_terms(F.col("text")).alias("terms"))


def file_facts(files: DataFrame) -> DataFrame:
    """What ranking needs of files: recency, importance, token cost and names, without their contents."""
    latest = files.groupBy("repo_id").agg(F.max("modified_at_ms").alias("latest"))
    names = F.transform("symbols", lambda s: F.lower(s["name"]))
    return files.join(latest, "repo_id").select(
        "repo_id", "path", "language", "is_test", names.alias("names"), T.recency(F.col("modified_at_ms"), F.col("latest")).alias("recency_score"),
        T.file_importance(F.col("path"), F.size("symbols"), F.col("is_test")).cast("double").alias("file_importance_score"), T.file_token_cost(F.col("size")).alias("token_cost"),
    )


def _trigrams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: word.substr(i, F.lit(3))))


def holders(words: DataFrame, terms: DataFrame) -> DataFrame:
    """repo_id, token, term for tokens of words(repo_id, token), each once, that hold a term of terms(repo_id, term).

    Tokens are posted under their trigrams. A term (three characters at least) is looked up by the one of its trigrams that
    fewest tokens have, and what is found there is verified; a term with a trigram that no token has is in none.
    """
    posted = staged(words.filter("length(token) >= 3").select("repo_id", "token", F.explode(_trigrams(F.col("token"))).alias("gram")))
    sizes = posted.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = terms.select("repo_id", "term").distinct().withColumn("gram", F.explode(_trigrams(F.col("term"))))
    found = asked.join(sizes, ["repo_id", "gram"], "left").groupBy("repo_id", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = found.filter("least.n > 0").select("repo_id", "term", F.col("least.gram").alias("gram"))
    return posted.join(rarest, ["repo_id", "gram"]).filter(F.col("token").contains(F.col("term"))).select("repo_id", "token", "term")


def structural_scores(analysis: DataFrame, facts: DataFrame) -> DataFrame:
    """task_id, repo_id, path, score, reason, role for files that score for a task.

    Files meet tasks by the terms that their paths' and names' tokens hold, never pair by pair. Of
    the files that score by the intent "docs" alone, only the first SEEDS in path order are listed
    (tests and others apart), as no later one can be a seed.
    """
    split = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    slots = F.concat(F.array(split(F.col("path"))), F.transform("names", split))
    spots = facts.select("repo_id", "path", F.posexplode(slots).alias("slot", "tokens")).select("repo_id", "path", "slot", F.explode("tokens").alias("token")).filter("token <> ''")
    terms = analysis.select("task_id", "repo_id", F.posexplode("terms").alias("ord", "term"))
    spots = staged(spots)
    held = spots.join(holders(spots.select("repo_id", "token").distinct(), terms), ["repo_id", "token"]).select("repo_id", "path", "slot", "term").distinct()
    counted = held.groupBy("repo_id", "path", "term").agg(F.bool_or(F.col("slot") == 0).alias("in_path"), F.count_if(F.col("slot") > 0).alias("named"))
    hit = F.struct("ord", "term", "in_path", "named")
    found = counted.join(terms, ["repo_id", "term"]).select("task_id", "repo_id", "path", hit.alias("hit"))
    first = top(facts.filter("language = 'markdown'").select("repo_id", "path", "is_test"), SEEDS, by_path(), by=("repo_id", "is_test")).select("repo_id", "path")
    asked = analysis.filter("intent = 'docs'").join(first, "repo_id").select("task_id", "repo_id", "path", F.lit(None).cast("struct<ord:int,term:string,in_path:boolean,named:bigint>").alias("hit"))
    hits = found.unionByName(asked).groupBy("task_id", "repo_id", "path").agg(F.sort_array(F.collect_list("hit")).alias("hits"))  # as many as a task has terms
    both = hits.join(analysis.select("task_id", "repo_id", "intent"), ["task_id", "repo_id"]).join(facts.select("repo_id", "path", "language", "is_test"), ["repo_id", "path"])
    docs = (F.col("intent") == "docs") & (F.col("language") == "markdown")
    score = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + F.when(h["in_path"], 6).otherwise(0) + h["named"] * 5) + F.when(docs, 4).otherwise(0) - F.col("is_test").cast("int")
    quoted = lambda kind, h: F.concat(F.lit(f'{kind} matches "'), h["term"], F.lit('"'))
    texts = F.flatten(F.transform("hits", lambda h: F.array(F.when(h["in_path"], quoted("Path", h)), F.when(h["named"] > 0, quoted("Symbol", h)))))
    reasons = F.array_distinct(F.array_compact(F.concat(texts, F.array(F.when(docs, "Documentation matches task intent")))))
    scored = both.withColumn("score", score.cast("double")).filter("score > 0")
    reason = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("Graph fallback matched file metadata")
    return scored.select("task_id", "repo_id", "path", "score", reason.alias("reason"), F.when(F.col("is_test"), "test").otherwise("primary").alias("role"))


def top(df: DataFrame, limit: int, *order: Column, by: tuple[str, ...] = ("task_id",), rank: str = "rank") -> DataFrame:
    """The first rows of each group in an order that leaves no ties."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= limit)


def structural_seeds(analysis: DataFrame, facts: DataFrame) -> DataFrame:
    return top(structural_scores(analysis, facts), SEEDS, F.desc("score"), by_path(), rank="seed_rank")


def structural_candidates(analysis: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    seeds = staged(structural_seeds(analysis, facts))  # five rows a task, read in three places
    return expand_seeds(seeds, edges, facts.select("repo_id", "path", "is_test"))


def semantic_chunks(analysis: DataFrame, chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The first 16 chunks of each task over the least score: cosine of token counts plus 0.1 for each term the text or path holds.

    index is block_index(chunks), if it is kept.
    """
    found = best_chunks(analysis, block_index(chunks) if index is None else index, CHUNK_HITS, LEAST_SCORE)
    return top(found, CHUNK_HITS, F.desc("score"), F.col("place")).drop("place")


def semantic_candidates(hits: DataFrame) -> DataFrame:
    """The first 8 files of each task by their best chunk, with up to three of their chunks."""
    chunk = F.struct("rank", "id", "kind", "start_line", "end_line", "token_estimate", "score")
    files = hits.groupBy("task_id", "repo_id", "file_path").agg(F.slice(F.sort_array(F.collect_list(chunk)), 1, CHUNKS_A_FILE).alias("c"))
    kind = F.col("c")[0]["kind"]
    spans = F.transform("c", lambda x: F.concat(x["start_line"], F.lit("-"), x["end_line"]))
    score = F.col("c")[0]["score"] * F.when(kind == "doc", 0.92).otherwise(1.0)
    found = files.select(
        "task_id", "repo_id", F.col("file_path").alias("path"), score.alias("semantic_score"), F.concat(F.lit("Semantic vector match from chunks "), F.array_join(spans, ", ")).alias("reason"),
        F.when(kind == "test", "test").when(kind == "doc", "semantic-support").otherwise("primary").alias("role"), F.when(kind == "doc", 2).otherwise(1).alias("dependency_distance"),
        F.array_min(F.transform("c", lambda x: x["token_estimate"])).alias("token_cost"), F.transform("c", lambda x: x["id"]).alias("chunk_ids"),
    )
    return top(found, SEMANTIC_FILES, F.desc("semantic_score"), by_path())


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """repo_id, path, all_chunks: ids of each file's chunks in order."""
    listed = chunks.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "id"))).alias("x"))
    return listed.select("repo_id", F.col("file_path").alias("path"), F.transform("x", lambda c: c["id"]).alias("all_chunks"))


def merged(structural: DataFrame, semantic: DataFrame, facts: DataFrame, lists: DataFrame) -> DataFrame:
    """Both kinds of candidates of a task and path as one, field by field."""
    s = structural.select("task_id", "repo_id", "path", *[F.col(c).alias(f"s_{c}") for c in ("reason", "structural_score", "role", "stage", "dependency_distance", "expansion_path")])
    m = semantic.select("task_id", "repo_id", "path", *[F.col(c).alias(f"m_{c}") for c in ("reason", "semantic_score", "role", "dependency_distance", "token_cost", "chunk_ids")])
    facts = facts.select("repo_id", "path", "language", "is_test", "recency_score", "file_importance_score", "token_cost")
    both = s.join(m, ["task_id", "repo_id", "path"], "full").join(facts, ["repo_id", "path"]).join(lists, ["repo_id", "path"], "left")
    here, there = F.col("s_reason").isNotNull(), F.col("m_reason").isNotNull()
    none = F.array().cast("array<string>")
    mine = F.when(here, F.coalesce("all_chunks", none)).otherwise(none)
    return both.select(
        "task_id", "repo_id", "path", "language", "is_test",
        F.when(here & there, T.append_reason(F.col("s_reason"), F.col("m_reason"))).otherwise(F.coalesce("s_reason", "m_reason")).alias("reason"),
        F.when(~here, "semantic").when(there & (F.col("s_structural_score") <= 0), "semantic").otherwise("structural").alias("source"),
        F.when(~here, F.col("m_role")).when(there & (F.col("s_role") == "semantic-support"), F.col("m_role")).otherwise(F.col("s_role")).alias("role"),
        F.coalesce("s_stage", F.lit("semantic")).alias("stage"),
        F.least("s_dependency_distance", "m_dependency_distance").alias("dependency_distance"),
        F.coalesce("s_structural_score", F.lit(0.0)).alias("structural_score"), F.coalesce("m_semantic_score", F.lit(0.0)).alias("semantic_score"),
        "recency_score", "file_importance_score", F.when(here, F.least("token_cost", "m_token_cost")).otherwise(F.col("m_token_cost")).alias("token_cost"),
        F.array_distinct(F.concat(mine, F.coalesce("m_chunk_ids", none))).alias("chunk_ids"),
        F.when(here & there & (F.size("s_expansion_path") > 1), F.array("path")).otherwise(F.coalesce("s_expansion_path", F.array("path"))).alias("expansion_path"),
    )


def rerank_score() -> Column:
    c, w = F.col, WEIGHTS
    floor = F.when(c("structural_score") > 0, c("structural_score") + F.greatest(F.lit(0), 3 - c("dependency_distance"))).otherwise(0.0)
    return (
        floor + c("structural_score") * w["structural"] + c("semantic_score") * w["semantic"] + c("dependency_distance") * w["distance"] + c("recency_score") * w["recency"]
        + c("file_importance_score") * w["importance"] + c("token_cost") * w["token_cost"] + F.when(c("language") == "markdown", w["markdown"]).otherwise(0.0)
    )


def reranked(candidates: DataFrame) -> DataFrame:
    """The first 12 candidates of each task."""
    return top(candidates.withColumn("score", rerank_score()), RANKED, F.desc("score"), by_path())


def truncation_reasons(ranked: DataFrame) -> DataFrame:
    """task_id and why candidates may be missing: told if the list is full, whether or not more were cut."""
    counted = ranked.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("task_id", F.when(F.col("n") >= RANKED, F.array(F.lit(TRUNCATED))).otherwise(F.array().cast("array<string>")).alias("truncation_reasons"))


def apply_overrides(ranked: DataFrame, overrides: DataFrame, facts: DataFrame, lists: DataFrame) -> DataFrame:
    """Drop excluded paths, raise or insert pinned ones (a pin that is excluded is no pin), and rank anew without a cut.

    overrides: task_id, repo_id, pinned, excluded.
    """
    out = overrides.select("task_id", F.explode("excluded").alias("path")).distinct()
    pins = overrides.select("task_id", "repo_id", F.explode(F.array_except("pinned", "excluded")).alias("path")).distinct()
    left = ranked.drop("rank").join(out, ["task_id", "path"], "left_anti").join(pins.select("task_id", "path", F.lit(True).alias("pin")), ["task_id", "path"], "left")
    pinned = F.col("pin").isNotNull()
    raised = left.withColumns({
        "reason": F.when(pinned, T.append_reason(F.col("reason"), F.lit("Pinned by user"))).otherwise(F.col("reason")),
        "score": F.when(pinned, F.greatest("score", F.lit(PINNED_SCORE))).otherwise(F.col("score")),
        "source": F.when(pinned, "manual").otherwise(F.col("source")), "role": F.when(pinned, "manual").otherwise(F.col("role")), "stage": F.when(pinned, "override").otherwise(F.col("stage")),
    }).drop("pin")
    new = pins.join(ranked.select("task_id", "path"), ["task_id", "path"], "left_anti").join(facts, ["repo_id", "path"]).join(lists, ["repo_id", "path"], "left")
    manual = new.select(
        "task_id", "repo_id", "path", "language", "is_test", F.lit("Pinned by user").alias("reason"), F.lit("manual").alias("source"), F.lit("manual").alias("role"), F.lit("override").alias("stage"),
        F.lit(0).alias("dependency_distance"), F.lit(PINNED_SCORE).alias("structural_score"), F.lit(0.0).alias("semantic_score"), "recency_score", "file_importance_score", "token_cost",
        F.coalesce("all_chunks", F.array().cast("array<string>")).alias("chunk_ids"), F.array("path").alias("expansion_path"), F.lit(PINNED_SCORE).alias("score"),
    )
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), by_path())
    return raised.unionByName(manual).withColumn("rank", F.row_number().over(w))


def related_tests(ranked: DataFrame) -> DataFrame:
    listed = ranked.filter("role = 'test'").groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("x"))
    return listed.select("task_id", F.transform("x", lambda c: c["path"]).alias("related_tests"))


def retrieve(tasks: DataFrame, files: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked candidates of every task, before overrides."""
    analysis, facts = analyzed(tasks), file_facts(files)
    structural = structural_candidates(analysis, facts, edges)
    semantic = semantic_candidates(staged(semantic_chunks(analysis, chunks)))  # 16 rows a task
    return reranked(merged(structural, semantic, facts, chunk_lists(chunks)))


def dense_matches(queries: DataFrame, vectors: DataFrame, limit: int = SEMANTIC_FILES) -> DataFrame:
    """query_id, vec_id, score, rank: the nearest vectors of each query by cosine, as dense.nearest finds them."""
    return nearest(queries, vectors, limit)
