"""From contents to files, symbols and chunks, and what changed since the last index.

Tables carry repo_id, so that any number of collections are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.functions.parse import parsed, script_facts

DOC_LINES, CODE_LINES = 12, 24


def file_records(contents: DataFrame) -> DataFrame:
    """contents(repo_id, path, size, modified_at_ms, content) with language, is_test and what the parsers find."""
    return contents.withColumn("s", script_facts(F.col("path"), F.col("content"))).select(
        "repo_id", "path", T.language(F.col("path")).alias("language"), F.col("size").cast("long"), F.col("modified_at_ms").cast("double"),
        T.is_test(F.col("path")).alias("is_test"), "content", parsed(F.col("path"), F.col("content"), F.col("s")).alias("p"),
    ).select("repo_id", "path", "language", "size", "modified_at_ms", "is_test", "content", "p.*")


def symbols_of(files: DataFrame) -> DataFrame:
    return files.select("repo_id", F.explode("symbols").alias("s")).select("repo_id", "s.*")


def chunk_kind(language: Column, is_test: Column) -> Column:
    return F.when(is_test, "test").when(language == "markdown", "doc").otherwise("code")


def chunk_files(files: DataFrame) -> DataFrame:
    """Windows of lines, 12 for documents and 24 for the rest, trimmed; blank ones are dropped."""
    lines = F.split(F.coalesce("content", F.lit("")), r"\r?\n")
    kind = chunk_kind(F.col("language"), F.col("is_test"))
    own = files.select("repo_id", "path", kind.alias("kind"), lines.alias("lines")).withColumn("n", F.when(F.col("kind") == "doc", DOC_LINES).otherwise(CODE_LINES))
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.col("n"))
    cut = own.select("repo_id", "path", "kind", F.explode(F.transform(starts, lambda i: F.struct((i + 1).alias("start_line"), F.least(i + F.col("n"), F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", i + 1, F.col("n")), "\n").alias("text")))).alias("c"))
    out = cut.select("repo_id", "path", "kind", F.col("c.start_line"), F.col("c.end_line"), T.trimmed(F.col("c.text")).alias("text")).filter("text <> ''")
    return out.select("repo_id", F.concat("path", F.lit("#"), "start_line", F.lit("-"), "end_line").alias("id"), F.col("path").alias("file_path"), "kind", "start_line", "end_line", T.token_estimate(F.col("text")).alias("token_estimate"), "text")


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """repo_id, path, change (added, changed, removed, reused) from two listings (repo_id, path, size, modified_at_ms)."""
    a = before.select("repo_id", "path", F.struct("size", "modified_at_ms").alias("was"))
    b = now.select("repo_id", "path", F.struct("size", "modified_at_ms").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "reused").otherwise("changed")
    return a.join(b, ["repo_id", "path"], "full").select("repo_id", "path", change.alias("change"))


def refreshed(before: DataFrame, before_chunks: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and changes after contents; only added and changed files are parsed and cut again."""
    changes = snapshot_changes(before, contents)
    stay = changes.filter("change = 'reused'").select("repo_id", "path")
    fresh = file_records(contents.join(changes.filter("change in ('added', 'changed')").select("repo_id", "path"), ["repo_id", "path"], "left_semi"))
    files = before.join(stay, ["repo_id", "path"], "left_semi").unionByName(fresh)
    kept = before_chunks.join(stay.withColumnRenamed("path", "file_path"), ["repo_id", "file_path"], "left_semi")
    return files, kept.unionByName(chunk_files(fresh)), changes


def index_metrics(changes: DataFrame, before_chunks: DataFrame, before_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """The six counters of an index run, a row for each collection."""
    counted = changes.groupBy("repo_id").agg(*[F.count_if(F.col("change") == c).alias(f"{c}_files") for c in ("added", "changed", "removed", "reused")])
    reused = changes.filter("change = 'reused'").select("repo_id", F.col("path").alias("file_path"))
    chunks = before_chunks.join(reused, ["repo_id", "file_path"], "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("reused_chunks"))
    was, now = (e.groupBy("repo_id").agg(F.count(F.lit(1)).alias(n)) for e, n in ((before_edges, "was"), (edges, "now")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = counted.join(chunks, "repo_id", "left").join(was, "repo_id", "left").join(now, "repo_id", "left")
    return out.select("repo_id", "added_files", "changed_files", "removed_files", "reused_files", zero(F.col("reused_chunks")).alias("reused_chunks"), F.least(zero(F.col("was")), zero(F.col("now"))).alias("reused_edges"))


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n_files"))


def breakdown_text(files: DataFrame) -> DataFrame:
    """`lang:n, lang:n`, the commonest first, a row for each collection."""
    pairs = language_breakdown(files).groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_files")).alias("k"), "language", "n_files"))).alias("x"))
    return pairs.select("repo_id", F.array_join(F.transform("x", lambda p: F.concat(p["language"], F.lit(":"), p["n_files"])), ", ").alias("languages"))


def diagnostics(files: DataFrame, chunks: DataFrame, edges: DataFrame, reused_chunks: Column | int = 0) -> DataFrame:
    """Counts of an index, a row for each collection."""
    f = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"), F.count_if("is_test").alias("test_count"), F.sum(F.size("symbols")).alias("symbol_count"))
    c = chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edge_count"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n)
    reused = reused_chunks if isinstance(reused_chunks, Column) else F.lit(reused_chunks)
    out = f.join(c, "repo_id", "left").join(e, "repo_id", "left").select("repo_id", "file_count", "test_count", "symbol_count", zero("chunk_count"), zero("edge_count"))
    return out.withColumn("chunk_reuse_ratio", F.when(F.col("chunk_count") == 0, 0.0).otherwise(reused / F.col("chunk_count")))
