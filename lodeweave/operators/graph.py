"""Edges between files: names and modules resolved by equi-joins, and walks of up to two edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.sources.shared import staged


def by_path(column: str = "path") -> Column:
    """Order of paths; used in ordering only, as the collation would stick to a selected column's type."""
    return F.expr(f"{column} COLLATE UNICODE")


def symbol_dictionary(files: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """repo_id, name, path: the last symbol of each name in the order of paths, modules and tests aside; of asked(repo_id, name) only, if given."""
    named = files.select("repo_id", F.posexplode("symbols").alias("ord", "s")).select("repo_id", "ord", F.col("s.name").alias("name"), F.col("s.path").alias("path"), F.col("s.kind").alias("kind"))
    if asked is not None:
        named = named.join(asked, ["repo_id", "name"], "left_semi")
    w = Window.partitionBy("repo_id", "name").orderBy(by_path().desc(), F.desc("ord"))
    return named.filter("kind not in ('module', 'test')").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("repo_id", "name", "path")


def _suffixes(path: Column) -> Column:
    """What follows each slash of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def module_matches(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, src, module, dst: all files that modules of imports(repo_id, src, module) can mean.

    A file's normal path equals the module, ends with it after a slash, or is what it ends with after a slash.
    Exploding what follows each slash, on either side, makes the suffix join two equi-joins.
    """
    wanted = imports.select("repo_id", "src", "module").distinct().withColumn("want", T.normal_module(T.joined_path(F.col("src"), F.col("module"))))
    have = files.select("repo_id", F.col("path").alias("dst"), T.normal_module(F.col("path")).alias("have"))
    has_slash = lambda c: F.col(c).contains("/")
    ends = have.filter(has_slash("have")).select("repo_id", "dst", F.explode(_suffixes(F.col("have"))).alias("want"))
    whole = have.select("repo_id", "dst", F.col("have").alias("want"))
    found = wanted.join(whole.unionByName(ends), ["repo_id", "want"]).select("repo_id", "src", "module", "dst")
    tails = wanted.filter(has_slash("want")).select("repo_id", "src", "module", F.explode(_suffixes(F.col("want"))).alias("have"))
    return found.unionByName(tails.join(have, ["repo_id", "have"]).select("repo_id", "src", "module", "dst"))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, src, module, dst for imports(repo_id, src, module): the first match in the order of paths."""
    found = module_matches(imports, files)
    w = Window.partitionBy("repo_id", "src", "module").orderBy(by_path("dst"))
    return found.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def _edge(src: str, dst: str, kind: str, weight: int) -> Column:
    return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """resolved(repo_id, src, dst, is_test): import, caller (backwards), callee and, from tests, test edges."""
    test = F.when(F.col("is_test"), F.array(_edge("src", "dst", "test", 4))).otherwise(F.array().cast("array<struct<src:string,dst:string,kind:string,weight:int>>"))
    all_edges = F.concat(F.array(_edge("src", "dst", "import", 5), _edge("dst", "src", "caller", 3), _edge("src", "dst", "callee", 3)), test)
    return resolved.select("repo_id", F.explode(all_edges).alias("e")).select("repo_id", "e.*")


def deduped(edges: DataFrame) -> DataFrame:
    """One edge for each pair and kind, with the largest weight."""
    return edges.groupBy("repo_id", "src", "dst", "kind").agg(F.max("weight").alias("weight"))


def _bindings(files: DataFrame) -> DataFrame:
    """repo_id, src, name, module: what each name of a file is bound to first."""
    bound = files.select("repo_id", F.col("path").alias("src"), F.posexplode("bindings").alias("ord", "b")).select("repo_id", "src", F.col("b.local").alias("name"), F.struct("ord", F.col("b.source").alias("module")).alias("m"))
    return bound.groupBy("repo_id", "src", "name").agg(F.min("m").alias("m")).select("repo_id", "src", "name", "m.module")


def _named(files: DataFrame, column: str) -> DataFrame:
    return files.select("repo_id", F.col("path").alias("src"), F.explode(column).alias("name"))


def _modules(files: DataFrame) -> DataFrame:
    return files.select("repo_id", F.col("path").alias("src"), F.explode("imports").alias("module"))


def build_edges(files: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """repo_id, src, dst, kind, weight from what the parsers found in files; from what they found in origins, files too, if given."""
    sources = files if origins is None else origins
    asked = None if origins is None else _named(sources, "refs").unionByName(_named(sources, "calls")).select("repo_id", "name").distinct()
    names = symbol_dictionary(files, asked)
    imports, bound = _modules(sources), _bindings(sources)
    resolved = resolve_modules(imports.unionByName(bound.select("repo_id", "src", "module")), files)
    tests = sources.select("repo_id", F.col("path").alias("src"), "is_test")
    from_imports = import_edges(imports.join(resolved, ["repo_id", "src", "module"]).join(tests, ["repo_id", "src"]))
    refs = _named(sources, "refs").join(names.withColumnRenamed("path", "dst"), ["repo_id", "name"])
    from_refs = refs.filter("src <> dst").select("repo_id", "src", "dst", F.lit("reference").alias("kind"), F.lit(2).alias("weight"))
    calls = _named(sources, "calls").join(bound, ["repo_id", "src", "name"], "left")
    by_binding = calls.filter("module is not null").join(resolved, ["repo_id", "src", "module"]).select("repo_id", "src", "dst")
    by_name = calls.filter("module is null").join(names.withColumnRenamed("path", "dst"), ["repo_id", "name"]).select("repo_id", "src", "dst")
    called = by_binding.unionByName(by_name).filter("src <> dst")
    from_calls = called.select("repo_id", F.explode(F.array(_edge("src", "dst", "caller", 4), _edge("src", "dst", "callee", 4))).alias("e")).select("repo_id", "e.*")
    return deduped(from_imports.unionByName(from_refs).unionByName(from_calls))


def stale_sources(before: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """repo_id, path: the files whose own edges can differ between two indexes.

    These are files that came, went or changed, and by the rules of resolution: files that use a name whose
    dictionary entry is another one now, which only names of such files can be; and files with a module
    that a path which came or went can mean. Only what changed is resolved for that.
    """
    changed = changes.filter("change <> 'reused'").select("repo_id", "path")
    names = lambda x: x.join(changed, ["repo_id", "path"], "left_semi").select("repo_id", F.explode("symbols.name").alias("name"))
    touched = staged(names(before).unionByName(names(files)).distinct())
    was, now = (symbol_dictionary(x, touched).withColumnRenamed("path", p) for x, p in ((before, "was"), (files, "now")))
    moved = was.join(now, ["repo_id", "name"], "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select("repo_id", "name")
    by_name = _named(files, "refs").unionByName(_named(files, "calls")).join(moved, ["repo_id", "name"], "left_semi")
    paths = changes.filter("change in ('added', 'removed')").select("repo_id", "path")
    by_module = module_matches(_modules(files).unionByName(_bindings(files).select("repo_id", "src", "module")), paths)
    return changed.unionByName(by_name.unionByName(by_module, allowMissingColumns=True).select("repo_id", F.col("src").alias("path"))).distinct()


def refreshed_edges(before: DataFrame, files: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """build_edges(files) from the edges of an index of `before`: only edges with a stale end are made anew.

    An edge comes from what was found in one of its two ends, so besides the stale files only those are looked
    at that had an edge with one. changes: repo_id, path, change, as snapshot_changes tells.
    """
    stale = staged(stale_sources(before, files, changes))
    end = lambda c: stale.select("repo_id", F.col("path").alias(c), F.lit(True).alias(f"{c}_stale"))
    marked = lambda e: e.join(end("src"), ["repo_id", "src"], "left").join(end("dst"), ["repo_id", "dst"], "left")
    none = F.col("src_stale").isNull() & F.col("dst_stale").isNull()
    columns = ("repo_id", "src", "dst", "kind", "weight")
    known = staged(marked(edges))
    ends = known.filter(~none).select("repo_id", F.explode(F.array("src", "dst")).alias("path"))
    origins = staged(files.join(stale.unionByName(ends).distinct(), ["repo_id", "path"], "left_semi").select("repo_id", "path", "is_test", "imports", "refs", "calls", "bindings"))
    made = marked(build_edges(files, origins)).filter(~none)
    return known.filter(none).select(*columns).unionByName(made.select(*columns))


def edge_reason(seed: Column, kind: Column, source: Column, to: Column) -> Column:
    return (
        F.when(kind == "import", F.concat(to, F.lit(" imported by "), source, F.lit(" from seed "), seed))
        .when(kind == "test", F.concat(to, F.lit(" is a related test for "), source))
        .when(kind == "reference", F.concat(to, F.lit(" referenced by "), source, F.lit(" from seed "), seed))
        .when(kind == "caller", F.concat(to, F.lit(" calls or is called from "), source))
        .otherwise(F.concat(to, F.lit(" reached through "), kind, F.lit(" edge from "), source))
    )


def expand_seeds(seeds: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Seeds and what walks of one or two edges reach, one row for each task and path.

    seeds: task_id, repo_id, seed_rank, path, score, reason, role; files: repo_id, path, is_test.
    Every walk is an event in the order of a breadth-first search: seeds first, then seed by seed
    the walks of one edge and of two. The earliest event with the largest score gives a path its
    row; reasons of later events are appended. Two joins are all walks, as none is longer.
    Neither step gathers walks: a path's row is a minimum over (score, order), and of the events after it
    the first of each different reason; both are combined in the tasks that walk, so a hub costs its
    path no more than its different reasons.
    """
    steps = edges.join(files.select("repo_id", F.col("path").alias("dst"), F.col("is_test").alias("to_test")), ["repo_id", "dst"])
    # An edge's place among those of its source: by kind, then path. No source's edges are gathered for it.
    place = lambda n, kind, path: F.struct(n.alias("n"), kind.alias("kind"), F.collate(path, "UNICODE").alias("to"))
    first, step = place(F.lit(0), F.lit(""), F.lit("")), place(F.lit(0), F.col("kind"), F.col("dst"))
    role = lambda d: F.when((F.col("kind") == "test") | F.col("to_test"), "test").otherwise("dependency" if d == 1 else "semantic-support")
    gain = lambda d: F.greatest(F.lit(1.0), F.col("seed_score") - 2 * d + F.col("weight"))
    start = seeds.select("task_id", "repo_id", "seed_rank", F.col("path").alias("seed"), F.col("score").cast("double").alias("seed_score"))
    one = start.withColumn("src", F.col("seed")).join(steps, ["repo_id", "src"]).select(
        "task_id", "repo_id", "seed_rank", "seed", "seed_score", F.col("dst").alias("path"), F.lit(1).alias("distance"), step.alias("o1"), first.alias("o2"),
        gain(1).alias("score"), role(1).alias("role"), edge_reason(F.col("seed"), F.col("kind"), F.col("src"), F.col("dst")).alias("reason"), F.array("seed", "dst").alias("trail"),
    )
    two = one.select("task_id", "repo_id", "seed_rank", "seed", "seed_score", F.col("path").alias("src"), "o1", F.col("trail").alias("before")).join(steps, ["repo_id", "src"]).select(
        "task_id", "repo_id", "seed_rank", "seed", "seed_score", F.col("dst").alias("path"), F.lit(2).alias("distance"), "o1", step.alias("o2"),
        gain(2).alias("score"), role(2).alias("role"), edge_reason(F.col("seed"), F.col("kind"), F.col("src"), F.col("dst")).alias("reason"), F.concat("before", F.array("dst")).alias("trail"),
    )
    own = seeds.select(
        "task_id", "repo_id", F.lit(0).alias("seed_rank"), F.col("path").alias("seed"), F.col("score").cast("double").alias("seed_score"), "path", F.lit(0).alias("distance"), place(F.col("seed_rank"), F.lit(""), F.lit("")).alias("o1"), first.alias("o2"),
        F.col("score").cast("double").alias("score"), "role", "reason", F.array("path").alias("trail"),
    )
    events = own.unionByName(one).unionByName(two)
    key, order = ["task_id", "repo_id", "path"], ("seed_rank", "distance", "o1", "o2")
    first_of_best = F.min(F.struct((-F.col("score")).alias("less"), F.struct(*order).alias("order"), "score", "role", "reason", "trail"))
    best = staged(events.groupBy(*key).agg(first_of_best.alias("e")))
    after = events.select(*key, "reason", F.struct(*order).alias("order")).join(best.select(*key, F.col("e.order").alias("from")), key).filter("order > from")
    reasons = after.groupBy(*key, "reason").agg(F.min("order").alias("order")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("order", "reason"))).alias("later"))
    best = best.join(reasons, key, "left").withColumn("e", F.col("e").withField("distance", F.col("e.order.distance")))
    best = best.withColumn("e", F.col("e").withField("reason", F.aggregate(F.coalesce("later", F.array()), F.col("e.reason"), lambda text, x: T.append_reason(text, x["reason"]))))
    return best.select(
        "task_id", "repo_id", "path", F.col("e.reason").alias("reason"), F.col("e.score").alias("structural_score"), F.col("e.role").alias("role"),
        F.when(F.col("e.distance") == 0, "seed").otherwise("graph").alias("stage"), F.col("e.distance").alias("dependency_distance"), F.col("e.trail").alias("expansion_path"),
    )
