"""Queries over source files: what patterns find in them, names, edges, and what a refresh keeps; with their SQL.

Each document stands for a source file: declarations named by its first terms, and an import of the file
with half its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import graph, index
from lodeweave.plans.oracle import STOP, _sql
from lodeweave.sources.shared import staged

KINDS = (".py", ".go", ".java", ".rb")


def contents(spark: SparkSession, d: str, before: bool = False) -> DataFrame:
    """A source file of each document. before: an earlier state, in which some files have other texts and some lie elsewhere.

    A file whose path, size and time are the same in both states has the same text in both: its import names the later
    path. Files that a refresh reads again name the earlier one.
    """

    def place(i, early):
        folder = F.concat(F.when((i % 7 == 0) & early, "old/d").when(i % 10 == 3, "tests/d").otherwise("src/d"), i % 16)
        return F.concat(folder, F.lit("/m"), F.lpad(i.cast("string"), 9, "0"), F.element_at(F.array(*map(F.lit, KINDS)), (i % 4 + 1).cast("int")))

    own, half = F.col("doc_id"), F.floor(F.col("doc_id") / 2)
    early = F.lit(before)
    moved = (own % 5 == 0) if before else F.lit(False)
    word = lambda k: F.concat(F.lit("f_"), F.coalesce(F.get("terms", F.lit(k) + moved.cast("int")), F.lit("none")))
    module = F.concat(F.lit("../../"), F.regexp_replace(place(half, early & ((own % 5 == 0) | (own % 7 == 0))), "[.]py$", ""))
    content = F.concat_ws(
        "\n",
        F.when(own > 0, F.concat(F.lit("import x from '"), module, F.lit("'"))),
        F.concat(F.lit("export class "), word(0), F.lit(" extends "), word(1)),
        F.concat(F.lit("interface "), word(2)),
        F.concat(F.lit("def "), word(3), F.lit("(self): return "), word(4), F.lit(" (1)")),
        F.concat(F.lit("export const "), word(4), F.lit(" = async (a) => "), word(5), F.lit("(a)")),
        F.concat(F.lit("const "), word(6), F.lit(" = b => class "), word(0)),
    )
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.query_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    return x.select(F.lit("code").alias("repo_id"), place(own, early).alias("path"), F.octet_length(content).cast("long").alias("size"), F.when(moved, 1.0).otherwise(0.0).alias("modified_at_ms"), content.alias("content"))


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """What the patterns find in source files."""
    listed = F.transform("symbols", lambda s: F.concat_ws(":", s["kind"], s["name"], s["exported"].cast("string")))
    found = index.file_records(contents(spark, d))
    return found.select("path", "language", "is_test", F.array_join("imports", ",").alias("imports"), F.array_join(listed, ",").alias("symbols"), F.array_join("refs", ",").alias("refs"), F.array_join("calls", ",").alias("calls"))


def symbol_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The file that each name means."""
    return graph.symbol_dictionary(staged(index.file_records(contents(spark, d)))).select("name", "path")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of imports, names and calls."""
    return graph.build_edges(staged(index.file_records(contents(spark, d)))).drop("repo_id")


def _refreshed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files of the earlier state; files, chunks and changes after the later one."""
    before = staged(index.file_records(contents(spark, d, before=True)))
    files, chunks, changes = index.refreshed(before, index.chunk_files(before), contents(spark, d))
    return before, staged(files), chunks, staged(changes)


def refreshed_edges(spark: SparkSession, d: str) -> DataFrame:
    """What code_edges has, made from the edges of the earlier state."""
    before, files, _, changes = _refreshed(spark, d)
    return graph.refreshed_edges(before, files, staged(graph.build_edges(before)), changes).drop("repo_id")


def refreshed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the later state, and whether they were taken from the earlier one."""
    _, _, chunks, changes = _refreshed(spark, d)
    reused = changes.select("repo_id", F.col("path").alias("file_path"), (F.col("change") == "reused").alias("reused"))
    return chunks.join(reused, ["repo_id", "file_path"]).select("id", "kind", "token_estimate", F.md5(F.col("text").cast("binary")).alias("text_md5"), "reused")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (code_files, symbol_dictionary, code_edges, refreshed_edges, refreshed_chunks)}


def _place(i: str) -> str:
    return f"CASE WHEN {i} % 10 = 3 THEN 'tests/d' ELSE 'src/d' END || {i} % 16 || '/m' || lpad(({i})::VARCHAR, 9, '0') || {list(KINDS)}[{i} % 4 + 1]"


def _word(k: int) -> str:
    return f"'f_' || coalesce(t[{k + 1}], 'none')"


CODE = f"""raw AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents),
parts AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM raw),
first AS (SELECT doc_id, word, min(pos) AS pos FROM parts WHERE length(word) >= 3 AND word NOT IN ({STOP}) GROUP BY ALL),
terms AS (SELECT raw.doc_id, coalesce(list(word ORDER BY pos) FILTER (word IS NOT NULL), []) AS t FROM raw LEFT JOIN first ON first.doc_id = raw.doc_id GROUP BY raw.doc_id),
code AS (SELECT doc_id, {_place("doc_id")} AS path, doc_id % 10 = 3 AS is_test, ['python', 'go', 'java', 'ruby'][doc_id % 4 + 1] AS language, concat_ws(chr(10),
  CASE WHEN doc_id > 0 THEN 'import x from ''../../' || regexp_replace({_place("doc_id // 2")}, '[.]py$', '') || '''' END,
  'export class ' || {_word(0)} || ' extends ' || {_word(1)}, 'interface ' || {_word(2)}, 'def ' || {_word(3)} || '(self): return ' || {_word(4)} || ' (1)',
  'export const ' || {_word(4)} || ' = async (a) => ' || {_word(5)} || '(a)', 'const ' || {_word(6)} || ' = b => class ' || {_word(0)}) AS content FROM terms)"""

_ID = "[A-Za-z_$][A-Za-z0-9_$]*"
#: Kind, whether exported, and pattern of each declaration, in the order in which they are tried.
_FORMS = (
    ("class", "true", rf"export\s+class\s+({_ID})"), ("class", "false", rf"class\s+({_ID})"), ("interface", "true", rf"export\s+interface\s+({_ID})"), ("interface", "false", rf"interface\s+({_ID})"),
    ("function", "true", rf"export\s+function\s+({_ID})"), ("function", "false", rf"function\s+({_ID})"), ("function", "true", rf"export\s+const\s+({_ID})\s*=\s*(?:async\s*)?\("),
    ("function", "false", rf"const\s+({_ID})\s*=\s*(?:async\s*)?\("), ("function", "false", rf"const\s+({_ID})\s*=\s*(?:async\s*)?{_ID}\s*=>"), ("function", "false", r"def\s+([A-Za-z_][A-Za-z0-9_]*)"),
)
_EACH = " UNION ALL ".join(rf"SELECT path, {k} AS form, '{kind}' AS kind, {exported} AS exported, regexp_extract_all(content, '\b{pattern}', 1) AS names FROM code" for k, (kind, exported, pattern) in enumerate(_FORMS))
SYMBOLS = rf"""found AS (SELECT path, form, kind, exported, unnest(names) AS name, generate_subscripts(names, 1) AS nth FROM ({_EACH})),
symbols AS (SELECT path, kind, name, exported, row_number() OVER (PARTITION BY path ORDER BY form, nth) AS ord FROM found QUALIFY row_number() OVER (PARTITION BY path, kind, name ORDER BY form, nth) = 1),
used AS (SELECT path, regexp_extract_all(content, '\b({_ID})\b', 1) AS r, regexp_extract_all(content, '\b({_ID})\s*\(', 1) AS c FROM code),
words AS (SELECT path, list_filter(r, lambda x, i: list_position(r, x) = i) AS refs, list_filter(c, lambda x, i: list_position(c, x) = i) AS calls FROM used),
names AS (SELECT name, path FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY path DESC, ord DESC) = 1)"""

EDGES = """up AS (SELECT c.path AS src, p.path AS dst, c.is_test FROM code c JOIN code p ON p.doc_id = c.doc_id // 2 WHERE c.doc_id > 0),
asked AS (SELECT path, unnest(refs) AS name, 'reference' AS how FROM words UNION ALL SELECT path, unnest(calls), 'call' FROM words),
met AS (SELECT a.path AS src, n.path AS dst, how FROM asked a JOIN names n ON n.name = a.name AND n.path <> a.path),
edges AS (SELECT src, dst, kind, max(weight)::INT AS weight FROM (
  SELECT src, dst, 'import' AS kind, 5 AS weight FROM up UNION ALL SELECT dst, src, 'caller', 3 FROM up UNION ALL SELECT src, dst, 'callee', 3 FROM up UNION ALL SELECT src, dst, 'test', 4 FROM up WHERE is_test
  UNION ALL SELECT src, dst, 'reference', 2 FROM met WHERE how = 'reference' UNION ALL SELECT src, dst, 'caller', 4 FROM met WHERE how = 'call' UNION ALL SELECT src, dst, 'callee', 4 FROM met WHERE how = 'call') GROUP BY ALL)"""

FILES = """SELECT c.path, language, is_test, coalesce(array_to_string(regexp_extract_all(content, 'import x from ''([^'']*)''', 1), ','), '') AS imports,
  CASE WHEN is_test THEN 'test' ELSE 'module' END || ':' || split_part(c.path, '/', -1) || ':true,' || s.list AS symbols, array_to_string(refs, ',') AS refs, array_to_string(calls, ',') AS calls
FROM code c JOIN words w ON w.path = c.path JOIN (SELECT path, string_agg(kind || ':' || name || ':' || exported, ',' ORDER BY ord) AS list FROM symbols GROUP BY path) s ON s.path = c.path"""

CHUNKS = """SELECT path || '#1-' || len(string_split(content, chr(10))) AS id, CASE WHEN is_test THEN 'test' ELSE 'code' END AS kind, ceil(length(content) / 4)::BIGINT AS token_estimate, md5(content) AS text_md5,
  doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS reused FROM code"""


def oracle_sql() -> dict[str, str]:
    edges = _sql("SELECT * FROM edges", CODE, SYMBOLS, EDGES)
    return {
        "code_files": _sql(FILES, CODE, SYMBOLS),
        "symbol_dictionary": _sql("SELECT name, path FROM names", CODE, SYMBOLS),
        "code_edges": edges,
        "refreshed_edges": edges,
        "refreshed_chunks": _sql(CHUNKS, CODE),
    }
