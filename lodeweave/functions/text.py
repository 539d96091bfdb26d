"""Text and path functions as Column expressions.

Lengths are UTF-16 code units and white space is JavaScript's, as the token estimates and trimmed
chunks of the data model need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

#: Language of each indexed extension; other indexed names are `text`.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".go": "go", ".java": "java",
    ".js": "javascript", ".json": "json", ".jsx": "javascriptreact", ".md": "markdown", ".mjs": "javascript",
    ".py": "python", ".rb": "ruby", ".rs": "rust", ".sh": "shell", ".sql": "sql", ".swift": "swift",
    ".ts": "typescript", ".tsx": "typescriptreact", ".txt": "text", ".yaml": "yaml", ".yml": "yaml",
}
#: Directories that are never descended into: this library's own, and fixed values.
IGNORED_DIRECTORIES = (".lodeweave", ".git", ".next", ".turbo", "build", "coverage", "dist", "node_modules", "tmp")
#: Words that are no query terms.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "into", "from", "your", "task", "flow", "file")
#: Words that tell a task's intent, in the order in which they are tried.
INTENTS = {
    "bugfix": ("fix", "bug", "regression", "error", "broken"),
    "refactor": ("refactor", "rename", "cleanup", "simplify"),
    "docs": ("docs", "documentation", "readme", "guide"),
    "feature": ("add", "build", "implement", "create", "support"),
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4)


def file_token_cost(size: Column) -> Column:
    return F.ceil(size / 4)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)$", 1))


def is_indexed(path: Column, ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> Column:
    """Whether a file is of an indexed kind and in no ignored directory."""
    name = base_name(path)
    kind = extension(path).isin(*LANGUAGES) | (name == "Dockerfile") | name.endswith(".env.example")
    parents = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return kind & ~F.arrays_overlap(parents, F.array(*[F.lit(d) for d in ignored]))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("text"))


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(test|tests|__tests__)/|(\.|_)(test|spec)\.")


def file_importance(path: Column, symbols: Column, test: Column) -> Column:
    bonus = F.when(path.contains("src/"), 3).otherwise(0) + F.when(path.contains("docs/"), 1).otherwise(0) - test.cast("int")
    return F.greatest(F.lit(1), symbols + bonus).cast("long")


def recency(modified: Column, latest: Column) -> Column:
    """5 for the newest file, a point less for each day before it."""
    behind = F.greatest(F.lit(0.0), latest - modified)
    return F.when(behind == 0, 5.0).otherwise(F.greatest(F.lit(0.0), 5.0 - behind / 86_400_000.0))


def intent(text: Column) -> Column:
    plain = F.lower(trimmed(text))
    found = F.lit(None).cast("string")
    for name, words in reversed(INTENTS.items()):
        found = F.when(plain.rlike("|".join(words)), name).otherwise(found)
    return F.coalesce(found, F.lit("general"))


def query_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))  # each word once, in their order


def embedding_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def term_trigrams(terms: Column) -> Column:
    """Each term under four characters as it is, of others all runs of three, repeats kept."""
    return F.flatten(F.transform(terms, lambda t: F.when(F.length(t) < 4, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: t.substr(i, F.lit(3))))))


def append_reason(have: Column, more: Column) -> Column:
    return F.when(have.contains(more), have).otherwise(F.concat(have, F.lit("; "), more))


def normal_module(path: Column) -> Column:
    """A path without a code extension and a final /index."""
    return F.regexp_replace(F.regexp_replace(path, r"(?i)\.(ts|tsx|js|jsx|mjs|py|md|json)\z", ""), r"(?i)/index\z", "")


def joined_path(source: Column, module: Column) -> Column:
    """module seen from the directory of source, with . and .. resolved; leading .. and a final slash stay."""
    folder = F.regexp_extract(source, r"(?s)^(.*)/[^/]*$", 1)
    whole = F.when(folder == "", module).otherwise(F.concat(folder, F.lit("/"), module))
    rooted = whole.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        back = F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    text = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    text = F.when(text == "", ".").otherwise(text)
    return F.when(whole.endswith("/") & ~text.endswith("/"), F.concat(text, F.lit("/"))).otherwise(text)


def prompt_id(prompt: Column) -> Column:
    return F.substring(F.sha1(prompt.cast("binary")), 1, 12)


def one_decimal(value: Column) -> Column:
    """A double with one decimal: its exact binary value, rounded half away from zero.

    Casting to decimal would round the shortest text instead (0.15 is a little less than 0.15). The
    fraction times 2^60 is a whole number for every fraction that can reach 0.05, so tenths are exact.
    """
    size = F.abs(value)
    whole = F.floor(size)
    fraction = ((size - whole) * float(1 << 60)).cast("long").cast("decimal(20,0)")
    tenths = F.call_function("div", fraction * F.lit(10).cast("decimal(2,0)") + F.lit(1 << 59).cast("decimal(20,0)"), F.lit(1 << 60).cast("decimal(20,0)"))
    all_tenths = whole * 10 + tenths
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(all_tenths / 10).cast("string"), F.lit("."), (all_tenths % 10).cast("string"))


def bucket(role: Column) -> Column:
    return F.when(role == "test", "tests").when(role.isin("dependency", "semantic-support"), "dependency").otherwise("summary")


def keep_raw(role: Column, score: Column) -> Column:
    return role.isin("primary", "manual") | (score >= 14)


def preserved_interfaces(symbols: Column) -> Column:
    return F.transform(F.filter(symbols, lambda s: s["kind"].isin("class", "function", "interface")), lambda s: s["name"])


def html_escaped(text: Column) -> Column:
    #: The five escapes.
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def target(name: Column) -> Column:
    return F.when(name == "claude", "claude").otherwise("codex")
