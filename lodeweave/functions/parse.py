"""Parsing of file contents into imports, symbols, references and calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.functions.script_parse import parse_scripts

_W = T.WHITE
_NOT_W = "A-Za-z0-9_"
#: A word boundary of ASCII letters; Java's is Unicode's.
_B = rf"(?:(?<![{_NOT_W}])(?=[{_NOT_W}])|(?<=[{_NOT_W}])(?![{_NOT_W}]))"
_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: What imports and symbols look like in files of other languages.
IMPORTS = (
    rf"""import{_W}+(?:type{_W}+)?(?:[^'"]+from{_W}+)?["']([^"']+)["']""",
    rf"""export{_W}+[^'"]+from{_W}+["']([^"']+)["']""",
    rf"""require\({_W}*["']([^"']+)["']{_W}*\)""",
    rf"""from{_W}+["']([^"']+)["']""",
)
SYMBOLS = (
    ("class", True, rf"{_B}export{_W}+class{_W}+({_ID})"),
    ("class", False, rf"{_B}class{_W}+({_ID})"),
    ("interface", True, rf"{_B}export{_W}+interface{_W}+({_ID})"),
    ("interface", False, rf"{_B}interface{_W}+({_ID})"),
    ("function", True, rf"{_B}export{_W}+function{_W}+({_ID})"),
    ("function", False, rf"{_B}function{_W}+({_ID})"),
    ("function", True, rf"{_B}export{_W}+const{_W}+({_ID}){_W}*={_W}*(?:async{_W}*)?\("),
    ("function", False, rf"{_B}const{_W}+({_ID}){_W}*={_W}*(?:async{_W}*)?\("),
    ("function", False, rf"{_B}const{_W}+({_ID}){_W}*={_W}*(?:async{_W}*)?{_ID}{_W}*=>"),
    ("function", False, rf"{_B}def{_W}+([A-Za-z_][A-Za-z0-9_]*)"),
)
_SYMBOL = "array<struct<id:string,name:string,kind:string,path:string,exported:boolean>>"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _sorted(words: Column) -> Column:
    """In the order of paths, repeats dropped."""
    a, b = (lambda c: F.collate(c, "UNICODE")), (lambda c: F.collate(c, "UNICODE"))
    return F.array_sort(F.array_distinct(words), lambda x, y: F.when(a(x) < b(y), -1).when(a(x) > b(y), 1).otherwise(0))


def module_symbol(path: Column) -> Column:
    kind = F.when(T.is_test(path), "test").otherwise("module")
    return F.array(F.struct(F.concat(path, F.lit("#module")).alias("id"), T.base_name(path).alias("name"), kind.alias("kind"), path.alias("path"), F.lit(True).alias("exported"))).cast(_SYMBOL)


def _named(path: Column, found: Column) -> Column:
    """found(kind, name, exported) as symbols; of those with one id the first stays.

    What a lambda uses from outside is evaluated again for each element, so symbols and ids are bound to names first.
    """
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    full = F.transform(found, lambda s: F.struct(F.concat(path, F.lit("#"), s["kind"], F.lit(":"), s["name"]).alias("id"), s["name"].alias("name"), s["kind"].alias("kind"), path.alias("path"), s["exported"].alias("exported")))
    firsts = lambda every, ids: F.filter(every, lambda s, i: F.array_position(ids, s["id"]) == i + 1)
    return bound(full, lambda every: bound(F.transform(every, lambda s: s["id"]), lambda ids: firsts(every, ids))).cast(_SYMBOL)


def is_script(path: Column) -> Column:
    return T.extension(path).isin(".ts", ".tsx", ".js", ".jsx", ".mjs")


_SCRIPT = "imports array<string>, symbols array<struct<kind:string,name:string,exported:boolean>>, refs array<string>, calls array<string>, bindings array<struct<local:string,source:string>>"


def script_facts(path: Column, content: Column) -> Column:
    """What the recogniser finds in scripts; null for other files. Select it as a column before parsed() uses it."""
    return F.pandas_udf(parse_scripts, _SCRIPT)(path, F.when(is_script(path), F.coalesce(content, F.lit(""))))


def parsed(path: Column, content: Column, s: Column) -> Column:
    """Struct of imports, symbols, refs, calls and bindings: scripts by the recogniser (s), other files by patterns."""
    text = F.coalesce(content, F.lit(""))
    script = is_script(path)
    matches = F.flatten(F.array(*[F.transform(_all(text, p), lambda n: F.struct(F.lit(k).alias("kind"), n.alias("name"), F.lit(e).alias("exported"))) for k, e, p in SYMBOLS]))
    imports = F.filter(F.transform(F.flatten(F.array(*[_all(text, p) for p in IMPORTS])), T.trimmed), lambda x: x != "")
    either = lambda a, b: F.when(script, a).otherwise(b)
    none = F.array().cast("array<struct<local:string,source:string>>")
    return F.struct(
        _sorted(either(s["imports"], imports)).alias("imports"),
        F.concat(module_symbol(path), _named(path, either(s["symbols"], matches))).alias("symbols"),
        F.array_distinct(either(s["refs"], _all(text, rf"{_B}({_ID}){_B}"))).alias("refs"),
        F.array_distinct(either(s["calls"], _all(text, rf"{_B}({_ID}){_W}*\("))).alias("calls"),
        F.coalesce(s["bindings"], none).alias("bindings"),
    )
