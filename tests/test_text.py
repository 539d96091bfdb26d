import math
import posixpath
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.functions.script_parse import Parser


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    paths = ["src/a.ts", "src/b.TSX", "Dockerfile", "x/.env.example", "a.unknown", "docs/r.md", ".github/ci.yml", "node_modules/a.ts", "a/dist/b.ts", "dist.ts", "__tests__/x.py", "src/a.spec.ts", "src/contest/a.ts", "b_test.go"]
    assert column(spark, T.language, paths) == ["typescript", "typescriptreact", "text", "text", "text", "markdown", "yaml", "typescript", "typescript", "typescript", "python", "typescript", "typescript", "go"]
    assert column(spark, T.is_indexed, paths) == [True, True, True, True, False, True, True, False, False, True, True, True, True, True]
    assert column(spark, T.is_test, paths) == [False] * 10 + [True, True, False, True]


def test_lengths_are_utf16(spark):
    assert column(spark, T.utf16_length, ["", "a😀", "é", "abcd"]) == [0, 3, 1, 4]
    assert column(spark, T.token_estimate, ["", "a😀", "abcd", "abcde"]) == [0, 1, 1, 2]


def test_trim_is_javascripts(spark):
    assert column(spark, T.trimmed, ["\u00a0 a\ufeff\n", "\u2003b\u3000", "c\u200b", ""]) == ["a", "b", "c\u200b", ""]


def test_intents_are_substrings(spark):
    texts = ["prefix", "debug it", "terror", "address", "rename x", "a readme", "hello", "Refactor the docs", " Add docs"]
    assert column(spark, T.intent, texts) == ["bugfix", "bugfix", "bugfix", "feature", "refactor", "docs", "general", "refactor", "docs"]


def test_terms_and_trigrams(spark):
    assert column(spark, T.query_terms, ["Refactor the authentication-login flow, Login", "a bb"]) == [["refactor", "authentication", "login"], []]
    assert column(spark, T.term_trigrams, [["fix", "login"], []], "array<string>") == [["fix", "log", "ogi", "gin"], []]
    assert column(spark, T.embedding_tokens, ["A bb c-dd"]) == [["bb", "dd"]]


def test_reasons_and_ids(spark):
    df = spark.createDataFrame([("a; b", "b"), ("a", "c")], "x string, y string")
    assert [r[0] for r in df.select(T.append_reason(F.col("x"), F.col("y"))).collect()] == ["a; b", "a; c"]
    assert column(spark, T.prompt_id, ["abc"]) == ["a9993e364706"]
    assert column(spark, T.html_escaped, ["<a href='x'>\"&"]) == ["&lt;a href=&#39;x&#39;&gt;&quot;&amp;"]


def test_modules(spark):
    assert column(spark, T.normal_module, ["src/a.ts", "src/index.JS", "a/INDEX", "index", "a.css", "x.d.ts"]) == ["src/a", "src", "a", "index", "a.css", "x.d"]
    cases = [("src/a.ts", "./b"), ("src/a.ts", "../b"), ("a.ts", "../../b"), ("src/x/a.ts", "."), ("src/a.ts", "./"), ("src/a.ts", "react"), ("src/a.ts", "b//c/../d/"), ("/r/a.ts", "../../../b"), ("a.ts", ".")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, m string")
    got = [r.y for r in df.select("i", T.joined_path(F.col("s"), F.col("m")).alias("y")).orderBy("i").collect()]
    want = []
    for s, m in cases:
        whole = posixpath.dirname(s) + "/" + m if posixpath.dirname(s) else m
        want.append(posixpath.normpath(whole) + ("/" if whole.endswith("/") else ""))
    assert got == want


def test_one_decimal_is_exact(spark):
    values = [0.15, 0.25, 0.05, 0.35, 1.005, 23.56, 18.744550473755904, 0.8370170592217174, -0.25, -0.04, 1000.0, 0.95, 9.95, 1e-12, 0.0, 2.5, 123456.75, 0.45] + [i / 20 for i in range(1, 60)]
    want = [("-" if v < 0 else "") + str(Decimal(abs(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert column(spark, T.one_decimal, values, "double") == want


def test_recency_and_importance(spark):
    df = spark.createDataFrame([(0.0,), (86_400_000.0,), (432_000_000.0,)], "m double")
    assert [r[0] for r in df.select(T.recency(F.col("m"), F.lit(432_000_000.0))).collect()] == [0.0, 1.0, 5.0]
    df = spark.createDataFrame([("src/docs/a", 1, False), ("x", 0, True), ("src/a", 2, True)], "p string, n int, t boolean")
    assert [r[0] for r in df.select(T.file_importance(F.col("p"), F.col("n"), F.col("t"))).collect()] == [5, 1, 4]


CODE = """import React, { useState as us, type Foo } from "react";
import * as path from 'node:path';
import type { A } from "./a";
import "./side";
export { x } from "./x";
export * from "./y";
// import { no } from "./comment"
export class AuthService { login(user: string): boolean { return hashPassword(user).then(a => a.b.c()); } }
export async function loginUser(name) { const t = `hi ${name} ${us(1)} import "./no"`; return hashPassword('x'); }
export const hashPassword = async (v: string): Promise<string> => { return v.split(/,"\\s*/g).join("/"); };
const a = 1, b = function () {}, c = x => x + 1
interface Opt<T> extends Base { key: string }
const o = { key: a, run() { go(); } };
function inner<T>(p: T) { const fn = (q) => q; return new Thing(p) }
"""


def test_script_recogniser():
    p = Parser(CODE)
    assert p.imports == ["react", "node:path", "./a", "./side", "./x", "./y"]
    assert p.bindings == [("React", "react"), ("us", "react"), ("Foo", "react"), ("A", "./a")]
    assert p.symbols == [("class", "AuthService", True), ("function", "loginUser", True), ("function", "hashPassword", True), ("function", "b", False), ("function", "c", False), ("interface", "Opt", False), ("function", "inner", False), ("function", "fn", False)]
    assert set(p.calls) == {"hashPassword", "then", "c", "us", "split", "join", "go"}
    refs = set(p.refs)
    assert {"path", "user", "name", "Base", "Thing", "us", "v", "T", "q", "p"} <= refs
    assert not {"React", "useState", "Foo", "x1", "AuthService", "loginUser", "b", "inner", "no"} & refs


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab(){}[]<>=;:,.'\"`$/\\\n importexportclassconst", max_size=80))
def test_recogniser_survives_anything(code):
    Parser(code)


@pytest.mark.parametrize("cap", [math.floor(8000 * f) for f in (0.5, 0.25, 0.15, 0.1)])
def test_default_caps(cap):
    from lodeweave.operators.pack import budget_caps

    assert cap in budget_caps().values()
