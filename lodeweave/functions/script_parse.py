"""What a TypeScript or JavaScript file declares, imports, mentions and calls.

A lexer (strings, templates with nested expressions, comments, regular expressions) and a shallow
recogniser of declarations; no syntax tree. Known differences from a compiler: words in JSX text
count as references, and class or function expressions are told from declarations by the token before them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd


class Token(NamedTuple):
    kind: str  # name, text, number, sign, regex
    value: str
    fresh: bool  # the first token of a line


#: Words that are never identifiers.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Words that are no identifiers where another word, or for async a parameter list, follows.
MODIFIERS = frozenset("async let type as of declare abstract readonly public private protected static get set keyof infer is satisfies namespace module override await yield implements interface".split())
_LEX = re.compile(
    r"(?P<line>\n)|(?P<blank>[^\S\n]+)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$À-￿][\w$À-￿]*)|(?P<number>\.?\d[\w.]*)"
    r"|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<tick>`)|(?P<sign>=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|[=!<>]=+|\+\+|--|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\(?:.|\Z)|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
_VALUE_END = frozenset(")]}")
_OBJECT_BEFORE = frozenset(["=", "(", ",", ":", "[", "?", "&&", "||", "??", "...", "return"])
_EXPRESSION_BEFORE = frozenset(["=", "(", ",", ":", "?", "=>", "[", "&&", "||", "??", "!", "...", "return", "new", "typeof", "void", "await", "case"])


def tokens_of(code: str) -> list[Token]:
    out: list[Token] = []
    at, fresh, depths = 0, True, []
    braces = 0
    while at < len(code):
        if code[at] == "/" and not code.startswith(("//", "/*"), at):
            before = out[-1] if out else None
            value = before is not None and (before.kind in ("number", "text", "regex") or (before.kind == "name" and before.value not in KEYWORDS) or before.value in _VALUE_END or before.value == "this")
            if not value and (m := _REGEX.match(code, at)):
                out.append(Token("regex", m[0], fresh))
                at, fresh = m.end(), False
                continue
        m = _LEX.match(code, at)
        kind, value = m.lastgroup, m[0]
        at = m.end()
        if kind == "line":
            fresh = True
        elif kind == "note":
            fresh = fresh or "\n" in value
        elif kind == "tick" or (kind == "sign" and value == "}" and depths and depths[-1] == braces):
            if kind == "sign":
                depths.pop()
                out.append(Token("sign", ")", False))
            else:
                out.append(Token("text", "``", fresh))
            # the rest of a template up to its end or the next expression, which stands in parentheses
            m = _TEMPLATE.match(code, at)
            at = m.end()
            if m[1] == "${":
                depths.append(braces)
                out.append(Token("sign", "(", False))
            fresh = False
        elif kind != "blank":
            braces += (value == "{") - (value == "}") if kind == "sign" else 0
            out.append(Token(kind, value, fresh))
            fresh = False
    return out


def _matching(t: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at `at`, or the end."""
    depth = 0
    for i in range(at, len(t)):
        if t[i].kind == "sign":
            depth += (t[i].value in "([{") - (t[i].value in ")]}") if len(t[i].value) == 1 else 0
            if depth == 0:
                return i
    return len(t)


class Parser:
    def __init__(self, code: str):
        self.t = tokens_of(code)
        self.imports: list[str] = []
        self.bindings: list[tuple[str, str]] = []
        self.symbols: list[tuple[str, str, bool]] = []
        self.refs: list[str] = []
        self.calls: list[str] = []
        self.declared: set[int] = set()  # tokens that are no references
        self.run()

    def value(self, i: int) -> str:
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind in ("sign", "name") else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and self.t[i].value not in KEYWORDS

    def text(self, i: int) -> str | None:
        return self.t[i].value[1:-1] if 0 <= i < len(self.t) and self.t[i].kind == "text" else None

    def exported(self, i: int) -> bool:
        while self.value(i - 1) in ("default", "abstract", "declare", "async"):
            i -= 1
        return self.value(i - 1) == "export"

    def run(self) -> None:
        i = 0
        while i < len(self.t):
            word = self.value(i)
            if self.t[i].kind == "name" and self.value(i - 1) not in (".", "?."):
                if word == "import":
                    i = self.import_at(i)
                    continue
                if word == "export":
                    self.export_at(i)
                elif word in ("class", "interface", "function"):
                    self.declaration_at(i, word)
                elif word in ("const", "let", "var") and not (word == "let" and not self.is_name(i + 1) and self.value(i + 1) not in ("{", "[")):
                    self.variables_at(i)
            i += 1
        self.mentions()

    def import_at(self, i: int) -> int:
        k = i + 1
        if self.value(k) in ("(", "."):
            return k
        if (source := self.text(k)) is not None:
            self.imports.append(source)
            return k + 1
        names: list[int] = []
        found: list[int] = []
        if self.value(k) == "type" and (self.is_name(k + 1) and self.value(k + 1) != "from" or self.value(k + 1) in ("{", "*") or self.value(k + 2) == "from"):
            self.declared.add(k)
            k += 1
        if self.is_name(k):
            found.append(k)
            names.append(k)
            k += 1
            if self.value(k) == "=":  # import x = require(...)
                return k
            if self.value(k) == ",":
                k += 1
        if self.value(k) == "*":
            k += 3  # * as name: the name counts as a reference
            self.declared.add(k - 2)
        elif self.value(k) == "{":
            end = _matching(self.t, k)
            last = -1
            for j in range(k + 1, end + 1):
                if j < end and self.t[j].kind == "name":
                    names.append(j)
                    last = j
                elif last >= 0:
                    found.append(last)
                    last = -1
            k = end + 1
        if self.value(k) == "from" and (source := self.text(k + 1)) is not None:
            self.imports.append(source)
            self.bindings += [(self.t[j].value, source) for j in found]
            self.declared.update(names, [k])
            return k + 2
        return i + 1

    def export_at(self, i: int) -> None:
        k = i + 1
        if self.value(k) == "type" and self.value(k + 1) in ("{", "*"):
            self.declared.add(k)
            k += 1
        if self.value(k) == "{":
            end = _matching(self.t, k)
            self.declared.update(range(k + 1, end))
            k = end + 1
        elif self.value(k) == "*":
            k += 1
            if self.value(k) == "as":
                self.declared.update((k, k + 1))
                k += 2
        else:
            return
        if self.value(k) == "from" and (source := self.text(k + 1)) is not None:
            self.imports.append(source)
            self.declared.add(k)

    def declaration_at(self, i: int, word: str) -> None:
        k = i + 1
        if word == "function" and self.value(k) == "*":
            k += 1
        before = self.value(i - 2) if self.value(i - 1) == "async" else self.value(i - 1)
        if not self.is_name(k) or (before in _EXPRESSION_BEFORE and before != "=>"):
            return
        if word == "interface" and self.value(k + 1) not in ("{", "extends", "<"):
            return
        self.symbols.append((word, self.t[k].value, self.exported(i)))
        self.declared.add(k)
        if word == "interface":
            self.declared.add(i)

    def variables_at(self, i: int) -> None:
        exported, k = self.exported(i), i + 1
        while k < len(self.t):
            if not self.is_name(k):
                if self.value(k) not in ("{", "["):
                    return
                k = _matching(self.t, k) + 1
                name = None
            else:
                name = k
                self.declared.add(k)
                k += 1
            while k < len(self.t) and self.value(k) not in ("=", ",", ";", "of", "in") and not (self.t[k].fresh and self.value(k - 1) not in (":", "|", "&", "<", ",")):
                k = _matching(self.t, k) + 1 if self.value(k) in ("(", "{", "[") else k + 1
            if self.value(k) == "=":
                if name is not None and self.starts_function(k + 1):
                    self.symbols.append(("function", self.t[name].value, exported))
                k = self.end_of_value(k + 1)
            if self.value(k) != ",":
                return
            k += 1

    def starts_function(self, k: int) -> bool:
        if self.value(k) == "async" and not (k + 1 < len(self.t) and self.t[k + 1].fresh):
            k += 1
        if self.value(k) == "function":
            return True
        if self.is_name(k):
            return self.value(k + 1) == "=>"
        if self.value(k) == "<":
            while k < len(self.t) and self.value(k) != "(":
                k += 1
        if self.value(k) != "(":
            return False
        k = _matching(self.t, k) + 1
        if self.value(k) == ":":
            while k < len(self.t) and self.value(k) not in ("=>", ";", "=") and not self.t[k].fresh:
                k = _matching(self.t, k) + 1 if self.value(k) in ("(", "{", "[") else k + 1
        return self.value(k) == "=>"

    def end_of_value(self, k: int) -> int:
        """Index of what ends an initialiser: a comma, a semicolon, a closing bracket or a new statement."""
        first = True
        while k < len(self.t):
            v = self.t[k]
            if v.kind == "sign" and v.value in (",", ";", ")", "]", "}"):
                return k
            if v.fresh and not first and v.kind != "sign" and not (self.t[k - 1].kind == "sign" and self.t[k - 1].value not in (")", "]", "}")):
                return k
            k = _matching(self.t, k) + 1 if v.kind == "sign" and v.value in ("(", "[", "{") else k + 1
            first = False
        return k

    def mentions(self) -> None:
        stack: list[str] = []
        for i, t in enumerate(self.t):
            if t.kind == "sign":
                if t.value == "{":
                    before = self.value(i - 1) if i else ""
                    stack.append("object" if before in _OBJECT_BEFORE and not (before == ":" and "object" not in stack[-1:]) else "class" if self._opens_class(i) else "block")
                elif t.value in ("(", "["):
                    stack.append(t.value)
                elif t.value in (")", "]", "}") and stack:
                    stack.pop()
                continue
            if t.kind != "name" or t.value in KEYWORDS:
                continue
            after = self.value(i + 1)
            if t.value in MODIFIERS and self.value(i - 1) not in (".", "?.") and i + 1 < len(self.t) and not self.t[i + 1].fresh:
                if self.t[i + 1].kind == "name" or (t.value == "async" and after == "(" and self.value(_matching(self.t, i + 1) + 1) in ("=>", ":")):
                    continue
            member = self.value(i - 1) in (".", "?.")
            where = stack[-1] if stack else ""
            if after == "(" and self.value(i - 1) not in ("function", "new") and not (self.value(i - 1) == "*" and self.value(i - 2) == "function") and i not in self.declared:
                if member or not (where in ("class", "object") and self._is_method(i)):
                    self.calls.append(t.value)
                    self.refs.append(t.value)
            if member or i in self.declared:
                continue
            if where == "object" and after == ":" and self.value(i - 1) in ("{", ","):
                continue
            self.refs.append(t.value)

    def _opens_class(self, i: int) -> bool:
        k = i - 1
        while k >= 0 and i - k < 40 and self.t[k].value not in (";", "{", "}", ")", "=>"):
            if self.t[k].value in ("class", "interface"):
                return True
            k -= 1
        return False

    def _is_method(self, i: int) -> bool:
        k = _matching(self.t, i + 1) + 1
        if self.value(k) == "{":
            return True
        return self.value(k) in (":", ";") and self.value(i - 1) not in ("=", "(", ",", "return", ".")


def parse_script(code: str) -> Parser:
    return Parser(code)


def parse_scripts(paths: pd.Series, codes: pd.Series) -> pd.DataFrame:
    """The parsed struct's fields but for symbols' ids and paths; null where there is no code."""
    rows = []
    for code in codes:
        if code is None:
            rows.append((None, None, None, None, None))
            continue
        p = Parser(code)
        rows.append((
            list(dict.fromkeys(p.imports)), [{"kind": k, "name": n, "exported": e} for k, n, e in p.symbols], list(dict.fromkeys(p.refs)), list(dict.fromkeys(p.calls)),
            [{"local": n, "source": s} for n, s in p.bindings],
        ))
    return pd.DataFrame(rows, columns=["imports", "symbols", "refs", "calls", "bindings"])
