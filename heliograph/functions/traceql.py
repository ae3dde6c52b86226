"""The span-set language: `{ .attr = "x" && duration > 10ms }` to a predicate over spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.dynamic import OPS, false_if_null, of_variant, to_double

KINDS = {"internal": 0, "server": 1, "client": 2, "producer": 3, "consumer": 4}
STATUS = {"unset": 0, "ok": 1, "error": 2, "err": 2}
_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_HTTP = {"http.status_code", "http.response.status_code"}
_LEX = re.compile(r"""\s+|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)|(?P<duration>[0-9]+(?:\.[0-9]+)?(?:ns|us|ms|s|m|h)\b)|(?P<number>-?[0-9]+(?:\.[0-9]+)?)|(?P<attr>\.[A-Za-z_][A-Za-z0-9_.:/-]*)|(?P<ident>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>=~|!=|<=|>=|=|<|>)|(?P<mark>&&|\|\||!|[{}()])|.""", re.S)


class TraceQLError(ValueError):
    """The query cannot be parsed."""


class _Parser:
    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m[0]) for m in _LEX.finditer(text) if m.lastgroup] + [("end", "")]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] == "mark" else self.tokens[self.at][0]

    def take(self, what: str) -> str:
        if self.peek() != what:
            raise TraceQLError(f"expected {what}, found {self.tokens[self.at][1] or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self) -> Column:
        self.take("{")
        out = F.lit(True) if self.peek() == "}" else self.any_of()
        self.take("}")
        return out

    def any_of(self) -> Column:
        out = self.all_of()
        while self.peek() == "||":
            self.at += 1
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while self.peek() == "&&":
            self.at += 1
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.peek() == "!":
            self.at += 1
            return ~self.one()
        if self.peek() == "(":
            self.at += 1
            out = self.any_of()
            self.take(")")
            return out
        kind, word = self.tokens[self.at]
        if kind not in ("attr", "ident"):
            raise TraceQLError(f"expected a field, found {word or 'the end'}")
        self.at += 1
        op = self.take("op").replace("=~", "=")
        value_kind, text = self.tokens[self.at]
        if value_kind not in ("string", "duration", "number", "ident"):
            raise TraceQLError(f"expected a value, found {text or 'the end'}")
        self.at += 1
        return false_if_null(_predicate(word, kind, op, value_kind, text))


def _predicate(word: str, kind: str, op: str, value_kind: str, text: str) -> Column:
    value = re.sub(r"\\(.)", r"\1", text[1:-1]) if value_kind == "string" else text
    f = OPS[op]
    if kind == "attr":
        return _attribute(word[1:], op, value_kind, value)
    same_only = op in ("=", "!=")
    if word == "duration":
        if value_kind == "duration":
            n, unit = re.match(r"([0-9.]+)(\w+)", value).groups()
            return f(F.col("duration_ns"), F.lit(int(float(n) * _UNITS[unit])))
        if value_kind != "number":
            raise TraceQLError("duration takes a duration or a number of nanoseconds")
        return f(F.col("duration_ns"), F.lit(float(value)))
    if word == "status":
        return f(F.col("status"), F.lit(STATUS.get(value.lower(), 0))) if same_only else F.lit(False)
    if word == "kind":
        return f(F.col("kind"), F.lit(KINDS.get(value.lower(), 0))) if same_only else F.lit(False)
    if word in ("service", "name"):
        return f(F.upper(word), F.lit(value.upper())) if same_only else F.lit(False)
    return _attribute(word, op, value_kind, value)


def _attribute(key: str, op: str, value_kind: str, value: str) -> Column:
    f = OPS[op]
    if key in _HTTP and value_kind == "number":
        return f(F.col("http_status"), F.lit(float(value)))  # no status counts as 0
    d = of_variant(F.try_variant_get("attrs", '$["' + key.replace('"', '\\"') + '"]', "variant"))
    if value_kind == "number":
        return f(F.coalesce(d.number, to_double(d.text)), F.lit(float(value)))
    return f(F.upper(d.text), F.lit(value.upper()))


def compile_traceql(text: str) -> Column:
    """The predicate of one span; a missing attribute matches no comparison."""
    return _Parser(text).query()
