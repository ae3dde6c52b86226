"""The log filter language: text to one Catalyst predicate.

    compile_filter("@l = 'Error' and Value > 100")  ->  Column

A hand-written parser turns the text into Columns directly. Every predicate is two-valued (never null),
so `not` is plain negation. Text after a complete expression is ignored; blank text matches all.
Beyond the base language, `<>` means `!=` and `P not in [...]` is accepted."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions import dynamic as dyn
from heliograph.functions.dynamic import Dyn, any_element, bound, compare, false_if_null, once

LEVELS = ("Verbose", "Debug", "Information", "Warning", "Error", "Fatal")
LEVEL_WORDS = {name.lower(): k for k, name in enumerate(LEVELS)} | {"info": 2, "warn": 3}

#: Accepted spellings of the built-in fields (fixed values), and the columns they stand for.
BUILTIN = {
    "@l": "level_name", "Level": "level_name",
    "@mt": "mt", "MessageTemplate": "mt", "@m": "mt", "Message": "mt",
    "@x": "x.type", "Exception": "x.type", "@x.type": "x.type", "Exception.Type": "x.type",
    "@x.message": "x.message", "Exception.Message": "x.message",
    "@x.stack": "x.stack", "Exception.StackTrace": "x.stack",
    "@x.inner.type": "x.inner.type", "Exception.Inner.Type": "x.inner.type",
    "@x.inner.message": "x.inner.message", "Exception.Inner.Message": "x.inner.message",
    "@t": "@t", "Timestamp": "@t",
    "@tr": "tr", "TraceId": "tr", "@sp": "sp", "SpanId": "sp",
    "@id": "id", "Id": "id",
    "service.name": "service", "ServiceName": "service",
}


class FilterSyntaxError(ValueError):
    """The filter text cannot be parsed."""


_LEX = re.compile(r"\s+|(?P<string>'(?:\\.|[^'\\])*')|(?P<number>-?[0-9][0-9.]*)|(?P<ident>[@_A-Za-z][@_A-Za-z0-9.]*)|(?P<op><>|!=|<=|>=|=|<|>)|(?P<mark>[()\[\],.])|.", re.S)
_WORDS = {"and", "or", "not", "in", "like", "true", "false", "null"}


def tokenize(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        value = m[0]
        if kind == "string":
            value = re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.S)
        elif kind == "ident" and value.lower() in _WORDS:
            kind, value = value.lower(), value.lower()
        elif kind in ("op", "mark"):
            kind, value = ("op", "!=" if value == "<>" else value) if kind == "op" else (value, value)
        out.append((kind, value))
    return [*out, ("end", "")]


Path = tuple  # of str (a key) and int (an index)


def path_text(path: Path) -> str:
    return ".".join(f"[{p}]" if isinstance(p, int) else p for p in path)


def _json_path(keys: list[str]) -> str:
    quoted = ('["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in keys)
    return "$" + "".join(quoted)


def _variant_path(v: Column, path: Path) -> Column:
    """A walk through a variant: keys, indexes, and numeric keys that may be indexes."""
    for p in path:
        if isinstance(p, int):
            v = F.try_variant_get(v, f"$[{p}]", "variant")
        elif p.isdigit():
            v = once(v, lambda x, p=p: F.coalesce(F.try_variant_get(x, _json_path([p]), "variant"), F.try_variant_get(x, f"$[{int(p)}]", "variant")))
        else:
            v = F.try_variant_get(v, _json_path([p]), "variant")
    return v


def _present(v: Column) -> Column:
    return once(v, lambda x: F.when(~F.is_variant_null(x), x))


class Row:
    """The columns that a filter reads. asked: those that may be made from JSON text, as far as they were read; they
    come from `made`, a struct of them, if it is given."""

    def __init__(self, made: Column | None = None):
        self.made = made
        self.asked: dict[str, None] = {}

    def __getitem__(self, name: str) -> Column:
        self.asked[name] = None
        return F.col(name) if self.made is None else self.made[name]


def resolve(path: Path, row: Row) -> Dyn:
    """A property: a built-in field, else a nested walk, else one flat dotted key."""
    name = path_text(path)
    if name == "@x.exists":
        return Dyn("bool", F.col("x.type").isNotNull().cast("string"), F.lit(None).cast("double"))
    column = BUILTIN.get(name)
    if column == "@t":
        return dyn.of_string(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00")))
    if column == "id":
        return dyn.of_number(F.col("id"))
    if column:
        return dyn.of_string(F.col(column))
    v = _present(_variant_path(row["props"], path))
    if len(path) > 1 and all(isinstance(p, str) for p in path):
        v = F.coalesce(v, _present(F.try_variant_get(row["props"], _json_path([name]), "variant")))
    return dyn.of_variant(v)


# ---------------------------------------------------------------- functions of one value


def _text_fn(f: Callable[..., Column], kind: str = "string") -> Callable:
    """A function of a value's text; a missing value is false."""

    def build(d: Dyn, *args) -> Dyn:
        out = f(d.text, *args)
        return dyn.of_string(out) if kind == "string" else dyn.of_number(out)

    return build


def _substring(text: Column, start: int, length: int | None = None) -> Column:
    if start < 0 or (length is not None and length < 0):
        return F.lit(None).cast("string")
    taken = F.substring(text, F.lit(start + 1), F.length(text) if length is None else F.lit(length))
    return F.when(F.length(text) >= start, taken)


def _last_index(text: Column, part: str) -> Column:
    at = F.length(text) - F.length(F.substring_index(text, part, -1)) - len(part)
    return F.when(F.contains(text, F.lit(part)), at).otherwise(F.lit(-1))


def _number_fn(f: Callable[..., Column], kind: str = "number") -> Callable:
    def build(d: Dyn, *args) -> Dyn:
        x = F.when(d.is_kind("number"), d.number).when(d.is_kind("string"), dyn.to_double(d.text))
        out = f(F.when(~F.isnan(x), x), *args)
        return dyn.of_number(out) if kind == "number" else dyn.of_string(out)

    return build


def _bucket(x: Column, err: float) -> Column:
    if err <= 0:
        return F.lit(None).cast("double")
    step = F.lit(float(err)) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)


def _time_fn(f: Callable[..., Column], kind: str = "number") -> Callable:
    def build(d: Dyn, *args) -> Dyn:
        out = f(dyn.ticks_of(d), *args)
        return dyn.of_number(out) if kind == "number" else dyn.of_string(out)

    return build


def _shifted(ticks: Column, hours: float) -> Column:
    return dyn.timestamp_of_ticks(ticks + F.lit(int(float(hours or 0) * 36_000_000_000)))


_PARTS: dict[str, Callable[[Column], Column]] = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": lambda t: F.weekday(t) + 1}


def _date_part(ticks: Column, part: str, hours: float = 0) -> Column:
    f = _PARTS.get(str(part).lower())
    return f(_shifted(ticks, hours)) if f else F.lit(None).cast("int")


def _iso(ticks: Column, hours: float = 0) -> Column:
    minutes = int(float(hours or 0) * 60)
    zone = f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    return F.concat(F.date_format(_shifted(ticks, hours), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0" + zone))


def _offset_in(ticks: Column, zone: str) -> Column:
    at = dyn.timestamp_of_ticks(ticks)
    return (F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)) * 10


def _span(d: Dyn) -> Dyn:
    return dyn.of_number(dyn.timespan_ticks(d.text))


def _milliseconds(d: Dyn) -> Dyn:
    ticks = F.when(d.is_kind("number"), d.number).otherwise(dyn.timespan_ticks(d.text).cast("double"))
    return dyn.of_number(ticks / 10_000)


def _type_of(d: Dyn) -> Dyn:
    return Dyn("string", F.coalesce(F.lit(d.kind) if isinstance(d.kind, str) else d.kind, F.lit("null")), F.lit(None).cast("double"))


def _element(d: Dyn, at) -> Dyn:
    return dyn.of_variant(_present(_variant_path(d.raw, (at,)))) if d.raw is not None else dyn.of_string(F.lit(None).cast("string"))


def _length(d: Dyn) -> Dyn:
    return dyn.of_number(F.when(d.is_kind("string"), F.length(d.text)))


def _to_json(d: Dyn) -> Dyn:
    out = F.to_json(d.raw) if d.raw is not None else F.concat(F.lit('"'), F.regexp_replace(d.text, r'(["\\])', r"\\$1"), F.lit('"'))
    return dyn.of_string(F.coalesce(out, F.lit("null")))


def _from_base64(text: Column) -> Column:
    return F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8")


def _regex_extract(text: Column, pattern: str, group: int = 1) -> Column:
    try:
        groups = re.compile(pattern).groups
    except re.error:
        groups = group
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)) if 0 <= group <= groups else F.lit(None).cast("string")


def xpath_text(text: Column, xpath: str) -> Column:
    # a text that is no XML would raise: only texts with one balanced root element are read
    sound = text.rlike(r"(?s)^\s*(<\?xml[^>]*\?>)?\s*<([A-Za-z_][\w.:-]*)(\s[^<>]*)?(/>|>.*</\2\s*>)\s*$") & ~text.rlike(r"&(?!(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")
    opened = F.size(F.regexp_extract_all(text, F.lit(r"<[A-Za-z_][^<>]*[^/<>]>|<[A-Za-z_]>"), F.lit(0)))
    closed = F.size(F.regexp_extract_all(text, F.lit(r"</[A-Za-z_][^<>]*>"), F.lit(0)))
    return F.when(sound & (opened == closed), F.xpath_string(text, F.lit(xpath)))


#: Functions of one value and constants: name, builder, and whether a missing value compares as null.
FUNCTIONS: dict[str, tuple[Callable, bool]] = {
    "length": (_length, True),
    "tojson": (_to_json, True),
    "tolower": (_text_fn(F.lower), False),
    "toupper": (_text_fn(F.upper), False),
    "tonumber": (_number_fn(lambda x: x), False),
    "substring": (_text_fn(_substring), False),
    "indexof": (_text_fn(lambda t, s: F.locate(s, t) - 1 if s else F.lit(0), "number"), False),
    "lastindexof": (_text_fn(_last_index, "number"), False),
    "replace": (_text_fn(lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))), False),
    "typeof": (_type_of, True),
    "elementat": (_element, True),
    "round": (_number_fn(lambda x, n=0: F.round(x, int(n))), False),
    "datetime": (lambda d: dyn.of_number(dyn.ticks_of(dyn.of_string(d.text))), False),
    "toisostring": (_time_fn(_iso, "string"), False),
    "datepart": (_time_fn(_date_part), False),
    "timeofday": (_time_fn(lambda t, h=0: (t + F.lit(int(float(h) * 36_000_000_000))) % 864_000_000_000), False),
    "timespan": (_span, False),
    "totalmilliseconds": (_milliseconds, False),
    "totimestring": (_number_fn(lambda x: dyn.timespan_text(x.cast("bigint")), "string"), False),
    "tohexstring": (_number_fn(lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x.cast("bigint")))), "string"), False),
    "bucket": (_number_fn(_bucket), False),
    "arrived": (_number_fn(lambda x: x), False),
    "fromxml": (_text_fn(xpath_text), False),
    "frombase64": (_text_fn(_from_base64), False),
    "tobase64": (_text_fn(lambda t: F.base64(F.encode(t, "UTF-8"))), False),
    "regexextract": (_text_fn(_regex_extract), False),
}
_WHOLE = {"typeof", "elementat"}  # of the whole value, not of an array's elements
_TESTS = {"startswith": "startswith", "contains": "contains", "endswith": "endswith"}
_NAMES = {*FUNCTIONS, *_TESTS, *("ci_" + t for t in _TESTS), "has", "isdefined", "fromjson", "coalesce", "concat", "keys", "values", "now", "offsetin", "regexmatch"}


class _Parser:
    def __init__(self, text: str, row: Row, at: int = 0):
        self.tokens = tokenize(text)
        self.row = row
        self.at = at

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, kind: str | None = None) -> str:
        k, v = self.peek()
        if kind and k != kind:
            raise FilterSyntaxError(f"expected {kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def accept(self, kind: str) -> bool:
        if self.peek()[0] == kind:
            self.at += 1
            return True
        return False

    # ------------------------------------------------------------ grammar

    def any_of(self) -> Column:
        out = self.all_of()
        while self.accept("or"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.negation()
        while self.accept("and"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        return ~self.negation() if self.accept("not") else self.atom()

    def atom(self) -> Column:
        if self.accept("("):
            out = self.any_of()
            self.take(")")
            return out
        kind, word = self.peek()
        if kind == "ident" and self.peek(1)[0] == "(" and word.lower() in _NAMES:
            self.at += 2
            return self.call(word.lower())
        return self.comparison()

    def path(self) -> Path:
        out: list = []
        kind, word = self.peek()
        if kind == "ident":
            self.at += 1
            out += [p for p in word.split(".") if p]
        elif kind != "[":
            raise FilterSyntaxError(f"expected a property, found {word or 'the end'}")
        return tuple(out) + self.steps()

    def steps(self) -> Path:
        out: list = []
        while True:
            if self.accept("["):
                kind, word = self.peek()
                self.at += 1
                out.append(int(word) if kind == "number" else word)
                self.take("]")
            elif self.peek()[0] == "." and self.peek(1)[0] == "ident":
                self.at += 1
                out += [p for p in self.take().split(".") if p]
            elif self.peek()[0] == "ident" and out and self.peek()[1].startswith("."):
                out += [p for p in self.take().split(".") if p]
            else:
                return tuple(out)

    def value(self):
        """A literal; None for anything else (a property on the right of a function is compared as null)."""
        kind, word = self.peek()
        if kind in ("ident", "["):
            self.path()
            return None
        self.at += 1
        if kind == "string":
            return word
        if kind == "number":
            try:
                return float(word) if "." in word else int(word)
            except ValueError:
                return word
        return {"true": True, "false": False}.get(kind)

    def items(self) -> list:
        self.take("[")
        out = []
        while self.peek()[0] not in ("]", "end"):
            kind, word = self.peek()
            value = self.value()
            out.append(word if kind == "number" and "." in word else value)  # decimals are compared as text
            self.accept(",")
        self.take("]")
        return out

    def comparison(self) -> Column:
        kind, _ = self.peek()
        if kind == "end":
            return F.lit(True)
        is_path = kind in ("ident", "[")
        left = self.path() if is_path else self.value()
        if self.peek()[0] == "not" and self.peek(1)[0] == "in":
            self.at += 2
            return ~is_in(resolve(left if is_path else ("@l",), self.row), self.items())
        if self.accept("in"):
            return is_in(resolve(left if is_path else ("@l",), self.row), self.items())
        if self.accept("like"):
            pattern = self.take("string")
            return any_element(resolve(left, self.row), lambda d: is_like(d, pattern)) if is_path else F.lit(False)
        if self.peek()[0] == "op":
            op = self.take()
            right_is_path = self.peek()[0] in ("ident", "[")
            right = self.path() if right_is_path else self.value()
            if is_path and right_is_path:
                b = resolve(right, self.row)
                return any_element(resolve(left, self.row), lambda d: dyn.compare_dyn(d, op, b))
            if is_path:
                return any_element(resolve(left, self.row), lambda d: compare(d, op, right))
            if right_is_path:
                flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
                return any_element(resolve(right, self.row), lambda d: compare(d, flipped, left))
            return F.lit(op == "!=" if (right is not None) else op == "=")
        if is_path and len(left) == 1 and str(left[0]).lower() in LEVEL_WORDS:
            return false_if_null(F.col("level") == LEVEL_WORDS[left[0].lower()])
        if is_path or left is not None and not isinstance(left, bool):
            terms = [path_text(left) if is_path else dyn.literal_text(left)]
            while self.peek()[0] == "string" or self.peek()[0] in ("ident", "number") and self.peek(1)[0] not in ("op", "in", "like", "(", "[", "."):
                terms.append(self.take())
            return free_text(terms, self.row)
        return F.lit(True)

    # ------------------------------------------------------------ calls

    def json_source(self) -> tuple[Dyn, Path] | None:
        """fromJson(P).path, if it comes next: the parsed text's variant, and the path."""
        if self.peek()[0] == "ident" and self.peek()[1].lower() == "fromjson" and self.peek(1)[0] == "(":
            self.at += 2
            d = resolve(self.path(), self.row)
            self.take(")")
            return dyn.of_variant(F.try_parse_json(d.text)), self.steps()
        return None

    def arguments(self) -> list:
        out = []
        while self.accept(","):
            out.append(self.value())
        self.take(")")
        return out

    def op_value(self) -> tuple[str, object]:
        return self.take("op"), self.value()

    def call(self, name: str) -> Column:
        if name in ("has", "isdefined"):
            source = self.json_source()
            d = _inside(*source) if source else resolve(self.path(), self.row)
            self.take(")")
            return ~d.missing()
        if name.removeprefix("ci_") in _TESTS:
            source = self.json_source()
            d = _inside(*source) if source else resolve(self.path(), self.row)
            self.take(",")
            part = self.take("string")
            self.take(")")
            return text_test(d, _TESTS[name.removeprefix("ci_")], part, name.startswith("ci_"))
        if name == "regexmatch":
            d = resolve(self.path(), self.row)
            (pattern,) = self.arguments()
            return any_element(d, lambda e: false_if_null(e.text.rlike(str(pattern))))
        if name == "fromjson":
            self.at -= 2
            source = self.json_source()
            d = _inside(*source)
            if self.accept("like"):
                pattern = self.take("string")
                return any_element(d, lambda e: is_like(e, pattern))
            if self.accept("in"):
                return is_in(d, self.items())
            op, value = self.op_value()
            # a text that is no JSON, and a missing path, never match
            return bound(d, lambda x: ~x.missing() & any_element(x, lambda e: compare(e, op, value))) if source[1] else once(d.raw, lambda v: v.isNotNull() & any_element(dyn.of_variant(v), lambda e: compare(e, op, value)))
        if name in ("coalesce", "concat"):
            args = []
            while True:
                if self.peek()[0] in ("ident", "["):
                    args.append(resolve(self.path(), self.row))
                else:
                    args.append(self.value())
                if not self.accept(","):
                    break
            self.take(")")
            if len(args) < 2:
                raise FilterSyntaxError(f"{name} takes two arguments or more")
            op, value = self.op_value()
            return (_coalesce if name == "coalesce" else _concat)(args, op, value)
        if name in ("keys", "values"):
            path = self.path()
            self.take(")")
            op, value = self.op_value()
            return _members(path, name, op, value, self.row)
        if name == "now":
            self.take(")")
            op, value = self.op_value()
            return compare(dyn.of_number(F.unix_micros(F.current_timestamp()) * 10 + F.lit(dyn.TICKS_AT_EPOCH)), op, value)
        if name == "offsetin":
            zone = self.take("string")
            self.take(",")
            d = resolve(self.path(), self.row)
            self.take(")")
            op, value = self.op_value()
            return any_element(d, lambda e: _compared(dyn.of_number(_offset_in(dyn.ticks_of(e), zone)), op, value, False))
        build, nullable = FUNCTIONS[name]
        d = resolve(self.path(), self.row)
        args = self.arguments()
        if self.accept("like"):
            pattern = self.take("string")
            return any_element(d, lambda e: bound(build(e, *args), lambda x: is_like(x, pattern)))
        op, value = self.op_value()
        if name in _WHOLE:
            return _compared(build(d, *args), op, value, nullable)
        return any_element(d, lambda e: _compared(build(e, *args), op, value, nullable))


def _compared(d: Dyn, op: str, value, nullable: bool) -> Column:
    return bound(d, lambda x: compare(x, op, value) if nullable else ~x.missing() & compare(x, op, value))


def _inside(d: Dyn, path: Path) -> Dyn:
    return dyn.of_variant(_present(_variant_path(d.raw, path))) if path else d


def _plain(d: Dyn) -> Column:
    return F.when(d.is_kind("number"), dyn.number_text(d.text)).otherwise(d.text)


def is_in(d: Dyn, values: list) -> Column:
    texts = [dyn.literal_text(v).upper() for v in values]
    return any_element(d, lambda e: false_if_null(F.upper(_plain(e)).isin(texts)) if texts else F.lit(False))


def is_like(d: Dyn, pattern: str) -> Column:
    return false_if_null(F.lower(_plain(d)).like(pattern.lower().replace("\\", "\\\\")))


def text_test(d: Dyn, method: str, part: str, fold: bool) -> Column:
    def test(e: Dyn) -> Column:
        text = F.upper(_plain(e)) if fold else _plain(e)
        return false_if_null(getattr(text, method)(part.upper() if fold else part))

    return any_element(d, test)


def _coalesce(args: list, op: str, value) -> Column:
    out = F.lit(False)
    for a in reversed(args):
        if isinstance(a, Dyn):
            out = F.when(~a.missing(), compare(a, op, value)).otherwise(out)
        elif a is not None:
            d = Dyn("bool", F.lit(str(a)), F.lit(None).cast("double")) if isinstance(a, bool) else dyn.of_number(F.lit(a)) if isinstance(a, int | float) else dyn.of_string(F.lit(a))
            out = compare(d, op, value)
    return out


def _concat(args: list, op: str, value) -> Column:
    ok, parts = F.lit(True), []
    for a in args:
        ok = ok & (a.is_kind("string") & ~a.missing() if isinstance(a, Dyn) else F.lit(isinstance(a, str)))
        parts.append(a.text if isinstance(a, Dyn) else F.lit(a if isinstance(a, str) else ""))
    return ok & compare(dyn.of_string(F.concat(*parts)), op, value)


def _members(path: Path, which: str, op: str, value, row: Row) -> Column:
    """keys(P) or values(P): an object's JSON list of keys (values) against the literal's JSON text."""
    if op not in ("=", "!="):
        return F.lit(False)
    d = resolve(path, row)
    keys = [str(p) for p in path]
    source = F.get_json_object(row["props_json"], "$" + "".join(f"['{k}']" for k in keys))
    items = F.to_json(F.json_object_keys(source)) if which == "keys" else F.to_json(F.map_values(F.from_json(source, "map<string,variant>")))
    items = F.regexp_replace(items, r",\s+", ",")
    empty = F.size(F.json_object_keys(source)) == 0
    if value is None:
        same = empty
    else:
        same = items == F.lit(json.dumps(value, separators=(",", ":")))
    out = false_if_null(same) if op == "=" else ~false_if_null(same) & ~false_if_null(empty)
    return d.is_kind("object") & out


def free_text(terms: list[str], row: Row) -> Column:
    """Every term is part of the template, the exception's type or message, or a text property."""
    out = F.lit(True)
    for t in terms:
        up = t.upper()
        here = [false_if_null(F.upper(F.col(c)).contains(up)) for c in ("mt", "x.type", "x.message")]
        leaf = false_if_null(F.exists(row["search_text"], lambda s: F.upper(s).contains(up)))
        out = out & (here[0] | here[1] | here[2] | leaf)
    return out


def compile_filter(text: str | None) -> Column:
    """The predicate of a filter text over the logs schema (heliograph.sources.schema). Terms joined by `and` that read
    none of the columns made from JSON text stay plain, before the others; these share one making of what they read."""
    if text is None or not text.strip():
        return F.lit(True)
    parser = _Parser(text, Row())
    starts = [0]
    parser.negation()
    while parser.accept("and"):
        starts.append(parser.at)
        parser.negation()
    whole = parser.peek()[0] == "or"
    read = lambda at, row: _Parser(text, row, at).any_of() if whole else _Parser(text, row, at).negation()
    plain, others, asked = [], [], {}
    for at in [0] if whole else starts:
        row = Row()
        term = read(at, row)
        asked |= row.asked
        if row.asked:
            others.append(at)
        else:
            plain.append(term)
    if others:
        plain.append(once(F.struct(*asked), lambda made: reduce(and_, (read(at, Row(made)) for at in others))))
    return reduce(and_, plain)
