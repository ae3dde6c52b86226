"""Values whose type is known only at run time, as columns.

A dynamic value is a VARIANT with its kind (string, number, bool, array, object; null where missing or
JSON null), its text and its number. Comparison follows the filter language: two-valued, by the kind of
the left side, and an array matches if any element does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_AT_EPOCH = 621_355_968_000_000_000  # 100 ns steps from 0001-01-01 to 1970-01-01
OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Dyn:
    """kind: a Column, or a str where it is known when the filter is compiled."""

    kind: Column | str
    text: Column
    number: Column
    raw: Column | None = None

    def is_kind(self, name: str) -> Column:
        return F.lit(self.kind == name) if isinstance(self.kind, str) else F.coalesce(self.kind == name, F.lit(False))

    def missing(self) -> Column:
        return self.text.isNull() if isinstance(self.kind, str) else self.kind.isNull()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once a row. A filter is pushed below the columns that it names, and each
    mention becomes the whole expression; nested mentions multiply."""
    return F.get(F.transform(F.array(value), use), 0)


def _kind(v: Column) -> Column:
    def of_schema(s: Column) -> Column:
        return (
            F.when(s.isNull() | (s == "VOID"), F.lit(None))
            .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
            .when(s == "STRING", "string").when(s == "BOOLEAN", "bool").otherwise("number")
        )

    return once(F.schema_of_variant(v), of_schema)


def of_variant(v: Column, kind: Column | None = None) -> Dyn:
    text = F.try_variant_get(v, "$", "string")
    return Dyn(_kind(v) if kind is None else kind, text, F.try_variant_get(v, "$", "double"), v)


def of_string(c: Column) -> Dyn:
    return Dyn("string", c, to_double(c))


def of_number(c: Column) -> Dyn:
    return Dyn("number", number_text(c), c.cast("double"))


def number_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def to_double(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def literal_text(value) -> str:
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return "" if value is None else str(value)


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compare(d: Dyn, op: str, value) -> Column:
    """d op value, for a literal value; never null."""
    if value is None:
        return d.missing() if op == "=" else ~d.missing() if op == "!=" else F.lit(False)
    text = literal_text(value)
    f = OPS[op]
    branches = {"string": lambda: f(F.upper(d.text), F.lit(text.upper()))}
    if op in ("=", "!="):
        truth = value if isinstance(value, bool) else text.lower() == "true"
        branches["bool"] = lambda: f(F.lower(d.text) == "true", F.lit(truth))
        branches["object"] = branches["array"] = lambda: F.lit(op == "!=")
    number = None
    if not isinstance(value, bool):
        try:
            number = float(str(value).replace(",", ""))
        except ValueError:
            number = None
    if number is not None:
        if op in ("=", "!="):
            near = F.abs(d.number - F.lit(number))
            branches["number"] = lambda: (near < 1e-15) if op == "=" else (near >= 1e-15)
        else:
            branches["number"] = lambda: f(d.number, F.lit(number))
    return _by_kind(d, branches, if_missing=op == "!=")


def compare_dyn(a: Dyn, op: str, b: Dyn) -> Column:
    """a op b for two dynamic values; never null. Arrays and objects are equal if their JSON is."""
    f = OPS[op]
    nested = (a.is_kind("object") | a.is_kind("array")) | (b.is_kind("object") | b.is_kind("array"))
    equal = F.coalesce(a.text == b.text, F.lit(False))
    structure = equal if op == "=" else ~equal if op == "!=" else F.lit(False)
    numbers = (F.abs(a.number - b.number) < 1e-15) if op == "=" else (F.abs(a.number - b.number) >= 1e-15) if op == "!=" else f(a.number, b.number)
    truth = f(F.lower(a.text) == "true", F.lower(b.text) == "true") if op in ("=", "!=") else F.lit(False)
    out = (
        F.when(a.missing() & b.missing(), F.lit(op == "=")).when(a.missing() | b.missing(), F.lit(op == "!="))
        .when(nested, structure).when(a.is_kind("bool"), truth)
        .when(a.is_kind("string"), f(F.upper(a.text), F.upper(b.text))).otherwise(numbers & ~F.isnan(a.number) & ~F.isnan(b.number))
    )
    return false_if_null(out)


def _by_kind(d: Dyn, branches: dict, if_missing: bool) -> Column:
    if isinstance(d.kind, str):
        body = branches.get(d.kind, lambda: F.lit(False))()
        return F.when(d.missing(), F.lit(if_missing)).otherwise(false_if_null(body))
    out = F.when(d.kind.isNull(), F.lit(if_missing))
    for kind, body in branches.items():
        out = out.when(d.kind == kind, false_if_null(body()))
    return out.otherwise(F.lit(False))


def any_element(d: Dyn, test: Callable[[Dyn], Column]) -> Column:
    """test of the value, or of any element where it is an array (an empty array never matches)."""
    if d.raw is None:
        return test(d)

    def by_kind(v: Column, kind: Column) -> Column:
        elements = F.try_variant_get(v, "$", "array<variant>")
        return F.when(kind == "array", false_if_null(F.exists(elements, lambda e: bound(of_variant(e), test)))).otherwise(test(of_variant(v, kind)))

    return once(d.raw, lambda v: once(_kind(v), lambda kind: by_kind(v, kind)))


def bound(d: Dyn, use: Callable[[Dyn], Column]) -> Column:
    """use(d), with what d is made of computed once a row."""
    if d.raw is not None:
        return once(d.raw, lambda v: once(_kind(v), lambda kind: use(of_variant(v, kind))))
    if d.kind == "string":
        return once(d.text, lambda text: use(of_string(text)))
    return once(F.struct(d.text.alias("text"), d.number.alias("number")), lambda x: use(Dyn(d.kind, x["text"], x["number"])))


# -------------------------------------------------------------- time


def ticks_of(d: Dyn) -> Column:
    """UTC ticks of an instant: a parseable text, or ticks already."""
    parsed = F.unix_micros(F.try_to_timestamp(d.text)) * 10 + F.lit(TICKS_AT_EPOCH)
    return F.when(d.is_kind("number"), d.number.cast("bigint")).otherwise(parsed)


def timestamp_of_ticks(ticks: Column) -> Column:
    return F.timestamp_micros(((ticks - F.lit(TICKS_AT_EPOCH)) / 10).cast("bigint"))


_SPAN = r"^\s*(-)?(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,7}))?)?\s*$"


def timespan_ticks(text: Column) -> Column:
    """Ticks of `[-][d.]hh:mm[:ss[.fffffff]]`; null for any other text."""

    def group(k: int) -> Column:
        g = F.regexp_extract(text, _SPAN, k)
        return F.when(g == "", F.lit("0")).otherwise(g)

    seconds = group(2).cast("bigint") * 86400 + group(3).cast("bigint") * 3600 + group(4).cast("bigint") * 60 + group(5).cast("bigint")
    ticks = seconds * 10_000_000 + F.rpad(group(6), 7, "0").cast("bigint")
    return F.when(text.rlike(_SPAN), F.when(F.regexp_extract(text, _SPAN, 1) == "-", -ticks).otherwise(ticks))


def timespan_text(ticks: Column) -> Column:
    t = F.abs(ticks)
    days, rest = F.floor(t / 864_000_000_000), t % 864_000_000_000
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 36_000_000_000), F.floor(rest / 600_000_000) % 60, F.floor(rest / 10_000_000) % 60)
    part = rest % 10_000_000
    return F.concat(
        F.when(ticks < 0, "-").otherwise(""), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""),
        clock, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 7, "0"))).otherwise(""),
    )
