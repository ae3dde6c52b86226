"""Values taken from HTTP answers, and their use in templates: `{{var}}`, JSON paths, XPath, regular
expressions, headers and status. Pure functions of columns `body`, `headers` (a map) and `status`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.filters import xpath_text


def substitute(template: str, variables: dict[str, str]) -> str:
    """Unknown variables stay as they are."""
    return re.sub(r"\{\{\s*([\w.-]+)\s*\}\}", lambda m: variables.get(m[1], m[0]), template)


def json_path(body: Column, path: str) -> Column:
    """A subset of JSONPath: `$.a.b[0]`, `$['a']`, and negative indexes from the end."""
    v = F.try_parse_json(body)
    for key, quoted, at in re.findall(r"\.([A-Za-z0-9_-]+)|\[['\"]([^'\"]+)['\"]\]|\[(-?\d+)\]", path):
        if at:
            v = F.try_element_at(F.try_variant_get(v, "$", "array<variant>"), F.lit(int(at) + (int(at) >= 0)))
        else:
            v = F.try_variant_get(v, '$["' + (key or quoted) + '"]', "variant")
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def extract(kind: str, expression: str) -> Column:
    """kind: json, xpath, regex, header or status. Null where nothing is found."""
    body = F.col("body")
    if kind == "json":
        return json_path(body, expression)
    if kind == "xpath":
        return xpath_text(body, expression)
    if kind == "regex":
        groups = re.compile(expression).groups
        return F.when(body.rlike(expression), F.regexp_extract(body, expression, min(1, groups)))
    if kind == "header":
        return F.get(F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == expression.lower())), F.lit(0))
    if kind == "status":
        return F.col("status").cast("string")
    raise ValueError(f"unknown extraction {kind!r}")
