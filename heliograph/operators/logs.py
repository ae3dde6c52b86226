"""Operators over logs: pages, catalogues, correlation, rendering, volume."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.functions.filters import LEVELS, compile_filter

#: Widths in seconds of a volume chart's columns (fixed values).
STEPS = (15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14_400, 21_600, 43_200, 86_400, 172_800, 604_800)


def _time(value: datetime | str) -> Column:
    return F.lit(value).cast("timestamp")


def window(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends inclusive."""
    if start is not None:
        df = df.filter(F.col("ts") >= _time(start))
    return df.filter(F.col("ts") <= _time(end)) if end is not None else df


def with_levels(df: DataFrame, levels: Iterable[str] | None) -> DataFrame:
    """Unknown names are ignored; none, or all six, filter nothing."""
    known = {k for x in levels or () for k, name in enumerate(LEVELS) if name.lower() == x.lower()}
    return df.filter(F.col("level").isin(sorted(known))) if known and len(known) < len(LEVELS) else df


def search(df: DataFrame, text: str | None = None, start=None, end=None, levels=None, forward: bool = False, count: int = 500, after: tuple | None = None) -> DataFrame:
    """A page of logs: filtered, by (ts, id), newest first unless forward, at most 1 to 10 000 rows, and
    strictly past the cursor `after` = (ts, id) in that direction."""
    out = with_levels(window(df, start, end), levels).filter(compile_filter(text))
    if after is not None:
        ts, at = _time(after[0]), F.lit(after[1])
        past = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("id") > at)) if forward else (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < at))
        out = out.filter(past)
    keys = ("ts", "id") if forward else (F.col("ts").desc(), F.col("id").desc())
    return out.orderBy(*keys).limit(max(1, min(10_000, count)))


def property_names(df: DataFrame, newest: int = 5000) -> DataFrame:
    """Distinct property names (case-insensitive, the least spelling kept) of the newest rows."""
    top = df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(newest)
    names = top.select(F.explode(F.json_object_keys("props_json")).alias("name"))
    return names.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name")).orderBy("_k").select("name")


def services(df: DataFrame, newest: int = 10_000) -> DataFrame:
    """Distinct services of the newest rows: service, else the property ApplicationContext; no blanks."""
    top = df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(newest)
    name = F.coalesce("service", F.try_variant_get("props", "$.ApplicationContext", "string"))
    return top.select(name.alias("service")).filter(F.trim("service") != "").distinct().orderBy("service")


def of_trace(df: DataFrame, trace_id: str, count: int = 2000) -> DataFrame:
    return _correlated(df, "tr", trace_id, 32, count)


def of_span(df: DataFrame, span_id: str, count: int = 500) -> DataFrame:
    return _correlated(df, "sp", span_id, 16, count)


def _correlated(df: DataFrame, column: str, value: str, digits: int, count: int) -> DataFrame:
    if len(value) != digits or set(value.lower()) - set("0123456789abcdef"):
        raise ValueError(f"{value!r} is not {digits} hexadecimal digits")
    return df.filter(F.col(column) == value.lower()).orderBy("ts", "id").limit(max(1, min(5000, count)))


def render(df: DataFrame, column: str = "message") -> DataFrame:
    """Adds the message: `{Name}` of the template replaced by its property. A prefix @ or $ and a suffix
    `:format` or `,width` do not count; a missing property keeps its token, a null one reads null."""
    names = F.regexp_extract_all("mt", F.lit(r"\{[@$]?([A-Za-z0-9_.]+)(?:[,:][^{}]*)?\}"), F.lit(1))
    tokens = F.regexp_extract_all("mt", F.lit(r"\{[@$]?[A-Za-z0-9_.]+(?:[,:][^{}]*)?\}"), F.lit(0))
    gaps = F.split("mt", r"\{[@$]?[A-Za-z0-9_.]+(?:[,:][^{}]*)?\}", -1)
    df = df.withColumns({"_names": names, "_tokens": tokens, "_gaps": gaps, "_vals": F.from_json("props_json", "map<string,variant>")})

    def value(name: Column, token: Column) -> Column:
        v = F.element_at("_vals", name)
        shown = F.when(F.is_variant_null(v), "null").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        return F.when(F.array_contains(F.map_keys("_vals"), name), F.coalesce(shown, F.lit("null"))).otherwise(token)

    shown = F.zip_with("_names", "_tokens", value)
    return df.withColumn("_shown", shown).withColumn(column, F.concat_ws("", F.zip_with("_gaps", "_shown", lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))))).drop("_names", "_tokens", "_gaps", "_vals", "_shown")


def stats(df: DataFrame) -> DataFrame:
    """Rows and the time they span."""
    return df.agg(F.count("*").alias("events"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def auto_width(seconds: float, columns: int = 120) -> int:
    """The least fixed step that gives at most `columns` columns; beyond the last step, whole multiples of it."""
    wanted = max(1.0, abs(seconds)) / columns
    return next((s for s in STEPS if s >= wanted), int(-(-wanted // STEPS[-1])) * STEPS[-1])


def chart_width(seconds: float, width: int | None = None, most: int = 2000) -> int:
    """The asked width, unless it is missing or gives over `most` columns."""
    return width if width and width > 0 and seconds / width + 1 <= most else auto_width(seconds)


def _dense(counts: DataFrame, width: int, key: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """counts (bucket, *key, n) with every bucket from the first to the last, 0 where none counted."""
    ends = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    buckets = ends.filter("lo is not null").select(F.explode(F.sequence(F.lit(start) if start is not None else "lo", F.lit(end) if end is not None else "hi")).alias("bucket"))
    groups = counts.select(*key).distinct()
    axis = groups.withColumn("_all", F.lit(1)).join(F.broadcast(buckets.withColumn("_all", F.lit(1))), "_all").drop("_all")
    return axis.join(counts, ["bucket", *key], "left").select((F.col("bucket") * width).alias("bucket_s"), *key, F.coalesce("n", F.lit(0)).alias("n"))


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("bucket", F.floor(F.unix_seconds("ts") / width))


def volume_by_service(df: DataFrame, width: int, top: int = 25, wanted: Iterable[str] | None = None) -> DataFrame:
    """Dense counts of the `top` services by count (ties by name). Blank services are `(unknown)`; names
    differing in case only are one, spelt as their least spelling."""
    name = F.when(F.trim(F.coalesce("service", F.lit(""))) == "", "(unknown)").otherwise(F.col("service"))
    rows = _bucketed(df.withColumn("_s", name), width)
    if wanted:
        rows = rows.filter(F.upper("_s").isin([w.upper() for w in wanted]))
    counts = rows.groupBy("bucket", F.upper("_s").alias("_u")).agg(F.count("*").alias("n"), F.min("_s").alias("_s"))
    best = counts.groupBy("_u").agg(F.sum("n").alias("total"), F.min("_s").alias("service")).orderBy(F.col("total").desc(), "service").limit(top)
    kept = counts.join(F.broadcast(best), "_u").select("bucket", "service", "n")
    return _dense(kept, width, ["service"])


def volume_by_level(df: DataFrame, width: int) -> DataFrame:
    """Dense counts of the levels that occur."""
    counts = _bucketed(df, width).groupBy("bucket", "level_name").agg(F.count("*").alias("n"))
    return _dense(counts, width, ["level_name"])


def event_ids(df: DataFrame, node: int = 0) -> DataFrame:
    """Adds event_id: milliseconds since 2024-01-01, ten bits of node, twelve of place within the
    millisecond (rows of one millisecond by id)."""
    ms = (F.unix_millis("ts") - F.lit(1_704_067_200_000)).cast("bigint")
    place = F.row_number().over(Window.partitionBy("_ms").orderBy("id")) - 1
    return df.withColumn("_ms", ms).withColumn("event_id", F.shiftleft("_ms", 22).bitwiseOR(F.lit(node << 12).cast("bigint")).bitwiseOR(place.cast("bigint"))).drop("_ms")
