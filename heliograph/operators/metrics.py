"""Operators over metrics in long form (one row per point).

A series is a name with its labels. Counters and histograms only grow until they reset; their
differences count a reset as growth from zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.sources.schema import series_key

NS = 1_000_000_000
REDUCTIONS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def parse_step(text: str | int | None) -> int | None:
    """Nanoseconds of `15`, `15s`, `5m`, `1h`, `1d` or `00:00:15`; None for none or zero."""
    if text is None or str(text).strip() == "":
        return None
    t = str(text).strip()
    if ":" in t:
        h, m, s = (float(x) for x in t.split(":"))
        seconds = h * 3600 + m * 60 + s
    else:
        unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}.get(t[-1])
        seconds = float(t[:-1]) * unit if unit else float(t)
    return int(seconds * NS) or None


def matching(labels: Mapping[str, str]) -> Column:
    """Labels equal to the given ones; `a|b` means either; a missing label fails."""
    out = F.lit(True)
    for k, v in labels.items():
        out = out & F.coalesce(F.element_at("labels", F.lit(k)).isin(v.split("|")), F.lit(False))
    return out


def series(points: DataFrame, name: str, labels: Mapping[str, str] | None = None, start_ns: int | None = None, end_ns: int | None = None, step: int | None = None) -> DataFrame:
    """The points of a metric (name case-insensitive) in a window, of repeated times the last, in steps if asked."""
    rows = points.filter((F.upper("name") == name.upper()) & matching(labels or {}))
    if start_ns is not None:
        rows = rows.filter(F.col("ts_ns") >= start_ns)
    if end_ns is not None:
        rows = rows.filter(F.col("ts_ns") <= end_ns)
    rows = deduplicate(rows.withColumn("key", series_key(F.col("labels"))))
    return downsample(rows, step) if step else rows


def deduplicate(rows: DataFrame) -> DataFrame:
    """One point for each series and time: the last to arrive, by the column `seq` where there is one (ties, and
    tables without it: the one of the largest value, count and sum, which a running count's last one is)."""
    rest = [c for c in rows.columns if c not in ("name", "key", "ts_ns", "labels", "seq")]
    first = [F.coalesce(F.col("seq"), F.lit(-1)).alias("seq")] if "seq" in rows.columns else []
    order = F.struct(*first, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("value", "count", "sum")))
    out = rows.groupBy("name", "key", "ts_ns").agg(F.max_by(F.struct("labels", *rest), order).alias("_r"))
    return out.select("name", "key", "ts_ns", "_r.*")


def downsample(rows: DataFrame, step: int) -> DataFrame:
    """One point for each series and step, at the step's start: a counter's or histogram's last point; of a
    gauge the mean value, the summed count and the summed sum."""
    bucket = F.expr(f"ts_ns - pmod(ts_ns, {step})")
    last = lambda c: F.max_by(c, "ts_ns")
    gauge = last("kind") == "Gauge"
    out = rows.groupBy("name", "key", bucket.alias("bucket")).agg(
        last("labels").alias("labels"), last("kind").alias("kind"), last("unit").alias("unit"),
        F.when(gauge, F.avg("value")).otherwise(last("value")).alias("value"), F.when(gauge, F.sum("count")).otherwise(last("count")).alias("count"),
        F.when(gauge, F.sum("sum")).otherwise(last("sum")).alias("sum"), last("bounds").alias("bounds"), last("buckets").alias("buckets"), last("exemplars").alias("exemplars"),
    )
    return out.withColumnRenamed("bucket", "ts_ns")


def latest(points: DataFrame, name: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    rows = series(points, name, labels)
    return rows.groupBy("key").agg(F.max("ts_ns").alias("ts_ns"), F.max_by("value", "ts_ns").alias("value"), F.max_by("count", "ts_ns").alias("count"))


def grouped(rows: DataFrame, by: Sequence[str] | None) -> DataFrame:
    """Adds group: the series itself, or the listed labels that it has, as text."""
    if not by:
        return rows.withColumn("group", F.col("key"))
    wanted = F.array(*(F.lit(k) for k in by))
    return rows.withColumn("group", series_key(F.map_filter("labels", lambda k, v: F.array_contains(wanted, k))))


def _steps() -> Window:
    return Window.partitionBy("key").orderBy("ts_ns")


def growth(rows: DataFrame, per_second: bool, by: Sequence[str] | None = None) -> DataFrame:
    """group, ts_ns, value: increases between neighbouring points (rates if per_second), summed by group. A
    series' first point has none; histograms grow by their count."""
    v = F.coalesce(F.when(F.col("kind") == "Histogram", F.col("count").cast("double")), F.col("value"))
    rows = grouped(rows.withColumn("v", v), by).withColumns({"pv": F.lag("v").over(_steps()), "pt": F.lag("ts_ns").over(_steps())}).filter("pt is not null")
    delta = F.when(F.col("v") >= F.col("pv"), F.col("v") - F.col("pv")).otherwise(F.col("v"))
    seconds = (F.col("ts_ns") - F.col("pt")) / NS
    value = F.when(seconds > 0, delta / seconds).otherwise(0.0) if per_second else delta
    return rows.withColumn("d", value).groupBy("group", "ts_ns").agg(F.sum("d").alias("value"))


def rate(rows: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    return growth(rows, True, by)


def increase(rows: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    return growth(rows, False, by)


def reduce_series(rows: DataFrame, how: str, by: Sequence[str] | None = None) -> DataFrame:
    """avg, min, max or sum across a group's series at each time; last: one point, the sum of the series' last
    values at their last time."""
    rows = grouped(rows, by)
    if how == "last":
        own = rows.groupBy("group", "key").agg(F.max_by("value", "ts_ns").alias("v"), F.max("ts_ns").alias("t"))
        return own.groupBy("group").agg(F.max("t").alias("ts_ns"), F.sum("v").alias("value"))
    return rows.groupBy("group", "ts_ns").agg(REDUCTIONS[how]("value").alias("value"))


def bucket_deltas(rows: DataFrame) -> DataFrame:
    """Adds deltas: growth of each bucket since the point before. A smaller total is a reset; negative growth
    is 0; a series' first point, and points after one without buckets, have none."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    rows = rows.withColumn("pb", F.lag("buckets").over(_steps())).filter("pb is not null and buckets is not null")
    rows = rows.withColumns({"now": total(F.col("buckets")), "was": total(F.col("pb"))})
    grown = F.zip_with("buckets", "pb", lambda c, p: F.greatest(F.lit(0).cast("bigint"), c - F.coalesce(p, F.lit(0))))
    return rows.withColumn("deltas", F.when(F.col("now") < F.col("was"), F.col("buckets")).otherwise(grown)).drop("pb", "now", "was")


def _summed(rows: DataFrame) -> DataFrame:
    """Buckets summed by group and time. Only series with as many buckets as the group's first (by key) count."""
    # sums by shape first, so that the shape of the group's first series is chosen among a few rows a time
    each = rows.select("group", "ts_ns", "key", "bounds", F.size("buckets").alias("size"), F.posexplode("deltas").alias("b", "d"))
    sums = each.groupBy("group", "ts_ns", "size", "b").agg(F.min(F.struct("key", "bounds")).alias("f"), F.sum("d").alias("d"))
    shape = sums.groupBy("group", "ts_ns", "size").agg(F.min("f").alias("f"), F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]).alias("deltas"))
    first = F.min(F.struct("f", "size")).over(Window.partitionBy("group"))
    shape = shape.withColumn("_first", first).filter(F.col("size") == F.col("_first.size"))
    return shape.select("group", "ts_ns", F.col("_first.f.bounds").alias("bounds"), "deltas")


def histogram_quantile(q: float, bounds: str = "bounds", counts: str = "deltas") -> Column:
    """Linear within the bucket that the q-share of the counts falls in; the first starts at 0, what lies in the
    last reads as the largest bound; 0 where nothing was counted."""
    q = min(1.0, max(0.0, q))
    n = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    rank = n * F.lit(q)
    cum = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda k: F.aggregate(F.slice(counts, F.lit(1), k), F.lit(0).cast("double"), lambda a, x: a + x))
    rows = F.zip_with(F.zip_with(cum, F.col(counts), lambda c, d: F.struct(c.alias("c"), d.alias("d"))), F.sequence(F.lit(0), F.size(counts) - 1), lambda x, k: F.struct(x["c"].alias("c"), x["d"].alias("d"), k.alias("k")))
    hit = F.get(F.filter(rows, lambda x: (x["c"] >= rank) & (x["d"] > 0)), F.lit(0))
    low = F.when(hit["k"] == 0, F.lit(0.0)).otherwise(F.get(bounds, hit["k"] - 1))
    high = F.get(bounds, hit["k"])
    inside = low + (high - low) * (rank - (hit["c"] - hit["d"])) / hit["d"]
    return F.when(n <= 0, F.lit(0.0)).when(hit["k"] >= F.size(bounds), F.element_at(bounds, -1)).otherwise(inside)


def quantile(rows: DataFrame, q: float = 0.95, by: Sequence[str] | None = None) -> DataFrame:
    summed = _summed(bucket_deltas(grouped(rows.filter("bounds is not null"), by)))
    return summed.select("group", "ts_ns", histogram_quantile(q).alias("value"))


def heatmap(rows: DataFrame) -> DataFrame:
    """ts_ms, bounds, counts: growth of each bucket at each time over all series."""
    one = bucket_deltas(rows.filter("bounds is not null").withColumn("group", F.lit("")))
    return _summed(one).select((F.col("ts_ns") / 1_000_000).cast("bigint").alias("ts_ms"), "bounds", F.col("deltas").alias("counts"))


def top_k(result: DataFrame, k: int) -> DataFrame:
    """The k groups of the largest last value (ties by group)."""
    best = result.groupBy("group").agg(F.max_by("value", "ts_ns").alias("_last")).orderBy(F.col("_last").desc(), "group").limit(k)
    return result.join(F.broadcast(best.select("group")), "group", "left_semi")


def query(points: DataFrame, name: str, agg: str = "none", labels=None, start_ns=None, end_ns=None, step=None, by=None, q: float = 0.95, topk: int | None = None) -> DataFrame:
    rows = series(points, name, labels, start_ns, end_ns, parse_step(step))
    agg = agg.lower()
    if agg in ("rate", "increase"):
        out = growth(rows, agg == "rate", by)
    elif agg == "quantile":
        out = quantile(rows, q, by)
    elif agg == "none":
        out = rows.select(F.col("key").alias("group"), "ts_ns", "value")
    else:
        out = reduce_series(rows, agg, by)
    return top_k(out, topk) if topk else out


def expression(left: DataFrame, op: str, right: DataFrame, scale: float = 1.0) -> DataFrame:
    """left op right (div, mul, add, sub) where both have a time; each side's groups are summed first."""
    a = left.groupBy("ts_ns").agg(F.sum("value").alias("a"))
    b = right.groupBy("ts_ns").agg(F.sum("value").alias("b"))
    x, y = F.col("a"), F.col("b")
    value = {"div": F.when(y != 0, x / y).otherwise(0.0), "mul": x * y, "add": x + y, "sub": x - y}[op]
    return a.join(b, "ts_ns").select("ts_ns", (value * F.lit(scale)).alias("value"))


def catalog(points: DataFrame, prefix: str = "", part: str = "") -> DataFrame:
    rows = points.filter(F.upper("name").startswith(prefix.upper()) & F.upper("name").contains(part.upper()))
    out = rows.groupBy("name").agg(F.max_by("kind", "ts_ns").alias("kind"), F.max_by("unit", "ts_ns").alias("unit"), F.count_distinct(series_key(F.col("labels"))).alias("series"), F.max("ts_ns").alias("last_ns"))
    return out.orderBy("name")


def label_keys(points: DataFrame, name: str) -> DataFrame:
    return points.filter(F.upper("name") == name.upper()).select(F.explode(F.map_keys("labels")).alias("key")).distinct().orderBy("key")


def label_values(points: DataFrame, name: str, key: str) -> DataFrame:
    return points.filter(F.upper("name") == name.upper()).select(F.element_at("labels", F.lit(key)).alias("value")).filter("value is not null").distinct().orderBy("value")


def exemplars(points: DataFrame, name: str, labels=None, start_ns: int = 0, end_ns: int = 2**62, limit: int = 200) -> DataFrame:
    rows = points.filter((F.upper("name") == name.upper()) & matching(labels or {})).select("labels", F.explode("exemplars").alias("e")).select("labels", "e.*")
    return rows.filter(F.col("ts_ns").between(start_ns, end_ns)).orderBy(F.col("ts_ns").desc()).limit(max(1, min(1000, limit)))


def rollup(points: DataFrame, now_ns: int, tiers: Sequence[tuple[int, int]] = ((3600 * NS, 300 * NS), (86400 * NS, 3600 * NS))) -> DataFrame:
    """Points older than a tier's age in the tier's steps (five minutes past an hour, one hour past a day)."""
    rows = deduplicate(points.withColumn("key", series_key(F.col("labels"))))
    step = F.lit(1)
    for age, width in tiers:
        step = F.when(F.lit(now_ns) - F.col("ts_ns") > age, width).otherwise(step)
    out = rows.withColumn("_step", step)
    fresh = out.filter("_step = 1").drop("_step")
    for _, width in tiers:
        fresh = fresh.unionByName(downsample(out.filter(F.col("_step") == width).drop("_step"), width).select(fresh.columns))
    return fresh
