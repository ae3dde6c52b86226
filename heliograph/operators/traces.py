"""Operators over spans: traces, statistics, the service graph, flame graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.traceql import compile_traceql

MS = 1_000_000
#: Upper edges in milliseconds of the duration buckets; a last bucket holds the rest (fixed values).
EDGES_MS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10_000, 30_000, 60_000, 120_000, 300_000, 600_000, 1_800_000)


def within(spans: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    if start_ns is not None:
        spans = spans.filter(F.col("start_ns") >= start_ns)
    return spans.filter(F.col("start_ns") <= end_ns) if end_ns is not None else spans


def is_root() -> Column:
    return F.coalesce(F.col("parent_span_id"), F.lit("")).isin("", "0" * 16)


def deduplicate(spans: DataFrame) -> DataFrame:
    """One row for each span of a trace: of several the earliest, shortest and first by name and service; spans
    without an id all stay. One aggregate; a span without an id is a group of its own."""
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id")]
    order = F.struct(*(c for c in ("start_ns", "duration_ns", "name", "service", "status", "http_status", "parent_span_id") if c in rest))
    own = F.when(F.coalesce(F.col("span_id"), F.lit("")) == "", F.monotonically_increasing_id())
    kept = spans.withColumn("_own", own).groupBy("trace_id", "span_id", "_own").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return kept.select("trace_id", "span_id", "_r.*").select(*spans.columns)


def summaries(spans: DataFrame) -> DataFrame:
    """One row per trace: its root's name, duration, status code and start (the earliest span's where there is
    no root: then the name is empty and the duration 0), services, spans and whether any failed. Of several
    roots the earliest counts (ties by span id)."""
    order = F.struct("start_ns", "span_id")
    root = F.when(is_root(), order)
    first = lambda c: F.min_by(c, order)
    of_root = lambda c: F.min_by(c, root)
    return spans.groupBy("trace_id").agg(
        F.coalesce(of_root(F.when(is_root(), F.col("name"))), F.lit("")).alias("name"),
        F.coalesce(of_root(F.when(is_root(), F.col("service"))), first("service")).alias("service"),
        F.coalesce(F.min(F.when(is_root(), F.col("start_ns"))), F.min("start_ns")).alias("start_ns"),
        F.coalesce(of_root(F.when(is_root(), F.col("duration_ns"))), F.lit(0).cast("bigint")).alias("duration_ns"),
        of_root(F.when(is_root() & (F.col("http_status") > 0), F.col("http_status"))).alias("http_status"),
        F.sort_array(F.collect_set("service")).alias("services"),
        F.count("*").alias("span_count"),
        F.bool_or(F.col("status") == 2).alias("has_error"),
    )


def http_class(text: str) -> Column:
    """`2xx` to `5xx`, or one status; traces without a status never match."""
    if text[1:].lower() == "xx":
        return F.coalesce(F.col("http_status").between(int(text[0]) * 100, int(text[0]) * 100 + 99), F.lit(False))
    return F.coalesce(F.col("http_status") == int(text), F.lit(False))


def trace_list(spans: DataFrame, status: str | None = None, service: str | None = None, name: str | None = None, min_ms: float | None = None, max_ms: float | None = None, http: str | None = None, limit: int = 200) -> DataFrame:
    rows = summaries(spans)
    if status:
        rows = rows.filter(F.col("has_error") if status.lower() == "error" else ~F.col("has_error"))
    if service:
        rows = rows.filter(F.exists("services", lambda s: F.upper(s) == service.upper()))
    if name:
        rows = rows.filter(F.upper("name").contains(name.upper()))
    if min_ms is not None:
        rows = rows.filter(F.col("duration_ns") >= int(min_ms * MS))
    if max_ms is not None:
        rows = rows.filter(F.col("duration_ns") <= int(max_ms * MS))
    if http:
        rows = rows.filter(http_class(http))
    return rows.orderBy(F.col("start_ns").desc(), "trace_id").limit(max(1, min(1000, limit)))


def traceql(spans: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Traces with matching spans, from those spans only, newest first."""
    return summaries(spans.filter(compile_traceql(query))).orderBy(F.col("start_ns").desc(), "trace_id").limit(limit)


def search_spans(spans: DataFrame, query: str = "{}", limit: int = 100) -> DataFrame:
    return spans.filter(compile_traceql(query)).orderBy(F.col("start_ns").desc(), "span_id", "trace_id", "duration_ns").limit(limit)


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return deduplicate(spans.filter(F.col("trace_id") == trace_id.lower())).orderBy("start_ns", "span_id")


def compare_traces(spans: DataFrame, a: str, b: str) -> DataFrame:
    return get_trace(spans, a).withColumn("side", F.lit("a")).unionByName(get_trace(spans, b).withColumn("side", F.lit("b")))


def exemplar_spans(exemplars: DataFrame, spans: DataFrame) -> DataFrame:
    """Exemplars (of metrics.exemplars) with the name, service and duration of the span that each points to; nulls
    where there is no such span. Exemplars are few: spans are filtered by them before they are de-duplicated."""
    wanted = exemplars.select("trace_id", "span_id").distinct()
    met = deduplicate(spans.join(wanted, ["trace_id", "span_id"], "left_semi")).select("trace_id", "span_id", "name", "service", "duration_ns", "status")
    return exemplars.join(met, ["trace_id", "span_id"], "left")


# ------------------------------------------------------------------ durations


def bucket_of(duration_ns: Column) -> Column:
    """The number of the duration's bucket; edges belong to the bucket above."""
    out = F.lit(len(EDGES_MS))
    for k in range(len(EDGES_MS) - 1, -1, -1):
        out = F.when(duration_ns < EDGES_MS[k] * MS, k).otherwise(out)
    return out


def by_bucket(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans, errors and extremes of the duration by the keys and the bucket. Keys and numbers only, so that each task
    counts in a small hash table; a text among what is aggregated would make it sort its rows."""
    return spans.groupBy(*keys, bucket_of(F.col("duration_ns")).alias("bucket")).agg(
        F.count("*").alias("spans"), F.count_if(F.col("status") == 2).alias("errors"), F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns"),
    )


def histogram() -> Column:
    """The counts of all buckets, over rows of by_bucket."""
    return F.array(*(F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("spans"))), F.lit(0).cast("bigint")) for k in range(len(EDGES_MS) + 1)))


def percentile(counts: Column, p: float) -> Column:
    """Milliseconds at the p-quantile of bucket counts: linear within the bucket that holds the ceil(p n)-th
    value; the last bucket ends at twice its lower edge. 0 where nothing was counted."""
    lows = F.array(*(F.lit(float(x)) for x in (0, *EDGES_MS)))
    highs = F.array(*(F.lit(float(x)) for x in (*EDGES_MS, EDGES_MS[-1] * 2)))
    n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    target = F.ceil(n * F.lit(p))
    rows = F.zip_with(F.zip_with(lows, highs, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), counts, lambda e, c: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), c.alias("c")))
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("double").alias("at"))
    found = F.aggregate(
        rows, start,
        lambda a, r: F.struct(
            (a["before"] + r["c"]).alias("before"),
            F.coalesce(a["at"], F.when((r["c"] > 0) & (a["before"] + r["c"] >= target), r["lo"] + (r["hi"] - r["lo"]) * (target - a["before"]) / r["c"])).alias("at"),
        ),
        lambda a: a["at"],
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(found)


def latency(spans: DataFrame) -> DataFrame:
    """By service (case-insensitive): spans, errors, extremes and percentiles in milliseconds."""
    return (
        by_bucket(spans, "service").groupBy(F.upper("service").alias("_k"))
        .agg(F.min("service").alias("service"), F.sum("spans").alias("spans"), F.sum("errors").alias("errors"), F.min("min_ns").alias("min_ns"), F.max("max_ns").alias("max_ns"), histogram().alias("counts"))
        .select("service", "spans", "errors", (F.col("min_ns") / MS).alias("min_ms"), (F.col("max_ns") / MS).alias("max_ms"), *(percentile(F.col("counts"), p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)), "counts")
    )


def volume(spans: DataFrame, start_ns: int, end_ns: int, columns: int = 20) -> DataFrame:
    """Traces and failed traces by time, each trace once, at its start; `columns` equal buckets, all present."""
    place = F.expr(f"(cast(start_ns AS decimal(38,0)) - {start_ns}) * {columns} div {max(1, end_ns - start_ns)}")  # exact, where a long would overflow
    bucket = F.greatest(F.lit(0), F.least(F.lit(columns - 1), place.cast("int")))
    counts = summaries(within(spans, start_ns, end_ns)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("traces"), F.count_if("has_error").alias("errors"))
    axis = spans.sparkSession.range(columns).select(F.col("id").cast("int").alias("bucket"))
    return axis.join(counts, "bucket", "left").select("bucket", F.coalesce("traces", F.lit(0)).alias("traces"), F.coalesce("errors", F.lit(0)).alias("errors"))


def trace_stats(spans: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """One row: traces, error rate in per cent, percentiles of all spans, traces a second."""
    inside = within(spans, start_ns, end_ns)
    traces = summaries(inside).agg(F.count("*").alias("traces"), F.count_if("has_error").alias("failed"))
    durations = by_bucket(inside).agg(histogram().alias("counts"))
    seconds = max(1.0, (end_ns - start_ns) / 1e9)
    both = traces.withColumn("_one", F.lit(1)).join(durations.withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.select("traces", F.when(F.col("traces") > 0, F.col("failed") * 100.0 / F.col("traces")).otherwise(0.0).alias("error_rate"), *(percentile(F.col("counts"), p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)), (F.col("traces") / F.lit(seconds)).alias("per_second"))


# ------------------------------------------------------------------ structure


def calls(spans: DataFrame) -> DataFrame:
    """Child spans whose parent, in the same trace, is of another service."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("from_service"))
    child = spans.filter(~is_root()).select("trace_id", "parent_span_id", F.col("service").alias("to_service"), "status", "duration_ns")
    return child.join(parent, ["trace_id", "parent_span_id"]).filter("from_service <> to_service")


def graph_edges(spans: DataFrame) -> DataFrame:
    """Calls from one service to another, with their errors and p95."""
    edges = by_bucket(calls(spans), "from_service", "to_service").groupBy("from_service", "to_service").agg(F.sum("spans").alias("calls"), F.sum("errors").alias("errors"), histogram().alias("counts"))
    return edges.select("from_service", "to_service", "calls", "errors", (F.col("errors") / F.col("calls")).alias("error_rate"), percentile(F.col("counts"), 0.95).alias("p95_ms"))


def graph_nodes(spans: DataFrame) -> DataFrame:
    """The services at either end of an edge, with their spans, error rate and p95 (0 where none)."""
    edges = calls(spans).select("from_service", "to_service").distinct()  # of calls only their ends are read
    names = edges.select(F.explode(F.array("from_service", "to_service")).alias("service")).distinct()
    own = latency(spans).select(F.upper("service").alias("_k"), "spans", "errors", "p95_ms")
    return names.join(own, F.upper("service") == F.col("_k"), "left").select("service", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce(F.col("errors") / F.col("spans"), F.lit(0.0)).alias("error_rate"), F.coalesce("p95_ms", F.lit(0.0)).alias("p95_ms"))


def self_time(spans: DataFrame) -> DataFrame:
    """Each span's duration, that of its children, and what is its own (not below 0), in milliseconds. spans:
    de-duplicated. Each span goes once to its own place and once to its parent's, so that one aggregate does."""
    none = F.lit(None)
    own = F.struct(F.col("span_id").alias("at"), F.when(F.coalesce(F.col("span_id"), F.lit("")) == "", F.monotonically_increasing_id()).alias("row"), F.struct("name", "service", "duration_ns").alias("own"), none.cast("bigint").alias("inner"))
    up = F.struct(F.col("parent_span_id").alias("at"), none.cast("bigint").alias("row"), none.cast(spans.select(F.struct("name", "service", "duration_ns").alias("own")).schema["own"].dataType).alias("own"), F.col("duration_ns").alias("inner"))
    each = spans.select("trace_id", F.explode(F.when(is_root(), F.array(own)).otherwise(F.array(own, up))).alias("x")).select("trace_id", "x.*")
    met = each.groupBy("trace_id", "at", "row").agg(F.max("own").alias("own"), F.sum("inner").alias("inner")).filter("own is not null")
    total = F.col("own.duration_ns")
    return met.select("trace_id", F.col("at").alias("span_id"), "own.name", "own.service", F.bround(total / MS, 3).alias("total_ms"), F.bround(F.greatest(F.lit(0), total - F.coalesce("inner", F.lit(0))) / MS, 3).alias("self_ms"))


def flamegraph(spans: DataFrame, trace_id: str, deepest: int = 64) -> DataFrame:
    """One trace's spans by depth; a span whose parent is not there is a root. root names each span's root."""
    one = get_trace(spans, trace_id)
    # the frame is passed by name, so that no view stays and two calls cannot meet
    tree = one.sparkSession.sql(
        f"""
        WITH RECURSIVE tree(span_id, root, depth) MAX RECURSION LEVEL {deepest} AS (
          SELECT s.span_id, s.span_id, 0 FROM {{one}} s LEFT ANTI JOIN {{one}} p ON s.parent_span_id = p.span_id
          UNION ALL
          SELECT c.span_id, t.root, t.depth + 1 FROM tree t JOIN {{one}} c ON c.parent_span_id = t.span_id)
        SELECT * FROM tree""",
        one=one.select("span_id", "parent_span_id"),
    )
    return tree.join(self_time(one), "span_id").orderBy("root", "depth", "span_id")
