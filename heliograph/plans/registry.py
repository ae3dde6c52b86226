"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Every time-relative query uses the fixed instant NOW. Sums whose order could show are rounded."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.filters import compile_filter
from heliograph.operators import alerts, logs, metrics, traces
from heliograph.sources import ingest, schema, wire

NOW = "2024-01-31 00:00:00"
DAY, HOUR = 86400, 3600
HOUR_NS = 3600 * 10**9
T0, T1 = 946_684_800 * 10**9, 1_735_689_600 * 10**9  # the years 2000 to 2024, in nanoseconds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ views in SQL

LOGS = """logs AS (SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'signup' THEN 'Information' WHEN 'click' THEN 'Debug' ELSE 'Verbose' END AS level_name,
 'User {UserId} ' || event_type AS mt, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service, user_id, value, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
 lpad(printf('%x', user_id), 32, '0') AS tr FROM events)"""
SPANS = """spans AS (
 SELECT lpad(printf('%x', o_orderkey), 32, '0') AS trace_id, lpad(printf('%x', (o_orderkey + 1) * 16), 16, '0') AS span_id, NULL AS parent_span_id,
  epoch_us(o_orderdate) * 1000 + (o_orderkey % 1000) * 1000000 AS start_ns, CAST(floor(o_totalprice * 1000) AS BIGINT) AS duration_ns, 'order ' || o_orderpriority AS name, 'api-' || substr(o_orderpriority, 1, 1) AS service,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS status, CASE o_orderstatus WHEN 'F' THEN 500 WHEN 'O' THEN 200 ELSE 0 END AS http_status, o_custkey AS custkey, NULL AS quantity, NULL AS flag FROM orders
 UNION ALL
 SELECT lpad(printf('%x', l_orderkey), 32, '0'), lpad(printf('%x', (l_orderkey + 1) * 16 + l_linenumber), 16, '0'), lpad(printf('%x', (l_orderkey + 1) * 16), 16, '0'),
  epoch_us(o_orderdate) * 1000 + (l_orderkey % 1000) * 1000000 + l_linenumber * 1000000, CAST(floor(l_extendedprice * 100) AS BIGINT), 'line ' || l_linestatus, 'store-' || lower(l_returnflag),
  CASE l_returnflag WHEN 'R' THEN 2 ELSE 0 END, 0, NULL, l_quantity, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SUMMARY = """sm AS (SELECT trace_id, coalesce(arg_min(name, (start_ns, span_id)) FILTER (WHERE parent_span_id IS NULL), '') AS name,
 coalesce(arg_min(service, (start_ns, span_id)) FILTER (WHERE parent_span_id IS NULL), arg_min(service, (start_ns, span_id))) AS service,
 coalesce(min(start_ns) FILTER (WHERE parent_span_id IS NULL), min(start_ns)) AS start_ns,
 coalesce(arg_min(duration_ns, (start_ns, span_id)) FILTER (WHERE parent_span_id IS NULL), 0) AS duration_ns,
 arg_min(http_status, (start_ns, span_id)) FILTER (WHERE parent_span_id IS NULL AND http_status > 0) AS http_status,
 list_sort(list(DISTINCT service)) AS services, count(*) AS span_count, bool_or(status = 2) AS has_error FROM {src} GROUP BY trace_id)"""
POINTS = """base AS (SELECT event_id, value AS v, epoch_us(ts) * 1000 AS ts_ns, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service, event_type AS type FROM events),
rn AS (SELECT *, (row_number() OVER (PARTITION BY service, type ORDER BY ts_ns, event_id) - 1) // 50 AS run FROM base),
cnt AS (SELECT *, count(*) OVER w AS n,
 [sum(CASE WHEN v <= 10 THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN v > 10 AND v <= 25 THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN v > 25 AND v <= 50 THEN 1 ELSE 0 END) OVER w,
  sum(CASE WHEN v > 50 AND v <= 100 THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN v > 100 AND v <= 250 THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN v > 250 THEN 1 ELSE 0 END) OVER w] AS b
 FROM rn WINDOW w AS (PARTITION BY service, type, run ORDER BY ts_ns, event_id ROWS UNBOUNDED PRECEDING)),
ded AS (SELECT service, type, ts_ns, max(n) AS n, arg_max(b, n) AS b, max(v) AS v FROM cnt GROUP BY ALL),
hourly AS (SELECT service, type, (ts_ns // 3600000000000) * 3600000000000 AS ts_ns, arg_max(n, ts_ns) AS n, arg_max(b, ts_ns) AS b, avg(v) AS v FROM ded GROUP BY ALL)"""
KEY = """'[{{"key":"service","value":"' || service || '"}},{{"key":"type","value":"' || type || '"}}]'""".replace("{{", "{").replace("}}", "}")
BY_TYPE = """'[{"key":"type","value":"' || type || '"}]'"""
EDGES = ", ".join(str(x) for x in traces.EDGES_MS)
DEDUP = "QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY start_ns, duration_ns, name, service, status, http_status, parent_span_id NULLS FIRST) = 1"


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ logs


@register("logs_filter_level_value", f"WITH {LOGS} SELECT id, level_name, service, value FROM logs WHERE level_name = 'Error' AND value > 100 ORDER BY ts DESC, id DESC LIMIT 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.search(schema.logs(spark, sf), "@l = 'Error' and Value > 100", count=100).select("id", "level_name", "service", F.try_variant_get("props", "$.Value", "double").alias("value"))


def _filter(name: str, text: str, where: str) -> None:
    QUERIES[name] = lambda spark, sf: schema.logs(spark, sf).filter(compile_filter(text)).select("id", "level_name", "mt")
    ORACLES[name] = f"WITH {LOGS} SELECT id, level_name, mt FROM logs WHERE {where}"


for _n, _t, _w in (
    ("logs_or_not", "not (Error or @l = 'Debug') and (UserId < 50 or not has(Missing))", "NOT (level_name IN ('Error', 'Debug'))"),
    ("logs_in_like_text", "Type in ['VIEW', 'click'] and @mt like '%ER {userid} v_ew'", "event_type IN ('view', 'click') AND lower(mt) LIKE '%er {userid} v_ew'"),
    ("logs_null_semantics", "Missing != 5 and not (Missing = 3) and Missing = null and k >= 10 and 50 > k", "k >= 10 AND k < 50"),
    ("logs_property_pair", "Value > UserId and not (k = UserId)", "value > user_id AND k <> user_id"),
    ("logs_string_scalars", "length(Type) = 5 and toUpper(Type) = 'CLICK' and indexOf(Type, 'c') = 0 and lastIndexOf(Type, 'c') = 3 and replace(Type, 'cl', 'br') = 'brick' and substring(Type, 1, 3) = 'lic' and concat(Type, '!') = 'click!'", "event_type = 'click'"),
    ("logs_math_scalars", "round(Value, 0) >= 50 and toHexString(UserId) != '0x7' and bucket(Value, 0.5) < 100 and toNumber(k) < 60", "round(value, 0) >= 50 AND user_id <> 7 AND (CASE WHEN value = 0 THEN 0 ELSE round_even(value / (0.5 * pow(10, floor(log10(abs(value))))), 0) * (0.5 * pow(10, floor(log10(abs(value))))) END) < 100 AND k < 60"),
    ("logs_date_scalars", "datePart(@t, 'hour', 2) = 10 and datePart(@t, 'weekday') <= 5 and timeOfDay(@t, 0) >= 288000000000 and dateTime(@t) > 638396640000000000 and offsetIn('UTC', @t) = 0", "date_part('hour', ts + INTERVAL 2 HOUR) = 10 AND isodow(ts) <= 5 AND (epoch_us(ts) % 86400000000) * 10 >= 288000000000 AND epoch_us(ts) * 10 + 621355968000000000 > 638396640000000000"),
    ("logs_timespan", "timeSpan(Missing) = 5 or totalMilliseconds(UserId) >= 0.01 or toTimeString(UserId) = '00:00:00.0000003'", "user_id >= 100 OR user_id = 3"),
    ("logs_json_path", "typeOf(k) = 'number' and coalesce(Missing, k) > 40 and toJson(k) != '41' and elementAt(Type, 0) = null and not (fromJson(Type).a = 1)", "k > 40 AND k <> 41"),
    ("logs_encoding_regex", "toBase64(Type) = 'dmlldw==' or regexMatch(Type, '^pur.*se$') or regexExtract(Type, '(sign)') = 'SIGN'", "event_type IN ('view', 'purchase', 'signup')"),
    ("logs_free_text", "'user {userid}' SIGNUP", "contains(upper(mt), 'USER {USERID}') AND contains(upper(mt), 'SIGNUP')"),
):
    _filter(_n, _t, _w)


@register("logs_string_preds", "SELECT doc_id AS id FROM documents WHERE (starts_with(text, 'Th') OR contains(upper(text), 'SCUM')) AND NOT ends_with(text, 'x.') AND starts_with(source, 'src')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return schema.doc_logs(spark, sf).filter(compile_filter("(startsWith(Text, 'Th') or ci_contains(Text, 'scum')) and not endsWith(Text, 'x.') and ci_startsWith(Source, 'SRC')")).select("id")


@register("logs_xml", f"WITH {LOGS} SELECT id FROM logs WHERE id = 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = schema.logs(spark, sf).withColumn("props", F.parse_json(F.to_json(F.struct(F.concat(F.lit("<r><a>"), "id", F.lit("</a></r>")).alias("Body")))))
    return rows.filter(compile_filter("fromXml(Body, 'r/a') = '5'")).select("id")


@register("logs_keyset_page_fwd", f"WITH {LOGS} SELECT id, level_name FROM logs WHERE (ts, id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, id LIMIT 50")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.search(schema.logs(spark, sf), forward=True, count=50, after=("2024-01-10 00:00:00", 0)).select("id", "level_name")


@register("logs_keyset_page_bwd", f"WITH {LOGS} SELECT id, level_name FROM logs WHERE (ts, id) < (TIMESTAMP '2024-01-10 00:00:00', 0) AND level_name IN ('Error', 'Warning') ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.search(schema.logs(spark, sf), levels=["error", "Warning", "none"], count=50, after=("2024-01-10 00:00:00", 0)).select("id", "level_name")


@register("logs_props_catalog", "SELECT unnest(['k', 'Type', 'UserId', 'Value']) AS name")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.property_names(schema.logs(spark, sf))


@register("logs_services", f"WITH {LOGS} SELECT DISTINCT service FROM (SELECT service FROM logs ORDER BY ts DESC, id DESC LIMIT 10000)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.services(schema.logs(spark, sf))


@register("logs_by_trace", f"WITH {LOGS} SELECT id, mt FROM logs WHERE tr = lpad('5', 32, '0') ORDER BY ts, id LIMIT 2000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.of_trace(schema.logs(spark, sf), "5".rjust(32, "0")).select("id", "mt")


@register("logs_by_span", f"WITH {LOGS} SELECT id, mt FROM logs WHERE id = 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.of_span(schema.logs(spark, sf), "a".rjust(16, "0")).select("id", "mt")


@register("logs_rendered", f"WITH {LOGS} SELECT id, 'User ' || user_id || ' ' || event_type AS message FROM logs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.render(schema.logs(spark, sf)).select("id", "message")


@register("logs_stats", "SELECT count(*) AS events, epoch_us(min(ts)) AS oldest, epoch_us(max(ts)) AS newest FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.stats(schema.logs(spark, sf)).select("events", F.unix_micros("oldest").alias("oldest"), F.unix_micros("newest").alias("newest"))


def _volume(key: str) -> str:
    return f"""WITH {LOGS}, c AS (SELECT epoch_us(ts) // 21600000000 AS b, {key} AS g, count(*) AS n FROM logs GROUP BY ALL)
SELECT x.b * 21600 AS bucket_s, g.g AS {key}, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c))) AS b) x CROSS JOIN (SELECT DISTINCT g FROM c) g LEFT JOIN c ON c.b = x.b AND c.g = g.g"""


@register("log_volume_by_service", _volume("service"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.volume_by_service(schema.logs(spark, sf), 21600)


@register("log_volume_by_level", _volume("level_name"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return logs.volume_by_level(schema.logs(spark, sf), 21600)


# ------------------------------------------------------------------ traces

_ROW = "trace_id, name, service, start_ns, duration_ns, http_status, array_to_string(services, ',') AS services, span_count, has_error"


def _row(df: DataFrame) -> DataFrame:
    return df.select("trace_id", "name", "service", "start_ns", "duration_ns", "http_status", F.array_join("services", ",").alias("services"), "span_count", "has_error")


def _traceql(name: str, query: str, where: str) -> None:
    QUERIES[name] = lambda spark, sf: _row(traces.traceql(schema.spans(spark, sf), query, 200))
    ORACLES[name] = f"WITH {SPANS}, m AS (SELECT * FROM spans WHERE {where}), {SUMMARY.format(src='m')} SELECT {_ROW} FROM sm ORDER BY start_ns DESC, trace_id LIMIT 200"


_traceql("traceql_attr", '{ .flag = "r" && .quantity > 40 }', "flag = 'R' AND quantity > 40")
_traceql("traceql_duration_status", '{ (duration > 300ms || service = "STORE-N") && !(status = error) && .http.status_code < 300 }', "(duration_ns > 300000000 OR service = 'store-n') AND status <> 2 AND http_status < 300")


@register("trace_list", f"WITH {SPANS}, {SUMMARY.format(src='spans')} SELECT {_ROW} FROM sm ORDER BY start_ns DESC, trace_id LIMIT 200")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _row(traces.trace_list(schema.spans(spark, sf)))


@register("trace_list_filtered", f"WITH {SPANS}, {SUMMARY.format(src='spans')} SELECT {_ROW} FROM sm WHERE has_error AND list_contains(services, 'store-r') AND contains(upper(name), 'ORDER') AND duration_ns >= 100000000 AND http_status BETWEEN 500 AND 599 ORDER BY start_ns DESC, trace_id LIMIT 200")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _row(traces.trace_list(schema.spans(spark, sf), "error", "STORE-R", "order", 100, None, "5xx"))


_HIST = f"""h AS (SELECT {{key}}, len(list_filter([{EDGES}], lambda e: duration_ns >= e * 1000000::BIGINT)) AS b, count(*) AS c FROM {{src}} GROUP BY ALL),
hc AS (SELECT *, sum(c) OVER (PARTITION BY {{part}} ORDER BY b) AS cum, sum(c) OVER (PARTITION BY {{part}}) AS n FROM h),
edges AS (SELECT [0.0::DOUBLE, {EDGES}] AS lo, [{EDGES}, 3600000.0::DOUBLE] AS hi),
pc AS (SELECT {{key}}, """ + ", ".join(f"arg_min(lo[b + 1] + (hi[b + 1] - lo[b + 1]) * (ceil(n * {p / 100}::DOUBLE) - (cum - c)) / c, b) FILTER (WHERE cum >= ceil(n * {p / 100}::DOUBLE)) AS p{p}_ms" for p in (50, 95, 99)) + " FROM hc, edges GROUP BY ALL)"


def _hist(src: str, key: str) -> str:
    return _HIST.replace("{src}", src).replace("{key}", key).replace("{part}", key)


@register("trace_latency", f"WITH {SPANS}, {_hist('spans', 'service')} SELECT service, spans, errors, min_ms, max_ms, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms FROM pc JOIN (SELECT service, count(*) AS spans, count(*) FILTER (WHERE status = 2) AS errors, min(duration_ns) / 1000000 AS min_ms, max(duration_ns) / 1000000 AS max_ms FROM spans GROUP BY service) USING (service)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.latency(schema.spans(spark, sf)).select("service", "spans", "errors", "min_ms", "max_ms", *(F.round(f"p{p}_ms", 6).alias(f"p{p}_ms") for p in (50, 95, 99)))


@register("trace_stats", f"WITH {SPANS}, {SUMMARY.format(src='spans')}, one AS (SELECT 1 AS k, duration_ns FROM spans), {_hist('one', 'k')} SELECT (SELECT count(*) FROM sm) AS traces, round((SELECT count(*) FILTER (WHERE has_error) * 100.0 / count(*) FROM sm), 6) AS error_rate, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms FROM pc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.trace_stats(schema.spans(spark, sf), 0, 2**62).select("traces", *(F.round(c, 6).alias(c) for c in ("error_rate", "p50_ms", "p95_ms", "p99_ms")))


@register("trace_volume", f"WITH {SPANS}, s2 AS (SELECT * FROM spans WHERE start_ns BETWEEN {T0} AND {T1}), {SUMMARY.format(src='s2')}, c AS (SELECT greatest(0, least(19, CAST((start_ns::HUGEINT - {T0}) * 20 // {T1 - T0} AS INT))) AS b, count(*) AS t, count(*) FILTER (WHERE has_error) AS e FROM sm GROUP BY 1) SELECT CAST(x.b AS INT) AS bucket, coalesce(t, 0) AS traces, coalesce(e, 0) AS errors FROM (SELECT unnest(generate_series(0, 19)) AS b) x LEFT JOIN c ON c.b = x.b")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.volume(schema.spans(spark, sf), T0, T1)


_EDGE = f"""WITH {SPANS}, e AS (SELECT p.service AS from_service, c.service AS to_service, c.status, c.duration_ns FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service <> p.service)"""


@register("service_graph_edges", f"{_EDGE}, {_hist('e', 'from_service, to_service')} SELECT from_service, to_service, calls, errors, round(errors / calls, 6) AS error_rate, round(p95_ms, 6) AS p95_ms FROM pc JOIN (SELECT from_service, to_service, count(*) AS calls, count(*) FILTER (WHERE status = 2) AS errors FROM e GROUP BY ALL) USING (from_service, to_service)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.graph_edges(schema.spans(spark, sf)).select("from_service", "to_service", "calls", "errors", F.round("error_rate", 6).alias("error_rate"), F.round("p95_ms", 6).alias("p95_ms"))


@register("service_graph_nodes", f"{_EDGE}, {_hist('spans', 'service')} SELECT service, spans, round(errors / spans, 6) AS error_rate, round(p95_ms, 6) AS p95_ms FROM pc JOIN (SELECT service, count(*) AS spans, count(*) FILTER (WHERE status = 2) AS errors FROM spans GROUP BY ALL) USING (service) WHERE service IN (SELECT from_service FROM e UNION SELECT to_service FROM e)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.graph_nodes(schema.spans(spark, sf)).select("service", "spans", F.round("error_rate", 6).alias("error_rate"), F.round("p95_ms", 6).alias("p95_ms"))


@register("trace_flame_self_time", f"WITH {SPANS}, u AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY start_ns, duration_ns, name, service, status, http_status, parent_span_id NULLS FIRST) = 1) SELECT s.trace_id, s.span_id, s.name, round_even(s.duration_ns / 1000000, 3) AS total_ms, round_even(greatest(0, s.duration_ns - coalesce(i.d, 0)) / 1000000, 3) AS self_ms FROM u s LEFT JOIN (SELECT trace_id, parent_span_id, sum(duration_ns) AS d FROM u GROUP BY ALL) i ON i.trace_id = s.trace_id AND i.parent_span_id = s.span_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.self_time(traces.deduplicate(schema.spans(spark, sf).drop("attrs", "kind")))
    return out.select("trace_id", "span_id", "name", F.round("total_ms", 3).alias("total_ms"), F.round("self_ms", 3).alias("self_ms"))


@register("trace_depth", f"WITH {SPANS} SELECT span_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth FROM spans WHERE trace_id = lpad('1', 32, '0') QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY start_ns, duration_ns, name, service, status, http_status, parent_span_id NULLS FIRST) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.flamegraph(schema.spans(spark, sf), "1".rjust(32, "0")).select("span_id", "depth")


@register("trace_get", f"WITH {SPANS} SELECT span_id, name, service, duration_ns FROM spans WHERE trace_id = lpad('2', 32, '0') QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY start_ns, duration_ns, name, service, status, http_status, parent_span_id NULLS FIRST) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.get_trace(schema.spans(spark, sf), "2".rjust(32, "0")).select("span_id", "name", "service", "duration_ns")


@register("trace_compare", f"WITH {SPANS}, u AS (SELECT * FROM spans {DEDUP}) SELECT 'a' AS side, span_id, name, duration_ns FROM u WHERE trace_id = lpad('2', 32, '0') UNION ALL SELECT 'b', span_id, name, duration_ns FROM u WHERE trace_id = lpad('5', 32, '0')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.compare_traces(schema.spans(spark, sf), "2".rjust(32, "0"), "5".rjust(32, "0")).select("side", "span_id", "name", "duration_ns")


@register("span_search", f"WITH {SPANS} SELECT trace_id, span_id, name, duration_ns FROM spans WHERE status = 2 AND duration_ns > 2000000 AND name = 'line F' ORDER BY start_ns DESC, span_id, trace_id, duration_ns LIMIT 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traces.search_spans(schema.spans(spark, sf), '{ status = error && duration > 2ms && name = "line F" }', 100).select("trace_id", "span_id", "name", "duration_ns")


# ------------------------------------------------------------------ metrics


def _query(name: str, metric: str, agg: str, sql: str, **options) -> None:
    ORACLES[name] = f"WITH {POINTS}{sql}"
    QUERIES[name] = lambda spark, sf: metrics.query(schema.metrics(spark, sf), metric, agg, **options).select("group", "ts_ns", F.round("value", 6).alias("value"))


_LAG = "lag(n) OVER w AS pn, lag(ts_ns) OVER w AS pt, lag(b) OVER w AS pb"
_DELTA = f", d AS (SELECT *, CASE WHEN n >= pn THEN n - pn ELSE n END AS d FROM (SELECT *, {_LAG} FROM hourly WINDOW w AS (PARTITION BY service, type ORDER BY ts_ns)) WHERE pt IS NOT NULL)"
_query("metric_downsample_gauge", "event.value", "none", f" SELECT {KEY} AS \"group\", ts_ns, round(v, 6) AS value FROM hourly", step="1h")
_query("metric_downsample_counter", "event.count", "none", f" SELECT {KEY} AS \"group\", ts_ns, round(n::DOUBLE, 6) AS value FROM hourly", step="3600")
_query("metric_rate", "event.count", "rate", f"{_DELTA} SELECT {BY_TYPE} AS \"group\", ts_ns, round(sum(d / ((ts_ns - pt) / 1e9)), 6) AS value FROM d GROUP BY ALL", step="1h", by=["type"])
_query("metric_increase", "event.count", "increase", f"{_DELTA} SELECT {KEY} AS \"group\", ts_ns, round(sum(d)::DOUBLE, 6) AS value FROM d GROUP BY ALL", step="01:00:00")
for _a in ("avg", "min", "max", "sum"):
    _query(f"metric_reduce_{_a}", "event.value", _a, f" SELECT {BY_TYPE} AS \"group\", ts_ns, round({_a}(v), 6) AS value FROM hourly GROUP BY ALL", step="60m", by=["type"])
_query("metric_reduce_last", "event.count", "last", f" SELECT {BY_TYPE} AS \"group\", max(t) AS ts_ns, round(sum(l)::DOUBLE, 6) AS value FROM (SELECT service, type, max(ts_ns) AS t, arg_max(n, ts_ns) AS l FROM hourly GROUP BY ALL) GROUP BY type", step="1h", by=["type"])
_query("metric_label_filter", "event.count", "none", f" SELECT {KEY} AS \"group\", ts_ns, round(n::DOUBLE, 6) AS value FROM hourly WHERE type IN ('view', 'click') AND service = 'svc-1'", step="1h", labels={"type": "view|click", "service": "svc-1"})
_BUCKETS = f", d AS (SELECT *, CASE WHEN list_sum(b) < list_sum(pb) THEN b ELSE list_transform(generate_series(1, 6), lambda i: greatest(0, b[i] - pb[i])) END AS db FROM (SELECT *, {_LAG} FROM hourly WINDOW w AS (PARTITION BY service, type ORDER BY ts_ns)) WHERE pb IS NOT NULL)"
_SUM6 = ", ".join(f"sum(db[{i}])" for i in range(1, 7))
_query(
    "metric_quantile", "event.size", "quantile",
    f"""{_BUCKETS}, g AS (SELECT type, ts_ns, [{_SUM6}] AS c FROM d GROUP BY ALL),
q AS (SELECT *, list_sum(c) AS n, list_transform(generate_series(1, 6), lambda i: list_sum(c[1:i])) AS cum FROM g),
k AS (SELECT *, list_filter(generate_series(1, 6), lambda i: cum[i] >= n * 0.9 AND c[i] > 0)[1] AS i FROM q)
SELECT {BY_TYPE} AS "group", ts_ns, round(CASE WHEN n <= 0 THEN 0.0 WHEN i = 6 THEN 250.0 ELSE [0.0, 10.0, 25.0, 50.0, 100.0][i] + ([10.0, 25.0, 50.0, 100.0, 250.0][i] - [0.0, 10.0, 25.0, 50.0, 100.0][i]) * (n * 0.9 - (cum[i] - c[i])) / c[i] END::DOUBLE, 6) AS value FROM k""",
    step="1h", by=["type"], q=0.9,
)
_query("metric_topk", "event.count", "increase", f"{_DELTA}, s AS (SELECT service, type, ts_ns, sum(d)::DOUBLE AS value FROM d GROUP BY ALL), best AS (SELECT service, type FROM s GROUP BY service, type ORDER BY arg_max(value, ts_ns) DESC, service, type LIMIT 3) SELECT {KEY} AS \"group\", ts_ns, value FROM s JOIN best USING (service, type)", step="1h", topk=3)


@register("metric_heatmap", f"WITH {POINTS}{_BUCKETS} SELECT ts_ns // 1000000 AS ts_ms, {', '.join(f'CAST(sum(db[{i}]) AS BIGINT) AS c{i}' for i in range(1, 7))} FROM d GROUP BY ts_ns")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.heatmap(metrics.series(schema.metrics(spark, sf), "event.size", step=HOUR_NS))
    return out.select("ts_ms", *(F.get("counts", F.lit(i - 1)).alias(f"c{i}") for i in range(1, 7)))


@register("metric_expr_ratio", f"WITH {POINTS}{_DELTA}, a AS (SELECT ts_ns, sum(d) AS a FROM d WHERE type = 'error' GROUP BY 1), b AS (SELECT ts_ns, sum(d) AS b FROM d GROUP BY 1) SELECT ts_ns, round(CASE WHEN b <> 0 THEN a / b ELSE 0 END * 100, 6) AS value FROM a JOIN b USING (ts_ns)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = schema.metrics(spark, sf)
    errors = metrics.query(p, "event.count", "increase", labels={"type": "error"}, step="1h")
    return metrics.expression(errors, "div", metrics.query(p, "event.count", "increase", step="1h"), 100.0).select("ts_ns", F.round("value", 6).alias("value"))


@register("metric_catalog", "SELECT name, kind, (SELECT count(DISTINCT (user_id % 5, event_type)) FROM events) AS series, (SELECT max(epoch_us(ts)) * 1000 FROM events) AS last_ns FROM (VALUES ('event.value', 'Gauge'), ('event.count', 'Counter'), ('event.size', 'Histogram')) t(name, kind)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.catalog(schema.metrics(spark, sf), "EVENT").select("name", "kind", "series", "last_ns")


@register("metric_label_values", "SELECT DISTINCT event_type AS value FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_values(schema.metrics(spark, sf), "event.count", "type")


@register("metric_label_keys", "SELECT unnest(['service', 'type']) AS key")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_keys(schema.metrics(spark, sf), "event.count")


@register("metric_latest", f"WITH {POINTS} SELECT {KEY} AS key, max(ts_ns) AS ts_ns, arg_max(n, ts_ns)::DOUBLE AS value FROM ded GROUP BY service, type")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latest(schema.metrics(spark, sf), "event.count").select("key", "ts_ns", "value")


_NOW_NS = 1_706_659_200 * 10**9


@register("metric_rollup_5m_1h", f"WITH {POINTS}, t AS (SELECT *, CASE WHEN {_NOW_NS} - ts_ns > 86400000000000 THEN 3600000000000 WHEN {_NOW_NS} - ts_ns > 3600000000000 THEN 300000000000 ELSE 1 END AS step FROM ded) SELECT {KEY} AS key, ts_ns - ts_ns % step AS ts_ns, round(avg(v), 6) AS value FROM t GROUP BY service, type, ts_ns - ts_ns % step")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = schema.metrics(spark, sf).filter("name = 'event.value'")
    return metrics.rollup(p, _NOW_NS).select("key", "ts_ns", F.round("value", 6).alias("value"))


# ------------------------------------------------------------------ alerts, retention, ingest, streams


@register("alert_log_count", f"WITH {LOGS} SELECT least(10000, count(*))::DOUBLE AS value FROM logs WHERE level_name = 'Error' AND ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '{NOW}'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.log_condition(schema.logs(spark, sf), "@l = 'Error'", "2024-01-20 00:00:00", NOW)


@register("alert_metric_peak", f"WITH {POINTS} SELECT round(max(v), 6) AS value FROM ded")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.metric_condition(schema.metrics(spark, sf), "event.value", ">", 0, 2**62, "max").select(F.round("value", 6).alias("value"))


@register("alert_trace_error_rate", f"WITH {SPANS} SELECT round(count(*) FILTER (WHERE status = 2) * 100.0 / count(*), 6) AS value FROM spans WHERE service = 'api-1'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.trace_condition(schema.spans(spark, sf), "error_rate", 0, 2**62, "API-1").select(F.round("value", 6).alias("value"))


@register("alert_state_timeline")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hourly = schema.logs(spark, sf).filter(compile_filter("Error")).groupBy((F.floor(F.unix_seconds("ts") / HOUR) * HOUR).alias("at")).count()
    values = alerts.ticks(hourly.select(F.lit("errors").alias("rule"), "at", F.col("count").cast("double").alias("value")), HOUR)
    return alerts.timeline(values, {"errors": alerts.Rule("errors", ">", 2, for_s=HOUR, repeat_s=6 * HOUR, escalate_s=12 * HOUR)})


@register("alert_ticks", f"WITH {LOGS}, h AS (SELECT epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM logs WHERE level_name = 'Error' GROUP BY 1) SELECT 'errors' AS rule, x.h * 3600 AS at, coalesce(n, 0)::DOUBLE AS value FROM (SELECT unnest(generate_series((SELECT min(h) FROM h), (SELECT max(h) FROM h))) AS h) x LEFT JOIN h USING (h)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hourly = schema.logs(spark, sf).filter(compile_filter("Error")).groupBy((F.floor(F.unix_seconds("ts") / HOUR) * HOUR).alias("at")).count()
    return alerts.ticks(hourly.select(F.lit("errors").alias("rule"), "at", F.col("count").cast("double").alias("value")), HOUR)


@register("retention_metrics", f"SELECT count(*) AS n FROM events WHERE epoch_us(ts) * 1000 >= {_NOW_NS - 7 * DAY * 10**9}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = schema.metrics(spark, sf).filter("name = 'event.value'")
    return alerts.retained_points(points, _NOW_NS, days=7).agg(F.count("*").alias("n"))


@register("retention_expired_by_level", f"WITH {LOGS} SELECT level_name, count(*) AS n FROM logs WHERE floor(epoch_us(ts) / 1000000) + CASE level_name WHEN 'Debug' THEN 3 ELSE 20 END * 86400 < epoch_us(TIMESTAMP '{NOW}') / 1000000 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return schema.logs(spark, sf).filter(alerts.expired(NOW, default=20)).groupBy("level_name").agg(F.count("*").alias("n"))


def _docs(spark: SparkSession, document: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(document),)], "value string")


_RES = {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}, {"key": "host", "value": {"stringValue": "h1"}}]}


@register("otlp_logs_flatten", """SELECT 'Error' AS level_name, 'failed {n}' AS mt, '{"host":"h1","n":5}' AS props_json, 'shop' AS service, 'ab' AS tr, 'cd' AS sp""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    record = {"timeUnixNano": "1700000000123456000", "severityNumber": 17, "body": {"stringValue": "failed {n}"}, "attributes": [{"key": "n", "value": {"intValue": "5"}}], "traceId": "AB", "spanId": "CD"}
    return ingest.otlp_logs(_docs(spark, {"resourceLogs": [{"resource": _RES, "scopeLogs": [{"logRecords": [record]}]}]})).select("level_name", "mt", "props_json", "service", "tr", "sp")


@register("otlp_spans_flatten", """SELECT 'a1' AS trace_id, 'b1' AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 10::BIGINT AS start_ns, 20::BIGINT AS duration_ns, 'GET /' AS name, 'shop' AS service,
 1 AS kind, 2 AS status, 503 AS http_status""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    span = {"traceId": "A1", "spanId": "B1", "name": "GET /", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "30", "status": {"code": 2}, "attributes": [{"key": "http.status_code", "value": {"intValue": "503"}}]}
    return ingest.otlp_spans(_docs(spark, {"resourceSpans": [{"resource": _RES, "scopeSpans": [{"spans": [span, {**span, "spanId": ""}]}]}]})).drop("attrs")


@register("otlp_metrics_flatten", """SELECT 'lat' AS name, 'Histogram' AS kind, '{"service.name":"shop","host":"h1","route":"/"}' AS labels, 10::BIGINT AS ts_ns, 2.0::DOUBLE AS value, 4::BIGINT AS count, '[1,3]' AS buckets
 UNION ALL SELECT 'hits', 'Counter', '{"service.name":"shop","host":"h1"}', 10, 7.0, NULL, NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    point = {"timeUnixNano": "10", "count": "4", "sum": 8.0, "explicitBounds": [1.0], "bucketCounts": ["1", "3"], "attributes": [{"key": "route", "value": {"stringValue": "/"}}]}
    out = ingest.otlp_metrics(_docs(spark, {"resourceMetrics": [{"resource": _RES, "scopeMetrics": [{"metrics": [{"name": "lat", "unit": "s", "histogram": {"dataPoints": [point]}}, {"name": "hits", "sum": {"isMonotonic": True, "dataPoints": [{"timeUnixNano": "10", "asInt": "7"}]}}]}]}]}))
    return out.select("name", "kind", F.to_json("labels").alias("labels"), "ts_ns", "value", "count", F.to_json("buckets").alias("buckets"))


# ------------------------------------------------------------------ binary bodies


def _text_hex(text: Column) -> Column:
    """A text of less than 128 bytes, with its size before it, in hexadecimal."""
    return F.concat(F.lpad(F.hex(F.octet_length(text)), 2, "0"), F.hex(text))


def _varint_hex(number: Column) -> Column:
    """A number below 2**35 as a varint of five bytes."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(number, 7 * k).bitwiseAND(127).bitwiseOR(128 if k < 4 else 0)), 2, "0") for k in range(5)))


def _fixed_hex(number: Column) -> Column:
    big = F.lpad(F.hex(number), 16, "0")
    return F.concat(*(F.substring(big, 2 * k + 1, 2) for k in range(7, -1, -1)))


def _sized_hex(body: Column) -> Column:
    # bound once, or nested sizes would multiply the expression
    return F.get(F.transform(F.array(body), lambda b: F.concat(_varint_hex((F.length(b) / 2).cast("bigint")), b)), 0)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@register("otlp_proto_logs", """SELECT event_id AS id, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'Error' ELSE 'Information' END AS level_name, event_type AS mt, 'svc' AS service, lpad(printf('%x', user_id), 32, '0') AS tr FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda key, value: F.concat(F.lit("0A"), _text_hex(F.lit(key)), F.lit("12"), _sized_hex(value))
    record = F.concat(
        F.lit("09"), _fixed_hex(F.col("us") * 1000), F.lit("10"), F.when(F.col("event_type") == "error", "11").otherwise("09"), F.lit("2A"), _sized_hex(F.concat(F.lit("0A"), _text_hex(F.col("event_type")))),
        F.lit("32"), _sized_hex(pair("id", F.concat(F.lit("18"), _varint_hex(F.col("event_id"))))), F.lit("4A10"), F.lpad(F.hex("user_id"), 32, "0"),
    )
    resource = F.concat(F.lit("0A"), _sized_hex(F.concat(F.lit("0A"), _sized_hex(pair("service.name", F.concat(F.lit("0A"), _text_hex(F.lit("svc"))))))))
    body = F.concat(F.lit("0A"), _sized_hex(F.concat(resource, F.lit("12"), _sized_hex(F.concat(F.lit("12"), _sized_hex(record))))))
    rows = wire.otlp_logs(_events(spark, sf).select(F.unhex(body).alias("content")))
    return rows.select(F.try_variant_get("props", "$.id", "bigint").alias("id"), F.unix_micros("ts").alias("us"), "level_name", "mt", "service", "tr")


@register("clef_msgpack", """SELECT event_id AS id, user_id, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'Error' ELSE 'Information' END AS level_name, 'User {UserId} ' || event_type AS mt FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.concat(F.lit("D9"), _text_hex(c))
    whole = lambda c: F.concat(F.lit("CE"), F.lpad(F.hex(c), 8, "0"))
    at = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    entries = (("@t", text(at)), ("@mt", text(F.concat(F.lit("User {UserId} "), "event_type"))), ("@l", text(F.col("event_type"))), ("Id", whole("event_id")), ("UserId", whole("user_id")))
    body = F.concat(F.lit("9185"), *(x for key, value in entries for x in (text(F.lit(key)), value)))
    rows = wire.clef(_events(spark, sf).select(F.unhex(body).alias("content")))
    return rows.select(F.try_variant_get("props", "$.Id", "bigint").alias("id"), F.try_variant_get("props", "$.UserId", "bigint").alias("user_id"), F.unix_micros("ts").alias("us"), "level_name", "mt")


# ------------------------------------------------------------------ values within documents


def _nested(name: str, text: str, where: str) -> None:
    """A filter over logs whose Body is JSON text, Map an object, Enc base64 and Dur a time span."""

    def rows(spark: SparkSession, sf: str) -> DataFrame:
        k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
        body = F.to_json(F.struct(F.struct(F.array(k.cast("string"), F.concat(F.lit("x"), (k % 7).cast("string"))).alias("b"), k.alias("n")).alias("a"), kind.alias("s")))
        dur = F.concat(F.lit("0."), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:01"))
        props = F.struct(k.alias("k"), kind.alias("Type"), body.alias("Body"), F.struct(k.alias("one"), kind.alias("two")).alias("Map"), F.base64(F.encode(kind, "utf-8")).alias("Enc"), dur.alias("Dur"))
        level = F.when(kind == "error", 4).when(kind == "purchase", 3).when(kind == "signup", 2).when(kind == "click", 1).otherwise(0)
        events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), level.alias("level"), F.lit("").alias("mt"), F.to_json(props).alias("props_json"))
        return schema.as_logs(events, deep=False).filter(compile_filter(text)).select("id", "level_name")

    QUERIES[name], ORACLES[name] = rows, f"WITH {LOGS} SELECT id, level_name FROM logs WHERE {where}"


for _n, _t, _w in (
    ("logs_json_number", "fromJson(Body).a.n > 40 and fromJson(Body).a['b'][1] = 'X3'", "k > 40 AND k % 7 = 3"),
    ("logs_json_text", "fromJson(Body).s like 'c%k' or (startsWith(fromJson(Body).s, 'pur') and ci_contains(fromJson(Body).s, 'CHA') and endsWith(fromJson(Body).s, 'se'))", "event_type IN ('click', 'purchase')"),
    ("logs_json_in_has", "fromJson(Body).a.b[1] in ['x1', 'x2'] and has(fromJson(Body).a.b) and not has(fromJson(Body).a.c)", "k % 7 IN (1, 2)"),
    ("logs_keys_values", "keys(Map) != 'two' and values(Map) != 5 and Type = 'click'", "event_type = 'click'"),
    ("logs_decoded", "fromBase64(Enc) = 'signup' and toLower(Type) = 'signup' and timeSpan(Dur) >= 432010000000 and now() > 0", "event_type = 'signup' AND k % 24 >= 12"),
    ("logs_iso_text", "toIsoString(@t, 4) like '%T04:%'", "date_part('hour', ts) = 0"),
):
    _nested(_n, _t, _w)


# ------------------------------------------------------------------ reads by id


@register("log_of_span", f"WITH {LOGS} SELECT id FROM logs WHERE lpad(printf('%x', id), 16, '0') = '0000000000000011'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return schema.logs(spark, sf).filter(compile_filter("@sp = '0000000000000011'")).select("id")
