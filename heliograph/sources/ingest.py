"""Ingest: CLEF lines and OTLP JSON (logs, traces, metrics) to the three schemas. Input: a frame with a text
column `value`, one JSON document a row (spark.read.text, or a stream of it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.sources.schema import EXEMPLAR, LOG_COLUMNS, METRIC_COLUMNS, SPAN_COLUMNS, X, as_logs, level_number

_CLEF = ("@t", "@mt", "@l", "@m", "@x", "@tr", "@sp", "service.name")
_ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_ANY}>>"
_RESOURCE = f"struct<attributes:{_ATTRS}>"
#: Resource attributes that are no metric labels (fixed values).
_DROPPED = r"^(service\.name|service\.instance\.id|telemetry\.sdk\..*|telemetry\.distro\..*)$"
#: Paths of the store's own intake, whose client spans are dropped (fixed values).
_OWN_INTAKE = ("/otlp/v1/", "/api/events")


def _exception(v: Column, depth: int = 3) -> Column:
    """A variant (text, or map of type, msg, stk, inner) as the nested struct, three levels deep."""
    text = F.try_variant_get(v, "$", "string")
    is_text = F.schema_of_variant(v) == "STRING"
    fields = [
        F.when(is_text, F.lit("Exception")).otherwise(F.try_variant_get(v, "$.type", "string")).alias("type"),
        F.when(is_text, text).otherwise(F.coalesce(F.try_variant_get(v, "$.msg", "string"), F.try_variant_get(v, "$.message", "string"))).alias("message"),
        F.when(~is_text, F.coalesce(F.try_variant_get(v, "$.stk", "string"), F.try_variant_get(v, "$.stack", "string"))).alias("stack"),
    ]
    if depth > 1:
        fields.append(F.when(~is_text, _exception(F.try_variant_get(v, "$.inner", "variant"), depth - 1)).alias("inner"))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.struct(*fields))


def clef(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """CLEF events. An unknown level is Information, a bad or missing time is now, a missing template is the
    message; other keys are properties. Lines that are no JSON objects are dropped. id: hash of the line."""
    v = F.try_parse_json("value")
    rows = lines.withColumn("_v", v).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    get = lambda k: F.try_variant_get("_v", f'$["{k}"]', "string")
    entries = F.map_filter(F.try_variant_get("_v", "$", "map<string,variant>"), lambda k, _: ~k.isin(*_CLEF))
    out = rows.select(
        F.xxhash64("value").bitwiseAND(F.lit(2**63 - 1)).alias("id"),
        F.coalesce(F.try_to_timestamp(get("@t")), now if now is not None else F.current_timestamp()).alias("ts"),
        level_number(F.coalesce(get("@l"), F.lit("Information"))).alias("level"),
        F.coalesce(get("@mt"), get("@m"), F.lit("")).alias("mt"),
        _exception(F.try_variant_get("_v", '$["@x"]', "variant")).cast(X).alias("x"),
        F.to_json(entries).alias("props_json"),
        F.lower(get("@tr")).alias("tr"), F.lower(get("@sp")).alias("sp"), get("service.name").alias("service"),
    )
    return as_logs(out)


def _any_json(v: Column) -> Column:
    """An OTLP value as JSON text."""
    return F.coalesce(
        F.when(v["stringValue"].isNotNull(), F.to_json(F.struct(v["stringValue"].alias("v")))),
        F.when(v["boolValue"].isNotNull(), F.concat(F.lit('{"v":'), v["boolValue"].cast("string"), F.lit("}"))),
        F.when(v["intValue"].isNotNull(), F.concat(F.lit('{"v":'), v["intValue"], F.lit("}"))),
        F.when(v["doubleValue"].isNotNull(), F.to_json(F.struct(v["doubleValue"].alias("v")))),
        F.when(v["arrayValue"].isNotNull(), F.concat(F.lit('{"v":'), F.coalesce(F.get_json_object(v["arrayValue"], "$.values"), F.lit("[]")), F.lit("}"))),
        F.when(v["kvlistValue"].isNotNull(), F.concat(F.lit('{"v":'), F.coalesce(F.get_json_object(v["kvlistValue"], "$.values"), F.lit("[]")), F.lit("}"))),
    )


def _any_text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), v["arrayValue"], v["kvlistValue"])


def _merged(weak: Column, strong: Column) -> Column:
    """Attributes of both lists, the strong list's winning, as an array of key and value without repeats."""
    empty = F.array().cast(_ATTRS)
    weak, strong = F.coalesce(weak, empty), F.coalesce(strong, empty)
    mine = F.transform(strong, lambda a: a["key"])
    return F.concat(F.filter(weak, lambda a: ~F.array_contains(mine, a["key"])), strong)


def _one_each(attrs: Column) -> Column:
    keys = F.array_distinct(F.transform(attrs, lambda a: a["key"]))
    return F.transform(keys, lambda k: F.try_element_at(F.filter(attrs, lambda a: a["key"] == k), F.lit(-1)))


def _as_json(attrs: Column) -> Column:
    """Attributes as one JSON object, written with the keys in order."""

    def pair(a: Column) -> Column:
        key = F.to_json(F.array(a["key"]))  # ["key"]
        return F.concat(key.substr(F.lit(2), F.length(key) - 2), F.lit(":"), _value_json(a["value"]))

    return F.concat(F.lit("{"), F.array_join(F.transform(attrs, pair), ","), F.lit("}"))


def _value_json(v: Column) -> Column:
    whole = F.coalesce(_any_json(v), F.lit('{"v":null}'))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def _attribute(attrs: Column, *keys: str) -> Column:
    """The text of the first of the keys that is there."""
    return F.coalesce(*(_any_text(F.try_element_at(_with_key(attrs, k), F.lit(-1))["value"]) for k in keys))


def _with_key(attrs: Column, key: str) -> Column:
    return F.filter(attrs, lambda a: a["key"] == key)


_LOGS = f"struct<resourceLogs:array<struct<resource:{_RESOURCE},scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},attributes:{_ATTRS},traceId:string,spanId:string>>>>>>>"


def otlp_logs(docs: DataFrame) -> DataFrame:
    """Log records: severity 1-4 Verbose, 5-8 Debug, 9-12 Information, 13-16 Warning, 17-20 Error, 21-24 Fatal;
    a text body is the template; resource attributes are weaker properties; microseconds are kept."""
    r = docs.select(F.from_json("value", _LOGS).alias("d")).select(F.explode("d.resourceLogs").alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("l"))
    attrs = _one_each(_merged(F.col("resource.attributes"), F.col("l.attributes")))
    r = r.withColumn("a", attrs)
    props = F.filter("a", lambda a: a["key"] != "service.name")
    nanos = F.coalesce(F.nullif(F.col("l.timeUnixNano").try_cast("bigint"), F.lit(0)), F.col("l.observedTimeUnixNano").try_cast("bigint"))
    level = F.when(F.col("l.severityNumber").between(1, 24), F.floor((F.col("l.severityNumber") - 1) / 4)).otherwise(level_number(F.coalesce("l.severityText", F.lit(""))))
    kind, text = _attribute(F.col("a"), "exception.type"), _attribute(F.col("a"), "exception.message")
    x = F.when(kind.isNotNull() | text.isNotNull(), F.struct(F.coalesce(kind, F.lit("Exception")).alias("type"), text.alias("message"), _attribute(F.col("a"), "exception.stacktrace").alias("stack"), F.lit(None).alias("inner")))
    out = r.select(
        F.xxhash64(F.to_json("l"), F.to_json("resource")).bitwiseAND(F.lit(2**63 - 1)).alias("id"), F.timestamp_micros(F.call_function("div", nanos, F.lit(1000))).alias("ts"), level.cast("int").alias("level"),
        F.coalesce(_any_text(F.col("l.body")), F.lit("")).alias("mt"), x.cast(X).alias("x"), _as_json(props).alias("props_json"),
        F.nullif(F.lower("l.traceId"), F.lit("")).alias("tr"), F.nullif(F.lower("l.spanId"), F.lit("")).alias("sp"), _attribute(F.col("a"), "service.name").alias("service"),
    )
    return as_logs(out).select(*LOG_COLUMNS)


_TRACES = f"struct<resourceSpans:array<struct<resource:{_RESOURCE},scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRS}>>>>>>>"


def otlp_spans(docs: DataFrame) -> DataFrame:
    """Spans with ids; client spans that call the store's own intake are dropped; durations are not negative."""
    r = docs.select(F.from_json("value", _TRACES).alias("d")).select(F.explode("d.resourceSpans").alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("l"))
    r = r.withColumn("a", _one_each(_merged(F.col("resource.attributes"), F.col("l.attributes"))))
    start, end = F.col("l.startTimeUnixNano").try_cast("bigint"), F.col("l.endTimeUnixNano").try_cast("bigint")
    url = F.coalesce(_attribute(F.col("a"), "url.full", "http.url", "url.path", "http.target"), F.lit(""))
    own = F.lit(False)
    for p in _OWN_INTAKE:
        own = own | url.contains(p)
    kind = F.coalesce(F.col("l.kind"), F.lit(0)).bitwiseAND(F.lit(7))
    out = r.filter((F.coalesce("l.traceId", F.lit("")) != "") & (F.coalesce("l.spanId", F.lit("")) != "") & ~((kind == 3) & own))
    code = F.coalesce(F.col("l.status.code"), F.lit(0))
    return out.select(
        F.lower("l.traceId").alias("trace_id"), F.lower("l.spanId").alias("span_id"), F.nullif(F.lower("l.parentSpanId"), F.lit("")).alias("parent_span_id"),
        start.alias("start_ns"), F.greatest(F.lit(0).cast("bigint"), end - start).alias("duration_ns"), F.coalesce("l.name", F.lit("")).alias("name"),
        F.coalesce(_attribute(F.col("a"), "service.name"), F.lit("unknown")).alias("service"),
        # wire kinds start at 1 (internal); 0 is unspecified
        F.greatest(F.lit(0), kind - 1).cast("int").alias("kind"), F.when(code.isin(1, 2), code).otherwise(0).cast("int").alias("status"),
        F.coalesce(_attribute(F.col("a"), "http.response.status_code", "http.status_code").try_cast("int"), F.lit(0)).alias("http_status"), F.try_parse_json(_as_json(F.col("a"))).alias("attrs"),
    ).select(*SPAN_COLUMNS)


_EX = f"array<struct<timeUnixNano:string,asDouble:double,asInt:string,traceId:string,spanId:string,filteredAttributes:{_ATTRS}>>"
_POINT = f"struct<attributes:{_ATTRS},timeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double,explicitBounds:array<double>,bucketCounts:array<string>,exemplars:{_EX}>"
_METRICS = f"struct<resourceMetrics:array<struct<resource:{_RESOURCE},scopeMetrics:array<struct<metrics:array<struct<name:string,unit:string,gauge:struct<dataPoints:array<{_POINT}>>,sum:struct<isMonotonic:boolean,dataPoints:array<{_POINT}>>,histogram:struct<dataPoints:array<{_POINT}>>>>>>>>>"


def otlp_metrics(docs: DataFrame) -> DataFrame:
    """Points of gauges, sums (monotonic ones are counters, others gauges) and histograms. Labels: the service,
    the point's attributes, and the resource's but for identities of instance and toolkit."""
    r = docs.select(F.from_json("value", _METRICS).alias("d")).select(F.explode("d.resourceMetrics").alias("r")).select("r.resource", F.explode("r.scopeMetrics").alias("s")).select("resource", F.explode("s.metrics").alias("m"))
    kind = F.when(F.col("m.histogram").isNotNull(), "Histogram").when(F.col("m.sum.isMonotonic"), "Counter").otherwise("Gauge")
    points = F.coalesce("m.histogram.dataPoints", "m.sum.dataPoints", "m.gauge.dataPoints")
    r = r.select("resource", "m.name", "m.unit", kind.alias("kind"), F.explode(points).alias("p"))
    service = F.filter(F.coalesce("resource.attributes", F.array().cast(_ATTRS)), lambda a: a["key"] == "service.name")
    rest = F.filter(F.coalesce("resource.attributes", F.array().cast(_ATTRS)), lambda a: ~a["key"].rlike(_DROPPED))
    r = r.withColumn("a", _one_each(_merged(F.concat(service, rest), F.col("p.attributes"))))
    labels = F.map_from_entries(F.transform("a", lambda a: F.struct(a["key"], F.coalesce(_any_text(a["value"]), F.lit("")))))
    value = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").try_cast("double"))
    ex = F.transform(F.filter("p.exemplars", lambda e: F.coalesce(e["traceId"], F.lit("")) != ""), lambda e: F.struct(e["timeUnixNano"].try_cast("bigint").alias("ts_ns"), F.coalesce(e["asDouble"], e["asInt"].try_cast("double")).alias("value"), F.lower(e["traceId"]).alias("trace_id"), F.lower(e["spanId"]).alias("span_id")))
    histogram = F.col("kind") == "Histogram"
    count = F.when(histogram, F.col("p.count").try_cast("bigint"))
    return r.select(
        "name", "kind", F.coalesce("unit", F.lit("")).alias("unit"), labels.alias("labels"), F.col("p.timeUnixNano").try_cast("bigint").alias("ts_ns"),
        F.when(histogram, F.when(count > 0, F.col("p.sum") / count).otherwise(0.0)).otherwise(value).alias("value"), count.alias("count"), F.when(histogram, F.col("p.sum")).alias("sum"),
        F.when(histogram, F.col("p.explicitBounds")).alias("bounds"), F.when(histogram, F.transform("p.bucketCounts", lambda b: b.try_cast("bigint"))).alias("buckets"), ex.cast(EXEMPLAR).alias("exemplars"),
    ).select(*METRIC_COLUMNS)
