"""Schemas of logs, spans and metrics, and views of the driver's tables in these shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

X = "struct<type:string,message:string,stack:string,inner:struct<type:string,message:string,stack:string,inner:struct<type:string,message:string,stack:string>>>"
LOG_COLUMNS = ("id", "ts", "level", "level_name", "mt", "x", "props", "props_json", "search_text", "tr", "sp", "service")
SPAN_COLUMNS = ("trace_id", "span_id", "parent_span_id", "start_ns", "duration_ns", "name", "service", "kind", "status", "http_status", "attrs")
METRIC_COLUMNS = ("name", "kind", "unit", "labels", "ts_ns", "value", "count", "sum", "bounds", "buckets", "exemplars")
EXEMPLAR = "array<struct<ts_ns:bigint,value:double,trace_id:string,span_id:string>>"
LEVELS = ("Verbose", "Debug", "Information", "Warning", "Error", "Fatal")


def level_number(name: Column) -> Column:
    """0 to 5 by name, case-insensitively, with the short forms; anything else is Information."""
    low = F.lower(name)
    out = F.when(low == "info", 2).when(low == "warn", 3)
    for k, word in enumerate(LEVELS):
        out = out.when(low == word.lower(), k)
    return out.otherwise(2)


def level_text(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LEVELS)), level + 1)


def text_leaves(props_json: Column, depth: int = 5) -> Column:
    """All text values of a JSON object, nested up to `depth` objects deep (arrays add no depth)."""
    found: list[Column] = []
    level = F.array(F.try_parse_json(props_json))
    for _ in range(depth + 1):
        flat = level
        for _ in range(2):  # arrays, and arrays within arrays
            flat = F.flatten(F.transform(flat, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
        found.append(F.transform(F.filter(flat, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")))
        objects = F.filter(flat, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
        level = F.flatten(F.transform(objects, lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))))
    return F.concat(*found)


def as_logs(df: DataFrame, deep: bool = True) -> DataFrame:
    """Completes a frame of id, ts, level, mt, props_json (and x, tr, sp, service where it has them)."""
    have = set(df.columns)
    for c in ("tr", "sp", "service"):
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "x" not in have:
        df = df.withColumn("x", F.lit(None).cast(X))
    leaves = text_leaves(F.col("props_json")) if deep else F.filter(F.map_values(F.from_json("props_json", "map<string,string>")), lambda v: v.isNotNull())
    return df.withColumns({"level": F.col("level").cast("int"), "level_name": level_text(F.col("level").cast("int")), "props": F.try_parse_json("props_json"), "search_text": leaves}).select(*LOG_COLUMNS)


def series_key(labels: Column) -> Column:
    """A map of labels as a text that can be grouped by: the sorted entries' JSON."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


# ------------------------------------------------------------------ views of the driver's tables


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as logs: the type gives the level, the user the service."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.create_map(*(F.lit(x) for kv in (("error", 4), ("purchase", 3), ("signup", 2), ("click", 1), ("view", 0)) for x in kv))
    props = F.to_json(F.struct(F.col("user_id").alias("UserId"), F.col("value").alias("Value"), F.col("event_type").alias("Type"), F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    rows = e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), level[F.col("event_type")].alias("level"),
        F.concat(F.lit("User {UserId} "), "event_type").alias("mt"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        props.alias("props_json"), F.lower(F.lpad(F.hex("user_id"), 32, "0")).alias("tr"), F.lower(F.lpad(F.hex("event_id"), 16, "0")).alias("sp"),
    )
    return as_logs(rows, deep=False)


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as logs: the text, language, source and length are properties."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    props = F.to_json(F.struct(F.col("text").alias("Text"), F.col("lang").alias("Lang"), F.col("source").alias("Source"), F.col("n_chars").alias("Chars")))
    start = F.lit(1_704_067_200)
    rows = d.select(F.col("doc_id").alias("id"), F.timestamp_seconds(start + F.col("doc_id")).alias("ts"), (F.col("doc_id") % 6).alias("level"), F.lit("Document {Source}").alias("mt"), F.col("source").alias("service"), props.alias("props_json"))
    return as_logs(rows, deep=False)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as root spans, lineitem as their children."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    root = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    trace = lambda c: F.lower(F.lpad(F.hex(c), 32, "0"))
    ok = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    parents = o.select(
        trace("o_orderkey").alias("trace_id"), root((F.col("o_orderkey") + 1) * 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + (F.col("o_orderkey") % 1000) * 1_000_000).alias("start_ns"),
        (F.col("o_totalprice") * 1000).cast("bigint").alias("duration_ns"), F.concat(F.lit("order "), "o_orderpriority").alias("name"),
        F.concat(F.lit("api-"), F.substring("o_orderpriority", 1, 1)).alias("service"), F.lit(1).alias("kind"), ok.cast("int").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 500).when(F.col("o_orderstatus") == "O", 200).otherwise(0).alias("http_status"),
        F.parse_json(F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority")))).alias("attrs"),
    )
    children = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        trace("l_orderkey").alias("trace_id"), root((F.col("l_orderkey") + 1) * 16 + F.col("l_linenumber")).alias("span_id"), root((F.col("l_orderkey") + 1) * 16).alias("parent_span_id"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + (F.col("l_orderkey") % 1000) * 1_000_000 + F.col("l_linenumber") * 1_000_000).alias("start_ns"),
        (F.col("l_extendedprice") * 100).cast("bigint").alias("duration_ns"), F.concat(F.lit("line "), "l_linestatus").alias("name"),
        F.concat(F.lit("store-"), F.lower("l_returnflag")).alias("service"), F.lit(2).alias("kind"), F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("status"), F.lit(0).alias("http_status"),
        F.parse_json(F.to_json(F.struct(F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("attrs"),
    )
    return parents.unionByName(children)


BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metrics, by service and type: a gauge (the value), a counter (a running count, reset each
    50 events) and a histogram of values (running bucket counts, likewise)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    labels = F.create_map(F.lit("service"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")), F.lit("type"), F.col("event_type"))
    base = e.select("event_id", F.col("value").alias("v"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), labels.alias("labels"), (F.col("user_id") % 5).alias("s"), "event_type")
    w = Window.partitionBy("s", "event_type").orderBy("ts_ns", "event_id")
    numbered = base.withColumn("rn", F.row_number().over(w) - 1).withColumn("run", F.floor(F.col("rn") / 50))
    inside = Window.partitionBy("s", "event_type", "run").orderBy("ts_ns", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    edges = [*BOUNDS, None]
    hit = [((F.col("v") <= hi) if lo is None else (F.col("v") > lo) if hi is None else (F.col("v") > lo) & (F.col("v") <= hi)) for lo, hi in zip([None, *BOUNDS], edges, strict=True)]
    counted = numbered.withColumn("buckets", F.array(*(F.sum(h.cast("bigint")).over(inside) for h in hit))).withColumn("n", F.count("*").over(inside))
    none = F.lit(None)
    tail = {"exemplars": none.cast(EXEMPLAR)}
    gauge = base.select(F.lit("event.value").alias("name"), F.lit("Gauge").alias("kind"), F.lit("1").alias("unit"), "labels", "ts_ns", F.col("v").alias("value"), none.cast("bigint").alias("count"), none.cast("double").alias("sum"), none.cast("array<double>").alias("bounds"), none.cast("array<bigint>").alias("buckets"))
    counter = counted.select(F.lit("event.count").alias("name"), F.lit("Counter").alias("kind"), F.lit("1").alias("unit"), "labels", "ts_ns", F.col("n").cast("double").alias("value"), none.cast("bigint").alias("count"), none.cast("double").alias("sum"), none.cast("array<double>").alias("bounds"), none.cast("array<bigint>").alias("buckets"))
    histogram = counted.select(F.lit("event.size").alias("name"), F.lit("Histogram").alias("kind"), F.lit("1").alias("unit"), "labels", "ts_ns", none.cast("double").alias("value"), F.col("n").alias("count"), none.cast("double").alias("sum"), F.array(*(F.lit(b) for b in BOUNDS)).alias("bounds"), "buckets")
    return gauge.unionByName(counter).unionByName(histogram).withColumns(tail)
