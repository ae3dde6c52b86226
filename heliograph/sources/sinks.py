"""Sinks and their readers: tables laid out for retention and pruning, JSON output, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000
DERIVED = ("props", "search_text")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ranges of the keys: a hot day, level or metric is split over many tasks by the keys after it."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def day_of(ns: str) -> F.Column:
    return F.to_date(F.timestamp_seconds((F.col(ns) / NS).cast("bigint")))


def write_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day and level, so that a level's retention drops whole folders; in order of time within files.
    Columns that the reader can derive (the parsed properties, the search texts) are not stored."""
    rows = df.withColumn("date", F.to_date("ts")).drop(*DERIVED)
    _dealt(rows, "date", "level_name", "ts", "id").write.mode(mode).partitionBy("date", "level_name").parquet(path)


def read_logs(spark: SparkSession, path: str, start=None, end=None, levels=None, deep: bool = True) -> DataFrame:
    """Logs as written, with what was derived. The window (both ends inclusive) and the levels (names, any case)
    become partition filters."""
    from heliograph.sources.schema import LEVELS, LOG_COLUMNS, text_leaves

    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.filter((F.col("date") >= F.to_date(F.lit(start).cast("timestamp"))) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end is not None:
        rows = rows.filter((F.col("date") <= F.to_date(F.lit(end).cast("timestamp"))) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    wanted = [name for name in LEVELS if name.lower() in {x.lower() for x in levels or ()}]
    if wanted and len(wanted) < len(LEVELS):
        rows = rows.filter(F.col("level_name").isin(wanted))
    leaves = text_leaves(F.col("props_json")) if deep else F.filter(F.map_values(F.from_json("props_json", "map<string,string>")), lambda v: v.isNotNull())
    return rows.withColumns({"props": F.try_parse_json("props_json"), "search_text": leaves}).select(*LOG_COLUMNS)


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    rows = df.withColumns({"metric": F.col("name"), "date": day_of("ts_ns")})
    _dealt(rows, "metric", "date", "ts_ns").write.mode(mode).partitionBy("metric", "date").parquet(path)


def read_metrics(spark: SparkSession, path: str, name: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Points as written; the name (any case) and the window become partition filters."""
    rows = spark.read.parquet(path)
    if name is not None:
        rows = rows.filter(F.upper("metric") == name.upper())
    return _window(rows, "ts_ns", start_ns, end_ns).drop("metric", "date")


def write_spans(df: DataFrame, path: str, mode: str = "append") -> None:
    rows = df.withColumn("date", day_of("start_ns")).withColumn("attrs", F.to_json("attrs"))
    _dealt(rows, "date", "start_ns").write.mode(mode).partitionBy("date").parquet(path)


def read_spans(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Spans as written; the window of starts becomes a partition filter."""
    return _window(spark.read.parquet(path), "start_ns", start_ns, end_ns).drop("date").withColumn("attrs", F.try_parse_json("attrs"))


def _window(rows: DataFrame, column: str, start_ns: int | None, end_ns: int | None) -> DataFrame:
    for ns, later in ((start_ns, True), (end_ns, False)):
        if ns is not None:
            day = F.to_date(F.timestamp_seconds(F.lit(ns // NS)))
            rows = rows.filter((F.col("date") >= day) & (F.col(column) >= ns) if later else (F.col("date") <= day) & (F.col(column) <= ns))
    return rows


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, in column `value`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def compact(df: DataFrame, rows_per_file: int = 1_000_000, time: str = "ts") -> DataFrame:
    """The same rows in fewer, time-ordered files (spans: time="start_ns"; metrics: time="ts_ns")."""
    keys = [time, *(c for c in ("id", "span_id") if c in df.columns)]
    return df.repartitionByRange(max(1, -(-df.count() // rows_per_file)), *keys).sortWithinPartitions(*keys)
