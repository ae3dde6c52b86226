"""Continuous queries: the live tail and alert evaluation over a stream of logs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.filters import compile_filter
from heliograph.operators.alerts import Rule
from heliograph.sources.ingest import clef


def read_clef(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return clef(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def tail(logs: DataFrame, text: str | None = None) -> DataFrame:
    """A stream's matching logs: stateless, nothing is late and nothing dropped."""
    return logs.filter(compile_filter(text))


def counts(logs: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Logs by window and level; windows close `delay` after the newest event."""
    return logs.withWatermark("ts", delay).groupBy(F.window("ts", width), "level_name").count()


def alert_ticks(logs: DataFrame, rules: Mapping[str, tuple[Rule, str]], emit: Callable[[DataFrame, int], None], every: str = "15 seconds"):
    """Each batch's matching rows by rule, given to `emit` (rule, value, breached) as a foreachBatch sink."""

    def batch(df: DataFrame, n: int) -> None:
        sums = [F.count_if(compile_filter(text)).cast("double").alias(name) for name, (_, text) in rules.items()]
        row = df.agg(*sums)
        pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("value"), F.lit(r.threshold).alias("threshold"), F.lit(r.op).alias("op")) for name, (r, _) in rules.items()))).alias("e")
        out = row.select(pairs).select("e.*")
        v, t = F.col("value"), F.col("threshold")
        emit(out.withColumn("breached", F.when(F.col("op") == ">", v > t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "<", v < t).otherwise(v <= t)), n)

    return logs.writeStream.foreachBatch(batch).trigger(processingTime=every)
