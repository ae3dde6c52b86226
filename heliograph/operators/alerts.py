"""Alerts: conditions over the three signals, the state machine, routing and messages, and retention."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.filters import compile_filter
from heliograph.operators import metrics, traces

SEVERITIES = ("info", "warning", "critical")


@dataclass(frozen=True)
class Rule:
    """Durations in seconds. reset_on_resolve: a resolved rule notifies anew when it fires again at once."""

    name: str
    op: str
    threshold: float
    for_s: int = 0
    cooldown_s: int = 0
    repeat_s: int = 0
    escalate_s: int = 0
    severity: str = "warning"
    source: str = "logs"
    reset_on_resolve: bool = True


def breaches(value: float, op: str, threshold: float) -> bool:
    return {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold}.get(op, False)


def log_condition(logs: DataFrame, text: str, start, end, most: int = 10_000) -> DataFrame:
    """value: matching logs in the window, at most 10 000."""
    rows = logs.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).filter(compile_filter(text))
    return rows.limit(most).agg(F.count("*").cast("double").alias("value"))


def metric_condition(points: DataFrame, name: str, op: str, start_ns: int, end_ns: int, agg: str = "last", **options) -> DataFrame:
    """value: the peak of a metric query for > and >=, its trough for < and <=; 0 where empty."""
    out = metrics.query(points, name, agg, start_ns=start_ns, end_ns=end_ns, **options)
    pick = F.max if op in (">", ">=") else F.min
    return out.agg(F.coalesce(pick("value"), F.lit(0.0)).alias("value"))


def trace_condition(spans: DataFrame, measure: str, start_ns: int, end_ns: int, service: str | None = None) -> DataFrame:
    """value: error_rate (per cent), span_count, p50, p95 or p99 (ms) of a service, or of the first by name;
    any other measure reads as p50; 0 where empty."""
    rows = traces.latency(traces.within(spans, start_ns, end_ns))
    if service:
        rows = rows.filter(F.upper("service") == service.upper())
    value = {"error_rate": F.col("errors") * 100.0 / F.col("spans"), "span_count": F.col("spans").cast("double"), "p95": F.col("p95_ms"), "p99": F.col("p99_ms")}.get(measure, F.col("p50_ms"))
    one = rows.orderBy("service").limit(1).select(value.alias("value"))
    return one.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


# ------------------------------------------------------------------ state


@dataclass
class State:
    state: str = "Ok"
    pending: int | None = None
    fired: int | None = None  # last notification
    firing: int | None = None
    notified: bool = False
    escalated: bool = False
    acknowledged: bool = False


@dataclass(frozen=True)
class Notice:
    at: int
    kind: str  # Ok, Firing, Repeat or Escalation
    value: float
    recorded: bool


@dataclass(frozen=True)
class Maintenance:
    """weekdays: Monday 0; start in minutes of the day; may run past midnight; up to a severity."""

    weekdays: frozenset[int] = frozenset(range(7))
    start_min: int = 0
    minutes: int = 0
    upto: str = "critical"

    def covers(self, at: int, severity: str) -> bool:
        if SEVERITIES.index(severity) > SEVERITIES.index(self.upto):
            return False
        day, minute = (at // 86400 + 3) % 7, at % 86400 // 60
        since = minute - self.start_min
        if day in self.weekdays and 0 <= since < self.minutes:
            return True
        return (day - 1) % 7 in self.weekdays and 0 <= since + 1440 < self.minutes


@dataclass
class Machine:
    """One rule's states over evaluations in time order."""

    rule: Rule
    silences: Iterable[tuple[int, int]] = ()
    maintenance: Iterable[Maintenance] = ()
    state: State = field(default_factory=State)

    def quiet(self, at: int) -> bool:
        return any(a <= at < b for a, b in self.silences) or any(m.covers(at, self.rule.severity) for m in self.maintenance)

    def acknowledge(self) -> None:
        """No repeats and no escalation until the rule resolves; of no effect unless it fires."""
        if self.state.state == "Firing":
            self.state.acknowledged = True

    def step(self, at: int, value: float) -> list[Notice]:
        """The notices of one evaluation; while silenced they are not sent, but states move on."""
        r, s, out = self.rule, self.state, []
        if not breaches(value, r.op, r.threshold):
            if s.state == "Firing":
                out.append(Notice(at, "Ok", value, True))
                notified = s.notified and not r.reset_on_resolve
                self.state = State(fired=s.fired, notified=notified)
            else:
                s.state, s.pending = "Ok", None
            return [] if self.quiet(at) else out
        if s.state in ("Ok", "NoData"):
            s.pending, s.state = at, "Firing" if r.for_s <= 0 else "Pending"
        elif s.state == "Pending" and at - s.pending >= r.for_s:
            s.state = "Firing"
        if s.state != "Firing":
            s.notified, s.firing, s.escalated = False, None, False
            return []
        s.firing = at if s.firing is None else s.firing
        if not s.notified:
            if s.fired is None or at - s.fired >= r.cooldown_s:
                s.fired, s.notified = at, True
                out.append(Notice(at, "Firing", value, True))
        elif not s.acknowledged and r.repeat_s > 0 and at - s.fired >= r.repeat_s:
            s.fired = at
            out.append(Notice(at, "Repeat", value, False))
        if r.escalate_s > 0 and not s.escalated and not s.acknowledged and at - s.firing >= r.escalate_s:
            s.escalated = True
            out.append(Notice(at, "Escalation", value, False))
        return [] if self.quiet(at) else out


def ticks(values: DataFrame, every: int, empty: float = 0.0) -> DataFrame:
    """values (rule, at, value) with a row for each tick between a rule's first and last, `empty` where none was
    measured: a rule is evaluated, and may resolve, when nothing happens."""
    ends = values.groupBy("rule").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    axis = ends.select("rule", F.explode(F.sequence("lo", "hi", F.lit(every).cast("bigint"))).alias("at"))
    return axis.join(values, ["rule", "at"], "left").select("rule", "at", F.coalesce("value", F.lit(empty)).alias("value"))


def timeline(values: DataFrame, rules: Mapping[str, Rule], silences: Mapping[str, Iterable[tuple[int, int]]] | None = None, maintenance: Iterable[Maintenance] = (), acknowledged: Mapping[str, Iterable[int]] | None = None) -> DataFrame:
    """values: rule, at (seconds), value. One row per evaluation: its state and notices; one task per rule.
    silences: by rule, from and until; acknowledged: by rule, the times at which someone took it over (in effect
    from the next evaluation until the rule resolves)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rule = group["rule"].iloc[0]
        machine = Machine(rules[rule], tuple((silences or {}).get(rule, ())), tuple(maintenance))
        marks = sorted((acknowledged or {}).get(rule, ()))
        out = []
        for row in group.sort_values("at").itertuples(index=False):
            while marks and marks[0] <= row.at:
                machine.acknowledge()
                marks.pop(0)
            notices = machine.step(int(row.at), float(row.value))
            out.append((row.rule, int(row.at), float(row.value), machine.state.state, ",".join(n.kind for n in notices)))
        return pd.DataFrame(out, columns=["rule", "at", "value", "state", "notices"])

    return values.filter(F.col("rule").isin(list(rules))).groupBy("rule").applyInPandas(run, "rule string, at bigint, value double, state string, notices string")


def route(notices: DataFrame, channels: DataFrame) -> DataFrame:
    """Which channels get which notices. notices: rule, kind, severity; channels: channel, tier, least
    (severity). A test goes to all; a resolve to those whose severity it reaches; firing and repeats to
    tier 1, escalations to tier 2, if the severity is reached."""
    rank = lambda c: F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), c)
    tier = F.when(F.col("kind") == "Escalation", 2).otherwise(1)
    reached = rank(F.col("severity")) >= rank(F.col("least"))
    both = notices.withColumn("_one", F.lit(1)).join(F.broadcast(channels.withColumn("_one", F.lit(1))), "_one").drop("_one")  # a handful of channels
    return both.filter((F.col("kind") == "Test") | ((F.col("kind") == "Ok") & reached) | (~F.col("kind").isin("Test", "Ok") & (F.col("tier") == tier) & reached))


def message(template: str) -> F.Column:
    """`{{name}}` and the like replaced by the columns of a notice."""
    out = F.lit(template)
    for key in ("name", "value", "threshold", "severity", "state", "source"):
        if "{{" + key + "}}" in template:
            out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return out


# ------------------------------------------------------------------ retention

#: Days that logs of a level stay; others stay `default` days (fixed values).
TTL_DAYS = {"Debug": 3}


def retained(logs: DataFrame, now, ttl: Mapping[str, int] = TTL_DAYS, default: int = 90) -> DataFrame:
    return logs.filter(~expired(now, ttl, default))


#: Days that metric points and spans stay (fixed values).
METRIC_DAYS, SPAN_DAYS = 30, 14


def retained_points(rows: DataFrame, now_ns: int, days: int = METRIC_DAYS, time: str = "ts_ns") -> DataFrame:
    """Points (spans: time="start_ns", days=SPAN_DAYS) that are no older than the days."""
    return rows.filter(F.col(time) >= now_ns - days * 86_400_000_000_000)


def expired(now, ttl: Mapping[str, int] = TTL_DAYS, default: int = 90) -> F.Column:
    days = F.lit(default)
    for level, n in ttl.items():
        days = F.when(F.col("level_name") == level, n).otherwise(days)
    return F.unix_seconds("ts") + days * 86400 < F.unix_seconds(F.lit(now).cast("timestamp"))
