"""The languages and operators over small fixtures."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from heliograph.functions import flow
from heliograph.functions.filters import FilterSyntaxError, compile_filter
from heliograph.functions.traceql import TraceQLError, compile_traceql
from heliograph.operators import alerts, logs, metrics, traces
from heliograph.sources import ingest, schema, sinks

CLEF = [
    {"@t": "2024-01-01T00:00:01Z", "@mt": "Order {OrderId} shipped to {Region}", "@l": "error", "service.name": "Wallet.API", "@tr": "0123456789ABCDEF" * 2, "@x": {"type": "TimeoutException", "msg": "timed out", "stk": "at Ship", "inner": {"type": "SocketException", "msg": "reset by peer"}}, "OrderId": "o-1", "Region": "ae-dxb", "Tags": ["urgent", "ops"], "Score": 12345, "Ratio": 2.5, "Enabled": True, "Mirror": "ae-dxb", "Body": '{"a":{"b":[155,"x"]},"s":"12 AED"}', "Xml": "<root><amount>155</amount></root>", "Enc": "aGVsbG8=", "Dur": "1.02:03:04.5"},
    {"@t": "2024-01-01T00:00:02Z", "@mt": "User {User} signed in", "service.name": "Auth.API", "User": "bob", "Region": "ae-auh", "http.request.method": "GET", "Empty": {}, "Nothing": None},
    {"@t": "2024-01-01T00:00:03Z", "@mt": "Retrying {Attempt}", "@l": "Warning", "service.name": "Wallet.API", "@x": "boom", "Region": "ae-shj", "http": {"route": "/orders", "method": "GET"}, "Deep": {"x": [{"y": "needle"}]}},
]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame([(json.dumps(e),) for e in CLEF] + [("not json",), ("[1]",)], "value string")
    return ingest.clef(df).withColumn("id", F.unix_seconds("ts") - 1_704_067_200 + 9000).cache()


MATCHES = {
    "@l = 'Error'": [9001], "Error": [9001], "warn": [9003], "not Error": [9002, 9003], "": [9001, 9002, 9003],
    "Exception.Inner.Type = 'socketexception'": [9001], "@x.exists = true": [9001, 9003], "@x.message = 'BOOM'": [9003],
    "Tags[0] = 'urgent'": [9001], "Tags = 'OPS'": [9001], "Tags != 'ops'": [9001, 9002, 9003], "elementAt(Tags, 1) = 'ops'": [9001],
    "http.request.method = 'get'": [9002], "http.method = 'GET'": [9003], "http['route'] like '/ord%'": [9003], "service.name like 'Wallet%'": [9001, 9003],
    "Region = Mirror": [9001], "'ae-auh' = Region": [9002], "Region in ['AE-DXB', 'ae-shj']": [9001, 9003], "Region not in ['ae-dxb']": [9002, 9003], "Region <> 'ae-dxb'": [9002, 9003],
    "Score > 9": [9001], "9 < Score": [9001], "Score = '12345'": [9001], "Ratio in [2.5]": [9001], "Enabled = true": [9001], "Enabled = 'TRUE'": [9001], "Enabled > false": [],
    "Missing = null": [9001, 9002, 9003], "Missing != 5": [9001, 9002, 9003], "Missing = 5": [], "has(Nothing)": [], "has(Region)": [9001, 9002, 9003], "isDefined(Score)": [9001],
    "length(Region) = 6 and length(Tags) = 3": [9001], "length(Missing) != 2": [9001, 9002, 9003], "toLower(Missing) != 'x'": [], "toJson(Missing) = 'null'": [9001, 9002, 9003],
    "fromJson(Body).a.b[0] = 155": [9001], "fromJson(Body).s like '%aed'": [9001], "has(fromJson(Body).a)": [9001], "contains(fromJson(Body).s, 'AED')": [9001], "fromJson(Body).a['b'][1] in ['X']": [9001], "fromJson(Region) = 5": [],
    "fromXml(Xml, 'root/amount') = '155'": [9001], "fromXml(Region, 'a') = 'x'": [], "fromBase64(Enc) = 'hello'": [9001], "toBase64(User) = 'Ym9i'": [9002], "fromBase64(Region) = 'x'": [],
    "timeSpan(Dur) = 937845000000": [9001], "totalMilliseconds(Dur) > 93784000": [9001], "toHexString(Score) = '0x3039'": [9001], "toTimeString(Score) = '00:00:00.0012345'": [9001], "round(Ratio, 0) = 3": [9001], "bucket(Score, 0.1) = 12000": [9001],
    "keys(http) = 'x'": [], "keys(Empty) = null": [9002], "typeOf(http) = 'object'": [9003], "typeOf(Missing) = 'null'": [9001, 9002, 9003],
    "substring(Region, 3) = 'dxb'": [9001], "substring(Region, 99) = ''": [], "coalesce(Missing, User) = 'BOB'": [9002], "concat(User, '@x') = 'bob@x'": [9002], "concat(Score, 'x') = '12345x'": [],
    "regexMatch(Region, '^ae-d')": [9001], "regexExtract(Region, 'ae-(...)') = 'shj'": [9003], "datePart(@t, 'second') = 2": [9002], "toIsoString(@t, 4) like '2024-01-01T04:00:0_.%+04:00'": [9001, 9002, 9003],
    "needle": [9003], "wallet": [], "'shipped to' order": [9001], "reset": [], "boom": [9003], "Tags = 'urgent' trailing": [9001], "@id >= 9002": [9002, 9003], "contains(@id, '900')": [9001, 9002, 9003],
    "@tr = '0123456789abcdef0123456789abcdef'": [9001], "(Error or warn) and not (Score > 0)": [9003],
}


def test_filters(events):
    flags = [compile_filter(text).alias(f"c{k}") for k, text in enumerate(MATCHES)]
    wrong = {}
    for at in range(0, len(flags), 12):
        rows = events.select("id", *flags[at : at + 12]).collect()
        for k, (text, ids) in list(enumerate(MATCHES.items()))[at : at + 12]:
            assert all(r[f"c{k}"] is not None for r in rows), f"{text} is null somewhere"
            got = sorted(r.id for r in rows if r[f"c{k}"])
            if got != ids:
                wrong[text] = got
    assert not wrong


def test_filter_errors():
    for text in ("(a = 1", "length(a = 1", "a in 5"):
        with pytest.raises(FilterSyntaxError):
            compile_filter(text)


def test_log_pages(events):
    first = logs.search(events, count=2).collect()
    assert [r.id for r in first] == [9003, 9002]
    rest = logs.search(events, count=2, after=(first[-1].ts, first[-1].id)).collect()
    assert [r.id for r in rest] == [9001]
    assert [r.id for r in logs.search(events, forward=True).collect()] == [9001, 9002, 9003]
    assert [r.message for r in logs.render(events).orderBy("id").select("message").collect()] == ["Order o-1 shipped to ae-dxb", "User bob signed in", "Retrying {Attempt}"]
    assert [r.service for r in logs.services(events).collect()] == ["Auth.API", "Wallet.API"]
    ids = [r.event_id for r in logs.event_ids(events, 1).orderBy("id").collect()]
    assert ids == [(k * 1000 << 22) | (1 << 12) for k in (1, 2, 3)]
    assert logs.auto_width(86400) == 900 and logs.chart_width(86400, 1) == 900 and logs.chart_width(3600, 10) == 10
    with pytest.raises(ValueError):
        logs.of_trace(events, "xyz")


def _spans(spark):
    ms = 1_000_000
    rows = [
        ("a", "a1", None, 10, 5 * ms, "GET /orders", "api", 1, 1, 200), ("a", "a2", "a1", 11, 3 * ms, "SELECT", "db", 2, 0, 0),
        ("b", "b1", None, 20, 8 * ms, "POST /pay", "api", 1, 2, 500), ("c", "c1", "zz", 30, 2 * ms, "work", "worker", 0, 0, 0),
    ]
    cols = "trace_id string, span_id string, parent_span_id string, start_ns bigint, duration_ns bigint, name string, service string, kind int, status int, http_status int"
    return spark.createDataFrame(rows, cols).withColumn("attrs", F.parse_json(F.lit('{"k":"V","n":"5"}')))


def test_traces(spark):
    spans = _spans(spark)
    rows = {r.trace_id: r for r in traces.summaries(spans).collect()}
    assert (rows["a"].span_count, rows["a"].services, rows["a"].duration_ns) == (2, ["api", "db"], 5_000_000)
    assert (rows["c"].name, rows["c"].service, rows["c"].start_ns, rows["c"].duration_ns) == ("", "worker", 30, 0)
    assert [r.trace_id for r in traces.trace_list(spans, http="5xx").collect()] == ["b"]
    assert [(r.from_service, r.to_service, r.calls) for r in traces.graph_edges(spans).collect()] == [("api", "db", 1)]
    assert {r.span_id: (r.depth, r.self_ms) for r in traces.flamegraph(spans, "a").collect()} == {"a1": (0, 2.0), "a2": (1, 3.0)}
    assert traces.deduplicate(spans.unionByName(spans)).count() == 4
    for text, ids in {'{ .k = "v" }': "abc", "{ .n > 4 && kind = server }": "ab", "{}": "abc", "{ .missing != 1 }": "", "{ duration >= 3ms && !(status = error) }": "a", "{ .http.status_code < 300 }": "ac", '{ name =~ "WORK" || service = "db" }': "ac"}.items():
        assert sorted(r.trace_id for r in traces.traceql(spans, text).collect()) == list(ids), text
    for text in ("{ .a = }", "x", "{ duration = abc }"):
        with pytest.raises(TraceQLError):
            compile_traceql(text)


def test_metrics(spark):
    s = 10**9
    rows = [("m", "Counter", "1", {"i": i}, t * s, float(v), None, None, None, None, None) for i, points in {"x": [(0, 5), (10, 15), (20, 3)], "y": [(0, 0), (10, 10)]}.items() for t, v in points]
    rows += [("h", "Histogram", "s", {"i": "x"}, t * s, None, sum(b), 0.0, [1.0, 2.0], b, None) for t, b in ((0, [1, 0, 0]), (10, [3, 2, 0]), (20, [1, 0, 1]))]
    df = spark.createDataFrame(rows, "name string, kind string, unit string, labels map<string,string>, ts_ns bigint, value double, count bigint, sum double, bounds array<double>, buckets array<bigint>, exemplars array<struct<ts_ns:bigint,value:double,trace_id:string,span_id:string>>")
    got = {(r.ts_ns // s): r.value for r in metrics.query(df, "M", "rate", by=["none"]).collect()}
    assert got == {10: 2.0, 20: 0.3}
    assert metrics.query(df, "m", "increase", topk=1).count() == 1
    assert [r.value for r in metrics.query(df, "m", "last", by=["none"]).collect()] == [13.0]
    assert {r.ts_ns // s: r.value for r in metrics.query(df, "h", "quantile", q=0.5, by=["none"]).collect()} == {10: 1.0, 20: 1.0}
    assert metrics.query(df, "m", "none", labels={"i": "x|z"}).count() == 3 and metrics.parse_step("00:00:15") == 15 * s and metrics.parse_step("5m") == 300 * s
    assert [(r.ts_ns, r.value) for r in metrics.query(df, "m", "none", labels={"i": "x"}, step="1m").collect()] == [(0, 3.0)]


def test_alert_machine(spark):
    m = alerts.Machine(alerts.Rule("r", ">", 5, for_s=60, repeat_s=120, escalate_s=180))
    kinds = [[n.kind for n in m.step(t, 9 if t < 600 else 1)] for t in range(0, 720, 60)]
    assert kinds == [[], ["Firing"], [], ["Repeat"], ["Escalation"], ["Repeat"], [], ["Repeat"], [], ["Repeat"], ["Ok"], []]
    again = alerts.Machine(alerts.Rule("r", ">", 5))
    assert [[n.kind for n in again.step(t, v)] for t, v in ((0, 9), (1, 1), (2, 9))] == [["Firing"], ["Ok"], ["Firing"]]
    old = alerts.Machine(alerts.Rule("r", ">", 5, reset_on_resolve=False))
    assert [[n.kind for n in old.step(t, v)] for t, v in ((0, 9), (1, 1), (2, 9))] == [["Firing"], ["Ok"], []]
    night = alerts.Maintenance(frozenset([3]), 23 * 60, 120, "warning")  # Thursdays from 23:00, two hours
    assert night.covers(23 * 3600, "warning") and night.covers(24 * 3600 + 1800, "warning") and not night.covers(26 * 3600, "warning") and not night.covers(23 * 3600, "critical")
    quiet = alerts.Machine(alerts.Rule("r", ">", 5), silences=[(0, 10)])
    assert quiet.step(0, 9) == [] and quiet.state.state == "Firing"
    notices = spark.createDataFrame([("r", "Firing", "critical"), ("r", "Test", "info"), ("r", "Escalation", "warning")], "rule string, kind string, severity string")
    channels = spark.createDataFrame([("a", 1, "warning"), ("b", 2, "critical")], "channel string, tier int, least string")
    assert sorted((r.kind, r.channel) for r in alerts.route(notices, channels).collect()) == [("Firing", "a"), ("Test", "a"), ("Test", "b")]


def test_flow_and_sinks(spark, events, tmp_path):
    row = spark.createDataFrame([('{"a":[1,{"b":"x"}]}', {"ETag": "7"}, 200)], "body string, headers map<string,string>, status int")
    got = row.select(flow.extract("json", "$.a[-1].b"), flow.extract("header", "etag"), flow.extract("status", ""), flow.extract("regex", '"b":"(.)"'), flow.extract("xpath", "a")).first()
    assert list(got) == ["x", "7", "200", "x", None]
    assert flow.substitute("{{a}}-{{b}}", {"a": "1"}) == "1-{{b}}"
    sinks.write_logs(events, str(tmp_path / "logs"))
    back = spark.read.parquet(str(tmp_path / "logs"))
    assert back.count() == 3 and {"date", "level_name"} <= set(back.columns)
    assert json.loads(sinks.as_json(events.select("id", "mt").orderBy("id")).first().value)["id"] == 9001
    assert sinks.compact(events).count() == 3


def test_tail_stream(spark, tmp_path):
    from heliograph.streaming import tail

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(json.dumps(e) for e in CLEF))
    stream = tail.tail(tail.read_clef(spark, str(tmp_path / "in")), "@l = 'Error'").select("mt")
    q = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tailed").count() == 1


def test_written_tables_prune(spark, tmp_path):
    """Readers give back what was written, and days, levels and names become partition filters."""
    from heliograph.sources import schema

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    logs, spans, points = schema.logs(spark, sf), schema.spans(spark, sf), schema.metrics(spark, sf)
    sinks.write_logs(logs, str(tmp_path / "l"))
    sinks.write_spans(spans, str(tmp_path / "s"))
    sinks.write_metrics(points, str(tmp_path / "m"))

    def rows(df, *columns):
        return sorted(map(str, df.select(*columns).collect()))

    def plan(df):
        return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    shown = ("id", "ts", "level_name", "props_json", "search_text", "tr")
    assert rows(sinks.read_logs(spark, str(tmp_path / "l"), deep=False), *shown) == rows(logs, *shown)
    day = ("2024-01-05 00:00:00", "2024-01-06 12:00:00")
    got = sinks.read_logs(spark, str(tmp_path / "l"), *day, levels=["error", "WARNING"], deep=False)
    want = logs.filter(F.col("ts").between(*(F.lit(x).cast("timestamp") for x in day))).filter("level_name in ('Error', 'Warning')")
    assert rows(got, *shown) == rows(want, *shown) and got.count()
    filters = re.search(r"PartitionFilters: \[(.*)\]", plan(got))[1]
    assert "date" in filters and "level_name" in filters
    ends = spans.agg(F.min("start_ns"), F.max("start_ns")).first()
    middle = (ends[0] + ends[1]) // 2
    shown = ("trace_id", "span_id", "start_ns", "duration_ns", F.to_json("attrs").alias("attrs"))
    got = sinks.read_spans(spark, str(tmp_path / "s"), middle)
    assert rows(got, *shown) == rows(spans.filter(F.col("start_ns") >= middle), *shown)
    assert "date" in re.search(r"PartitionFilters: \[(.*)\]", plan(got))[1]
    got = sinks.read_metrics(spark, str(tmp_path / "m"), "EVENT.size")
    shown = ("name", "ts_ns", "count", "buckets")
    assert rows(got, *shown) == rows(points.filter("name = 'event.size'"), *shown) and "metric" in plan(got)


def test_deduplication_is_ordered(spark):
    """Of several spans of one id the earliest stays; of several points the last to arrive."""
    shape = "trace_id string, span_id string, parent_span_id string, start_ns bigint, duration_ns bigint, name string, service string, status int, http_status int"
    rows = [("t", "a", None, 5, 1, "late", "s", 0, 0), ("t", "a", None, 3, 9, "early", "s", 0, 0), ("t", "", None, 1, 1, "x", "s", 0, 0), ("t", "", None, 1, 1, "x", "s", 0, 0), ("t", None, None, 1, 1, "y", "s", 0, 0)]
    got = traces.deduplicate(spark.createDataFrame(rows, shape))
    assert sorted(r.name for r in got.collect()) == ["early", "x", "x", "y"]
    points = spark.createDataFrame([("m", "k", 1, {"a": "b"}, v, None, None, q) for v, q in ((9.0, 0), (2.0, 2), (5.0, 1))], "name string, key string, ts_ns bigint, labels map<string,string>, value double, count bigint, sum double, seq bigint")
    assert [r.value for r in metrics.deduplicate(points).collect()] == [2.0]


def test_ticks_silences_and_acknowledgement(spark):
    """A rule resolves on a tick without a value; an acknowledged one neither repeats nor escalates; a silence hides notices."""
    values = spark.createDataFrame([("r", t, 9.0) for t in (0, 60, 120, 240, 300, 360)], "rule string, at bigint, value double")
    rule = alerts.Rule("r", ">", 1, repeat_s=60, escalate_s=60)
    dense = alerts.ticks(values, 60)
    assert [r.value for r in dense.orderBy("at").collect()] == [9.0, 9.0, 9.0, 0.0, 9.0, 9.0, 9.0]
    run = lambda **k: [(r.at, r.notices) for r in alerts.timeline(dense, {"r": rule}, **k).orderBy("at").collect()]
    assert run() == [(0, "Firing"), (60, "Repeat,Escalation"), (120, "Repeat"), (180, "Ok"), (240, "Firing"), (300, "Repeat,Escalation"), (360, "Repeat")]
    assert run(acknowledged={"r": [50]}) == [(0, "Firing"), (60, ""), (120, ""), (180, "Ok"), (240, "Firing"), (300, "Repeat,Escalation"), (360, "Repeat")]
    assert run(silences={"r": [(100, 300)]}) == [(0, "Firing"), (60, "Repeat,Escalation"), (120, ""), (180, ""), (240, ""), (300, "Repeat,Escalation"), (360, "Repeat")]


def test_exemplars_lead_to_spans(spark):
    spans = spark.createDataFrame([("t", "a", None, 5, 7, "op", "s", 0, 0)], "trace_id string, span_id string, parent_span_id string, start_ns bigint, duration_ns bigint, name string, service string, status int, http_status int")
    found = spark.createDataFrame([(1, 2.0, "t", "a"), (2, 3.0, "u", "b")], "ts_ns bigint, value double, trace_id string, span_id string")
    assert sorted((r.ts_ns, r.name) for r in traces.exemplar_spans(found, spans).collect()) == [(1, "op"), (2, None)]


def _made(spark, text, body):
    """How often the plan of a filter over logs makes what: texts of structs, variants, XPath."""
    body = F.to_json(F.struct(body.alias("Body"), F.col("id").alias("n")))
    rows = spark.range(10).select("id", F.current_timestamp().alias("ts"), F.lit(1).alias("level"), F.lit("m").alias("mt"), body.alias("props_json"))
    df = schema.as_logs(rows, deep=False).filter(compile_filter(text)).select("id")
    condition = df._jdf.queryExecution().optimizedPlan().toString()
    return [r.id for r in df.collect()], [condition.count(x) for x in ("StructsToJsonEvaluator(", "parseJson(", "XPathStringEvaluator(")]


def test_json_of_a_row_is_made_once(spark):
    """A filter pushed below the view of logs makes the text and its variant once, whatever it reads of them."""
    body = F.to_json(F.struct(F.concat(F.lit("s"), "id").alias("s")))
    ids, (texts, parsed, _) = _made(spark, "fromJson(Body).s like '%3' or (startsWith(fromJson(Body).s, 'S') and n > 1) or ci_contains(fromJson(Body).s, 'S5') or n in [7]", body)
    assert ids == [3, 5, 7]
    assert (texts, parsed) == (2, 4)  # the row's two texts; its variant and one for each fromJson


def test_xml_of_a_row_is_read_once(spark):
    """A function's result is compared, not computed again for each mention in the comparison."""
    xml = F.concat(F.lit("<r><a>"), "id", F.lit("</a></r>"))
    ids, (texts, parsed, read) = _made(spark, "fromXml(Body, 'r/a') = '5'", xml)
    assert ids == [5] and (texts, parsed) == (1, 1)
    assert read == 2  # of a value, and of an array's elements


def _first_aggregate(df):
    """The aggregate that meets the rows, deepest in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate(" in line][-1]


def test_latency_counts_in_hash_tables(spark):
    """No task sorts its spans to count them; services that differ by case are one, in any bucket."""
    ms = 1_000_000
    rows = [("t", "Api", 2, ms - 1), ("t", "api", 0, ms), ("t", "API", 2, 2_000_000 * ms), ("t", "api", 0, None), ("t", None, 1, 7 * ms)]
    spans = spark.createDataFrame(rows, "trace_id string, service string, status int, duration_ns bigint")
    assert "HashAggregate" in _first_aggregate(traces.latency(spans))
    got = {r.service: r for r in traces.latency(spans).collect()}
    assert set(got) == {"API", None}
    r = got["API"]
    assert (r.spans, r.errors, r.min_ms, r.max_ms) == (4, 2, (ms - 1) / ms, 2_000_000.0)
    assert r.counts == [1, 1, *[0] * 16, 2] and got[None].counts == [0, 0, 1, *[0] * 16]
    assert r.p50_ms == 5.0
    assert [x.counts for x in traces.latency(spans.filter("false")).collect()] == []
    empty = traces.trace_stats(_spans(spark).filter("false"), 0, 10**12).first()
    assert (empty.traces, empty.error_rate, empty.p95_ms) == (0, 0.0, 0.0)


def test_graph_nodes_count_in_hash_tables(spark):
    """Nodes sort no spans to count them; a service at an end of a call has all its spans, whatever their case."""
    rows = [("t", "1", None, "Api", 2, 3_000_000), ("t", "2", "1", "db", 0, 500_000), ("u", "3", None, "api", 0, 3_000_000), ("u", "4", "3", "api", 0, 1), ("v", "5", None, "alone", 0, 1)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, status int, duration_ns bigint")
    nodes = traces.graph_nodes(spans)
    assert "HashAggregate" in _first_aggregate(nodes)
    assert "bucket" not in nodes._jdf.queryExecution().optimizedPlan().toString().split("explode", 1)[1].split("Aggregate [_groupingexpression", 1)[0]  # the calls are not counted
    assert sorted((r.service, r.spans, round(r.error_rate, 3), r.p95_ms) for r in nodes.collect()) == [("Api", 3, 0.333, 5.0), ("db", 1, 0.0, 1.0)]
