"""Binary bodies against their JSON forms."""

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from heliograph.sources import ingest, wire


def varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def encode(doc: dict, layout: str, packed: bool = True) -> bytes:
    """The plain writer of the same layouts."""
    out = b""
    for number, (name, kind, many) in wire.LAYOUTS[layout].items():
        if name not in doc:
            continue
        values = doc[name] if many else [doc[name]]
        eight = {"fixed": lambda v: struct.pack("<Q", int(v)), "sfixed": lambda v: struct.pack("<q", int(v)), "double": lambda v: struct.pack("<d", float(v))}
        if many and packed and kind in eight:
            body = b"".join(map(eight[kind], values))
            out += varint(number << 3 | 2) + varint(len(body)) + body
            continue
        for v in values:
            if kind in eight:
                out += varint(number << 3 | 1) + eight[kind](v)
            elif kind in ("bool", "int", "enum"):
                out += varint(number << 3) + varint(int(v))
            else:
                body = encode(v, kind, packed) if kind in wire.LAYOUTS else v.encode() if kind == "text" else bytes.fromhex(v) if kind == "hex" else base64.b64decode(v)
                out += varint(number << 3 | 2) + varint(len(body)) + body
    return out


RES = {"attributes": [{"key": "service.name", "value": {"stringValue": "pay"}}, {"key": "zone", "value": {"stringValue": "z"}}]}
ATTRS = [
    {"key": "n", "value": {"intValue": "-5"}}, {"key": "ok", "value": {"boolValue": False}}, {"key": "d", "value": {"doubleValue": 2.5}},
    {"key": "list", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "ü"}]}}}, {"key": "http.status_code", "value": {"intValue": "503"}},
    {"key": "map", "value": {"kvlistValue": {"values": [{"key": "a", "value": {"stringValue": "b"}}]}}}, {"key": "none", "value": {}},
]
T, S = "0123456789abcdef" * 2, "00000000000000ab"
EX = [{"timeUnixNano": "7", "asDouble": 1.5, "traceId": T, "spanId": S}]
DOCS = {
    "logs": {"resourceLogs": [{"resource": RES, "scopeLogs": [{"logRecords": [
        {"timeUnixNano": "1700000000123456000", "severityNumber": 17, "body": {"stringValue": "failed {n}"}, "attributes": ATTRS, "traceId": T, "spanId": S},
        {"observedTimeUnixNano": "1700000001000000000", "severityText": "warn", "body": {"intValue": "4"}},
    ]}]}]},
    "traces": {"resourceSpans": [{"resource": RES, "scopeSpans": [{"spans": [
        {"traceId": T, "spanId": S, "name": "GET /", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "30", "status": {"code": 2}, "attributes": ATTRS},
        {"traceId": T, "spanId": "00000000000000ac", "parentSpanId": S, "kind": 3, "startTimeUnixNano": "10", "endTimeUnixNano": "5", "attributes": [{"key": "url.full", "value": {"stringValue": "http://x/otlp/v1/logs"}}]},
    ]}]}]},
    "metrics": {"resourceMetrics": [{"resource": RES, "scopeMetrics": [{"metrics": [
        {"name": "lat", "unit": "s", "histogram": {"dataPoints": [{"timeUnixNano": "10", "count": "4", "sum": 8.0, "explicitBounds": [1.0, 2.0], "bucketCounts": ["1", "3", "0"], "attributes": ATTRS, "exemplars": EX}]}},
        {"name": "hits", "sum": {"isMonotonic": True, "dataPoints": [{"timeUnixNano": "10", "asInt": "-7"}]}}, {"name": "temp", "gauge": {"dataPoints": [{"timeUnixNano": "11", "asDouble": 0.5, "exemplars": EX}]}},
    ]}]}]},
}
READ = {"logs": ("otlp_logs", ["props", "id"]), "traces": ("otlp_spans", ["attrs"]), "metrics": ("otlp_metrics", [])}


def plain(df, *without):
    df = df.drop(*without)
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("layout", sorted(DOCS))
def test_protobuf_is_read_as_its_json(spark, layout, packed):
    body = encode(DOCS[layout], layout, packed)
    unknown = varint(99 << 3 | 2) + b"\x02hi" + varint(98 << 3 | 5) + b"abcd" + varint(97 << 3) + b"\x01"
    assert wire.message(memoryview(body + unknown), layout) == DOCS[layout]
    name, without = READ[layout]
    bodies = spark.createDataFrame([(bytearray(body + unknown),), (bytearray(body[:-1]),), (None,), (bytearray(b""),), (bytearray(b"\xff" * 12),)], "content binary")
    lines = spark.createDataFrame([(json.dumps(DOCS[layout]),)], "value string")
    got = plain(getattr(wire, name)(bodies), *without)
    assert got and got == plain(getattr(ingest, name)(lines), *without)


def test_deep_or_odd_messages_are_dropped():
    value = b""
    for _ in range(3000):  # an array within an array, and so on
        inner = b"\x0a" + varint(len(value)) + value
        value = b"\x2a" + varint(len(inner)) + inner
    assert wire._or_none(lambda x: wire.message(memoryview(x), "any"), value) is None
    assert wire.message(memoryview(b"\x21" + struct.pack("<d", float("nan"))), "any") == {"doubleValue": "NaN"}


def pack(v) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        return bytes([v]) if 0 <= v < 128 else b"\xd3" + struct.pack(">q", v) if v < 2**63 else b"\xcf" + struct.pack(">Q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        b = v.encode()
        return (bytes([0xA0 | len(b)]) if len(b) < 32 else b"\xd9" + bytes([len(b)]) if len(b) < 256 else b"\xda" + struct.pack(">H", len(b))) + b
    if isinstance(v, list):
        return (bytes([0x90 | len(v)]) if len(v) < 16 else b"\xdc" + struct.pack(">H", len(v))) + b"".join(map(pack, v))
    return (bytes([0x80 | len(v)]) if len(v) < 16 else b"\xde" + struct.pack(">H", len(v))) + b"".join(pack(k) + pack(x) for k, x in v.items())


EVENTS = [
    {"@t": "2024-01-01T00:00:01Z", "@mt": "Order {Id} " + "x" * 300, "@l": "error", "service.name": "W", "@tr": T.upper(), "@x": {"type": "E", "msg": "late", "inner": {"type": "I"}}, "Id": -2**40, "Big": 2**64 - 1, "Ratio": 2.5, "On": True, "Nil": None, "Tags": [*range(20)]},
    {"@t": "2024-01-01T00:00:02Z", "@m": "ü" * 40, "@l": "odd", "@x": "boom", **{f"k{i}": i for i in range(20)}},
]


def test_msgpack_is_read_as_its_json(spark):
    body = pack([*EVENTS, 5])
    alone = pack(EVENTS[0])
    bodies = spark.createDataFrame([(bytearray(b),) for b in (body, alone, body[:-3], body + b"\x01", b"", b"\xc1")] + [(None,)], "content binary")
    lines = spark.createDataFrame([(json.dumps(e),) for e in [*EVENTS, EVENTS[0]]], "value string")
    got = plain(wire.clef(bodies), "props", "id")
    assert len(got) == 3 and got == plain(ingest.clef(lines), "props", "id")


def test_msgpack_types():
    read = lambda b: wire.msgpack(memoryview(b))[0]
    assert [read(bytes.fromhex(x)) for x in ("ff", "d0ff", "cd0100", "d1ff00", "ce00010000", "ca40200000")] == [-1, -1, 256, -256, 65536, 2.5]
    assert read(b"\xc4\x02hi") == "aGk=" and read(b"\xd4\x05x") == "eA=="
    assert read(b"\xd6\xff" + struct.pack(">I", 1)) == "1970-01-01T00:00:01Z"
    assert read(b"\xd7\xff" + struct.pack(">Q", (5000 << 34) | 1)) == "1970-01-01T00:00:01.000005Z"
    assert read(b"\xc7\x0c\xff" + struct.pack(">Iq", 0, -1)) == "1969-12-31T23:59:59Z"
    assert read(b"\x81\x01\x02") == {"1": 2}
