"""Binary request bodies: OTLP protobuf and CLEF msgpack, one body a row, as the JSON text that `ingest` reads.

A body is read in an Arrow batch UDF, so it meets the same flattening as its JSON form. A malformed or null
body gives null, which the readers drop; unknown fields are skipped; of a repeated scalar the last stays."""

from __future__ import annotations

import base64
import datetime
import json
import math
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from heliograph.sources import ingest

#: Message layouts by field number: name, kind, repeated (fixed values of the public OTLP schema). A kind is a
#: layout's name or one of text, hex, base64, bool, int, enum, fixed, sfixed, double.
LAYOUTS: dict[str, dict[int, tuple[str, str, bool]]] = {
    "any": {1: ("stringValue", "text", False), 2: ("boolValue", "bool", False), 3: ("intValue", "int", False), 4: ("doubleValue", "double", False), 5: ("arrayValue", "array", False), 6: ("kvlistValue", "kvlist", False), 7: ("bytesValue", "base64", False)},
    "array": {1: ("values", "any", True)},
    "kvlist": {1: ("values", "pair", True)},
    "pair": {1: ("key", "text", False), 2: ("value", "any", False)},
    "resource": {1: ("attributes", "pair", True)},
    "logs": {1: ("resourceLogs", "resource_logs", True)},
    "resource_logs": {1: ("resource", "resource", False), 2: ("scopeLogs", "scope_logs", True)},
    "scope_logs": {2: ("logRecords", "log", True)},
    "log": {1: ("timeUnixNano", "fixed", False), 2: ("severityNumber", "enum", False), 3: ("severityText", "text", False), 5: ("body", "any", False), 6: ("attributes", "pair", True), 9: ("traceId", "hex", False), 10: ("spanId", "hex", False), 11: ("observedTimeUnixNano", "fixed", False)},
    "traces": {1: ("resourceSpans", "resource_spans", True)},
    "resource_spans": {1: ("resource", "resource", False), 2: ("scopeSpans", "scope_spans", True)},
    "scope_spans": {2: ("spans", "span", True)},
    "span": {1: ("traceId", "hex", False), 2: ("spanId", "hex", False), 4: ("parentSpanId", "hex", False), 5: ("name", "text", False), 6: ("kind", "enum", False), 7: ("startTimeUnixNano", "fixed", False), 8: ("endTimeUnixNano", "fixed", False), 9: ("attributes", "pair", True), 15: ("status", "status", False)},
    "status": {3: ("code", "enum", False)},
    "metrics": {1: ("resourceMetrics", "resource_metrics", True)},
    "resource_metrics": {1: ("resource", "resource", False), 2: ("scopeMetrics", "scope_metrics", True)},
    "scope_metrics": {2: ("metrics", "metric", True)},
    "metric": {1: ("name", "text", False), 3: ("unit", "text", False), 5: ("gauge", "numbers", False), 7: ("sum", "numbers", False), 9: ("histogram", "histogram", False)},
    "numbers": {1: ("dataPoints", "number", True), 3: ("isMonotonic", "bool", False)},
    "number": {3: ("timeUnixNano", "fixed", False), 4: ("asDouble", "double", False), 5: ("exemplars", "exemplar", True), 6: ("asInt", "sfixed", False), 7: ("attributes", "pair", True)},
    "histogram": {1: ("dataPoints", "histogram_point", True)},
    "histogram_point": {3: ("timeUnixNano", "fixed", False), 4: ("count", "fixed", False), 5: ("sum", "double", False), 6: ("bucketCounts", "fixed", True), 7: ("explicitBounds", "double", True), 8: ("exemplars", "exemplar", True), 9: ("attributes", "pair", True)},
    "exemplar": {2: ("timeUnixNano", "fixed", False), 3: ("asDouble", "double", False), 4: ("spanId", "hex", False), 5: ("traceId", "hex", False), 6: ("asInt", "sfixed", False), 7: ("filteredAttributes", "pair", True)},
}

_BROKEN = (ValueError, IndexError, struct.error, RecursionError, OverflowError, TypeError)


def _number(x: float):
    """A double as proto3 JSON has it."""
    return x if math.isfinite(x) else "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"


#: What eight bytes are, by kind.
_EIGHT = {"fixed": lambda b: str(int.from_bytes(b, "little")), "sfixed": lambda b: str(int.from_bytes(b, "little", signed=True)), "double": lambda b: _number(struct.unpack("<d", b)[0])}
_VARINT = {"bool": bool, "int": lambda u: str(u - 2**64 if u >= 2**63 else u), "enum": lambda u: int.from_bytes((u & 0xFFFFFFFF).to_bytes(4, "little"), "little", signed=True)}
_BYTES = {"text": lambda b: str(b, "utf-8", "replace"), "hex": lambda b: b.hex(), "base64": lambda b: base64.b64encode(b).decode()}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & (2**64 - 1), at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def message(data: memoryview, layout: str) -> dict:
    """One protobuf message as a dictionary in the JSON form's names."""
    out: dict = {}
    fields, at, end = LAYOUTS[layout], 0, len(data)
    while at < end:
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            raw, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError("wire type")
        if at > end:
            raise ValueError("cut short")
        if tag >> 3 not in fields:
            continue
        name, kind, many = fields[tag >> 3]
        if wire == 0 and kind in _VARINT:
            found = [_VARINT[kind](raw)]
        elif wire == 1 and kind in _EIGHT:
            found = [_EIGHT[kind](raw)]
        elif wire == 2 and kind in _BYTES:
            found = [_BYTES[kind](raw)]
        elif wire == 2 and kind in _EIGHT and many and len(raw) % 8 == 0:  # packed
            found = [_EIGHT[kind](raw[k : k + 8]) for k in range(0, len(raw), 8)]
        elif wire == 2 and kind in LAYOUTS:
            found = [message(raw, kind)]
        else:
            continue
        if many:
            out.setdefault(name, []).extend(found)
        else:
            out[name] = found[-1]
    return out


def msgpack(data: memoryview, at: int = 0) -> tuple[object, int]:
    """The value that starts at `at`, and where it ends. Binary is base64, a timestamp ISO text in UTC."""
    first = data[at]
    at += 1

    def take(size: int) -> memoryview:
        if at + size > len(data):
            raise ValueError("cut short")
        return data[at : at + size]

    def items(count: int, at: int) -> tuple[list, int]:
        out = []
        for _ in range(count):
            value, at = msgpack(data, at)
            out.append(value)
        return out, at

    def pairs(count: int, at: int) -> tuple[dict, int]:
        flat, at = items(2 * count, at)
        return {k if isinstance(k, str) else json.dumps(k): v for k, v in zip(flat[::2], flat[1::2], strict=True)}, at

    if first < 0x80:
        return first, at
    if first >= 0xE0:
        return first - 256, at
    if first < 0x90:
        return pairs(first & 15, at)
    if first < 0xA0:
        return items(first & 15, at)
    if first < 0xC0:
        return _BYTES["text"](take(first & 31)), at + (first & 31)
    if first in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[first], at
    if first == 0xCA:
        return _number(struct.unpack(">f", take(4))[0]), at + 4
    if first == 0xCB:
        return _number(struct.unpack(">d", take(8))[0]), at + 8
    if 0xCC <= first <= 0xD3:  # integers of 1, 2, 4 and 8 bytes, without and with sign
        size = 1 << (first & 3)
        return int.from_bytes(take(size), "big", signed=first >= 0xD0), at + size
    if first in (0xD4, 0xD5, 0xD6, 0xD7, 0xD8):
        head, size = 0, 1 << (first - 0xD4)
    elif first in (0xC4, 0xC7, 0xD9):
        head, size = 1, take(1)[0]
    elif first in (0xC5, 0xC8, 0xDA, 0xDC, 0xDE):
        head, size = 2, int.from_bytes(take(2), "big")
    elif first in (0xC6, 0xC9, 0xDB, 0xDD, 0xDF):
        head, size = 4, int.from_bytes(take(4), "big")
    else:
        raise ValueError("type byte")
    at += head
    if first in (0xDC, 0xDD):
        return items(size, at)
    if first in (0xDE, 0xDF):
        return pairs(size, at)
    if first in (0xD9, 0xDA, 0xDB):
        return _BYTES["text"](take(size)), at + size
    if first in (0xC4, 0xC5, 0xC6):
        return _BYTES["base64"](take(size)), at + size
    kind = int.from_bytes(take(1), "big", signed=True)
    at += 1
    body = take(size)
    if kind != -1 or size not in (4, 8, 12):
        return _BYTES["base64"](body), at + size
    whole = int.from_bytes(body, "big")
    nanos, seconds = (0, whole) if size == 4 else (whole >> 34, whole & (2**34 - 1)) if size == 8 else (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:], "big", signed=True))
    when = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds, microseconds=nanos // 1000)
    return when.isoformat() + "Z", at + size


def _events(body: bytes) -> list[str]:
    """The maps of an array (or one map alone) as JSON lines; what is no map stays out."""
    value, at = msgpack(memoryview(body))
    if at != len(body):
        raise ValueError("bytes after the value")
    return [json.dumps(v) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]


def _or_none(read, body: bytes | None):
    try:
        return None if body is None else read(body)
    except _BROKEN:
        return None


def proto_json(bodies: DataFrame, layout: str, column: str = "content") -> DataFrame:
    """value: the JSON text of each body in `column` (as spark.read.format("binaryFile") has it)."""

    @F.pandas_udf(StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: _or_none(lambda x: json.dumps(message(memoryview(x), layout)), b))

    return bodies.select(decode(column).alias("value"))


def msgpack_json(bodies: DataFrame, column: str = "content") -> DataFrame:
    """value: the JSON text of each event of each body in `column`."""

    @F.pandas_udf(ArrayType(StringType()))
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: _or_none(_events, b))

    return bodies.select(F.explode(decode(column)).alias("value"))


def otlp_logs(bodies: DataFrame, column: str = "content") -> DataFrame:
    return ingest.otlp_logs(proto_json(bodies, "logs", column))


def otlp_spans(bodies: DataFrame, column: str = "content") -> DataFrame:
    return ingest.otlp_spans(proto_json(bodies, "traces", column))


def otlp_metrics(bodies: DataFrame, column: str = "content") -> DataFrame:
    return ingest.otlp_metrics(proto_json(bodies, "metrics", column))


def clef(bodies: DataFrame, column: str = "content", now=None) -> DataFrame:
    return ingest.clef(msgpack_json(bodies, column), now)
