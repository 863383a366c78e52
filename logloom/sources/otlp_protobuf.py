"""OTLP bodies in protobuf, gzip or JSON, brought to the JSON text that ingest.otlp_logs and ingest.otlp_spans take."""

from __future__ import annotations

import base64
import gzip
import json
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logloom.session import ship
from logloom.sources.ingest import body_kind

#: Field numbers of the public OTLP messages: number: (JSON name, kind). A kind in capitals is a message, one in [] repeats.
FIELDS = {
    "LOGS": {1: ("resourceLogs", ["RESOURCE_LOGS"])},
    "RESOURCE_LOGS": {1: ("resource", "RESOURCE"), 2: ("scopeLogs", ["SCOPE_LOGS"])},
    "SCOPE_LOGS": {1: ("scope", "SCOPE"), 2: ("logRecords", ["LOG_RECORD"])},
    "LOG_RECORD": {
        1: ("timeUnixNano", "fixed"), 2: ("severityNumber", "number"), 3: ("severityText", "text"), 5: ("body", "VALUE"), 6: ("attributes", ["KEY_VALUE"]),
        9: ("traceId", "id"), 10: ("spanId", "id"), 11: ("observedTimeUnixNano", "fixed"),
    },
    "SPANS": {1: ("resourceSpans", ["RESOURCE_SPANS"])},
    "RESOURCE_SPANS": {1: ("resource", "RESOURCE"), 2: ("scopeSpans", ["SCOPE_SPANS"])},
    "SCOPE_SPANS": {1: ("scope", "SCOPE"), 2: ("spans", ["SPAN"])},
    "SPAN": {
        1: ("traceId", "id"), 2: ("spanId", "id"), 4: ("parentSpanId", "id"), 5: ("name", "text"), 6: ("kind", "number"), 7: ("startTimeUnixNano", "fixed"),
        8: ("endTimeUnixNano", "fixed"), 9: ("attributes", ["KEY_VALUE"]), 11: ("events", ["EVENT"]), 13: ("links", ["LINK"]), 15: ("status", "STATUS"),
    },
    "EVENT": {1: ("timeUnixNano", "fixed"), 2: ("name", "text"), 3: ("attributes", ["KEY_VALUE"])},
    "LINK": {1: ("traceId", "id"), 2: ("spanId", "id"), 4: ("attributes", ["KEY_VALUE"])},
    "STATUS": {2: ("message", "text"), 3: ("code", "number")},
    "RESOURCE": {1: ("attributes", ["KEY_VALUE"])},
    "SCOPE": {1: ("name", "text"), 2: ("version", "text")},
    "KEY_VALUE": {1: ("key", "text"), 2: ("value", "VALUE")},
    "VALUE": {
        1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "long"), 4: ("doubleValue", "double"), 5: ("arrayValue", "VALUES"), 6: ("kvlistValue", "KEY_VALUES"),
        7: ("bytesValue", "base64"),
    },
    "VALUES": {1: ("values", ["VALUE"])},
    "KEY_VALUES": {1: ("values", ["KEY_VALUE"])},
}
#: Wire types, and how each kind of value is read from what its wire type gives.
VARINT, EIGHT, BYTES, FOUR = 0, 1, 2, 5
signed = lambda n: n - (1 << 64) if n >> 63 else n
KINDS = {
    "text": (BYTES, lambda b: bytes(b).decode("utf-8", "replace")), "id": (BYTES, lambda b: bytes(b).hex()), "base64": (BYTES, lambda b: base64.b64encode(b).decode()),
    "number": (VARINT, signed), "long": (VARINT, lambda n: str(signed(n))), "bool": (VARINT, bool), "fixed": (EIGHT, lambda b: str(int.from_bytes(b, "little"))),
    "double": (EIGHT, lambda b: struct.unpack("<d", b)[0]),
}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    n = 0
    for shift in range(0, 70, 7):
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n & (1 << 64) - 1, at
    raise ValueError("varint of more than ten bytes")


def _fields(data: memoryview):
    """(number, wire type, value) of a message's fields in their order."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == VARINT:
            value, at = _varint(data, at)
        elif wire in (EIGHT, FOUR, BYTES):
            size, at = _varint(data, at) if wire == BYTES else (8 if wire == EIGHT else 4, at)
            if size > len(data) - at:
                raise ValueError("message ends early")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, wire, value


def message(data: memoryview, name: str) -> dict:
    """A message as OTLP/JSON has it. Unknown fields are passed over; of a field that doesn't repeat, and of a value's kinds, the last counts."""
    out: dict = {}
    for number, wire, value in _fields(data):
        field, kind = FIELDS[name].get(number, (None, None))
        many, kind = isinstance(kind, list), kind[0] if isinstance(kind, list) else kind
        wanted, read = KINDS.get(kind, (BYTES, lambda b, k=kind: message(b, k)))
        if field is None or wire != wanted:
            continue
        if name == "VALUE":
            out.clear()
        if many:
            out.setdefault(field, []).append(read(value))
        else:
            out[field] = read(value)
    return out


def as_json(body: bytes | None, kind: str, name: str) -> str | None:
    """A body's JSON text; null for one that can't be read. Gzip is known by its first bytes, and JSON in a protobuf request by its brace."""
    if body is None:
        return None
    try:
        plain = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else bytes(body)
        if kind == "json" or plain.lstrip()[:1] == b"{":
            text = plain.decode("utf-8")
            json.loads(text)
            return text
        return json.dumps(message(memoryview(plain), name))
    except (ValueError, IndexError, EOFError, OSError, RecursionError, zlib.error):
        return None


def decoded(requests: DataFrame, signal: str) -> DataFrame:
    """Requests (content_type, body as bytes) of one signal, logs or spans, with body as JSON text.

    An unknown or missing content type is taken for JSON. A body that can't be read (null, cut off, no such format)
    has null, and otlp_logs and otlp_spans make no rows of it: `where body is null` is the quarantine.
    """
    ship(requests.sparkSession)
    name = {"logs": "LOGS", "spans": "SPANS"}[signal]

    @F.pandas_udf(StringType())
    def read(body: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([as_json(b, k, name) for b, k in zip(body, kind, strict=True)], dtype=object)

    return requests.withColumn("body", read(F.col("body"), body_kind(F.coalesce("content_type", F.lit("")))))
