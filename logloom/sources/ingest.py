"""Ingest adapters: JSON batches, shippers, journald, syslog, container paths, OTLP JSON, threat lists, export."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logloom.functions.scalars import level_of, level_of_otlp, level_of_priority, ns_to_ms, span_kind, span_status, valid_trace_id
from logloom.session import scratch, ship

LOG_SCHEMA = "time string, service string, level string, message string, metadata string, trace_id string, span_id string"
LEVELS = ("debug", "info", "warn", "error", "critical")
#: Values and attributes stay JSON text: lists and maps in them nest to any depth.
RESOURCE = "resource:struct<attributes:string>"
OTLP_LOGS = f"resourceLogs array<struct<{RESOURCE},scopeLogs:array<struct<scope:struct<name:string,version:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:string,attributes:string,traceId:string,spanId:string>>>>>>"
OTLP_SPANS = (
    f"resourceSpans array<struct<{RESOURCE},scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int,message:string>,attributes:string,events:string,links:string>>>>>>"
)
#: Keys that senders may also spell in snake_case.
CAMEL = "resourceLogs scopeLogs logRecords resourceSpans scopeSpans timeUnixNano observedTimeUnixNano severityNumber severityText traceId spanId parentSpanId startTimeUnixNano endTimeUnixNano stringValue intValue doubleValue boolValue bytesValue arrayValue kvlistValue".split()


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid logs, quarantine): service of 1..100 characters, a known level, a message, a time, a hex span id if any."""
    ok = F.length("service").between(1, 100) & F.col("level").isin(*LEVELS) & (F.length("message") > 0) & F.try_to_timestamp(F.col("time")).isNotNull() & (F.col("span_id").isNull() | F.col("span_id").rlike(r"(?i)^[a-f0-9]{16}\z"))
    ok = F.coalesce(ok, F.lit(False))
    return rows.where(ok).withColumn("time", F.to_timestamp("time")), rows.where(~ok)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def shipper(raw: DataFrame) -> DataFrame:
    """time, service, message of loosely shaped records (time, date, service, container_name, message, log)."""
    return raw.select(
        F.coalesce(F.col("time"), F.timestamp_seconds("date").cast("timestamp_ntz")).alias("time"),
        F.coalesce("service", "container_name", F.lit("unknown")).alias("service"), F.coalesce("message", "log", F.lit("")).alias("message"),
    )


def journald(raw: DataFrame) -> DataFrame:
    """service, level, message, time_ms of journald fields. A priority or time that is no number counts as missing."""
    unit = F.regexp_replace("_SYSTEMD_UNIT", r"\.service$", "")
    service = F.coalesce("SYSLOG_IDENTIFIER", unit, "_COMM", F.element_at(F.split("_EXE", "/"), -1), F.lit("unknown"))
    return raw.select(service.alias("service"), level_of_priority(F.col("PRIORITY").try_cast("int")).alias("level"), F.coalesce("MESSAGE", F.lit("")).alias("message"), F.floor(F.col("__REALTIME_TIMESTAMP").try_cast("bigint") / 1000).alias("time_ms"))


#: Fields by which a record is journald's (of the first some text, of the others anything), and those of its fields that are kept as metadata.
TELLING, PRESENT = ("_SYSTEMD_UNIT", "_COMM", "_EXE", "SYSLOG_IDENTIFIER", "_HOSTNAME"), ("MESSAGE", "PRIORITY")
JOURNALD = (
    "_HOSTNAME _MACHINE_ID _BOOT_ID _PID _UID _GID _COMM _EXE _CMDLINE _SYSTEMD_CGROUP _SYSTEMD_UNIT _SYSTEMD_SLICE _SYSTEMD_USER_UNIT _STREAM_ID _TRANSPORT SYSLOG_FACILITY SYSLOG_IDENTIFIER SYSLOG_PID _SELINUX_CONTEXT _RUNTIME_SCOPE".split()
)


def shipped(bodies: DataFrame) -> DataFrame:
    """time, service, level, message, metadata (JSON) and is_journald of records (column `body`, a JSON object each) of shippers and journald, told apart by their fields.

    A record's own metadata comes first, then journald's kept fields, then the container's ids; later ones win and keep their JSON type.
    Null for a time that a record doesn't have; a body that is no object has neither fields nor metadata.
    """
    raw, typed = F.from_json("body", "map<string,string>"), F.from_json("body", "map<string,variant>")
    rows = bodies.select("*", F.coalesce(raw, F.create_map().cast("map<string,string>")).alias("_r"), F.coalesce(typed, F.from_json(F.lit("{}"), "map<string,variant>")).alias("_v"))
    of = lambda k: F.nullif(F.try_element_at("_r", F.lit(k)), F.lit(""))
    some = lambda *ks: F.coalesce(*[of(k) for k in ks])
    own = reduce(or_, [of(k).isNotNull() for k in TELLING] + [F.map_contains_key("_r", F.lit(k)) for k in PRESENT])
    only = lambda m, keys: F.map_filter(m, lambda k, v: k.isin(list(keys)))
    over = lambda below, above: F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)
    told = F.coalesce(F.from_json(of("metadata"), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    ids = only(F.col("_v"), ("container_id", "container_short_id"))
    plain = over(told, ids)
    journal = over(over(over(told, only(F.col("_v"), JOURNALD)), ids), F.from_json(F.lit('{"source":"journald"}'), "map<string,variant>"))
    micros = some("__REALTIME_TIMESTAMP", "_SOURCE_REALTIME_TIMESTAMP").try_cast("bigint")
    sent = F.coalesce(F.try_to_timestamp(of("time")), F.timestamp_seconds(of("date").try_cast("double")))
    time = F.coalesce(F.when(own, F.timestamp_millis(F.floor(micros / 1000))), sent).cast("timestamp_ntz")
    name = F.coalesce(of("SYSLOG_IDENTIFIER"), F.regexp_replace(of("_SYSTEMD_UNIT"), r"\.service$", ""), of("_COMM"), F.element_at(F.split(of("_EXE"), "/"), -1))
    level = F.when(own & F.map_contains_key("_r", F.lit("PRIORITY")), level_of_priority(of("PRIORITY").try_cast("int"))).otherwise(level_of(of("level")))
    return rows.select(
        *bodies.columns, own.alias("is_journald"), time.alias("time"), F.coalesce(of("service"), F.when(own, name).otherwise(of("container_name")), F.lit("unknown")).alias("service"), level.alias("level"),
        F.coalesce(F.when(own, of("MESSAGE")), of("message"), of("log"), F.lit("")).alias("message"), F.to_json(F.when(own, journal).otherwise(plain)).alias("metadata"),
    )


RFC3164 = r"^<([0-9]+)>([A-Z][a-z]{2} +[0-9]+ [0-9:]{8}) ([^ ]+) ([^:\[ ]+)(?:\[[0-9]+\])?: (.*)$"


def syslog(lines: DataFrame) -> DataFrame:
    """pri, host, service, level, message of RFC 3164 lines (column `line`); others have null fields and their text as message."""
    part = lambda i: F.nullif(F.regexp_extract("line", RFC3164, i), F.lit(""))
    pri = part(1).try_cast("int")
    return lines.select("id", pri.alias("pri"), part(3).alias("host"), F.coalesce(part(4), part(3), F.lit("syslog")).alias("service"), F.when(pri.isNull(), "info").otherwise(level_of_priority(F.pmod(pri, F.lit(8)))).alias("level"), F.coalesce(part(5), "line").alias("message"))


def container_id(path):
    return F.substring(F.regexp_extract(path, r"/containers/([0-9a-f]{12,})/", 1), 1, 12)


def _clean(text):
    return F.replace(text, F.lit("\0"), F.lit(""))


def whole(told) -> int | None:
    """A 64-bit number that may come as a text; null for anything else, larger ones included."""
    try:
        n = int(told)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if -(1 << 63) <= n < 1 << 63 else None


def text_of(told) -> str:
    return (told if isinstance(told, str) else _json(told)).replace("\0", "")


def items_of(told, name: str) -> list:
    """The list of that name in an object; none if there is none of that kind."""
    found = told.get(name) if isinstance(told, dict) else None
    return found if isinstance(found, list) else []


def plain_value(value):
    """A value of OTLP/JSON as JSON has it; null for nothing known, and for numbers that are none."""
    for name, told in value.items() if isinstance(value, dict) else ():
        if told is None:
            continue
        if name == "stringValue":
            return text_of(told)
        if name == "intValue":
            return whole(told)
        if name in ("boolValue", "doubleValue", "bytesValue"):
            return told
        if name == "arrayValue":
            return [plain_value(v) for v in items_of(told, "values")]
        if name == "kvlistValue":
            return plain_attributes(told.get("values") if isinstance(told, dict) else None)
    return None


def plain_attributes(attributes) -> dict:
    """Of equal keys the last counts; what has no key that is a text is passed over."""
    some = attributes if isinstance(attributes, list) else []
    return {a["key"]: plain_value(a.get("value")) for a in some if isinstance(a, dict) and isinstance(a.get("key"), str)}


def plain_message(value) -> str:
    """A log's text: a plain value as such, a list as a JSON list of texts, a map as JSON, bytes as [bytes: base64]."""
    told = plain_value(value)
    if isinstance(value, dict) and value.get("bytesValue") is not None:
        return f"[bytes: {told}]"
    if isinstance(told, list):
        return _json([plain_message(v) for v in items_of(value["arrayValue"], "values")])
    return "" if told is None else told if isinstance(told, str) else _json(told)


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _read(text):
    try:
        return json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None


def _each(column: pd.Series, fn) -> pd.Series:
    """fn of every text; null where it is nested too deep, and half characters as question marks, so that no row ends the job."""

    def safe(text):
        try:
            told = fn(text)
        except RecursionError:
            return None
        return told if told is None else told.encode("utf-8", "replace").decode()

    return pd.Series([safe(t) for t in column], dtype=object)


@F.pandas_udf(StringType())
def message_of(body: pd.Series) -> pd.Series:
    return _each(body, lambda t: plain_message(_read(t)))


@F.pandas_udf(StringType())
def attributes_json(attributes: pd.Series) -> pd.Series:
    return _each(attributes, lambda t: _json(plain_attributes(_read(t))))


@F.pandas_udf(StringType())
def metadata_json(resource: pd.Series, scope: pd.Series, own: pd.Series, severity: pd.Series) -> pd.Series:
    """Attributes of the resource and of the record; scope and severity are JSON objects; later keys win."""
    rows = pd.Series(list(zip(resource, scope, own, severity, strict=True)), dtype=object)
    return _each(rows, lambda x: _json(plain_attributes(_read(x[0])) | (_read(x[1]) or {}) | plain_attributes(_read(x[2])) | (_read(x[3]) or {})))


@F.pandas_udf(StringType())
def events_json(events: pd.Series) -> pd.Series:
    """Events with their time in ms (null for what is no number), a name and attributes; null for none."""

    def told(text):
        found = _read(text)
        some = [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []
        ms = lambda e: None if (n := whole(e.get("timeUnixNano"))) is None or not n else n // 1_000_000
        return _json([{"time_ms": ms(e), "name": text_of(e.get("name") or "event"), "attributes": plain_attributes(e.get("attributes"))} for e in some]) if some else None

    return _each(events, told)


@F.pandas_udf(StringType())
def links_json(links: pd.Series) -> pd.Series:
    """Links that have both ids; null for no links at all."""

    def told(text):
        found = _read(text)
        some = [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []
        return _json([{"trace_id": e["traceId"], "span_id": e["spanId"], "attributes": plain_attributes(e.get("attributes"))} for e in some if e.get("traceId") and e.get("spanId")]) if some else None

    return _each(links, told)


def _service(attributes):
    told = F.from_json(attributes, "array<struct<key:string,value:struct<stringValue:string>>>")
    found = F.get(F.filter(told, lambda a: a["key"] == "service.name"), F.lit(0))["value"]["stringValue"]
    return F.coalesce(F.nullif(_clean(found), F.lit("")), F.lit("unknown"))


def camel(body):
    """An OTLP/JSON text with its keys in camelCase. A quote inside a JSON text is escaped, so only keys fit."""
    out = body
    for name in CAMEL:
        snake = "".join("_" + c.lower() if c.isupper() else c for c in name)
        out = F.regexp_replace(out, f'"{snake}"(\\s*:)', f'"{name}"$1')
    return F.when(F.regexp_like(body, F.lit('"[a-z]+_[a-z_]+"\\s*:')), out).otherwise(body)  # most bodies have none of them


def otlp_logs(bodies: DataFrame) -> DataFrame:
    """Log rows of OTLP/JSON bodies (column `body`): three nested arrays flattened.

    metadata is JSON: attributes of the resource, then scope name and version, the record's own, and its severity; later keys win.
    """
    r = bodies.select(F.explode(F.from_json(camel(F.col("body")), OTLP_LOGS)["resourceLogs"]).alias("r"))
    rec = r.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope", F.explode("s.logRecords").alias("l"))
    scope = F.to_json(F.struct(F.col("scope.name").alias("otel.scope.name"), F.col("scope.version").alias("otel.scope.version")))
    severity = F.to_json(F.struct(F.col("l.severityNumber").alias("otel.severity_number"), F.nullif(F.col("l.severityText"), F.lit("")).alias("otel.severity_text")))
    ship(bodies.sparkSession)
    return rec.select(
        _service(F.col("resource")).alias("service"), ns_to_ms(F.coalesce("l.timeUnixNano", "l.observedTimeUnixNano")).alias("time_ms"), level_of_otlp(F.col("l.severityText"), F.col("l.severityNumber")).alias("level"), message_of(F.col("l.body")).alias("message"),
        valid_trace_id(F.col("l.traceId")).alias("trace_id"), F.nullif(F.col("l.spanId"), F.lit("")).alias("span_id"), metadata_json(F.col("resource"), scope, F.col("l.attributes"), severity).alias("metadata"),
    )


def otlp_spans(bodies: DataFrame) -> DataFrame:
    """Span rows of OTLP/JSON bodies; spans without ids, or with an all-zero trace id, are dropped. attributes, events and links are JSON; links without ids are left out."""
    r = bodies.select(F.explode(F.from_json(camel(F.col("body")), OTLP_SPANS)["resourceSpans"]).alias("r"))
    sp = r.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("x"))
    ship(bodies.sparkSession)
    out = sp.select(
        _service(F.col("resource")).alias("service"), valid_trace_id(F.col("x.traceId")).alias("trace_id"), F.nullif(F.col("x.spanId"), F.lit("")).alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.coalesce(F.nullif(_clean(F.col("x.name")), F.lit("")), F.lit("unknown")).alias("operation"), span_kind(F.col("x.kind")).alias("kind"), span_status(F.col("x.status.code")).alias("status"), F.col("x.status.message").alias("status_message"),
        ns_to_ms(F.col("x.startTimeUnixNano")).alias("start_ms"), ns_to_ms(F.col("x.endTimeUnixNano")).alias("end_ms"), attributes_json(F.col("x.attributes")).alias("attributes"), attributes_json(F.col("resource")).alias("resource_attributes"),
        events_json(F.col("x.events")).alias("events"), links_json(F.col("x.links")).alias("links"),
    )
    return out.where("trace_id is not null and span_id is not null")


#: RFC 5424: priority, version 1, time with zone, host, program, process, message id, structured data, message.
RFC5424 = r"^<([0-9]{1,5})>1 ([^ ]+) ([^ ]+) ([^ ]+) ([-0-9]+) ([^ ]+) (\[.*\]|-) (.+)$"


def syslog_5424(lines: DataFrame) -> DataFrame:
    """pri, time (UTC), host, service, level, message of RFC 5424 lines (column `line`); `-` is nothing."""
    part = lambda i: F.nullif(F.nullif(F.regexp_extract("line", RFC5424, i), F.lit("")), F.lit("-"))
    pri = part(1).cast("int")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(part(2)).cast("timestamp_ntz"))
    return lines.select("id", pri.alias("pri"), utc.alias("time"), part(3).alias("host"), F.coalesce(part(4), part(3), F.lit("syslog")).alias("service"), F.when(pri.isNull(), "info").otherwise(level_of_priority(F.pmod(pri, F.lit(8)))).alias("level"), F.coalesce(part(8), "line").alias("message"))


def syslog_time(line, year: int, offset_seconds: int = 0):
    """UTC time of an RFC 3164 line, which names neither year nor zone: the sender's clock is offset_seconds ahead of UTC."""
    told = F.regexp_replace(F.regexp_extract(line, r"^<[0-9]+>([A-Z][a-z]{2} +[0-9]+ [0-9:]{8})", 1), " +", " ")
    at = F.try_to_timestamp(F.concat(F.lit(f"{year} "), told), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    return at - F.expr(f"make_dt_interval(0, 0, 0, {offset_seconds})")


def wrapped(rows: DataFrame) -> DataFrame:
    """Each record as a body that the batch API takes: {"logs": [...]}."""
    record = F.struct(*rows.columns)
    return rows.select(F.to_json(F.struct(F.array(record).alias("logs"))).alias("body"))


def body_kind(content_type):
    """json or protobuf by content type; anything else is tried as json."""
    return F.when(F.lower(content_type).rlike("application/(x-protobuf|protobuf|vnd.google.protobuf)"), "protobuf").otherwise("json")


def threat_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="ip string, score int")


#: Header, RFC 4180 quoting, and times to the microsecond, so that nothing is lost.
CSV = {"header": True, "quote": '"', "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def exported(logs: DataFrame, limit: int = 50_000) -> DataFrame:
    """What export_csv has written to the shared folder, read back: Time, Service, Level, Message, Metadata, TraceID."""
    path = scratch(logs.sparkSession)
    export_csv(logs, path, limit)
    schema = "Time timestamp_ntz, Service string, Level string, Message string, Metadata string, TraceID string"
    return logs.sparkSession.read.options(**CSV, multiLine=True).csv(path, schema=schema)


def export_json(logs: DataFrame, path: str, limit: int = 50_000) -> None:
    """The newest `limit` rows, one JSON object a line."""
    logs.orderBy(F.col("time").desc(), F.col("id").desc()).limit(limit).write.json(path)


def export_csv(logs: DataFrame, path: str, limit: int = 50_000) -> None:
    """The newest `limit` rows with RFC 4180 quoting."""
    newest = logs.orderBy(F.col("time").desc(), F.col("id").desc()).limit(limit)
    newest.select(F.col("time").alias("Time"), F.col("service").alias("Service"), F.col("level").alias("Level"), F.col("message").alias("Message"), F.col("metadata").alias("Metadata"), F.col("trace_id").alias("TraceID")).write.options(**CSV).csv(path)
