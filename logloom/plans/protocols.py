"""Registered queries of protobuf bodies, tree walks, updates and streamed traces, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import errors, incidents, traces
from logloom.plans.catalogue import ERRORS, grouped, logs, register
from logloom.plans.listings import OTLP_SQL, numbered, otlp_record, otlp_span, otlp_text, streamed
from logloom.plans.more import INCIDENTS, detected, incidents_of
from logloom.plans.views import view
from logloom.sources import ingest, otlp_protobuf
from logloom.streaming import streams

# protobuf by hand: lengths take two bytes, which any reader must accept, so a message is a concatenation
byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
varint = lambda c: F.concat(byte(c.bitwiseAND(127).bitwiseOR(128)), byte(F.shiftright(c, 7)))
tag = lambda number, wire: F.unhex(F.lit(f"{number << 3 | wire:02x}"))
binary = lambda c: F.encode(F.coalesce(c, F.lit("")), "utf-8")


def part(number: int, payload):
    # bound once: each mention of a payload would build all that is nested in it again
    return F.get(F.transform(F.array(payload), lambda p: F.concat(tag(number, 2), varint(F.octet_length(p)), p)), F.lit(0))


def fixed(number: int, c):
    big = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.concat(tag(number, 1), *[F.unhex(F.substring(big, i, 2)) for i in range(15, 0, -2)])


def whole(number: int, c):
    return F.concat(tag(number, 0), varint(c))


def wire_body(record):
    """A request of one record: resource with service.name, scope, record."""
    name = part(1, F.concat(part(1, binary(F.lit("service.name"))), part(2, part(1, binary(F.col("service"))))))
    return part(1, F.concat(part(1, name), part(2, part(2, record))))


def log_wire():
    i = F.col("id")
    return F.concat(fixed(1, i * 1_000_000 + 17), whole(2, i % 25), part(5, part(1, binary(F.col("message")))), part(9, F.unhex(F.coalesce("trace_id", F.lit("")))))


def span_wire():
    i = F.col("id")
    return F.concat(part(1, F.unhex(F.coalesce("trace_id", F.lit("")))), part(2, F.unhex(F.lpad(F.hex(i), 16, "0"))), part(5, binary(F.col("level"))), whole(6, i % 7), fixed(7, i * 1_000_000), fixed(8, i * 1_000_000 + 5_900_000), part(15, whole(3, i % 3)))


def requests(x, wire, *form):
    """Every other request is protobuf; the rest is JSON, declared as such, as protobuf, or as nothing. Trace ids are digests, as protobuf has bytes there."""
    i = F.col("id")
    kind = F.when(i % 2 == 0, "application/x-protobuf").when(i % 4 == 1, "application/json").when(i % 8 == 3, "application/protobuf; v=1")
    x = x.withColumn("trace_id", F.md5(F.encode("trace_id", "utf-8")))
    return x.select(kind.alias("content_type"), F.when(i % 2 == 0, wire_body(wire)).otherwise(F.encode(otlp_text(*form), "utf-8")).alias("body"))


def log_requests(x):
    return otlp_protobuf.decoded(requests(x, log_wire(), otlp_record(), "logRecords", "scopeLogs", "resourceLogs"), "logs")


def span_requests(x):
    return otlp_protobuf.decoded(requests(x, span_wire(), otlp_span(), "spans", "scopeSpans", "resourceSpans"), "spans")


register("otlp_logs_protobuf", logs(lambda x: ingest.otlp_logs(log_requests(x)).select("service", "time_ms", "level", "message", "trace_id")), f"select service, id as time_ms, {OTLP_SQL} as level, message, md5(trace_id) as trace_id from logs", "logs")
register("otlp_traces_protobuf", logs(lambda x: ingest.otlp_spans(span_requests(x)).select("service", "trace_id", "span_id", "operation", "kind", "status", "start_ms", "end_ms")), f"select service, md5(trace_id) as trace_id, case when id % 2 = 0 then lpad(lower(to_hex(id)), 16, '0') else cast(id as varchar) end as span_id, level as operation, {numbered(X.SPAN_KINDS, 7, 1)} as kind, {numbered(X.STATUSES, 3, 0)} as status, id as start_ms, id + 5 as end_ms from logs where trace_id is not null", "logs")

# a tree of two children a span, the later number first
UP = "case when minutes = 1 then concat('o', substr(trace_id, 2)) when minutes > 1 then concat('l', substr(trace_id, 2), '-', cast(cast(floor(minutes / 2) as int) as string)) end"
heap = lambda s, d: view(s, d, "spans").withColumn("parent_span_id", F.expr(UP)).withColumn("start_time", F.expr("timestamp_ntz'2024-01-01' - make_dt_interval(0, 0, minutes, 0)"))
register("span_preorder", lambda s, d: traces.preorder(heap(s, d)), """select trace_id, span_id, case when minutes = 0 then 0 else length(bin(minutes)) - case when bool_or(minutes = 0) over (partition by trace_id) then 0 else 1 end end as depth,
 row_number() over (partition by trace_id order by case when minutes = 0 then '' else translate(bin(minutes), '01', '10') end) as position from spans""", "spans")

# updates: all rows set a field, some in vain; every 40th row deletes
CHANGE = "case when id % 40 = 1 then 'deleted' when id % 4 = 0 then 'status' when id % 4 = 1 then 'severity' when id % 4 = 2 then 'assignee' else 'title' end"
VALUE = "case when id % 4 = 0 then case when id % 3 = 0 then 'resolved' else 'false_positive' end when id % 4 = 1 and id % 3 = 0 then '' when id % 4 = 1 then 'low' when id % 3 > 0 then concat('user', cast(id as string)) end"
CHANGES = f"select concat(trace_id, '/', cast(project_id as string)) as incident, id as changed_at, {CHANGE} as field, {VALUE} as value from logs where trace_id is not null"
changes = lambda x: x.sparkSession.sql(CHANGES.replace("from logs", "from {x}"), x=x)
named = lambda x: detected(incidents_of)(*x).withColumn("incident", F.concat("trace_id", F.lit("/"), F.col("project_id").cast("string")))
LAST = lambda f: f"arg_max(value, changed_at) filter (field = '{f}' and value <> '')"
register("incidents_updated", lambda s, d: incidents.updated(named((s, d)), changes(view(s, d, "logs")), "incident").select("incident", "status", "severity", "assignee"), f"""select i.incident, coalesce(u.status, i.status) as status, coalesce(u.severity, i.severity) as severity, case when u.assignee is null then i.assignee else nullif(u.assignee, '-') end as assignee
 from (select *, concat(trace_id, '/', cast(project_id as varchar)) as incident from ({INCIDENTS}) z) i left join (select incident, {LAST('status')} as status, {LAST('severity')} as severity, arg_max(coalesce(value, '-'), changed_at) filter (field = 'assignee') as assignee, bool_or(field = 'deleted') as gone from ({CHANGES}) c group by 1) u on i.incident = u.incident where u.gone is not true""", "logs")
SET = ("project_id", "fingerprint", "time as changed_at", "case id % 3 when 0 then 'resolved' when 1 then 'ignored' else 'open' end as status", "case when id % 2 = 0 then 'ann' end as who")
register("group_status", logs(lambda x: errors.latest_statuses(grouped(x).selectExpr(*SET))), f"""select project_id, fingerprint, u.status as status, case when u.status = 'resolved' then u.changed_at end as resolved_at, nullif(u.who, '') as resolved_by
 from (select project_id, fingerprint, max({{'changed_at': changed_at, 'status': status, 'who': coalesce(who, '')}}) as u from (select {", ".join(SET)} from ({ERRORS}) e) s group by 1, 2) t""", "logs")

# traces as they end: half an hour of silence, which the watermark, an hour late, has passed
ended = lambda x: streams.traces(x.where("trace_id is not null").selectExpr("trace_id", "time as start_time", "time + interval '5 seconds' as end_time", "case when level = 'error' then 'ERROR' else 'OK' end as status_code"))
register("stream_traces", streamed(lambda x: ended(x).select("trace_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "end_time", "span_count", "error"), "append"), """select trace_id, min(time) as start_time, max(time) + interval '5 seconds' as end_time, count(*) as span_count, bool_or(level = 'error') as error
 from (select *, sum(new) over (partition by trace_id order by time rows unbounded preceding) as n from (select *, case when time - lag(time) over (partition by trace_id order by time) <= interval '30 minutes' then 0 else 1 end as new from logs where trace_id is not null) a) b
 group by trace_id, n having max(time) + interval '30 minutes' <= (select max(time) from logs where trace_id is not null) - interval '1 hour'""", "logs")
