"""Registered queries of scalars, adapters, counters, listings and streams, with their DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import admin, analytics, incidents, platform, siem, sigma, traces
from logloom.plans.catalogue import WEIGHT, BUCKETS, C, COLS, DETECTED, EDGES, ERRORS, MEMBERS, grouped, k, logs, members, numbers, on, register
from logloom.plans.more import BAD, INCIDENTS, RUNS, detected, runs
from logloom.plans.views import LOGS, NOW, view
from logloom.session import table, written
from logloom.sources import ingest
from logloom.streaming import streams


def picked(values):
    """The value at key mod their number: as SQL."""
    quote = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"case o_orderkey % {len(values)}" + "".join(f" when {i} then {quote(v)}" for i, v in enumerate(values)) + " end"


def pick(values):
    """The same as a column."""
    return F.element_at(F.array(*map(F.lit, values)), (k() % len(values) + 1).cast("int"))


def keyed(name: str, columns, sql: str) -> None:
    """A query over the order keys; columns() gives its columns by name."""
    register(name, lambda s, d: numbers(s, d).select("o_orderkey", *[c.alias(a) for a, c in columns().items()]), f"select o_orderkey, {sql} from orders")


def whens(pairs) -> str:
    return "".join(f" when '{a}' then {b!r}" for a, b in pairs)


RAW = ["60", "55", "45", "35", "5", "", "WARNING", "fatal", "odd", "notice"]
WANT = ["critical", "error", "warn", "info", "debug", "debug", "warn", "critical", "info", "info"]
keyed("map_level", lambda: {"level": X.level_of(pick(RAW))}, f"{picked(WANT)} as level")
keyed("map_span_kind", lambda: {"kind": X.span_kind((k() % 7).cast("int"))}, f"{picked([None, *X.SPAN_KINDS, None])} as kind")
keyed("map_span_status", lambda: {"status": X.span_status((k() % 4).cast("int"))}, f"{picked([*X.STATUSES, None])} as status")
NAMES = [*X.SEVERITY_WEIGHT, "other"]
keyed("map_severity_weight", lambda: {"weight": X.severity_weight(pick(NAMES))}, f"case {picked(NAMES)}{whens(X.SEVERITY_WEIGHT.items())} else 0 end as weight")
keyed(
    "sigma_threshold", lambda: {c: X.sigma_threshold(pick(NAMES))[c] for c in ("matches", "seconds")},
    ", ".join(f"case {picked(NAMES)}{whens((a, b[i]) for a, b in X.SIGMA_THRESHOLD.items())} end as {alias}" for i, alias in enumerate(("matches", "seconds"))),
)
keyed(
    "id_to_hex", lambda: {"hex": X.id_to_hex(F.when(k() % 2 == 0, F.lpad(k().cast("string"), 16, "0")).otherwise(F.base64(F.encode(k().cast("string"), "utf-8"))))},
    "case when o_orderkey % 2 = 0 then lpad(cast(o_orderkey as varchar), 16, '0') else lower(hex(cast(o_orderkey as varchar))) end as hex",
)
keyed(
    "format_duration", lambda: {"text": X.duration_text(F.when(k() % 3 == 0, k() % 1000).when(k() % 3 == 1, 1000 + 10 * (k() % 5900)).otherwise(60_000 + 600 * (k() % 1000)))},
    "case when o_orderkey % 3 = 0 and o_orderkey % 1000 = 0 then '<1ms' when o_orderkey % 3 = 0 then concat(cast(o_orderkey % 1000 as varchar), 'ms') when o_orderkey % 3 = 1 then printf('%.2fs', (1000 + 10 * (o_orderkey % 5900)) / 1000.0::double) else printf('%.2fm', (60000 + 600 * (o_orderkey % 1000)) / 60000.0::double) end as text",
)
PATHS = ["/app/", "/home/ann/", "/var/www/", "C:\\code\\", "/Users/ann/", "/srv/", "file:///app/", "D:\\x\\"]
LEFT = ["", "", "", "", "", "/srv/", "file:///app/", "D:/x/"]
keyed("stack_path_normalise", lambda: {"path": X.stack_path(F.concat(pick(PATHS), F.lit("lib\\f"), k().cast("string"), F.lit(".js")))}, f"concat({picked(LEFT)}, 'lib/f', cast(o_orderkey as varchar), '.js') as path")
TACTIC_IDS, TACTIC_NAMES = ["initial_access", "TA0040", "Credential_Access", "own_made up", "x"], ["Initial Access", "Impact", "Credential Access", "Own Made up", "X"]
keyed("mitre_names", lambda: {"name": X.tactic_name(pick(TACTIC_IDS)), "tactic": X.tactic_url(pick(TACTIC_IDS)), "technique": X.technique_url(pick(["T1110", "T1110.001"]))}, f"{picked(TACTIC_NAMES)} as name, concat('https://attack.mitre.org/tactics/', {picked(['TA0001', 'TA0000', 'TA0006', 'TA0000', 'TA0000'])}, '/') as tactic, concat('https://attack.mitre.org/techniques/', {picked(['T1110', 'T1110/001'])}, '/') as technique")
keyed("otlp_of_level", lambda: {"n": X.otlp_of_level(pick(["debug", "info", "warn", "error", "critical", "odd"]))}, "case o_orderkey % 6 when 0 then 5 when 2 then 13 when 3 then 17 when 4 then 21 else 9 end as n")
keyed("ns_to_iso", lambda: {"iso": X.ns_to_iso(k().cast("decimal(19, 0)") * 1_234_567_891_011)}, "strftime(timestamp '1970-01-01' + to_microseconds((o_orderkey * 1234567891011) // 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as iso")
keyed("severity_label", lambda: {"label": X.severity_label(pick(NAMES))}, f"case when {picked(NAMES)} = 'other' then 'other' else concat(upper(substr({picked(NAMES)}, 1, 1)), substr({picked(NAMES)}, 2)) end as label")
SECONDS = "(o_orderkey * 7919) % 400000"
keyed("time_ago", lambda: {"told": X.time_ago(F.expr(f"timestamp_ntz'{NOW}' - make_interval(0, 0, 0, 0, 0, 0, {SECONDS})"), F.expr(f"timestamp_ntz'{NOW}'"))}, f"(select case when s < 60 then 'just now' when s < 3600 then printf('%d minute%s ago', s // 60, case when s >= 120 then 's' else '' end) when s < 86400 then printf('%d hour%s ago', s // 3600, case when s >= 7200 then 's' else '' end) else printf('%d day%s ago', s // 86400, case when s >= 172800 then 's' else '' end) end from (select {SECONDS} as s) q) as told")
TAGS = ["attack.t1110", "attack.t1059.001", "attack.execution", "cve.2024", "attack.t12"]
IS_TECHNIQUE = f"regexp_matches({picked(TAGS)}, '^attack\\.t[0-9]{{4}}(\\.[0-9]{{3}})?$')"
keyed(
    "mitre_tags", lambda: {"tactics": F.array_join(X.mitre_tactics(F.array(pick(TAGS))), ","), "techniques": F.array_join(X.mitre_techniques(F.array(pick(TAGS))), ",")},
    f"case when starts_with({picked(TAGS)}, 'attack.') and not {IS_TECHNIQUE} then substr({picked(TAGS)}, 8) else '' end as tactics, case when {IS_TECHNIQUE} then upper(substr({picked(TAGS)}, 8)) else '' end as techniques",
)
register("message_normalise", logs(lambda x: x.select("id", X.message_shape(F.concat(F.lit("  "), "message", F.lit(" in 'x y' \"z\" [a] {b} 0xFF "))).alias("shape"))), "select id, concat(regexp_replace(message, '[0-9]+', 'N', 'g'), ' in ''STRING'' \"STRING\" [ARRAY] {OBJECT} NxFF') as shape from logs", "logs")


def frames():
    frame = lambda p, f, app: F.struct(p.alias("path"), F.lit(f).alias("func"), F.lit(app).alias("app"))
    return F.array(frame(F.concat(F.lit("src/"), F.col("service")), "run", True), frame(F.lit("lib/x"), "go", False), frame(F.col("level"), "end", True))


register("fingerprint", logs(lambda x: x.select("id", X.fingerprint(F.concat(F.lit("E"), F.col("level")), frames()).alias("fingerprint"))), "select id, sha256(concat('E', level, ':src/', service, ':run|', level, ':end')) as fingerprint from logs", "logs")


# adapters, on records made from the logs
def journal(x):
    i, none = F.col("id"), F.lit(None).cast("string")
    return x.select(
        F.when(i % 3 == 0, F.col("service")).alias("SYSLOG_IDENTIFIER"), F.when(i % 3 == 1, F.concat("service", F.lit(".service"))).alias("_SYSTEMD_UNIT"), none.alias("_COMM"), F.concat(F.lit("/usr/bin/"), "service").alias("_EXE"),
        (i % 8).cast("string").alias("PRIORITY"), F.col("message").alias("MESSAGE"), (i * 1_000_777).cast("string").alias("__REALTIME_TIMESTAMP"),
    )


def loose(x):
    even = lambda c: F.when(F.col("id") % 2 == 0, F.col(c)).alias(c)
    return x.select(even("time"), (F.col("id") % 1000).alias("date"), even("service"), F.when(F.col("id") % 3 == 0, F.lit("box")).alias("container_name"), F.lit(None).cast("string").alias("message"), F.col("message").alias("log"))


def otlp_text(record, inner: str, middle: str, outer: str):
    text = lambda c: F.struct(c.alias("stringValue"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), text(F.col("service")).alias("value"))).alias("attributes")).alias("resource")
    return F.to_json(F.struct(F.array(F.struct(resource, F.array(F.struct(F.array(record).alias(inner))).alias(middle))).alias(outer)))


def otlp_body(x, *form):
    return x.select(otlp_text(*form).alias("body"))


def otlp_record():
    i = F.col("id")
    return F.struct((i * 1_000_000 + 17).cast("string").alias("timeUnixNano"), (i % 25).cast("int").alias("severityNumber"), F.struct(F.col("message").alias("stringValue")).alias("body"), F.coalesce("trace_id", F.lit("000")).alias("traceId"))


def otlp_span():
    i = F.col("id")
    return F.struct(
        F.coalesce("trace_id", F.lit("")).alias("traceId"), i.cast("string").alias("spanId"), F.lit("").alias("parentSpanId"), F.col("level").alias("name"), (i % 7).cast("int").alias("kind"),
        (i * 1_000_000).cast("string").alias("startTimeUnixNano"), (i * 1_000_000 + 5_900_000).cast("string").alias("endTimeUnixNano"), F.struct((i % 3).cast("int").alias("code")).alias("status"),
    )


SYSLOG_SQL = "case when id % 8 <= 2 then 'critical' when id % 8 = 3 then 'error' when id % 8 = 4 then 'warn' when id % 8 <= 6 then 'info' else 'debug' end"
OTLP_SQL = "case when id % 25 >= 21 then 'critical' when id % 25 >= 17 then 'error' when id % 25 >= 13 then 'warn' when id % 25 >= 9 then 'info' when id % 25 >= 1 then 'debug' else 'info' end"
numbered = lambda names, n, first: f"case id % {n}" + "".join(f" when {i} then '{v}'" for i, v in enumerate(names, first)) + " end"
register("journald_normalise", logs(lambda x: ingest.journald(journal(x))), f"select service, {SYSLOG_SQL} as level, message, (id * 1000777) // 1000 as time_ms from logs", "logs")
register("shipper_normalise", logs(lambda x: ingest.shipper(loose(x))), "select case when id % 2 = 0 then time else timestamp '1970-01-01' + to_seconds(id % 1000) end as time, case when id % 2 = 0 then service when id % 3 = 0 then 'box' else 'unknown' end as service, message from logs", "logs")
register("otlp_logs", logs(lambda x: ingest.otlp_logs(otlp_body(x, otlp_record(), "logRecords", "scopeLogs", "resourceLogs")).select("service", "time_ms", "level", "message", "trace_id")), f"select service, id as time_ms, {OTLP_SQL} as level, message, trace_id from logs", "logs")
register("otlp_traces", logs(lambda x: ingest.otlp_spans(otlp_body(x, otlp_span(), "spans", "scopeSpans", "resourceSpans")).select("service", "trace_id", "span_id", "parent_span_id", "operation", "kind", "status", "start_ms", "end_ms")), f"select service, trace_id, cast(id as varchar) as span_id, cast(null as varchar) as parent_span_id, level as operation, {numbered(X.SPAN_KINDS, 7, 1)} as kind, {numbered(X.STATUSES, 3, 0)} as status, id as start_ms, id + 5 as end_ms from logs where trace_id is not null", "logs")

# counters and listings
register("platform_counters", logs(lambda x: platform.activity(x, NOW)), f"select count(*) as total, count(*) filter (time >= date_trunc('day', n) and time <= n) as today, count(*) filter (time > n - interval '7 days' and time <= n) as week, count(*) filter (time > n - interval '30 days' and time <= n) as month, count(distinct project_id) filter (time > n - interval '30 days' and time <= n) as active_projects from (select *, timestamp '{NOW}' as n from logs) x", "logs")
# accounts: made some days before NOW by their keys, and last seen half as long ago
ACCOUNTS = {"users": ("customer", "c_custkey"), "organizations": ("region", "r_regionkey"), "projects": ("nation", "n_nationkey")}
made = lambda s, d, name, key: table(s, d, name).select((F.expr(f"timestamp_ntz'{NOW}' - make_interval(0, 0, 0, cast({key} % 90 as int))")).alias("created_at"), (F.expr(f"timestamp_ntz'{NOW}' - make_interval(0, 0, 0, cast({key} % 90 div 2 as int))")).alias("last_login"))
register("platform_growth", lambda s, d: reduce(lambda a, b: a.unionByName(b), [platform.growth(made(s, d, *of), NOW).withColumn("kind", F.lit(kind)) for kind, of in ACCOUNTS.items()]), " union all ".join(f"select '{kind}' as kind, count(*) as total, count(*) filter (c >= d) as today, count(*) filter (c >= d - interval '7 days') as week, count(*) filter (c >= d - interval '30 days') as month, count(*) filter (l >= timestamp '{NOW}' - interval '30 days') as active from (select timestamp '{NOW}' - to_days(cast({key} % 90 as int)) as c, timestamp '{NOW}' - to_days(cast({key} % 90 // 2 as int)) as l, date_trunc('day', timestamp '{NOW}') as d from {name}) x" for kind, (name, key) in ACCOUNTS.items()))
counted = lambda x, p, r: p.select("id", "name").join(x.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("logs")), "id", "left").join(r.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("rules")), "id", "left").na.fill(0, ["logs", "rules"])
register("project_counts", on("logs", "projects", "alert_rules")(counted), "select id, name, (select count(*) from logs l where l.project_id = p.id) as logs, (select count(*) from alert_rules r where r.project_id = p.id) as rules from projects p", "logs", "projects", "alert_rules")
register("members_of_org", lambda s, d: members(s, d).where("organization_id = 2").join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), "user_id"), f"select user_id, organization_id, c_name as name from ({MEMBERS}) m join customer on c_custkey = user_id where organization_id = 2")
register("trace_services", on("spans")(lambda x: x.select("service_name").distinct()), "select distinct service_name from spans", "spans")
register("service_map_scale", on("spans")(lambda x: platform.edge_widths(traces.dependencies(x))), f"select source, target, calls, 1 + 5.0::double * calls / max(calls) over () as width from ({EDGES}) e", "spans")
register("incidents_list", detected(lambda q: siem.incidents_by_trace(q).where(F.col("severity").isin("high", "critical") & F.array_contains(F.split("services", ","), "auth-service")).select("trace_id", "project_id", "severity")), f"select trace_id, project_id, severity from ({INCIDENTS}) i where severity in ('high', 'critical') and trace_id in (select trace_id from ({DETECTED}) d where service = 'auth-service' and d.project_id = i.project_id)", "logs")
rules = [(r.id, r.pack, *[",".join(x) for x in sigma.mitre(r.tags)]) for r in sigma.PACKS]
listed = lambda s, _: s.createDataFrame(rules, "rule_id string, pack string, tactics string, techniques string")
told_rules = "(values " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rules) + ") t(rule_id, pack, tactics, techniques)"
hits = lambda s, d: sigma.detect(view(s, d, "logs")).groupBy("rule_id").agg(F.count("*").alias("hits"))
register("rules_by_technique", lambda s, d: listed(s, d).where(F.array_contains(F.split("techniques", ","), "T1190")).join(hits(s, d), "rule_id", "left").na.fill(0, ["hits"]), f"select t.*, (select count(*) from ({DETECTED}) d where d.rule_id = t.rule_id) as hits from {told_rules} where list_contains(string_split(techniques, ','), 'T1190')", "logs")
register("rules_by_pack", detected(lambda q: sigma.pack_counts(q.select("rule_id"), ["web", "auth", "ops"])), f"select split_part(rule_id, '-', 1) as pack, count(*) as n from ({DETECTED}) d where split_part(rule_id, '-', 1) in ('web', 'auth', 'ops') group by 1", "logs")
register("sync_status", on("alert_history")(lambda h: platform.sync_status(h.withColumnRenamed("triggered_at", "synced_at"))), "select count(*) as total, count(*) filter (error is null) as synced, count(*) filter (error is not null) as failed, max(triggered_at) as last_synced from alert_history", "alert_history")
register("queue_depth", on("alert_history")(lambda h: h.groupBy("rule_id").agg(F.count_if(~F.col("notified")).alias("waiting"), F.count_if(F.col("error").isNotNull()).alias("failed"))), "select rule_id, count(*) filter (not notified) as waiting, count(*) filter (error is not null) as failed from alert_history group by 1", "alert_history")
register("notification_counts", on("alert_history")(lambda h: platform.notification_counts(h.select(F.col("rule_id").alias("user_id"), F.col("notified").alias("is_read")))), "select rule_id as user_id, count(*) as total, count(*) filter (not notified) as unread from alert_history group by 1", "alert_history")
notes = lambda x, p, o: x.where("level = 'critical'").select("id", "project_id").join(p.select(F.col("id").alias("project_id"), "organization_id", F.col("name").alias("project")), "project_id", "left").join(o.select(F.col("id").alias("organization_id"), F.col("name").alias("organization")), "organization_id", "left").select("id", "project", "organization")
register("notifications_list", on("logs", "projects", "organizations")(notes), "select l.id, p.name as project, o.name as organization from logs l left join projects p on p.id = l.project_id left join organizations o on o.id = p.organization_id where l.level = 'critical'", "logs", "projects", "organizations")
register("incident_history_users", lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("c_custkey")).join(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("o_orderkey", "c_name"), "select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey and o_orderkey % 2 = 0")
comments = lambda s, d: table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")
register("incident_comments", comments, "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
tag = lambda: F.sha2(F.lit("api-gateway:error"), 256)
print_of = lambda x: grouped(x).select(F.col("id").alias("log_id"), F.sha2(F.concat_ws(":", "service", "level"), 256).alias("fingerprint"))
register("error_group_logs", logs(lambda x: platform.group_logs(print_of(x), x, tag()).select(*COLS)), f"select {C} from logs where id in (select id from ({ERRORS}) e where service = 'api-gateway' and level = 'error')", "logs")
twice = lambda x: grouped(x).select(F.col("id").alias("log_id"), "fingerprint", F.explode(F.array(F.lit(2), F.lit(1))).alias("part"))
register("exceptions_dedupe", logs(lambda x: platform.once_per_log(twice(x), ["part"])), f"select id as log_id, fingerprint, 1 as part from ({ERRORS}) e", "logs")
threats = lambda x: x.sparkSession.range(251).select(F.concat(F.lit("203.0.113."), F.col("id").cast("string")).alias("ip"), (F.col("id") % 6).cast("int").alias("score"))
linked = lambda x: (lambda q: incidents.links(q, siem.incidents_by_trace(q)))(written(sigma.detect(x))).select(F.col("log_id").alias("id"), "incident").distinct().join(x.select("id", "message"), "id")
score = "cast(split_part(ip, '.', 4) as int) % 6"
register("incident_ip_enrichment", logs(lambda x: platform.incident_addresses(linked(x), threats(x))), f"select distinct incident, ip, {score} as score, {score} * 10 as confidence, case when {score} >= 3 then 'malicious' when {score} >= 1 then 'suspicious' else 'clean' end as verdict from (select concat(i.trace_id, '/', cast(i.project_id as varchar)) as incident, regexp_extract(d.message, '203\\.0\\.113\\.[0-9]+') as ip from ({DETECTED}) d join ({INCIDENTS}) i on d.trace_id = i.trace_id and d.project_id = i.project_id where contains(d.message, '203.0.113.')) x", "logs")
register("alert_preview_services", logs(lambda x: platform.run_services(x, runs(x), BAD)), f"select r.start_time, string_agg(distinct l.service, ',' order by l.service) as services from ({RUNS}) r join logs l on l.time >= r.start_time and l.time < r.end_time and l.level in ('error', 'critical') and l.service <> 'unknown' and time_bucket(interval '1 hour', l.time) in (select bucket from ({BUCKETS}) b) group by 1", "logs")


def streamed(fn, mode: str):
    """A query that runs fn over the events as a stream, to its end, and reads what the sink has."""

    def query(spark, sf_dir):
        schema = table(spark, sf_dir, "events").schema
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        return streams.to_parquet(fn(spark.sql(LOGS.replace("from events", "from {events}"), events=events)), mode)

    return query


hourly = lambda x: streams.hourly_counts(x).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
register("stream_hourly_counts", streamed(hourly, "append"), "select time_bucket(interval '1 hour', time) as bucket, project_id, level, service, count(*) as log_count from logs where time_bucket(interval '1 hour', time) + interval '1 hour' <= (select max(time) from logs) - interval '3 hours' group by 1, 2, 3, 4", "logs")


first = lambda x: streams.first_of_group(grouped(x), ignored=x.sparkSession.createDataFrame([(3, "x")], "project_id int, fingerprint string")).select("project_id", "fingerprint")
register("stream_new_groups", streamed(first, "append"), f"select distinct project_id, fingerprint from ({ERRORS}) e", "logs")
register("stream_exceptions_once", streamed(lambda x: streams.once_per_log(twice(x.withColumn("log_id", F.col("id"))).withColumn("time", F.expr("timestamp'2024-01-01'"))).select("log_id"), "append"), f"select id as log_id from ({ERRORS}) e", "logs")
CHECKED = "select id, case when id % 3 > 0 then time end as checked from logs"
register("enrichment_stale", logs(lambda x: streams.fresh(x.sparkSession.sql(CHECKED.replace("from logs", "from {x}"), x=x), "checked", NOW)), f"select id, checked from ({CHECKED}) c where checked is null or checked <= timestamp '{NOW}' - interval '24 hours'", "logs")
register("stream_live_tail", streamed(lambda x: streams.live_tail(x, levels=["critical"]).select(*COLS), "append"), f"select {C} from logs where level = 'critical'", "logs")
register("stream_detections", streamed(lambda x: streams.detections(x).select("log_id", "rule_id", "severity"), "append"), f"select log_id, rule_id, severity from ({DETECTED}) d", "logs")
# every third record is journald's; every other one has metadata of its own
RECORD = """case when id % 3 = 0 then concat('{"SYSLOG_IDENTIFIER":"', service, '","PRIORITY":', cast(id % 8 as string), ',"MESSAGE":"m', cast(id as string), '","_PID":', cast(id as string), ',"_HOSTNAME":"h","__REALTIME_TIMESTAMP":"', cast(id as string), '000000","metadata":{"_PID":"old","k":1},"container_id":"c1"}')
 else concat('{"date":', cast(id as string), ',"container_name":"', service, '","level":"WARNING","log":"m', cast(id as string), '","container_short_id":"s1"', case when id % 2 = 0 then ',"metadata":{"a":{"b":[1]},"container_short_id":"old"}' else '' end, '}') end"""
PART_OF = lambda path: F.get_json_object("metadata", path)
register("shipper_records", logs(lambda x: ingest.shipped(x.select("id", F.expr(RECORD).alias("body"))).select("id", "is_journald", "time", "service", "level", "message", PART_OF("$._PID").alias("pid"), PART_OF("$.k").alias("k"), PART_OF("$.a").alias("a"), PART_OF("$.container_id").alias("c"), PART_OF("$.container_short_id").alias("cs"), PART_OF("$.source").alias("source"))), """select id, id % 3 = 0 as is_journald, make_timestamp(id * 1000000) as time, service, case when id % 3 > 0 then 'warn' when id % 8 <= 2 then 'critical' when id % 8 = 3 then 'error' when id % 8 = 4 then 'warn' when id % 8 <= 6 then 'info' else 'debug' end as level, concat('m', cast(id as varchar)) as message,
 case when id % 3 = 0 then cast(id as varchar) end as pid, case when id % 3 = 0 then '1' end as k, case when id % 3 > 0 and id % 2 = 0 then '{"b":[1]}' end as a, case when id % 3 = 0 then 'c1' end as c, case when id % 3 > 0 then 's1' end as cs, case when id % 3 = 0 then 'journald' end as source from logs""", "logs")
register("csv_export", lambda s, d: ingest.exported(view(s, d, "logs").select(*COLS, "metadata")), "select time as \"Time\", service as \"Service\", level as \"Level\", message as \"Message\", metadata as \"Metadata\", trace_id as \"TraceID\" from logs order by time desc, id desc limit 50000", "logs")
attribute = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
valued = lambda **kw: F.struct(*[v.alias(n) for n, v in kw.items()])
rich = lambda: F.struct((F.col("id") * 1_000_000).cast("string").alias("time_unix_nano"), F.lit("error").alias("severity_text"), valued(intValue=F.col("id").cast("string")).alias("body"), F.array(attribute("level", valued(string_value=F.col("level"))), attribute("service.name", valued(string_value=F.lit("own")))).alias("attributes"))
register("otlp_logs_snake_case", logs(lambda x: ingest.otlp_logs(otlp_body(x, rich(), "log_records", "scope_logs", "resource_logs")).select("service", "time_ms", "level", "message", F.get_json_object("metadata", "$.level").alias("own_level"), F.get_json_object("metadata", "$['service.name']").alias("own_service"), F.get_json_object("metadata", "$['otel.severity_text']").alias("severity"))), "select service, id as time_ms, 'error' as level, cast(id as varchar) as message, level as own_level, 'own' as own_service, 'error' as severity from logs", "logs")
register("syslog_5424_parse", logs(lambda x: ingest.syslog_5424(x.select("id", F.concat(F.lit("<"), (F.col("id") % 190).cast("string"), F.lit(">1 "), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000+01:00 host1 "), "service", F.lit(" - ID1 - "), "message").alias("line")))), f"select id, cast(id % 190 as int) as pri, date_trunc('second', time) - interval '1 hour' as time, 'host1' as host, service, {SYSLOG_SQL.replace('id % 8', 'id % 190 % 8')} as level, message from logs", "logs")
register("syslog_times", logs(lambda x: x.select("id", ingest.syslog_time(F.concat(F.lit("<11>"), F.date_format("time", "MMM d HH:mm:ss"), F.lit(" h x: y")), 2024, 7200).alias("at"))), "select id, date_trunc('second', time) - interval '2 hours' as at from logs", "logs")
register("rollup_or_raw", logs(lambda x: analytics.rollup_or_raw(x, "no_such_rollup")), "select time_bucket(interval '1 hour', time) as bucket, project_id, level, service, count(*) as log_count from logs group by 1, 2, 3, 4", "logs")
register("compression_ratio", logs(lambda x: admin.compression(x.select(F.length("message").alias("before"), F.length("service").alias("after")))), "select round(sum(length(message)) / sum(length(service))::double, 2) as ratio from logs", "logs")
