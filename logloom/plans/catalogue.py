"""Every registered query of the log, trace and security catalogue, with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import admin, alerts, analytics, errors, identifiers, search, siem, sigma, traces
from logloom.plans.views import NOW, twin, view
from logloom.session import table, written
from logloom.sources import ingest

QUERIES: dict = {}
ORACLES: dict = {}
DAY = "2024-01-15 00:00:00"
MONTH = "2023-12-31 23:57:13"  # 30 days before NOW


def register(name: str, query, sql: str | None = None, *names: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = twin(sql, *names) if names else sql


def on(*names: str):
    """A query over views: fn(*views)."""
    return lambda fn: lambda s, d: fn(*[view(s, d, n) for n in names])


logs = on("logs")
spans = lambda s, d: view(s, d, "spans").withColumn("end_time", F.col("start_time") + F.expr("make_interval(0, 0, 0, 0, 0, minutes)"))
SPANS_SQL = "select *, start_time + to_minutes(minutes) as end_time from spans"
COLS = ["id", "time", "project_id", "service", "level", "message", "trace_id"]
C = ", ".join(COLS)

# search
register("log_search_filters", logs(lambda x: search.search(x, services=["auth-service"], levels=["error", "critical"], since=DAY, until="2024-01-20 00:00:00").select(*COLS)), f"select {C} from logs where service = 'auth-service' and level in ('error', 'critical') and time >= timestamp '{DAY}' and time <= timestamp '2024-01-20 00:00:00'", "logs")
register("log_search_multi", logs(lambda x: search.search(x, projects=[1, 2, 3], services=["api-gateway", "user-service"]).select(*COLS)), f"select {C} from logs where project_id in (1, 2, 3) and service in ('api-gateway', 'user-service')", "logs")
register("log_search_substring", logs(lambda x: search.search(x, text="50%_OFF").select(*COLS)), f"select {C} from logs where contains(lower(message), '50%_off')", "logs")
register("log_search_page", logs(lambda x: search.page(x, 50, 100).select(*COLS)), f"select {C} from logs order by time desc, id desc limit 50 offset 100", "logs")
register("log_search_cursor", logs(lambda x: search.page(search.search(x, cursor=search.make_cursor(DAY, 500)), 50).select(*COLS)), f"select {C} from logs where time < timestamp '{DAY}' or (time = timestamp '{DAY}' and id < 500) order by time desc, id desc limit 50", "logs")
register("log_by_id", logs(lambda x: x.where("id = 42 and project_id is not null").select(*COLS)), f"select {C} from logs where id = 42", "logs")
register("logs_by_trace", logs(lambda x: search.search(x, trace_id="trace-7-2024-01-15").select(*COLS)), f"select {C} from logs where trace_id = 'trace-7-2024-01-15'", "logs")
register("log_context", logs(lambda x: search.context(x, DAY, 5).select("place", *COLS)), f"(select 'before' as place, {C} from logs where time < timestamp '{DAY}' order by time desc, id desc limit 5) union all (select 'at', {C} from logs where time = timestamp '{DAY}') union all (select 'after', {C} from logs where time > timestamp '{DAY}' order by time, id limit 5)", "logs")
WORDS = "list_has_any(string_split_regex(lower(message), '[^a-z0-9]+'), [{0}])"  # the words of the logs that a query's words stand for
for name, words, forms in (("log_fulltext", "the failed logins", (("fail", "fails", "failed", "failing"), ("login", "logins"))), ("log_fulltext_stems", "connected timeouts", (("connection", "connections", "connect", "connected"), ("timeout", "timeouts"))), ("log_fulltext_stem", "escalate privileged", (("escalation", "escalate", "escalated"), ("privilege", "privileges", "privileged")))):
    register(name, logs(lambda x, w=words: search.search(x, text=w, mode="words").select(*COLS)), f"select {C} from logs where " + " and ".join(WORDS.format(", ".join(f"'{v}'" for v in form)) for form in forms), "logs")
register("log_search_page_and_next", logs(lambda x: search.page_and_next(x.where("level = 'critical'"), 20, 20).select("id", "has_next")), "select id, (select count(*) from logs where level = 'critical') > 40 as has_next from logs where level = 'critical' order by time desc, id desc limit 20 offset 20", "logs")
register("log_api_rows", logs(lambda x: search.api_rows(x.where("project_id = 3"))), 'select id, time, project_id as "projectId", service, level, message, metadata, trace_id as "traceId" from logs where project_id = 3', "logs")
register("logs_first_and_last", logs(admin.first_and_last), "select min(time) as oldest, max(time) as latest, arg_min(id, (time, id)) as oldest_id, arg_max(id, (time, id)) as latest_id from logs", "logs")
register("distinct_services", logs(lambda x: x.where("service <> ''").select("service").distinct()), "select distinct service from logs where service <> ''", "logs")
register("recent_errors", logs(lambda x: search.page(search.search(x, levels=["error", "critical"]), 10).select(*COLS)), f"select {C} from logs where level in ('error', 'critical') order by time desc, id desc limit 10", "logs")

# analytics
for width, words in (("1m", "1 minute"), ("5m", "5 minutes"), ("1h", "1 hour"), ("1d", "1 day")):
    register(f"log_histogram_{width}", logs(lambda x, w=width: analytics.histogram(x, w)), f"select time_bucket(interval '{words}', time) as bucket, level, count(*) as n from logs group by 1, 2", "logs")
WIDE = ", ".join(f"count(*) filter (level = '{v}') as {v}" for v in analytics.LEVELS)
register("log_histogram_pivot", logs(lambda x: analytics.histogram_wide(x, "1h")), f"select time_bucket(interval '1 hour', time) as bucket, count(*) as total, {WIDE} from logs group by 1", "logs")
register("level_totals", logs(lambda x: search.search(x, since=DAY).groupBy("level").agg(F.count("*").alias("n"))), f"select level, count(*) as n from logs where time >= timestamp '{DAY}' group by 1", "logs")
register("top_services", logs(lambda x: analytics.top(x, "service", 3)), "select service, count(*) as n from logs group by 1 order by n desc, service limit 3", "logs")
register("top_services_share", logs(lambda x: analytics.top_share(x, "service", 5)), "select service, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over ()) as share from logs group by 1 order by n desc, service limit 5", "logs")
register("top_errors", logs(lambda x: analytics.top(x.where("level in ('error', 'critical')"), "message", 10)), "select message, count(*) as n from logs where level in ('error', 'critical') group by 1 order by n desc, message limit 10", "logs")
register("logs_per_day", logs(lambda x: search.search(x, since=MONTH).groupBy(F.to_date("time").cast("string").alias("day")).agg(F.count("*").alias("n")).orderBy(F.col("day").desc()).limit(30)), f"select cast(cast(time as date) as varchar) as day, count(*) as n from logs where time >= timestamp '{NOW}' - interval '30 days' group by 1 order by day desc limit 30", "logs")
register("dashboard_kpis", logs(lambda x: analytics.kpis(x, NOW)), f"""select *, case when yesterday > 0 then (today - yesterday) * 100.0::double / yesterday else 0 end as trend, case when today > 0 then errors_today * 100.0::double / today else 0 end as error_rate from (select
 count(*) filter (time >= t and time <= n) as today, count(*) filter (time < t) as yesterday, count(*) filter (time >= t and time <= n and bad) as errors_today, count(*) filter (time < t and bad) as errors_yesterday,
 count(distinct service) filter (time >= t and time <= n) as services, count(*) filter (time > n - interval '1 hour' and time <= n) / 3600.0::double as per_second
 from (select *, level in ('error', 'critical') as bad, timestamp '{NOW}' as n, date_trunc('day', timestamp '{NOW}') as t from logs) x where time >= t - interval '1 day') y""", "logs")
register("rollup_hourly", logs(lambda x: analytics.rollup(x, "1h")), "select time_bucket(interval '1 hour', time) as bucket, project_id, level, service, count(*) as log_count from logs group by 1, 2, 3, 4", "logs")
register("rollup_daily", logs(lambda x: analytics.rollup(x, "1d")), "select time_bucket(interval '1 day', time) as bucket, project_id, level, service, count(*) as log_count from logs group by 1, 2, 3, 4", "logs")
register("dashboard_timeseries", logs(lambda x: analytics.timeseries(analytics.rollup(x, "1h"), x, NOW)), f"select time_bucket(interval '1 hour', time) as bucket, count(*) as total, {WIDE} from logs where time >= date_trunc('hour', timestamp '{NOW}') - interval '23 hours' and time <= timestamp '{NOW}' group by 1", "logs")

# tenants
MEMBERS = "select c_custkey as user_id, n_regionkey as organization_id from customer join nation on c_nationkey = n_nationkey"
members = lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("organization_id"))
register("top_orgs", on("logs", "projects", "organizations")(admin.top_orgs), "select p.organization_id, count(*) as n, o.name from logs l join projects p on l.project_id = p.id join organizations o on p.organization_id = o.id group by 1, 3 order by n desc, name limit 10", "logs", "projects", "organizations")
register("top_projects", on("logs", "projects")(lambda x, p: p.select(F.col("id").alias("project_id"), "name").join(F.broadcast(analytics.top(x, "project_id", 10)), "project_id")), "select project_id, n, name from (select project_id, count(*) as n from logs group by 1 order by n desc, project_id limit 10) x join projects p on p.id = x.project_id", "logs", "projects")
register("org_counts", lambda s, d: admin.org_counts(view(s, d, "organizations"), view(s, d, "projects"), members(s, d)), f"select o.id as organization_id, o.name, (select count(*) from projects p where p.organization_id = o.id) as projects, (select count(*) from ({MEMBERS}) m where m.organization_id = o.id) as members from organizations o", "organizations", "projects")
register("logs_visible_to_user", lambda s, d: admin.visible(view(s, d, "logs"), view(s, d, "projects"), members(s, d), 17).select(*COLS), f"select {C} from logs where project_id in (select id from projects where organization_id in (select organization_id from ({MEMBERS}) m where user_id = 17))", "logs", "projects")
register("admin_search", lambda s, d: table(s, d, "customer").where(F.col("c_name").ilike("%0001%") | F.col("c_mktsegment").ilike("%build%")).orderBy("c_custkey").limit(20).select("c_custkey", "c_name"), "select c_custkey, c_name from customer where c_name ilike '%0001%' or c_mktsegment ilike '%build%' order by c_custkey limit 20")
CUT = f"(select l.*, p.organization_id, timestamp '{NOW}' - to_days(cast(7 + p.organization_id as int)) as cutoff from logs l join projects p on l.project_id = p.id) x"
register("retention_status", on("logs", "projects")(lambda x, p: admin.retention_status(x, p, NOW)), f"select organization_id, min(time) as oldest, count(*) as n, count(*) filter (time < cutoff) as expired from {CUT} group by 1", "logs", "projects")
register("retention_survivors", on("logs", "projects")(lambda x, p: admin.survivors(x, p, NOW).select("organization_id", *COLS)), f"select organization_id, {C} from {CUT} where time >= cutoff", "logs", "projects")
register("cascade_survivors", on("logs", "projects")(lambda x, p: x.join(p.where("organization_id = 1").select(F.col("id").alias("project_id")), "project_id", "left_anti").select(*COLS)), f"select {C} from logs where project_id not in (select id from projects where organization_id = 1)", "logs", "projects")

# traces
ROLL = f"""select trace_id, start_time, end_time, span_count, error, service_name, root_service, root_operation, cast(date_diff('millisecond', start_time, end_time) as bigint) as duration_ms from (select trace_id, min(start_time) as start_time, max(end_time) as end_time, count(*) as span_count, bool_or(status_code = 'ERROR') as error,
 arg_min(service_name, (start_time, span_id)) as service_name, arg_min(service_name, (start_time, span_id)) filter (parent_span_id is null) as root_service, arg_min(operation_name, (start_time, span_id)) filter (parent_span_id is null) as root_operation from ({SPANS_SQL}) s group by 1) x"""
register("trace_rollup", lambda s, d: traces.assemble(spans(s, d)), ROLL, "spans")
register("trace_list", lambda s, d: traces.assemble(spans(s, d)).orderBy(F.col("start_time").desc(), "trace_id").limit(50).select("trace_id", "start_time", "span_count"), f"select trace_id, start_time, span_count from ({ROLL}) r order by start_time desc, trace_id limit 50", "spans")
register("trace_stats", lambda s, d: traces.stats(traces.assemble(spans(s, d))), f"select count(*) as traces, sum(span_count)::bigint as spans, round(avg(duration_ms))::bigint as avg_ms, max(duration_ms) as max_ms, count(*) filter (error) as errors, count(*) filter (error) / count(*)::double as error_fraction from ({ROLL}) r", "spans")
register("trace_spans", lambda s, d: spans(s, d).where("trace_id = 't1'").select("span_id", "parent_span_id", "service_name", "start_time"), "select span_id, parent_span_id, service_name, start_time from spans where trace_id = 't1'", "spans")
EDGES = "select p.service_name as source, c.service_name as target, count(*) as calls from spans c join spans p on c.trace_id = p.trace_id and c.parent_span_id = p.span_id where p.service_name <> c.service_name group by 1, 2"
register("service_dependencies", lambda s, d: traces.dependencies(view(s, d, "spans")), EDGES, "spans")
register("service_nodes", lambda s, d: traces.nodes(traces.dependencies(view(s, d, "spans"))), f"select service, calls, 30 + 40.0::double * calls / max(calls) over () as size from (select service, sum(calls)::bigint as calls from (select source as service, calls from ({EDGES}) e union all select target, calls from ({EDGES}) e) x group by 1) y", "spans")
register("span_waterfall", lambda s, d: traces.waterfall(spans(s, d)), f"select trace_id, span_id, case when total > 0 then date_diff('microsecond', t0, start_time) / total * 100 else 0 end as left_pct, case when total > 0 then greatest(date_diff('microsecond', start_time, end_time) / total * 100, 0.5) else 100 end as width_pct from (select *, date_diff('microsecond', t0, t1)::double as total from (select *, min(start_time) over (partition by trace_id) as t0, max(end_time) over (partition by trace_id) as t1 from ({SPANS_SQL}) s) w) v", "spans")
register("span_depth", lambda s, d: traces.depths(view(s, d, "spans")), "select trace_id, span_id, case when span_id like 'o%' then 0 else cast(split_part(span_id, '-', 2) as int) - case when bool_or(span_id like 'o%') over (partition by trace_id) then 0 else 1 end end as depth from spans", "spans")

# alerts
register("alert_rule_scope", on("alert_rules", "projects")(lambda r, p: alerts.in_scope(r, p.select(F.col("id").alias("project_id"))).select("project_id", "rule_id", "threshold")), "select p.id as project_id, rule_id, threshold from alert_rules r join projects p on r.project_id = p.id or r.project_id is null", "alert_rules", "projects")
register("alert_last_trigger", on("alert_history")(alerts.last_triggers), "select rule_id, max(triggered_at) as last_trigger from alert_history group by 1", "alert_history")
register("alert_fire", on("alert_rules", "alert_history", "logs")(lambda r, h, x: alerts.fired(r, h, x, NOW)), f"""select r.rule_id, count(*) as log_count, r.threshold from alert_rules r left join (select rule_id, max(triggered_at) as t from alert_history group by 1) h on h.rule_id = r.rule_id join logs l
 on list_contains(string_split(r.levels, ','), l.level) and (r.service is null or l.service = r.service or l.service = 'unknown') and (r.project_id is null or l.project_id = r.project_id) and l.time <= timestamp '{NOW}' and l.time > greatest(coalesce(h.t, timestamp '1970-01-01'), timestamp '{NOW}' - to_minutes(r.time_window))
 where r.enabled group by 1, 3 having count(*) >= r.threshold""", "alert_rules", "alert_history", "logs")
register("alert_history_list", on("alert_history", "alert_rules", "projects")(lambda h, r, p: h.join(r.join(p.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id", "left"), "rule_id").select("id", "rule_id", "triggered_at", "log_count", "service", "project")), "select h.id, h.rule_id, h.triggered_at, h.log_count, r.service, p.name as project from alert_history h join alert_rules r on h.rule_id = r.rule_id left join projects p on p.id = r.project_id", "alert_history", "alert_rules", "projects")
register("alert_stats", on("alert_rules", "alert_history", "projects")(lambda r, h, p: admin.alert_stats(r, h, p, NOW)), f"""select p.organization_id, count(*) as rules, count(*) filter (r.enabled) as active, count(*) filter (not r.enabled) as disabled, coalesce(sum(h.day), 0)::bigint as day, coalesce(sum(h.week), 0)::bigint as week, coalesce(sum(h.sent), 0)::bigint as sent, coalesce(sum(h.failed), 0)::bigint as failed
 from alert_rules r left join projects p on p.id = r.project_id left join (select rule_id, count(*) filter (triggered_at >= timestamp '{NOW}' - interval '24 hours') as day, count(*) filter (triggered_at >= timestamp '{NOW}' - interval '7 days') as week, count(*) filter (notified and error is null) as sent, count(*) filter (notified and error is not null) as failed from alert_history group by 1) h on h.rule_id = r.rule_id group by 1""", "alert_rules", "alert_history", "projects")
register("alert_rules_of_organizations", on("alert_rules", "projects", "organizations")(admin.rules_of_organizations), "select r.rule_id, o.name as organization from alert_rules r join projects p on p.id = r.project_id join organizations o on o.id = p.organization_id", "alert_rules", "projects", "organizations")
register("alerts_marked_notified", on("alert_history")(lambda h: admin.notified(h).select("id", "notified")), "select id, notified and error is null as notified from alert_history", "alert_history")
BUCKETS = "select time_bucket(interval '1 hour', time) as bucket, count(*) as n from logs where level in ('error', 'critical') group by 1"
preview = lambda x: alerts.preview_buckets(x, ["error", "critical"], "1h")
register("alert_preview_buckets", logs(preview), BUCKETS, "logs")
register("alert_preview_incidents", logs(lambda x: alerts.preview_incidents(preview(x), 3, "1h")), f"""select start_time, end_time, buckets, peak, average from (with recursive b as (select *, row_number() over (order by bucket) as i from ({BUCKETS}) q),
 h as (select *, i - row_number() over (order by bucket) as island from b where n >= 3), o as (select *, row_number() over (partition by island order by bucket) as k from h),
 f(island, k, bucket, average) as (select island, k, bucket, n::bigint from o where k = 1 union all select o.island, o.k, o.bucket, floor((f.average * f.k + o.n) / o.k::double + 0.5)::bigint from f join o on o.island = f.island and o.k = f.k + 1)
 select min(o.bucket) as start_time, max(o.bucket) + interval '1 hour' as end_time, count(*) as buckets, max(n) as peak, arg_max(f.average, o.k) as average from o join f on f.island = o.island and f.k = o.k group by o.island) z""", "logs")
register("alert_preview_stats", logs(lambda x: alerts.preview_stats(preview(x), 3)), f"select count(*) as buckets, count(*) filter (n >= 3) as hot, list_sort(list(n))[least(floor(count(*) * 0.5), count(*) - 1)::int + 1] as p50, list_sort(list(n))[least(floor(count(*) * 0.95), count(*) - 1)::int + 1] as p95, list_sort(list(n))[least(floor(count(*) * 0.99), count(*) - 1)::int + 1] as p99, case when count(*) > 0 then count(*) filter (n >= 3) * 100.0::double / count(*) else 0 end as pct_hot from ({BUCKETS}) b", "logs")

# detections
HAS = lambda *w: "(" + " or ".join(f"contains(lower(message), '{x}')" for x in w) + ")"
RULE_SQL = {
    "auth-1": HAS("failed login", "authentication failure"), "auth-2": HAS("sudo:", "privilege escalation") + " and not level = 'debug'", "web-1": "regexp_matches(lower(message), '(or 1=1|union select)')", "web-2": HAS("../../", "/etc/passwd"),
    "web-3": HAS("<script>"), "ops-1": "(" + " or ".join(f"contains(lower({c}), '{w}')" for c in ("service", "level", "message", "metadata", "trace_id") for w in ("timeout", "timed out")) + ") and level in ('error', 'critical')", "ops-2": "service = 'payment-service' and starts_with(level, 'err')",
}
quoted = lambda w: w.lower().replace("'", "''")
for rule in sigma.BUILT_IN:
    field, wanted = next(iter(rule.detection["selection"].items()))
    RULE_SQL[rule.id] = HAS(*map(quoted, wanted)) if field == "message|contains" else "level in (" + ", ".join(f"'{v}'" for v in wanted) + ")"
DETECTED = " union all ".join(f"select id as log_id, time, project_id, service, level, message, trace_id, '{r.id}' as rule_id, '{r.title}' as title, '{r.level}' as severity, '{','.join(sigma.mitre(r.tags)[0])}' as tactics, '{','.join(sigma.mitre(r.tags)[1])}' as techniques from logs where {RULE_SQL[r.id]}" for r in sigma.PACKS)
for pack in ("auth", "web", "ops"):
    own = [r for r in sigma.PACKS if r.pack == pack]
    register(f"sigma_match_{pack}", logs(lambda x, own=own: sigma.detect(x, own).select("log_id", "rule_id", "severity")), f"select log_id, rule_id, severity from ({DETECTED}) d where rule_id in ({', '.join(repr(r.id) for r in own)})", "logs")
MIXES = {
    "sigma_condition_mix": ({"a": {"level": "warn"}, "b": {"service": "auth-service"}, "c": {"message|contains": "timeout"}, "condition": "a or b and not c"}, "(level = 'warn' or service = 'auth-service') and not contains(lower(message), 'timeout')"),
    "sigma_modifiers": ({"a": {"message|startswith": "click", "message|endswith": "5"}, "b": {"message|all": "payment ok"}, "condition": "1 of them"}, "(starts_with(lower(message), 'click') and ends_with(lower(message), '5')) or (contains(lower(message), 'payment') and contains(lower(message), 'ok'))"),
    "sigma_not_missing_field": ({"a": {"trace_id|startswith": "trace-1"}, "condition": "not a"}, "not coalesce(starts_with(trace_id, 'trace-1'), false)"),
}
for name, (detection, where) in MIXES.items():
    register(name, logs(lambda x, dt=detection: sigma.detect(x, [sigma.Rule("r", "r", "low", dt)]).select("log_id")), f"select id as log_id from logs where {where}", "logs")
SOURCES = {
    "sigma_logsource": ({"service": "auth*", "product": "any"}, "(starts_with(service, 'auth') or service = 'unknown')"), "sigma_logsource_exact": ({"service": "Auth-Service"}, "service in ('auth-service', 'unknown')"),
    "sigma_logsource_product": ({"product": "windows"}, "id % 4 in (0, 1)"), "sigma_logsource_category": ({"category": "*-service"}, "(service like '%-service' or service = 'unknown')"),
}
PRODUCT = "case id % 4 when 0 then 'Windows' when 1 then 'unknown' when 2 then 'linux' end"
for name, (source, where) in SOURCES.items():
    rule = sigma.Rule("r", "r", "low", {"a": {"level": "error"}, "condition": "a"}, source)
    register(name, logs(lambda x, r=rule: sigma.detect(x.withColumn("metadata", F.expr(f"to_json(struct({PRODUCT} as product))")), [r]).select("log_id")), f"select id as log_id from logs where level = 'error' and {where}", "logs")
told_fields = sigma.Rule("r", "r", "low", {"a": {"level": "error"}, "b": [{"metadata.k": 7}, {"k|contains": "1"}, {"service|base64offset": "x"}], "condition": "a and b"}, tags=("attack.t1190",))
register("sigma_matched_fields", logs(lambda x: sigma.matched(x, [told_fields]).select("log_id", "rule_id", F.array_join("tags", ",").alias("tags"), F.get_json_object("fields", "$.level").alias("level"), F.get_json_object("fields", "$.k").alias("k"))), "select id as log_id, 'r' as rule_id, 'attack.t1190' as tags, level, metadata->>'k' as k from logs where level = 'error' and (metadata->>'k' = '7' or contains(metadata->>'k', '1'))", "logs")
register("sigma_base64", logs(lambda x: sigma.detect(x.withColumn("message", F.concat(F.lit("="), F.base64(F.encode("message", "utf-8")))), [sigma.Rule("r", "r", "low", {"a": {"message|base64offset": "FAILED login"}, "condition": "a"})]).select("log_id")), "select id as log_id from logs where contains(lower(message), 'failed login')", "logs")
register("sigma_built_in", logs(lambda x: sigma.detect(x, sigma.BUILT_IN).select("log_id", "rule_id", "severity")), " union all ".join(f"select id as log_id, '{r.id}' as rule_id, '{r.level}' as severity from logs where {RULE_SQL[r.id]}" for r in sigma.BUILT_IN), "logs")
as_alerts = lambda x: sigma.alert_rules(x.sparkSession, sigma.BUILT_IN[:2])
judged = lambda r, x: r.join(r.select("rule_id", F.explode(F.split("levels", ",")).alias("level")).join(x.groupBy("level").agg(F.count("*").alias("n")), "level").groupBy("rule_id").agg(F.sum("n").alias("logs")), "rule_id")
register("sigma_alert_rules", logs(lambda x: judged(as_alerts(x), x).withColumn("keywords", F.array_join("keywords", ","))), "select t.*, (select count(*) from logs l where list_contains(string_split(t.levels, ','), l.level)) as logs from (values ('startup-reliability-high-error-rate', 'High Error Rate Detection', 'any', 'debug,info,warn,error,critical', 3, 300, 'error,critical'), ('startup-reliability-critical-errors', 'Critical System Errors', 'any', 'debug,info,warn,error,critical', 1, 60, 'critical')) t(rule_id, name, service, levels, threshold, time_window, keywords)", "logs")
STORED = "select id as rule_id, id % 3 as organization_id, case when id % 2 = 0 then cast(id % 5 as int) end as project_id, case id % 4 when 0 then 'failed' when 1 then 'partial' else 'success' end as status, id % 7 <> 0 as enabled from logs"
register("sigma_rule_selection", logs(lambda x: sigma.selected(x.sparkSession.sql(STORED.replace("from logs", "from {x}"), x=x), 1, 3).select("rule_id", "project_id")), f"select rule_id, project_id from ({STORED}) r where organization_id = 1 and status <> 'failed' and enabled and (project_id = 3 or project_id is null)", "logs")
mitre_of = lambda q: sigma.with_stored_mitre(q, q.sparkSession.createDataFrame([("web-1", ["own"], ["T9999"]), ("web-2", [], [])], "rule_id string, tactics array<string>, techniques array<string>"))
register("detections_stored_mitre", logs(lambda x: mitre_of(sigma.detect(x)).select("log_id", "rule_id", F.array_join("tactics", ",").alias("tactics"), F.array_join("techniques", ",").alias("techniques"))), f"select log_id, rule_id, case when rule_id = 'web-1' then 'own' else tactics end as tactics, case when rule_id = 'web-1' then 'T9999' else techniques end as techniques from ({DETECTED}) d", "logs")
detected = lambda fn: logs(lambda x: fn(sigma.detect(x)))
register("detections_list", detected(lambda q: q.where("severity in ('high', 'critical')").orderBy(F.col("time").desc(), "log_id", "rule_id").limit(50).select("log_id", "time", "rule_id", "severity")), f"select log_id, time, rule_id, severity from ({DETECTED}) d where severity in ('high', 'critical') order by time desc, log_id, rule_id limit 50", "logs")
register("siem_top_threats", detected(siem.top_threats), f"select rule_id, title, severity, tactics, techniques, count(*) as n from ({DETECTED}) d group by all order by n desc, rule_id limit 10", "logs")
register("siem_timeline", detected(lambda q: siem.timeline(q, "6h")), f"select time_bucket(interval '6 hours', time) as bucket, count(*) as n from ({DETECTED}) d group by 1", "logs")
register("siem_severity_share", detected(siem.severity_share), f"select severity, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over ()) as share from ({DETECTED}) d group by 1", "logs")
register("siem_mitre_heatmap", detected(siem.mitre_heatmap), f"select techniques, tactics, count(*) as n from ({DETECTED}) d where techniques <> '' group by 1, 2 order by n desc, techniques, tactics limit 50", "logs")
WEIGHT = "case severity when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 else 1 end"
register("incident_by_trace", detected(lambda q: siem.incidents_by_trace(q).drop("tactics", "techniques").withColumn("log_ids", F.array_join(F.transform("log_ids", lambda i: i.cast("string")), ","))), f"select trace_id, project_id, count(*) as n, min(time) as start_time, max(time) as end_time, arg_max(severity, {WEIGHT}) as severity, string_agg(distinct service, ',' order by service) as services, array_to_string(list_sort(list(log_id)), ',') as log_ids from ({DETECTED}) d where trace_id is not null group by 1, 2 having count(*) > 1", "logs")
BUSY = DETECTED.replace("from logs where", "from busy_logs where")
for name, since in (("incident_burst", "2024-01-01 22:00:00"), ("incident_burst_month", MONTH)):
    register(name, on("busy_logs")(lambda x, t=since: siem.incidents_by_burst(sigma.detect(x), since=t)), f"select service, severity, time_bucket(interval '5 minutes', time) as bucket, count(*) as n, arg_min(project_id, (time, log_id, rule_id)) as project_id, min(time) as start_time, max(time) as end_time from ({BUSY}) d where trace_id is null and time >= timestamp '{since}' group by 1, 2, 3 having count(*) >= 3", "busy_logs")

INCIDENTS = f"select trace_id, project_id, arg_max(severity, {WEIGHT}) as severity, concat(trace_id, '/', cast(project_id as varchar)) as incident_id from ({DETECTED}) d where trace_id is not null group by 1, 2 having count(*) > 1"
once = lambda fn: logs(lambda x: fn(written(sigma.detect(x))))  # noqa: E731  detections that are used twice are written, not found twice
register("siem_affected_services", once(lambda q: siem.affected_services(siem.with_incident(q, siem.incidents_by_trace(q)))), f"select d.service, count(*) as n, count(distinct i.incident_id) as incidents, count(*) filter (d.severity = 'critical') as critical, count(*) filter (d.severity = 'high') as high from ({DETECTED}) d left join ({INCIDENTS}) i on d.trace_id = i.trace_id and d.project_id = i.project_id group by 1 order by n desc, service limit 10", "logs")
for width in ("1h", "1d"):
    register(f"siem_timeline_{width}", detected(lambda q, w=width: siem.timeline(q, w)), f"select time_bucket(interval '{width[0]} {'hour' if width == '1h' else 'day'}', time) as bucket, count(*) as n from ({DETECTED}) d group by 1", "logs")

# identifiers and addresses
FOUND = " union ".join(f"select id as log_id, time, project_id, '{p.type}' as type, unnest(regexp_extract_all(message, '{quoted_regex}', 1)) as value, 'message' as source from logs" for p in identifiers.PATTERNS if (quoted_regex := p.expression.replace("'", "''")))
register("identifiers_extract", logs(lambda x: identifiers.extract(x).drop("field")), FOUND, "logs")
register("correlated_logs", logs(lambda x: identifiers.correlated(x, identifiers.extract(x), "user_id", "7", DAY, 20_000, 100).select("id", "time")), f"select id, time from logs where id in (select log_id from ({FOUND}) f where type = 'user_id' and lower(value) = '7' and time between timestamp '{DAY}' - interval '20000 minutes' and timestamp '{DAY}' + interval '20000 minutes' order by time desc, log_id desc limit 100)", "logs")
register("ip_extract", logs(lambda x: x.select("id", F.explode(X.public_ips(F.col("message"))).alias("ip"))), "select distinct id, ip from (select id, unnest(regexp_extract_all(message, '\\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\b')) as ip from logs) x where not regexp_matches(ip, '^(10\\.|127\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|0\\.0\\.0\\.0$)')", "logs")
SCORE = "cast(split_part(ip, '.', 4) as int) % 6"
register("ip_reputation", logs(lambda x: x.select(F.explode(X.public_ips(F.col("message"))).alias("ip")).groupBy("ip").agg(F.count("*").alias("n")).withColumn("score", F.split_part("ip", F.lit("."), F.lit(4)).cast("int") % 6).withColumn("verdict", F.when(F.col("score") >= 3, "malicious").when(F.col("score") >= 1, "suspicious").otherwise("clean"))), f"select ip, count(*) as n, {SCORE} as score, case when {SCORE} >= 3 then 'malicious' when {SCORE} >= 1 then 'suspicious' else 'clean' end as verdict from (select regexp_extract(message, '203\\.0\\.113\\.[0-9]+') as ip from logs where contains(message, '203.0.113.')) x group by 1", "logs")

# errors and scalars
ERRORS = "select *, sha256(concat(service, ':', regexp_replace(message, '[0-9]+', 'N', 'g'))) as fingerprint from logs where level in ('error', 'critical')"
grouped = lambda x: x.where("level in ('error', 'critical')").withColumn("fingerprint", F.sha2(F.concat("service", F.lit(":"), F.regexp_replace("message", "[0-9]+", "N")), 256))
GROUPS = f"select project_id, fingerprint, count(*) as n, min(time) as first_seen, max(time) as last_seen, string_agg(distinct service, ',' order by service) as services, arg_min(id, (time, id)) as sample_log_id from ({ERRORS}) e group by 1, 2"
register("error_groups", logs(lambda x: errors.error_groups(grouped(x))), GROUPS, "logs")
OPEN = "case when substr(fingerprint, 1, 1) in ('0', '1', '2', '3') then 'ignored' else 'open' end = 'open'"
register("error_groups_top", logs(lambda x: errors.error_groups(grouped(x)).where(F.expr(OPEN)).orderBy(F.col("n").desc(), "project_id", "fingerprint").limit(5).select("project_id", "fingerprint", "n")), f"select project_id, fingerprint, n from ({GROUPS}) g where {OPEN} order by n desc, project_id, fingerprint limit 5", "logs")
PRINT = "api-gateway:error worker heartbeat req-N"
register("error_trend", logs(lambda x: errors.trend(grouped(x), F.sha2(F.lit(PRINT), 256), "1d")), f"select time_bucket(interval '1 day', time) as bucket, count(*) as n from ({ERRORS}) e where fingerprint = sha256('{PRINT}') group by 1", "logs")
numbers = lambda s, d: table(s, d, "orders").select("o_orderkey")
k = lambda: F.col("o_orderkey")
register("map_syslog_priority", lambda s, d: numbers(s, d).select("o_orderkey", X.level_of_priority((k() % 8).cast("int")).alias("level")), "select o_orderkey, case when o_orderkey % 8 <= 2 then 'critical' when o_orderkey % 8 = 3 then 'error' when o_orderkey % 8 = 4 then 'warn' when o_orderkey % 8 <= 6 then 'info' else 'debug' end as level from orders")
register("map_otlp_severity", lambda s, d: numbers(s, d).select("o_orderkey", X.level_of_otlp(F.when(k() % 3 == 0, "WARNING"), (k() % 25).cast("int")).alias("level")), "select o_orderkey, case when o_orderkey % 3 = 0 then 'warn' when o_orderkey % 25 >= 21 then 'critical' when o_orderkey % 25 >= 17 then 'error' when o_orderkey % 25 >= 13 then 'warn' when o_orderkey % 25 >= 9 then 'info' when o_orderkey % 25 >= 1 then 'debug' else 'info' end as level from orders")
register("ns_to_ms", lambda s, d: numbers(s, d).select("o_orderkey", X.ns_to_ms(k() * 1_234_567).alias("ms")), "select o_orderkey, (o_orderkey * 1234567) // 1000000 as ms from orders")
register("trace_id_normalise", lambda s, d: numbers(s, d).select("o_orderkey", X.valid_trace_id(F.when(k() % 2 == 0, F.repeat(F.lit("0"), (k() % 5).cast("int"))).otherwise(k().cast("string"))).alias("trace_id")), "select o_orderkey, case when o_orderkey % 2 = 0 then null else cast(o_orderkey as varchar) end as trace_id from orders")
register("syslog_parse", logs(lambda x: ingest.syslog(x.select("id", F.concat(F.lit("<"), (F.col("id") % 190).cast("string"), F.lit(">Jan 15 10:00:00 host1 "), "service", F.lit("[12]: "), "message").alias("line")))), "select id, cast(id % 190 as int) as pri, 'host1' as host, service, case when id % 190 % 8 <= 2 then 'critical' when id % 190 % 8 = 3 then 'error' when id % 190 % 8 = 4 then 'warn' when id % 190 % 8 <= 6 then 'info' else 'debug' end as level, message from logs", "logs")
register("container_id", logs(lambda x: x.select("id", ingest.container_id(F.concat(F.lit("/var/lib/docker/containers/"), F.md5(F.col("id").cast("string")), F.lit("/x.log"))).alias("container"))), "select id, substr(md5(cast(id as varchar)), 1, 12) as container from logs", "logs")
register("exceptions_parse", logs(lambda x: errors.exceptions(x.drop("metadata").withColumn("message", F.concat(F.lit("TypeError: bad "), "message", F.lit("\n    at handle (/app/src/"), "service", F.lit(".js:10:5)\n    at next (/app/node_modules/x/i.js:1:2)")))).select("log_id", "type", "language", "fingerprint", "shape")), "select id as log_id, 'TypeError' as type, 'nodejs' as language, sha256(concat('TypeError:src/', service, '.js:handle')) as fingerprint, concat('bad ', regexp_replace(message, '[0-9]+', 'N', 'g')) as shape from logs where level in ('error', 'critical')", "logs")
