"""More registered queries: incidents, previews, enrichment and listings, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import alerts, errors, identifiers, incidents, siem, sigma
from logloom.plans.catalogue import BUCKETS, DETECTED, FOUND, GROUPS, WEIGHT, grouped, logs, once, preview, register
from logloom.plans.views import NOW

BAD = ["error", "critical"]
detected = lambda fn: logs(lambda x: fn(sigma.detect(x)))
STATUS = "case n % 3 when 0 then 'open' when 1 then 'investigating' else 'resolved' end"
ASSIGNEE = "case when project_id % 2 = 0 then 'ann' end"
INCIDENTS = f"select *, {STATUS} as status, {ASSIGNEE} as assignee from (select trace_id, project_id, count(*) as n, arg_max(severity, {WEIGHT}) as severity from ({DETECTED}) d where trace_id is not null group by 1, 2 having count(*) > 1) x"
incidents_of = lambda q: siem.incidents_by_trace(q).withColumn("status", F.expr(STATUS)).withColumn("assignee", F.expr(ASSIGNEE))

register("incident_links", once(lambda q: incidents.links(q, siem.incidents_by_trace(q))), f"select d.log_id, d.rule_id, concat(i.trace_id, '/', cast(i.project_id as varchar)) as incident from ({DETECTED}) d join ({INCIDENTS}) i on d.trace_id = i.trace_id and d.project_id = i.project_id", "logs")
register("siem_totals", once(lambda q: incidents.totals(q, incidents_of(q))), f"select (select count(*) from ({DETECTED}) d) as detections, count(*) as incidents, count(*) filter (status in ('open', 'investigating')) as open, count(*) filter (severity = 'critical') as critical from ({INCIDENTS}) i", "logs")
PICKED = f"select trace_id, project_id, status, severity from ({INCIDENTS}) i"
register("incidents_by_status", detected(lambda q: incidents.listed(incidents_of(q), statuses=["open", "investigating"], severities="critical", assignee="ann", technique="T1190").select("trace_id", "project_id", "status", "severity")), f"{PICKED} where status in ('open', 'investigating') and severity = 'critical' and assignee = 'ann' and exists (select 1 from ({DETECTED}) d where d.trace_id = i.trace_id and d.project_id = i.project_id and list_contains(string_split(techniques, ','), 'T1190'))", "logs")
register("incident_by_id", detected(lambda q: incidents_of(q).where("trace_id = 'trace-12-2024-01-12' and project_id = 12").select("trace_id", "project_id", "status", "severity")), f"{PICKED} where trace_id = 'trace-12-2024-01-12' and project_id = 12", "logs")
TACTICS = sorted({t for r in sigma.PACKS for t in sigma.mitre(r.tags)[0]})
MATRIX = ", ".join(f"count(*) filter (tactics = '{t}') as {t}" for t in TACTICS)
register("siem_heatmap_matrix", detected(lambda q: incidents.heatmap_matrix(q, TACTICS)), f"select techniques, {MATRIX} from ({DETECTED}) d where techniques <> '' group by 1", "logs")
register("detections_by_technique", detected(lambda q: q.where(F.array_contains("techniques", "T1190")).select("log_id", "rule_id")), f"select log_id, rule_id from ({DETECTED}) d where list_contains(string_split(techniques, ','), 'T1190')", "logs")
HISTORY = "select trace_id as incident, time, id, level, case when level in ('error', 'critical') then 'resolved' else 'open' end as status from logs where trace_id is not null"
history = logs(lambda x: x.where("trace_id is not null").select(F.col("trace_id").alias("incident"), "time", "id", "level", F.when(F.col("level").isin(BAD), "resolved").otherwise("open").alias("status")))
register("incident_history", lambda s, d: incidents.audit_trail(history(s, d), "incident", ["time", "id"], ["level", "status"]), f"""select * from (with h as (select *, lag(level) over w as l, lag(status) over w as t, row_number() over w as n from ({HISTORY}) x window w as (partition by incident order by time, id))
 select incident, time, id, 'level' as field, l as old, level as new from h where n > 1 and level is distinct from l union all select incident, time, id, 'status', t, status from h where n > 1 and status is distinct from t) z""", "logs")
register("incident_resolution", lambda s, d: incidents.resolution(history(s, d)).select("incident", "id", "status", "resolved_at"), f"""select incident, id, status, case when status = 'resolved' then max(b) over (partition by incident order by time, id) end as resolved_at
 from (select *, case when status = 'resolved' and coalesce(lag(status) over (partition by incident order by time, id), '') <> 'resolved' then time end as b from ({HISTORY}) x) y""", "logs")

register("ingest_throughput", logs(lambda x: incidents.throughput(x, NOW)), f"select count(*) / 3600.0::double as per_second, avg(date_diff('microsecond', time, timestamp '{NOW}') / 1000.0::double) filter (time >= timestamp '{NOW}' - interval '5 minutes') as age_ms from logs where time >= timestamp '{NOW}' - interval '1 hour' and time <= timestamp '{NOW}'", "logs")
RANGES = [("203.0.113.0", "203.0.113.99", "north"), ("203.0.113.120", "203.0.113.199", "south"), ("198.51.0.0", "198.53.255.255", "east")]
ips = lambda x: x.select("id", F.explode(X.public_ips(F.col("message"))).alias("ip"))
LAST = "cast(split_part(ip, '.', 4) as int)"
register("ip_locate", logs(lambda x: incidents.locate(ips(x), x.sparkSession.createDataFrame(RANGES, "first string, last string, place string"))), f"select id, ip, case when {LAST} between 0 and 99 then 'north' when {LAST} between 120 and 199 then 'south' end as place from (select id, regexp_extract(message, '203\\.0\\.113\\.[0-9]+') as ip from logs where contains(message, '203.0.113.')) x", "logs")

# previews: hot runs of non-empty hours
RUNS = f"select min(bucket) as start_time, max(bucket) + interval '1 hour' as end_time from (select *, row_number() over (order by bucket) - row_number() over (partition by n >= 3 order by bucket) as island from ({BUCKETS}) b) h where n >= 3 group by island"
runs = lambda x: alerts.preview_incidents(preview(x), 3, "1h")
for unit, part, slots in (("hour", "hour(start_time)", 24), ("day", "dayofweek(start_time)", 7)):
    register(f"alert_preview_by_{unit}", logs(lambda x, u=unit: incidents.start_slots(runs(x), u)), f"select s.slot, count(r.start_time) as n from (select unnest(range({slots})) as slot) s left join ({RUNS}) r on {part} = s.slot group by 1", "logs")
register("alert_preview_samples", logs(lambda x: incidents.samples(x, BAD, runs(x), "1h")), f"select * from (select r.start_time, l.id, row_number() over (partition by r.start_time order by l.time desc, l.id desc) as rank from ({RUNS}) r join logs l on l.time >= r.start_time and l.time < r.end_time and l.level in ('error', 'critical') and time_bucket(interval '1 hour', l.time) in (select bucket from ({BUCKETS}) b where n >= 3)) x where rank <= 5", "logs")
register("alert_preview_advice", logs(lambda x: incidents.suggestions(alerts.preview_stats(preview(x), 3), runs(x), 30)), f"""select concat_ws(',', case when hot * 100.0::double / buckets > 15 then 'raise_threshold' end, case when n > 150 then 'too_many_incidents' end, case when n = 0 and buckets > 0 then 'lower_threshold' end, case when n > 0 and d / n::double > 0.4 then 'one_weekday' end, case when n > 0 and h / n::double > 0.3 then 'one_hour' end) as advice
 from (select count(*) as buckets, count(*) filter (n >= 3) as hot from ({BUCKETS}) b) s, (select count(*) as n from ({RUNS}) r) c, (select coalesce(max(k), 0) as d from (select count(*) as k from ({RUNS}) r group by dayofweek(start_time)) q) w, (select coalesce(max(k), 0) as h from (select count(*) as k from ({RUNS}) r group by hour(start_time)) q) o""", "logs")

MINUTES = "date_diff('second', start_time, end_time) / 60.0::double"
RUN_ROWS = "select min(bucket) as start_time, max(bucket) + interval '1 hour' as end_time, count(*) as buckets from (select *, row_number() over (order by bucket) - row_number() over (partition by n >= 3 order by bucket) as island from ({BUCKETS}) b) h where n >= 3 group by island".replace("{BUCKETS}", BUCKETS)
register("alert_preview_summary", logs(lambda x: alerts.preview_summary(runs(x))), f"select count(*) as incidents, coalesce(sum(buckets), 0)::bigint as triggers, coalesce(floor(avg({MINUTES}) + 0.5), 0)::bigint as average, coalesce(max({MINUTES}), 0)::bigint as longest, coalesce(min({MINUTES}), 0)::bigint as shortest from ({RUN_ROWS}) r", "logs")
register("alert_preview_first", logs(lambda x: alerts.first_incidents(runs(x)).select("start_time", "end_time", "buckets")), f"select start_time, end_time, buckets from ({RUN_ROWS}) r order by start_time limit 10", "logs")

# listings
register("log_search_numbered_page", logs(lambda x: incidents.paged(x.where("level = 'error'").select("id", "time", "service"), [F.col("time").desc(), F.col("id").desc()], 2, 20)), "select id, time, service, (select count(*) from logs where level = 'error') as total, (select cast(ceil(count(*) / 20.0) as bigint) from logs where level = 'error') as pages from logs where level = 'error' order by time desc, id desc limit 20 offset 20", "logs")
register("error_groups_list", logs(lambda x: errors.error_groups(grouped(x)).where(F.col("services").ilike("%GATE%")).orderBy(F.col("last_seen").desc(), "project_id", "fingerprint").limit(20).select("project_id", "fingerprint", "n", "last_seen")), f"select project_id, fingerprint, n, last_seen from ({GROUPS}) g where services ilike '%GATE%' order by last_seen desc, project_id, fingerprint limit 20", "logs")
register("identifiers_by_log", logs(lambda x: identifiers.extract(x).groupBy("log_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "type", "value"))), ";").alias("found"))), f"select log_id, string_agg(distinct concat(type, '=', value), ';' order by concat(type, '=', value)) as found from ({FOUND}) f group by 1", "logs")
register("identifier_dry_run", logs(lambda x: x.select("id", F.slice(F.regexp_extract_all("message", F.lit(r"([0-9]{3,})"), F.lit(1)), 1, 100).alias("m")).where("size(m) > 0").select("id", F.array_join("m", ",").alias("matches"))), "select id, array_to_string(m[1:100], ',') as matches from (select id, regexp_extract_all(message, '([0-9]{3,})', 1) as m from logs) x where len(m) > 0", "logs")
