"""Registered queries of streams that come in parts, each run a restart from the checkpoint of the one before; with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.plans.catalogue import BUSY, DETECTED, ORACLES, QUERIES, SPANS_SQL, WEIGHT, register, spans
from logloom.plans.views import twin, view
from logloom.session import move, scratch, ship
from logloom.sources import ingest, tail
from logloom.streaming import alarms, casework, rollups, spanstore
from logloom.streaming.tables import append

#: The ten days of a log; part 2 is what is left.
PART = "least(2, cast(floor((day({0}) - 1) / 10) as int))"


def in_parts(rows, part: str, follow) -> str:
    """follow(stream, path) on rows as they come, part by part; the path that it has written."""
    spark, staged, source, path = rows.sparkSession, *[scratch(rows.sparkSession) for _ in range(3)]
    # rows are made once; a part comes as its folder moves to the source
    rows.withColumn("_part", F.expr(part).cast("int")).write.partitionBy("_part").parquet(staged)
    for p in range(3):
        move(spark, f"{staged}/_part={p}", f"{source}/{p}")
        follow(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(source), path)
    return path


def logs_in_parts(spark, sf_dir: str, follow, part: str = PART.format("time"), name: str = "logs") -> str:
    return in_parts(view(spark, sf_dir, name), part, follow)


def alerts(spark, sf_dir):
    rules = view(spark, sf_dir, "alert_rules")
    path = logs_in_parts(spark, sf_dir, lambda x, path: alarms.evaluate(x, rules, path))
    return alarms.history(spark, path).rows().select("rule_id", "triggered_at", "log_count")


FITS = "list_contains(string_split(r.levels, ','), l.level) and (r.service is null or l.service = r.service or l.service = 'unknown') and (r.project_id is null or l.project_id = r.project_id)"
COUNTED = "least(s.inside, s.so_far - f.so_far)"
register("stream_alerts", alerts)
ORACLES["stream_alerts"] = twin("", "alert_rules", "logs").replace("with ", "with recursive ", 1).rstrip() + f""",
 c as materialized (select r.rule_id, r.threshold, r.time_window, time_bucket(interval '1 minute', l.time) + interval '1 minute' as tick, count(*) as n from alert_rules r join logs l on {FITS} where r.enabled group by all),
 s as materialized (select *, sum(n) over (partition by rule_id order by tick) as so_far, sum(n) over (partition by rule_id order by tick range between to_minutes(time_window - 1) preceding and current row) as inside from c where tick <= (select max(time) from logs) - interval '10 minutes'),
 f as (select distinct rule_id, timestamp '1970-01-01' as tick, cast(0 as hugeint) as so_far, cast(0 as hugeint) as log_count from s
  union all select s.rule_id, min(s.tick), arg_min(s.so_far, s.tick), arg_min({COUNTED}, s.tick) from f join s on f.rule_id = s.rule_id and s.tick > f.tick and {COUNTED} >= s.threshold group by s.rule_id)
 select rule_id, tick as triggered_at, cast(log_count as bigint) as log_count from f where log_count > 0"""


def incidents(kind: str, *columns, **how):
    return lambda s, d: casework.incidents(s, logs_in_parts(s, d, casework.follow, **how)).rows().where(F.col("kind") == kind).selectExpr(*columns)


def feed(spark, sf_dir):
    path = logs_in_parts(spark, sf_dir, casework.follow)
    return casework.events(spark, path).select("type", "id", F.get_json_object("data", "$.n").cast("long").alias("n"))


BURSTS = f"select service, severity, time_bucket(interval '5 minutes', time) as b, count(*) as n, min(time) as start_time, max(time) as end_time, arg_min(project_id, (time, log_id, rule_id)) as project_id from ({BUSY}) d where trace_id is null group by 1, 2, 3 having count(*) >= 3"
NAMED = f"select case when trace_id is not null then concat(trace_id, '/', cast(project_id as varchar)) else concat('burst/', service, '/', severity, '/', cast(cast(epoch(time_bucket(interval '5 minutes', time)) as bigint) as varchar)) end as id, case when trace_id is null then 3 else 2 end as least_size, {PART.format('time')} as part from ({DETECTED}) d"
register("stream_incidents", incidents("trace", "trace_id", "project_id", "n", "severity"), f"select trace_id, project_id, count(*) as n, arg_max(severity, {WEIGHT}) as severity from ({DETECTED}) d where trace_id is not null group by 1, 2 having count(*) > 1", "logs")
register("stream_incident_bursts", incidents("burst", "project_id", "severity", "n", "start_time", "end_time", "array_join(services, ',') as services", part="id % 3", name="busy_logs"), f"select project_id, severity, n, start_time, end_time, service as services from ({BURSTS}) x", "busy_logs")
register("siem_event_feed", feed, f"""select case when n - own < least_size then 'incident_created' else 'incident_updated' end as type, id, cast(n as bigint) as n
 from (select id, least_size, count(*) as own, sum(count(*)) over (partition by id order by part) as n from ({NAMED}) x group by id, least_size, part) y where n >= least_size""", "logs")

# roots and every third child come after the other spans of their trace
LATER = "case when minutes = 0 then 2 when minutes % 3 = 0 then 1 else 0 end"


def trace_rows(spark, sf_dir):
    return spanstore.traces(spark, in_parts(spans(spark, sf_dir), LATER, spanstore.upsert)).rows()


register("stream_trace_upserts", lambda s, d: trace_rows(s, d).select(*QUERIES["trace_rollup"](s, d).columns))
ORACLES["stream_trace_upserts"] = ORACLES["trace_rollup"]
stored_spans = lambda s, d: spanstore.spans(s, in_parts(spans(s, d), LATER, lambda x, path: spanstore.insert(x, path, "month"))).rows()
register("span_bulk_insert", lambda s, d: stored_spans(s, d).groupBy("period").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"), F.count_if(F.col("parent_span_id").isNull()).alias("roots")), f"select cast(date_trunc('month', start_time) as date) as period, count(*) as n, count(distinct trace_id) as traces, count(*) filter (parent_span_id is null) as roots from ({SPANS_SQL}) s group by 1", "spans")

# every other row of a part's last two hours comes with the next part
LATE = f"case when id % 2 = 0 and day(time) in (10, 20) and hour(time) >= 22 then {PART.format('time')} + 1 else {PART.format('time')} end"
kept = lambda s, d: rollups.Rollups(s, logs_in_parts(s, d, rollups.follow, LATE))
ROLLED = "select time_bucket(interval '{0}', time) as bucket, project_id, level, service, count(*) as log_count from logs group by 1, 2, 3, 4"
CLOSED = "where bucket + interval '{0}' <= (select max(time) from logs) - interval '{0}'"
register("stream_rollup_hourly", lambda s, d: kept(s, d).stored(rollups.HOURLY), f"select * from ({ROLLED.format('1 hour')}) x {CLOSED.format('1 hour')}", "logs")
register("stream_rollup_daily", lambda s, d: kept(s, d).stored(rollups.DAILY), f"select * from ({ROLLED.format('1 day')}) x {CLOSED.format('1 day')}", "logs")
register("rollup_stored_and_recent", lambda s, d: kept(s, d).counts(rollups.HOURLY), ROLLED.format("1 hour"), "logs")


def tailed(spark, sf_dir):
    """Logs as syslog lines in files of a folder, which the tail source follows into an exactly-once table."""
    ship(spark)
    spark.dataSource.register(tail.TailSource)
    folder, out = scratch(spark), scratch(spark)
    rows = view(spark, sf_dir, "logs")
    line = F.concat(F.lit("<"), (F.col("id") % 190).cast("string"), F.lit(">"), F.date_format("time", "MMM"), F.lpad(F.dayofmonth("time").cast("string"), 3, " "), F.date_format("time", " HH:mm:ss"), F.lit(" host1 "), "service", F.lit("[7]: "), "message")
    for p in range(2):
        rows.where(f"id % 2 = {p}").select(line).write.mode("append").text(folder)
        lines = spark.readStream.format("tail").options(path=folder, pattern="part-*", chunk="262144").load()
        append(lines, f"{out}/lines", f"{out}/state")
    read = spark.read.schema(tail.SCHEMA).parquet(f"{out}/lines")
    return ingest.syslog(read.select(F.col("place").alias("id"), "line")).select("pri", "host", "service", "message")


register("stream_tail_syslog", tailed, "select cast(id % 190 as int) as pri, 'host1' as host, service, message from logs", "logs")
