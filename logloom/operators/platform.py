"""Platform counters, listings, service-map scaling and address enrichment of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import public_ips
from logloom.operators.analytics import ntz


def edge_widths(edges: DataFrame) -> DataFrame:
    """source, target, calls, width: 1 to 6 by calls. Edges are aggregated already: as many as pairs of services."""
    return edges.withColumn("width", 1 + 5.0 * F.col("calls") / F.max("calls").over(Window.partitionBy()))


def reputation(score: Column) -> Column:
    return F.when(score >= 3, "malicious").when(score >= 1, "suspicious").otherwise("clean")


def incident_addresses(linked: DataFrame, threats: DataFrame) -> DataFrame:
    """incident, ip, score, confidence, verdict of the distinct public addresses in an incident's messages.

    linked (incident, message); threats (ip, score). An address without an entry scores 0. Both sides of
    the join are dealt by address, whatever the size of the threat list.
    """
    ips = linked.select("incident", F.explode(public_ips(F.col("message"))).alias("ip")).distinct()
    scored = ips.join(threats.groupBy("ip").agg(F.max("score").alias("score")), "ip", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return scored.select("incident", "ip", "score", (F.col("score") * 10).alias("confidence"), reputation(F.col("score")).alias("verdict"))


def group_logs(errors: DataFrame, logs: DataFrame, print_of: Column) -> DataFrame:
    """Logs of an error group: errors (log_id, fingerprint) joined back to the logs on the log's id."""
    mine = errors.where(F.col("fingerprint") == print_of).select(F.col("log_id").alias("id")).distinct()
    return logs.join(mine, "id", "left_semi")


def once_per_log(errors: DataFrame, order: list[str]) -> DataFrame:
    """One exception a log: the first by `order`."""
    w = Window.partitionBy("log_id").orderBy(*order)
    return errors.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sync_status(syncs: DataFrame) -> DataFrame:
    """total, synced, failed, last_synced of (synced_at, error)."""
    return syncs.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("synced"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.max("synced_at").alias("last_synced"))


def notification_counts(notes: DataFrame) -> DataFrame:
    """total and unread by user of (user_id, is_read)."""
    return notes.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"))


def activity(logs: DataFrame, now: str) -> DataFrame:
    """Logs in all, of today, of the last 7 and 30 days, and the projects with logs in the last 30: one pass."""
    t = F.col("time")
    since = lambda days: (t > ntz(now) - F.expr(f"interval {days} days")) & (t <= ntz(now))
    return logs.agg(
        F.count("*").alias("total"), F.count_if((t >= F.date_trunc("day", ntz(now))) & (t <= ntz(now))).alias("today"), F.count_if(since(7)).alias("week"), F.count_if(since(30)).alias("month"),
        F.countDistinct(F.when(since(30), F.col("project_id"))).alias("active_projects"),
    )


def growth(rows: DataFrame, now: str) -> DataFrame:
    """One row of accounts (created_at, last_login): all, those made today, in the 7 and 30 days up to today's start and since, and those that came in the last 30 days."""
    today = F.date_trunc("day", ntz(now)).cast("timestamp_ntz")
    since = lambda days: F.count_if(F.col("created_at") >= today - F.expr(f"interval {days} days"))
    return rows.agg(F.count("*").alias("total"), since(0).alias("today"), since(7).alias("week"), since(30).alias("month"), F.count_if(F.col("last_login") >= ntz(now) - F.expr("interval 30 days")).alias("active"))


def run_services(logs: DataFrame, incidents: DataFrame, levels) -> DataFrame:
    """start_time, services: services other than 'unknown' with logs in each preview incident (start_time, end_time).

    Services are aggregated by hour first, so hours, not logs, meet the incidents.
    """
    hour = F.date_trunc("hour", "time")
    by_hour = logs.where(F.col("level").isin(list(levels)) & (F.col("service") != "unknown")).select(hour.alias("bucket"), "service").distinct()
    step = F.expr("interval 1 hour")
    spans = incidents.select("start_time", F.explode(F.sequence("start_time", F.col("end_time") - step, step)).alias("bucket"))
    found = spans.join(by_hour.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), "bucket")
    return found.groupBy("start_time").agg(F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"))
