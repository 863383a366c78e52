"""Dashboards over detections, and incident grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import percent, severity_weight
from logloom.operators.analytics import bucket


def top_threats(detections: DataFrame, k: int = 10) -> DataFrame:
    """Counted by rule, title, severity and tags: an edited rule, or one whose tags are stored, has a row of its own."""
    counts = detections.groupBy("rule_id", "title", "severity", "tactics", "techniques").agg(F.count("*").alias("n"))
    out = counts.orderBy(F.col("n").desc(), "rule_id", "title", "severity", "tactics", "techniques").limit(k)
    return out.select("rule_id", "title", "severity", F.array_join("tactics", ",").alias("tactics"), F.array_join("techniques", ",").alias("techniques"), "n")


def timeline(detections: DataFrame, width: str) -> DataFrame:
    return detections.groupBy(bucket(F.col("time"), width).alias("bucket")).agg(F.count("*").alias("n"))


def with_incident(detections: DataFrame, incidents: DataFrame) -> DataFrame:
    """Detections with the id of their trace's incident, null if it has none."""
    keys = incidents.select("trace_id", "project_id", F.concat_ws("/", "trace_id", F.col("project_id").cast("string")).alias("incident_id"))
    return detections.join(keys, ["trace_id", "project_id"], "left")


def affected_services(detections: DataFrame, k: int = 10) -> DataFrame:
    """Detections with their incident_id."""
    out = detections.groupBy("service").agg(F.count("*").alias("n"), F.countDistinct("incident_id").alias("incidents"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return out.orderBy(F.col("n").desc(), "service").limit(k)


def severity_share(detections: DataFrame) -> DataFrame:
    counts = detections.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def mitre_heatmap(detections: DataFrame, k: int = 50) -> DataFrame:
    """Technique and tactic in lockstep (the shorter array is padded with null)."""
    pairs = detections.select(F.inline(F.arrays_zip("techniques", "tactics")))
    return pairs.groupBy("techniques", "tactics").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "techniques", "tactics").limit(k)


def incidents_by_trace(detections: DataFrame) -> DataFrame:
    """Traces of a project with more than one detection; severity is the heaviest."""
    rows = detections.where("trace_id is not null")
    out = rows.groupBy("trace_id", "project_id").agg(F.count("*").alias("n"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.max_by("severity", severity_weight(F.col("severity"))).alias("severity"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"), F.array_sort(F.collect_list("log_id")).alias("log_ids"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("tactics", "techniques")])
    return out.where("n > 1")


def incidents_by_burst(detections: DataFrame, least: int = 3, since: str | None = None) -> DataFrame:
    """Bursts outside traces since a time: at least `least` detections of a service and severity in five minutes; project of the earliest."""
    if since is not None:
        detections = detections.where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    rows = detections.where("trace_id is null").withColumn("bucket", bucket(F.col("time"), "5m"))
    out = rows.groupBy("service", "severity", "bucket").agg(F.count("*").alias("n"), F.min_by("project_id", F.struct("time", "log_id", "rule_id")).alias("project_id"), F.min("time").alias("start_time"), F.max("time").alias("end_time"))
    return out.where(F.col("n") >= least)
