"""Time buckets, top-k, dashboards and rollups over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import percent, trend

LEVELS = ("debug", "info", "warn", "error", "critical")
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}


def ntz(t: str):
    return F.lit(t).cast("timestamp_ntz")


def bucket(time, width: str):
    return F.window(time, WIDTHS[width])["start"]


def histogram(logs: DataFrame, width: str) -> DataFrame:
    """bucket, level, count."""
    return logs.groupBy(bucket(F.col("time"), width).alias("bucket"), "level").agg(F.count("*").alias("n"))


def histogram_wide(logs: DataFrame, width: str) -> DataFrame:
    """One row a bucket, a column for each level, in one pass of conditional counts."""
    return logs.groupBy(bucket(F.col("time"), width).alias("bucket")).agg(F.count("*").alias("total"), *[F.count_if(F.col("level") == v).alias(v) for v in LEVELS])


def top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k (1..50) commonest values."""
    k = max(1, min(50, k))
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def top_share(logs: DataFrame, key: str, k: int) -> DataFrame:
    """Counts with their rounded percentage of all rows; the window is over one row for each key."""
    counts = logs.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy()))).orderBy(F.col("n").desc(), key).limit(k)


def kpis(logs: DataFrame, now: str) -> DataFrame:
    """Today against yesterday in a single scan: counts, error rate, services, throughput of the last hour."""
    t = F.col("time")
    today = F.date_trunc("day", ntz(now)).cast("timestamp_ntz")
    is_today, was = (t >= today) & (t <= ntz(now)), (t >= today - F.expr("interval 1 day")) & (t < today)
    bad = F.col("level").isin("error", "critical")
    one = logs.where(t >= today - F.expr("interval 1 day")).agg(
        F.count_if(is_today).alias("today"), F.count_if(was).alias("yesterday"), F.count_if(is_today & bad).alias("errors_today"), F.count_if(was & bad).alias("errors_yesterday"),
        F.countDistinct(F.when(is_today, F.col("service"))).alias("services"), (F.count_if((t > ntz(now) - F.expr("interval 1 hour")) & (t <= ntz(now))) / 3600.0).alias("per_second"),
    )
    return one.select("today", "yesterday", "errors_today", "errors_yesterday", "services", "per_second", trend(F.col("today"), F.col("yesterday")).alias("trend"), F.when(F.col("today") > 0, F.col("errors_today") * 100.0 / F.col("today")).otherwise(0.0).alias("error_rate"))


def rollup(logs: DataFrame, width: str) -> DataFrame:
    return logs.groupBy(bucket(F.col("time"), width).alias("bucket"), "project_id", "level", "service").agg(F.count("*").alias("log_count"))


def timeseries(rolled: DataFrame, logs: DataFrame, now: str) -> DataFrame:
    """24 hours by hour and level: the rollup before the current hour, raw rows from it on (cut at the hour, so nothing counts twice)."""
    cut, start = F.date_trunc("hour", ntz(now)).cast("timestamp_ntz"), (F.date_trunc("hour", ntz(now)) - F.expr("interval 23 hours")).cast("timestamp_ntz")
    old = rolled.where((F.col("bucket") >= start) & (F.col("bucket") < cut)).select("bucket", "level", "log_count")
    new = logs.where((F.col("time") >= cut) & (F.col("time") <= ntz(now))).groupBy(bucket(F.col("time"), "1h").alias("bucket"), "level").agg(F.count("*").alias("log_count"))
    both = old.unionByName(new)
    return both.groupBy("bucket").agg(F.sum("log_count").alias("total"), *[F.coalesce(F.sum(F.when(F.col("level") == v, F.col("log_count"))), F.lit(0)).alias(v) for v in LEVELS])


def rollup_or_raw(logs: DataFrame, name: str, width: str = "1h") -> DataFrame:
    """The table of hourly counts if there is one by that name, else the same from the logs."""
    spark = logs.sparkSession
    return spark.table(name) if spark.catalog.tableExists(name) else rollup(logs, width)
