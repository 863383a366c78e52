"""Threshold alerts, and the preview of a rule on past logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.analytics import WIDTHS, bucket, ntz

#: What a rule is told by, and the key of those of any service or project.
RULE, ANY = ["rule_id", "service", "levels", "project_id", "enabled"], "*"


def last_triggers(history: DataFrame) -> DataFrame:
    return history.groupBy("rule_id").agg(F.max("triggered_at").alias("last_trigger"))


def in_scope(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """Each project (project_id) with the rules that hold there: its own, and those of no project. Rules of no project are meant for all, so as many rows are the result."""
    own = projects.join(rules, "project_id")
    every = rules.where("project_id is null").drop("project_id").withColumn("_one", F.lit(1))
    return own.unionByName(projects.withColumn("_one", F.lit(1)).join(every, "_one").drop("_one"))


def rule_keys(rules: DataFrame) -> DataFrame:
    """Enabled rules under the keys (level, service, project) that their logs have; a rule of a service also fits the service 'unknown'."""
    services = F.when(F.col("service").isNull(), F.array(F.lit(ANY))).otherwise(F.array_distinct(F.array("service", F.lit("unknown"))))
    more = [c for c in rules.columns if c not in RULE]
    live = rules.where("enabled").select("rule_id", *more, F.explode(F.array_distinct(F.split("levels", ","))).alias("level"), services.alias("services"), F.coalesce(F.col("project_id").cast("string"), F.lit(ANY)).alias("project"))
    return live.withColumn("service", F.explode("services")).drop("services")


def matched(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """time, rule_id and what else rules have, of each log with each rule that it counts for, once; an equality join of four narrow rows for each log."""
    either = lambda c: F.array_distinct(F.array(F.coalesce(c, F.lit(ANY)), F.lit(ANY)))
    keyed = logs.select("time", "level", F.explode(either(F.col("service"))).alias("service"), F.col("project_id").cast("string").alias("project_id"))
    keyed = keyed.select("time", "level", "service", F.explode(either(F.col("project_id"))).alias("project"))
    return keyed.join(rule_keys(rules), ["level", "service", "project"]).drop("level", "service", "project")


def fired(rules: DataFrame, history: DataFrame, logs: DataFrame, now: str) -> DataFrame:
    """Enabled rules whose count since max(last trigger, now - window), exclusive, reaches the threshold.

    Only logs of the longest window are read. They meet the rules of their level, service and project, never rule by rule, and
    partial counts by rule leave each task. Whether rules are broadcast is the planner's choice, by their size.
    """
    since = F.greatest(F.coalesce("last_trigger", ntz("1970-01-01")), F.expr(f"timestamp_ntz'{now}' - make_interval(0, 0, 0, 0, 0, time_window)"))
    live = rules.where("enabled").join(last_triggers(history), "rule_id", "left").withColumn("since", since)
    longest = rules.where("enabled").agg(F.max("time_window").alias("w")).head()["w"] or 0
    seen = logs.where((F.col("time") <= ntz(now)) & (F.col("time") > ntz(now) - F.expr(f"make_interval(0, 0, 0, 0, 0, {longest})")))
    hits = matched(seen, live.select(*RULE, "since")).where("time > since").groupBy("rule_id").agg(F.count("*").alias("log_count"))
    return live.join(hits, "rule_id").where("log_count >= threshold").select("rule_id", "log_count", "threshold")


def preview_buckets(logs: DataFrame, levels, width: str, service: str | None = None) -> DataFrame:
    rows = logs.where(F.col("level").isin(list(levels)))
    if service is not None:
        rows = rows.where(F.col("service").isin(service, "unknown"))
    return rows.groupBy(bucket(F.col("time"), width).alias("bucket")).agg(F.count("*").alias("n"))


def preview_incidents(buckets: DataFrame, threshold: int, width: str) -> DataFrame:
    """Maximal runs of non-empty buckets at the threshold; the average is rounded at every step, in order.

    One partition sorts the buckets: as many as the range has, not as many as logs.
    """
    order = Window.orderBy("bucket")
    hot = buckets.withColumn("hot", F.col("n") >= threshold)
    runs = hot.withColumn("island", F.row_number().over(order) - F.row_number().over(Window.partitionBy("hot").orderBy("bucket"))).where("hot")
    listed = runs.groupBy("island").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("avg"))
    fold = F.aggregate("xs", start, lambda a, x: F.struct((a["k"] + 1).alias("k"), F.floor((a["avg"] * a["k"] + x["n"]) / (a["k"] + 1) + F.lit(0.5).cast("double")).cast("bigint").alias("avg")), lambda a: a["avg"])
    return listed.select(
        F.col("xs")[0]["bucket"].alias("start_time"), (F.element_at("xs", -1)["bucket"] + F.expr(f"interval {WIDTHS[width]}")).alias("end_time"), F.size("xs").cast("bigint").alias("buckets"),
        F.array_max(F.transform("xs", lambda x: x["n"])).alias("peak"), fold.alias("average"),
    )


#: Bucket width of a preview by its range in days; longer ranges take the last.
PREVIEW_WIDTHS = {1: "5m", 7: "15m", 30: "1h"}


def preview_width(days: int) -> str:
    return next((width for most, width in PREVIEW_WIDTHS.items() if days <= most), "1h")


def preview_summary(incidents: DataFrame) -> DataFrame:
    """One row: incidents, hot buckets in all, and the average (rounded half up), longest and shortest duration in minutes; zeros for none."""
    minutes = F.expr("timestampdiff(SECOND, start_time, end_time) / 60.0D")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return incidents.agg(F.count("*").alias("incidents"), zero(F.sum("buckets")).alias("triggers"), zero(F.floor(F.avg(minutes) + 0.5)).alias("average"), zero(F.max(minutes)).alias("longest"), zero(F.min(minutes)).alias("shortest"))


def first_incidents(incidents: DataFrame, k: int = 10) -> DataFrame:
    """The first incidents of a preview, for which samples are fetched."""
    return incidents.orderBy("start_time").limit(k)


def preview_stats(buckets: DataFrame, threshold: int) -> DataFrame:
    """Share of non-empty buckets at the threshold, and percentiles by index: sorted[min(floor(n p), n - 1)]."""
    at = lambda p: F.element_at("s", (F.least(F.floor(F.size("s") * F.lit(p)), F.size("s") - 1) + 1).cast("int"))
    one = buckets.agg(F.count("*").alias("buckets"), F.count_if(F.col("n") >= threshold).alias("hot"), F.array_sort(F.collect_list("n")).alias("s"))
    return one.select("buckets", "hot", *[at(p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)], F.when(F.col("buckets") > 0, F.col("hot") * 100.0 / F.col("buckets")).otherwise(0.0).alias("pct_hot"))
