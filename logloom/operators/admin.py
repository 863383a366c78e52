"""Tenant dimensions joined to facts, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.analytics import ntz


def top_orgs(logs: DataFrame, projects: DataFrame, orgs: DataFrame, k: int = 10) -> DataFrame:
    """Counted by project before the dimensions are joined."""
    counts = logs.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"))
    by_org = counts.join(projects.select("id", "organization_id"), "id").groupBy("organization_id").agg(F.sum("n").alias("n"))
    return by_org.join(orgs.select(F.col("id").alias("organization_id"), "name"), "organization_id").orderBy(F.col("n").desc(), "name").limit(k)


def org_counts(orgs: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """Projects and members of each organization, 0 included."""
    p = projects.groupBy("organization_id").agg(F.count("*").alias("projects"))
    m = members.groupBy("organization_id").agg(F.count("*").alias("members"))
    out = orgs.select(F.col("id").alias("organization_id"), "name").join(p, "organization_id", "left").join(m, "organization_id", "left")
    return out.select("organization_id", "name", F.coalesce("projects", F.lit(0)).alias("projects"), F.coalesce("members", F.lit(0)).alias("members"))


def visible(facts: DataFrame, projects: DataFrame, members: DataFrame, user: int) -> DataFrame:
    """Facts of projects in the user's organizations."""
    mine = projects.join(members.where(F.col("user_id") == user), "organization_id", "left_semi").select(F.col("id").alias("project_id"))
    return facts.join(mine, "project_id", "left_semi")


def with_cutoff(logs: DataFrame, projects: DataFrame, now: str) -> DataFrame:
    """Retention is 7 days and the organization's number more."""
    cut = F.expr(f"timestamp_ntz'{now}' - make_interval(0, 0, 0, cast(7 + organization_id as int))")
    return logs.join(projects.select(F.col("id").alias("project_id"), "organization_id"), "project_id").withColumn("cutoff", cut)


def retention_status(logs: DataFrame, projects: DataFrame, now: str) -> DataFrame:
    rows = with_cutoff(logs, projects, now)
    return rows.groupBy("organization_id").agg(F.min("time").alias("oldest"), F.count("*").alias("n"), F.count_if(F.col("time") < F.col("cutoff")).alias("expired"))


def survivors(logs: DataFrame, projects: DataFrame, now: str) -> DataFrame:
    return with_cutoff(logs, projects, now).where("time >= cutoff").drop("cutoff")


def alert_stats(rules: DataFrame, history: DataFrame, projects: DataFrame, now: str) -> DataFrame:
    """By organization (null: rules of no project): rules in all, active, disabled; triggers of 24 hours and 7 days; notifications sent and failed."""
    org = projects.select(F.col("id").alias("project_id"), "organization_id")
    r = rules.join(org, "project_id", "left").select("rule_id", "organization_id", "enabled")
    per_rule = history.groupBy("rule_id").agg(
        *[F.count_if(F.col("triggered_at") >= ntz(now) - F.expr(f"interval {h} hours")).alias(n) for n, h in (("day", 24), ("week", 168))],
        F.count_if(F.col("notified") & F.col("error").isNull()).alias("sent"), F.count_if(F.col("notified") & F.col("error").isNotNull()).alias("failed"),
    )
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("day", "week", "sent", "failed")]
    return r.join(per_rule, "rule_id", "left").groupBy("organization_id").agg(F.count("*").alias("rules"), F.count_if("enabled").alias("active"), F.count_if(~F.col("enabled")).alias("disabled"), *sums)


def rules_of_organizations(rules: DataFrame, projects: DataFrame, orgs: DataFrame) -> DataFrame:
    """rule_id, organization of the rules that belong to a project."""
    mine = rules.select("rule_id", "project_id").join(projects.select(F.col("id").alias("project_id"), "organization_id"), "project_id")
    return mine.join(orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization")), "organization_id").select("rule_id", "organization")


def compression(chunks: DataFrame) -> DataFrame:
    """ratio of (before, after) sizes to two places; 0 where there are none."""
    return chunks.agg(F.coalesce(F.round(F.sum("before") / F.nullif(F.sum("after"), F.lit(0)), 2), F.lit(0.0)).alias("ratio"))


def first_and_last(logs: DataFrame) -> DataFrame:
    """oldest and latest time, and the ids there (ties: smallest for the oldest, greatest for the latest)."""
    at = F.struct("time", "id")
    return logs.agg(F.min("time").alias("oldest"), F.max("time").alias("latest"), F.min(at)["id"].alias("oldest_id"), F.max(at)["id"].alias("latest_id"))


def notified(history: DataFrame) -> DataFrame:
    """Alerts after notification: `notified` is false where it failed."""
    return history.withColumn("notified", F.col("notified") & F.col("error").isNull())
