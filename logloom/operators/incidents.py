"""Incidents: links to their detections, audit trail, totals, address enrichment; previews' samples and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.analytics import WIDTHS, bucket, ntz


def links(detections: DataFrame, incidents: DataFrame) -> DataFrame:
    """log_id, rule_id, incident: each detection of a trace incident. Keys are the incidents' own, so the join deals both sides by them."""
    keys = incidents.select("trace_id", "project_id", F.concat_ws("/", "trace_id", F.col("project_id").cast("string")).alias("incident"))
    return detections.join(keys, ["trace_id", "project_id"]).select("log_id", "rule_id", "incident")


def audit_trail(snapshots: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row for each tracked field that differs (null-safe) from the snapshot before: key, order columns, field, old, new."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = snapshots.select(key, *order, *fields, *[F.lag(f).over(w).alias(f"_old_{f}") for f in fields], F.row_number().over(w).alias("_n")).where("_n > 1")
    changes = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_old_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_old_{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new"))) for f in fields])
    return seen.select(key, *order, F.inline(F.array_compact(changes)))


def totals(detections: DataFrame, incidents: DataFrame) -> DataFrame:
    """detections, incidents, open (or investigating), critical: one row; both sides are aggregated before they meet."""
    zero = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    d = detections.agg(F.count("*").alias("detections")).select("detections", *zero("incidents", "open", "critical"))
    i = incidents.agg(F.count("*").alias("incidents"), F.count_if(F.col("status").isin("open", "investigating")).alias("open"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return d.unionByName(i.select(*zero("detections"), "incidents", "open", "critical")).agg(*[F.sum(c).alias(c) for c in ("detections", "incidents", "open", "critical")])


def resolution(history: DataFrame) -> DataFrame:
    """History of a status (incident, time, id, status) with resolved_at: set when the status becomes resolved or false_positive, kept while it stays so, else null."""
    w = Window.partitionBy("incident").orderBy("time", "id")
    done = F.col("status").isin("resolved", "false_positive")
    begins = done & ~F.coalesce(F.lag(done).over(w), F.lit(False))
    marked = history.withColumn("_b", F.when(begins, F.col("time")))
    return marked.withColumn("resolved_at", F.when(done, F.last("_b", ignorenulls=True).over(w))).drop("_b")


def listed(incidents: DataFrame, statuses=None, severities=None, assignee: str | None = None, service: str | None = None, technique: str | None = None) -> DataFrame:
    """Incidents that fit all criteria given."""
    for column, wanted in (("status", statuses), ("severity", severities)):
        if wanted is not None:
            incidents = incidents.where(F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    if assignee is not None:
        incidents = incidents.where(F.col("assignee") == assignee)
    if service is not None:
        incidents = incidents.where(F.array_contains(F.split("services", ","), service))
    return incidents if technique is None else incidents.where(F.array_contains("techniques", technique))


def heatmap_matrix(detections: DataFrame, tactics: list[str]) -> DataFrame:
    """A row for each technique, a column for each tactic."""
    pairs = detections.select(F.inline(F.arrays_zip("techniques", "tactics"))).where("techniques is not null")
    return pairs.groupBy("techniques").agg(*[F.count_if(F.col("tactics") == t).alias(t) for t in tactics])


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z"), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def locate(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """ips (ip, ...) with the place of the range (first, last, place: addresses as text, disjoint) that holds it, else null.

    Distinct addresses are looked up, so a block that many rows share is no hot key. Ranges are cut at /16
    borders, so the range join is an equality on the upper half of the address.
    """
    known = _located(ips.select("ip").where("ip is not null").distinct(), ranges)
    return ips.join(known, "ip", "left").select(*ips.columns, "place")


def _located(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    r = ranges.select(ip_number(F.col("first")).alias("_lo"), ip_number(F.col("last")).alias("_hi"), "place")
    r = r.withColumn("_block", F.explode(F.sequence(F.shiftright("_lo", 16), F.shiftright("_hi", 16))))
    known = ips.withColumn("_n", ip_number(F.col("ip"))).withColumn("_block", F.shiftright("_n", 16))
    on = (known["_block"] == r["_block"]) & (known["_n"] >= r["_lo"]) & (known["_n"] <= r["_hi"])
    return known.join(r, on, "left").select(*ips.columns, "place")


def throughput(logs: DataFrame, now: str) -> DataFrame:
    """Logs a second over the last hour, and the mean age in ms of the last five minutes' logs."""
    t = F.col("time")
    hour, five = t >= ntz(now) - F.expr("interval 1 hour"), t >= ntz(now) - F.expr("interval 5 minutes")
    age = F.expr(f"timestampdiff(MICROSECOND, time, timestamp_ntz'{now}') / 1000.0D")
    return logs.where(hour & (t <= ntz(now))).agg((F.count("*") / 3600.0).alias("per_second"), F.avg(F.when(five, age)).alias("age_ms"))


def start_slots(incidents: DataFrame, unit: str) -> DataFrame:
    """Incidents by hour (0..23) or weekday (0 Sunday .. 6) of their start, empty slots included."""
    slot = F.hour("start_time") if unit == "hour" else F.dayofweek("start_time") - 1
    counts = incidents.groupBy(slot.cast("bigint").alias("slot")).agg(F.count("*").alias("n"))
    every = incidents.sparkSession.range(24 if unit == "hour" else 7).withColumnRenamed("id", "slot")
    return every.join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


def samples(logs: DataFrame, levels, incidents: DataFrame, width: str, k: int = 5) -> DataFrame:
    """start_time, id, rank: the k newest logs of each preview incident. Logs meet incidents by their bucket, not by a range."""
    step = F.expr(f"interval {WIDTHS[width]}")
    spans = incidents.select("start_time", F.explode(F.sequence("start_time", F.col("end_time") - step, step)).alias("bucket"))
    rows = logs.where(F.col("level").isin(list(levels))).select("id", "time", bucket(F.col("time"), width).alias("bucket"))
    # only a bucket's k newest can be among its incident's; this limit also runs before the shuffle
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("time").desc(), F.col("id").desc()))
    rows = rows.withColumn("_own", own).where(F.col("_own") <= k).drop("_own")
    newest = F.row_number().over(Window.partitionBy("start_time").orderBy(F.col("time").desc(), F.col("id").desc()))
    return rows.join(spans, "bucket").withColumn("rank", newest).where(F.col("rank") <= k).select("start_time", "id", F.col("rank").cast("bigint").alias("rank"))


def suggestions(stats: DataFrame, incidents: DataFrame, days: int) -> DataFrame:
    """Advice on a rule, comma-joined, from its preview: statistics (one row) and incidents."""
    share = lambda unit: start_slots(incidents, unit).agg(F.max("n").alias("top"), F.sum("n").alias("all")).select(F.lit(1).alias("one"), F.when(F.col("all") > 0, F.col("top") / F.col("all")).otherwise(0.0).alias(unit), F.col("all").alias(f"n_{unit}"))
    row = stats.withColumn("one", F.lit(1)).join(share("hour"), "one").join(share("day"), "one")
    told = F.array(
        F.when(F.col("pct_hot") > 15, "raise_threshold"), F.when(F.col("n_hour") > 5 * days, "too_many_incidents"), F.when((F.col("n_hour") == 0) & (F.col("p99") > 0), "lower_threshold"),
        F.when(F.col("day") > 0.4, "one_weekday"), F.when(F.col("hour") > 0.3, "one_hour"),
    )
    return row.select(F.array_join(F.array_compact(told), ",").alias("advice"))


def paged(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A numbered page (from 1) with the total and the number of pages; the total is one row, joined by a constant."""
    total = df.agg(F.count("*").alias("total")).select(F.lit(1).alias("_one"), "total", F.ceil(F.col("total") / size).alias("pages"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


#: Fields that an update may set, and whether null or an empty text clears them or is passed over.
CLEARABLE = {"title": False, "description": True, "severity": False, "status": False, "assignee": True}


def updated(incidents: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new snapshot after changes (key, changed_at, field, value): of each field the last change counts, the greater value on ties.

    Null clears description and assignee; null and empty texts set no title, severity or status. The field
    'deleted' removes the incident. Changes are gathered by key first, so a key changed often is no hot key in the join.
    """
    fields = [f for f in CLEARABLE if f in incidents.columns]
    sets = lambda f: (F.col("field") == f) if CLEARABLE[f] else (F.col("field") == f) & (F.col("value") != "")
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.col("field") == "deleted").alias("_gone"), *[F.max(F.when(sets(f), F.struct("changed_at", "value"))).alias(f"_{f}") for f in fields])
    joined = incidents.join(last, incidents[key] == last["_key"], "left").where(~F.coalesce("_gone", F.lit(False)))
    return joined.select(*[F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}.value")).alias(c) if c in fields else F.col(c) for c in incidents.columns])
