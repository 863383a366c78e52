"""Continuous aggregates: counts by bucket in a stored table, of which each batch rewrites only the buckets it must.

Logs are kept by day. A batch brings up to date the buckets that have closed since the batch before (`edge` behind the
newest log), and those of its own late rows, as far as `back` behind the newest log before; later rows are stored, but change no
bucket until refresh() is asked to. A bucket is counted anew from the logs of its days, never added to, so a batch
that is run again changes nothing; only the partitions of these buckets are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.analytics import WIDTHS, bucket, rollup
from logloom.session import exists
from logloom.streaming.tables import Batches, run

COUNTS = "bucket timestamp_ntz, project_id int, level string, service string, log_count long"
KEPT = "time timestamp_ntz, project_id int, level string, service string"


@dataclass(frozen=True)
class Policy:
    """width: of a bucket. back, edge: the oldest and newest age at which buckets are brought up to date."""

    name: str
    width: str
    back: str
    edge: str


HOURLY, DAILY = Policy("hourly", "1h", "3 hours", "1 hour"), Policy("daily", "1d", "3 days", "1 day")


class Rollups:
    def __init__(self, spark: SparkSession, path: str, policies: tuple[Policy, ...] = (HOURLY, DAILY)) -> None:
        self.spark, self.path, self.policies = spark, path, policies
        self.logs = Batches(spark, f"{path}/logs", f"{KEPT}, day date", ("day",))
        self.marks = Batches(spark, f"{path}/marks", "newest timestamp_ntz")

    def put(self, batch: DataFrame, number: int) -> None:
        """A batch of logs (time, project_id, level, service)."""
        batch.persist()
        self.logs.put(batch.select("time", "project_id", "level", "service").withColumn("day", F.to_date("time")), number)
        newest = batch.agg(F.max("time").alias("t")).head()["t"]
        before = self.marks.rows(before=number).agg(F.max("newest").alias("t")).head()["t"]
        if newest is not None:
            now = newest if before is None else max(newest, before)
            for p in self.policies:
                self._bring(p, batch, before, now)
            self.spark.createDataFrame([(now,)], "newest timestamp_ntz").write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")
        batch.unpersist()

    def _bring(self, p: Policy, batch: DataFrame, before, now) -> None:
        at = lambda t: F.lit(t).cast("timestamp_ntz")
        ends = F.col("bucket") + F.expr(f"interval {WIDTHS[p.width]}")
        closed = ends <= at(now) - F.expr(f"interval {p.edge}")
        if before is not None:
            known, reach = ends <= at(before) - F.expr(f"interval {p.edge}"), F.col("bucket") >= at(before) - F.expr(f"interval {p.back}")
            late = batch.select(bucket(F.col("time"), p.width).alias("bucket")).distinct().where(known & reach)
            waiting = self.logs.rows().where(F.col("day") >= F.to_date(at(before) - F.expr(f"interval {p.edge}") - F.expr(f"interval {WIDTHS[p.width]}"))).select(bucket(F.col("time"), p.width).alias("bucket")).distinct().where(closed & ~known)
            due = [r["bucket"] for r in late.union(waiting).distinct().collect()]  # as many as buckets lie between two batches, and back
            self.refresh(p, F.col("bucket").isin(due), min(due), max(due)) if due else None
        else:
            self.refresh(p, closed, None, now)

    def refresh(self, p: Policy, which, first=None, last=None) -> None:
        """Counts anew the buckets of a condition, which lie between two times, from the logs of these days."""
        logs = self.logs.rows()
        if first is not None:
            logs = logs.where(F.col("day") >= F.to_date(F.lit(first)))
        if last is not None:
            logs = logs.where(F.col("day") <= F.to_date(F.lit(last) + F.expr(f"interval {WIDTHS[p.width]}")))
        counts = rollup(logs, p.width).where(which).withColumn("part", F.date_format("bucket", "yyyy-MM-dd-HH"))
        counts.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{p.name}")

    def stored(self, p: Policy = HOURLY) -> DataFrame | None:
        """The stored counts, None before there are any."""
        where = f"{self.path}/{p.name}"
        return self.spark.read.schema(f"{COUNTS}, part string").parquet(where).drop("part") if exists(self.spark, where) else None

    def counts(self, p: Policy = HOURLY) -> DataFrame:
        """Stored buckets, and those after the last stored one counted from the logs of their days; all from the logs without a table."""
        old = self.stored(p)
        if old is None:
            return rollup(self.logs.rows(), p.width)
        last = old.agg(F.max("bucket").alias("t")).head()["t"]
        new = self.logs.rows().where((F.col("day") >= F.to_date(F.lit(last))) & (F.col("time") >= F.lit(last) + F.expr(f"interval {WIDTHS[p.width]}")))
        return old.unionByName(rollup(new, p.width))


def follow(logs: DataFrame, path: str, policies: tuple[Policy, ...] = (HOURLY, DAILY)) -> Rollups:
    """Brings the rollups at a path up to date with what is new in a stream of logs."""
    kept = Rollups(logs.sparkSession, path, policies)
    run(logs.withColumn("time", F.col("time").cast("timestamp_ntz")), kept.put, f"{path}/state")
    return kept
