"""Incidents kept up to date by a stream of detections, and the feed of what is new.

Two queries follow each other: logs become detections in an exactly-once Parquet table, and new detections change the incidents
they belong to: a trace of a project with two and more, or a burst of three and more of a service and severity in five
minutes outside traces. Detections are folded in each task before they are shuffled, so an incident that holds a third of
all detections is a few rows a task; what an incident keeps is its totals, in the state of a streaming aggregation, so no
batch reads earlier detections and none calls Python for an incident.
Changed incidents are appended as their new row (the latest counts) and as an event: incident_created when a group
reaches its least size, incident_updated afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from logloom.functions.scalars import severity_weight
from logloom.operators.sigma import PACKS, detect
from logloom.session import ship
from logloom.streaming.tables import Batches, Latest, append, run

LEAST = {"trace": 2, "burst": 3}
BURST = "5 minutes"
#: What tells detections of one incident apart; the rest of them is totals.
OWN = ["incident", "kind", "trace_id", "project_id", "service", "severity", "weight", "tactics", "techniques"]
FOLDED = "incident string, kind string, trace_id string, project_id int, service string, severity string, weight int, tactics string, techniques string, n long, first string, start_us long, end_us long"
COUNTED = f"{FOLDED}, batch long, own long"
#: Rows of an Arrow batch.
ROWS = 10_000
INCIDENTS = "incident string, kind string, trace_id string, project_id int, severity string, n long, start_time timestamp_ntz, end_time timestamp_ntz, services array<string>, tactics array<string>, techniques array<string>"
FEED = "type string, id string, data string"
SEEN = "log_id long, time timestamp_ntz, project_id int, service string, level string, message string, trace_id string, rule_id string, title string, severity string, tactics array<string>, techniques array<string>"


def grouped(detections: DataFrame) -> DataFrame:
    """Each detection with its incident's name, and its tags as texts."""
    us = F.unix_micros(F.col("time").cast("timestamp"))
    traced = F.col("trace_id").isNotNull()
    bucket = F.unix_seconds(F.window(F.col("time").cast("timestamp"), BURST)["start"]).cast("string")
    of_trace, of_burst = F.concat_ws("/", "trace_id", F.col("project_id").cast("string")), F.concat_ws("/", F.lit("burst"), "service", "severity", bucket)
    joined = lambda c: F.array_join(c, "\n")
    return detections.select(
        F.when(traced, of_trace).otherwise(of_burst).alias("incident"), F.when(traced, "trace").otherwise("burst").alias("kind"), "trace_id", F.col("project_id").cast("int").alias("project_id"), "service", "severity",
        severity_weight(F.col("severity")).cast("int").alias("weight"), joined("tactics").alias("tactics"), joined("techniques").alias("techniques"), us.alias("us"),
        F.concat_ws("|", F.lpad(us.cast("string"), 20, "0"), F.lpad(F.col("log_id").cast("string"), 20, "0"), "rule_id").alias("first"),
    )


def folded(rows: DataFrame) -> DataFrame:
    """A task's rows that differ in nothing but time, as one with their number, first and last; without a shuffle or state."""
    target = to_arrow_schema(_parse_datatype_string(FOLDED))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.Table.from_batches([batch]).group_by(OWN).aggregate([("us", "count"), ("first", "min"), ("us", "min"), ("us", "max")])
            yield from some.select([*OWN, "us_count", "first_min", "us_min", "us_max"]).rename_columns(target.names).cast(target).combine_chunks().to_batches()

    ship(rows.sparkSession)
    return rows.mapInArrow(fold, FOLDED)


def counted(rows: DataFrame) -> DataFrame:
    """Folded rows with their batch, each incident's in one task; one more row an incident, without detections, tells its number in the batch."""
    told = to_arrow_schema(_parse_datatype_string(COUNTED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, some = int(TaskContext.get().getLocalProperty("streaming.sql.batchId")), []
        fixed = {"batch": number, "n": 0, "own": 0}

        def filled(t: pa.Table) -> list[pa.RecordBatch]:
            lacking = lambda f: pa.repeat(pa.scalar(fixed[f.name], f.type), t.num_rows) if f.name in fixed else pa.nulls(t.num_rows, f.type)
            return pa.table([t[f.name].cast(f.type) if f.name in t.column_names else lacking(f) for f in told], schema=told).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            some.append(table.group_by("incident").aggregate([("n", "sum")]))
            yield from filled(table)
        if some:
            own = pa.concat_tables(some).group_by("incident").aggregate([("n_sum", "sum")]).rename_columns(["incident", "own"])
            for at in range(0, own.num_rows, ROWS):
                yield from filled(own.slice(at, ROWS))

    return rows.repartition("incident").mapInArrow(count, COUNTED)


def changes(detections: DataFrame) -> DataFrame:
    """Incidents that a batch of detections has made or changed, their totals being state; for update mode.

    A trace's severity is its heaviest, a burst's project that of its earliest detection. An incident is created by the batch
    before which it was too small.
    """
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    words = lambda c: F.array_sort(F.filter(F.array_distinct(F.flatten(F.transform(c, lambda x: F.split(x, "\n")))), lambda x: x != ""))
    sets = ("services", "tactics", "techniques")
    out = counted(folded(grouped(detections))).groupBy("incident").agg(
        F.max("kind").alias("kind"), F.max("trace_id").alias("trace_id"), F.min_by("project_id", "first").alias("project_id"), F.max_by("severity", F.struct("weight", "severity")).alias("severity"),
        F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.collect_set("service").alias("services"), F.collect_set("tactics").alias("tactics"),
        F.collect_set("techniques").alias("techniques"), F.max_by("own", F.struct("batch", "own")).alias("own"),
    )
    least = F.when(F.col("kind") == "trace", LEAST["trace"]).otherwise(LEAST["burst"])
    event = F.when(F.col("n") - F.col("own") < least, "incident_created").otherwise("incident_updated")
    whole = out.where(F.col("n") >= least).withColumns({"services": F.array_sort(F.filter("services", lambda x: x != "")), **{c: words(F.col(c)) for c in sets[1:]}, "start_time": at("start_us"), "end_time": at("end_us"), "event": event})
    return whole.drop("start_us", "end_us", "own")


def incidents(spark: SparkSession, path: str) -> Latest:
    return Latest(spark, f"{path}/incidents", INCIDENTS, ["incident"])


def feed(spark: SparkSession, path: str) -> Batches:
    return Batches(spark, f"{path}/feed", FEED)


def detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEEN).parquet(f"{path}/detections")


def follow(logs: DataFrame, path: str, rules=PACKS) -> None:
    """Brings path/detections, path/incidents and path/feed up to date with what is new in a stream of logs."""
    spark = logs.sparkSession
    known, told = incidents(spark, path), feed(spark, path)
    names = [c.split()[0] for c in SEEN.split(", ")]
    append(detect(logs, rules).select(*names), f"{path}/detections", f"{path}/state/detections")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        known.put(batch.select(*[c.split()[0] for c in INCIDENTS.split(", ")]), number)
        told.put(batch.select(F.col("event").alias("type"), F.col("incident").alias("id"), F.to_json(F.struct("kind", "project_id", "severity", "n", "start_time", "end_time", "services")).alias("data")), number)
        batch.unpersist()

    run(changes(spark.readStream.schema(SEEN).parquet(f"{path}/detections")), each, f"{path}/state/incidents", "update")


def events(spark: SparkSession, path: str, after: int = -1, limit: int | None = None) -> DataFrame:
    """batch, type, id, data of incident events after a batch, in order; a consumer goes on from the last batch it has seen."""
    some = told = feed(spark, path).rows(after).select("batch", "type", "id", "data")
    if limit is not None:  # whole batches, so that going on from the last one skips nothing
        sizes = told.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()
        last, size = None, 0
        for r in sizes:
            if last is not None and size + r["n"] > limit:
                break
            last, size = r["batch"], size + r["n"]
        some = told.where(F.col("batch") <= last) if last is not None else told
    return some.orderBy("batch", "id")
