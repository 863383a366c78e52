"""Spans in bulk, and one row for each trace however late its spans come.

A stream of spans goes to a table by the day of their start, exactly once, and into its traces: a native aggregation in
update mode whose state is the traces' partial results (minimum, maximum, count, any error, earliest of each kind).
Partial results leave each task, so a trace of a third of all spans is a few rows a task. Each batch appends the new row of
the traces it has changed; readers take the latest. Nothing expires: a span after days of silence changes its trace's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.traces import assemble
from logloom.streaming.tables import Batches, Latest, run

TRACES = "trace_id string, start_time timestamp_ntz, end_time timestamp_ntz, span_count long, error boolean, service_name string, root_service string, root_operation string, duration_ms long"
SPANS = "trace_id string, span_id string, parent_span_id string, service_name string, operation_name string, start_time timestamp_ntz, end_time timestamp_ntz, status_code string"


def traces(spark: SparkSession, path: str) -> Latest:
    return Latest(spark, f"{path}/traces", TRACES, ["trace_id"])


def spans(spark: SparkSession, path: str) -> Batches:
    return Batches(spark, f"{path}/spans", f"{SPANS}, period date", ("period",))


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def insert(stream: DataFrame, path: str, period: str = "day") -> None:
    """Stores what is new in a stream of spans at path/spans, by the day (or month, ...) of their start."""
    of = F.to_date(F.date_trunc(period, "start_time"))
    run(stream.select(*names(SPANS)).withColumn("period", of), spans(stream.sparkSession, path).put, f"{path}/state/spans")


def upsert(stream: DataFrame, path: str) -> None:
    """Brings path/traces up to date with what is new in a stream of spans; those without a trace id make no trace."""
    run(assemble(stream.where("trace_id is not null")).select(*names(TRACES)), traces(stream.sparkSession, path).put, f"{path}/state/traces", "update")


def follow(stream: DataFrame, path: str) -> None:
    insert(stream, path)
    upsert(stream, path)
