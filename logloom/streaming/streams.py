"""Structured Streaming counterparts: hourly counts with late data, live tail, detections, trace sessions, new error groups.

Alerts are in alarms, incidents in casework, whole traces in spanstore, stored counts in rollups.
State is bounded by a watermark wherever there is any. To run a stream over what is there now and stop, see to_parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.search import search
from logloom.operators.sigma import PACKS, detect
from logloom.session import shared_dir
from logloom.streaming.tables import Batches, run


def watched(rows: DataFrame, late: str, column: str = "time") -> DataFrame:
    """Rows with a watermark on their time, which becomes a timestamp."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def hourly_counts(logs: DataFrame, late: str = "3 hours", width: str = "1 hour") -> DataFrame:
    """Counts by bucket, project, level and service; rows up to `late` behind the newest still count.

    In append mode a bucket comes out once, when the watermark has passed it; in update mode whenever it grows.
    """
    keys = [F.window("time", width)["start"].alias("bucket"), "project_id", "level", "service"]
    return watched(logs, late).groupBy(F.window("time", width).alias("_w"), *keys[1:]).agg(F.count("*").alias("log_count")).select(F.col("_w.start").alias("bucket"), *keys[1:], "log_count")


def live_tail(logs: DataFrame, **criteria) -> DataFrame:
    """New rows that fit; the stream's offsets see to it that none comes twice."""
    return search(logs, **criteria)


#: Ids of a notification: as many as fit a message of 7,900 bytes at 40 bytes each.
CHUNK = 7900 // 40
NOTICES = "project_id int, ids array<long>, newest timestamp_ntz"


def notices(spark: SparkSession, path: str) -> Batches:
    return Batches(spark, path, NOTICES)


def fan_out(logs: DataFrame, path: str, checkpoint: str) -> None:
    """Notifications of what is new in a stream of logs: a project and at most CHUNK of its log ids in each, in a table by batch.

    A consumer goes on behind the last batch that it has seen, and looks up the rows by their ids. Chunks are formed within
    pieces of a project, dealt by id, so a project of a third of all logs is no single task's.
    """
    told = notices(logs.sparkSession, path)

    def each(batch: DataFrame, number: int) -> None:
        dealt = batch.where("project_id is not null").select("project_id", "id", F.col("time").cast("timestamp_ntz").alias("time"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("piece"))
        place = F.row_number().over(Window.partitionBy("project_id", "piece").orderBy("time", "id")) - 1
        chunks = dealt.withColumn("chunk", F.floor(place / CHUNK)).groupBy("project_id", "piece", "chunk").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("time").alias("newest"))
        told.put(chunks.select("project_id", "ids", "newest"), number)

    run(logs, each, checkpoint)


def polled(logs: DataFrame, after: tuple[str, int] | None = None, limit: int = 100) -> DataFrame:
    """The next page, oldest first, of the rows behind a (time, id); with the last row's, it is asked again until a page comes back short."""
    if after is not None:
        t = F.lit(after[0]).cast("timestamp_ntz")
        logs = logs.where((F.col("time") > t) | (F.col("time") == t) & (F.col("id") > after[1]))
    return logs.orderBy("time", "id").limit(max(1, min(100, limit)))


def detections(logs: DataFrame, rules=PACKS) -> DataFrame:
    return detect(logs, rules)


def traces(spans: DataFrame, late: str = "1 hour", idle: str = "30 minutes") -> DataFrame:
    """Traces, each when no span has come for `idle` and the watermark has passed it; later spans make a new row. For append mode."""
    rows = watched(spans, late, "start_time")
    out = rows.groupBy("trace_id", F.session_window("start_time", idle).alias("_s")).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("span_count"), F.bool_or(F.col("status_code") == "ERROR").alias("error")
    )
    return out.drop("_s")


def first_of_group(errors: DataFrame, within: str = "7 days", ignored: DataFrame | None = None) -> DataFrame:
    """The first row of each project and fingerprint; state ends with the watermark. Groups in `ignored` (project_id, fingerprint) stay silent."""
    if ignored is not None:
        errors = errors.join(ignored.select("project_id", "fingerprint").distinct(), ["project_id", "fingerprint"], "left_anti")
    return watched(errors, within).dropDuplicatesWithinWatermark(["project_id", "fingerprint"])


def once_per_log(errors: DataFrame, within: str = "1 day") -> DataFrame:
    """One exception for each log id, whatever is sent twice within the watermark."""
    return watched(errors, within).dropDuplicatesWithinWatermark(["log_id"])


def fresh(table: DataFrame, checked: str, now: str, hours: int = 24) -> DataFrame:
    """Rows of an enrichment table that must be looked up again: checked never, or `hours` ago and more."""
    return table.where(F.col(checked).isNull() | (F.col(checked) <= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")))


def to_parquet(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet in the shared folder; the sink grows on executors, not on the driver.

    In complete mode each batch replaces the result.
    """
    top = f"{shared_dir(stream.sparkSession)}/logloom-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{top}/out")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{top}/out")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/out")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a memory table; for small results and tests."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
