"""Trace assembly, dependency graph, span trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators import trees
from logloom.session import ship, written

#: Rows of a trace beyond which its tree is settled by joins over all tasks, not within one; and groups of traces that are counted for it.
LARGE, GROUPS = 100_000, 1 << 16


def assemble(spans: DataFrame) -> DataFrame:
    """One row a trace. Root: the earliest span without parent; service: the earliest span's."""
    first = F.struct("start_time", "span_id")
    root = F.col("parent_span_id").isNull()
    return spans.groupBy("trace_id").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("span_count"), F.bool_or(F.col("status_code") == "ERROR").alias("error"),
        F.min_by("service_name", first).alias("service_name"), F.min_by(F.when(root, F.col("service_name")), F.when(root, first)).alias("root_service"), F.min_by(F.when(root, F.col("operation_name")), F.when(root, first)).alias("root_operation"),
    ).withColumn("duration_ms", F.expr("cast(timestampdiff(MILLISECOND, start_time, end_time) as bigint)"))


def stats(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count("*").alias("traces"), F.sum("span_count").alias("spans"), F.round(F.avg("duration_ms")).cast("bigint").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
        F.count_if("error").alias("errors"), F.when(F.count("*") > 0, F.count_if("error") / F.count("*")).otherwise(0.0).alias("error_fraction"),
    )


def dependencies(spans: DataFrame) -> DataFrame:
    """Calls between services: child joined to parent of the same trace, same-service edges left out."""
    c, p = spans.select("trace_id", "parent_span_id", F.col("service_name").alias("target")), spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("source"))
    return c.where("parent_span_id is not null").join(p, ["trace_id", "parent_span_id"]).where("source <> target").groupBy("source", "target").agg(F.count("*").alias("calls"))


def nodes(edges: DataFrame) -> DataFrame:
    """Services with the sum of calls in and out, and their size on a map."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("service"), "calls")
    out = ends.groupBy("service").agg(F.sum("calls").alias("calls"))
    return out.withColumn("size", 30 + 40.0 * F.col("calls") / F.max("calls").over(Window.partitionBy()))


def waterfall(spans: DataFrame) -> DataFrame:
    """Left edge and width of each span in percent of its trace. Traces are aggregated and joined, so a giant one is no single task's."""
    us = lambda a, b: F.expr(f"cast(timestampdiff(MICROSECOND, {a}, {b}) as double)")
    whole = spans.groupBy("trace_id").agg(F.min("start_time").alias("t0"), F.max("end_time").alias("t1"))
    df = spans.select("trace_id", "span_id", "start_time", "end_time").join(whole, "trace_id").withColumn("total", us("t0", "t1"))
    return df.select("trace_id", "span_id", F.when(F.col("total") > 0, us("t0", "start_time") / F.col("total") * 100).otherwise(0.0).alias("left_pct"), F.when(F.col("total") > 0, F.greatest(us("start_time", "end_time") / F.col("total") * 100, F.lit(0.5))).otherwise(100.0).alias("width_pct"))


def to_end(links: DataFrame, *sums: str) -> DataFrame:
    """Rows of linked lists (trace_id, node, next, sums): each sum then runs from its node to the list's last, and next is null.

    Pointer doubling: each round takes every open node to its next one's next, so a list takes as many rounds as its
    length has binary digits, whatever its length. While a list is open, each round ends some node of it; a round
    that ends none leaves cycles only, whose nodes keep a next.
    """
    state, still_open, before = written(links), None, None
    while still_open is None or 0 < still_open != before:
        before = still_open
        over = state.select("trace_id", F.col("node").alias("next"), F.col("next").alias("over"), *[F.col(c).alias(f"more_{c}") for c in sums])
        moved = state.where("next is not null").join(over, ["trace_id", "next"]).select("trace_id", "node", F.col("over").alias("next"), *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in sums])
        state = written(state.where("next is null").union(moved))
        still_open = state.where("next is not null").count()
    return state


def _nodes(ids: DataFrame) -> DataFrame:
    """One row a span id of a trace, with the smallest parent that its rows name, or null where that one isn't there (a root)."""
    told = ids.where("trace_id is not null and span_id is not null").groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("up"), F.min("start_time").alias("start_time"))
    there = told.select("trace_id", F.col("span_id").alias("up"), F.lit(True).alias("known"))
    return told.join(there, ["trace_id", "up"], "left").select("trace_id", "span_id", F.when(F.col("known"), F.col("up")).alias("up"), "start_time")


def _large(ids: DataFrame, large: int) -> DataFrame:
    """trace_id of traces with more rows than large: only groups of traces that have as many are counted by trace."""
    group = F.pmod(F.xxhash64("trace_id"), F.lit(GROUPS))
    some = ids.where("trace_id is not null").select("trace_id", group.alias("of"))
    full = written(some.groupBy("of").agg(F.count("*").alias("n")).where(F.col("n") > large).select("of"))
    return written(some.join(F.broadcast(full), "of", "left_semi").groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("trace_id"))


def _settled(ids: DataFrame, settle, schema: str, by_joins, large: int) -> DataFrame:
    """settle(), an Arrow function, on whole traces in tasks that they are shuffled to once; by_joins() on those of more than large rows."""
    ship(ids.sparkSession)
    most = F.broadcast(_large(ids, large))
    within = ids.where("trace_id is not null").join(most, "trace_id", "left_anti").repartition("trace_id").sortWithinPartitions("trace_id").mapInArrow(trees.by_trace(settle), schema)
    return within if most.isEmpty() else within.unionByName(by_joins(written(ids.join(most, "trace_id", "left_semi"))))


def depths(spans: DataFrame, large: int = LARGE) -> DataFrame:
    """Depth of each span below its root, one row a row; orphans are roots. On a cycle or below one, depth is null.

    Repeated span ids of a trace count as one parent, whose own parent is the smallest they name. A null id is a root's.
    """
    ids = written(spans.select(*[F.col(c).cast("string").alias(c) for c in ("trace_id", "span_id", "parent_span_id")]))
    roots = ids.where("trace_id is null").select("trace_id", "span_id", F.lit(0).alias("depth"))
    return _settled(ids, trees.depths, "trace_id string, span_id string, depth int", _depths_by_joins, large).unionByName(roots)


def _depths_by_joins(ids: DataFrame) -> DataFrame:
    nodes = _nodes(ids.withColumn("start_time", F.lit(0)))
    state = to_end(nodes.select("trace_id", F.col("span_id").alias("node"), F.col("up").alias("next"), F.col("up").isNotNull().cast("long").alias("hops")), "hops")
    parents = state.select("trace_id", F.col("node").alias("parent_span_id"), F.lit(True).alias("known"), F.when(F.col("next").isNull(), F.col("hops") + 1).alias("below"))
    return ids.join(parents, ["trace_id", "parent_span_id"], "left").select("trace_id", "span_id", F.when(F.col("known"), F.col("below")).otherwise(0).cast("int").alias("depth"))


def _siblings(nodes: DataFrame) -> DataFrame:
    """Nodes with their family (parent's id, or none), next sibling by start_time and id, and whether they are the first.

    Families are cut where ranges of the sorted nodes end, so that one of any size is spread over tasks; the cuts,
    as few as there are partitions, are then sewn up by joining each piece's last row to the next piece's first.
    """
    family = F.when(F.col("up").isNull(), "r").otherwise(F.concat(F.lit("c"), "up"))
    cut = written(nodes.withColumn("family", family).repartitionByRange("trace_id", "family", "start_time", "span_id").withColumn("piece", F.spark_partition_id()))
    piece = Window.partitionBy("trace_id", "family", "piece").orderBy(F.col("start_time"), "span_id")
    rows = written(cut.withColumn("after", F.lead("span_id").over(piece)).withColumn("leads", F.row_number().over(piece) == 1))
    pieces = Window.partitionBy("trace_id", "family").orderBy("piece")
    heads = rows.where("leads").select("trace_id", "family", "piece", F.lead("span_id").over(pieces).alias("sewn"), (F.row_number().over(pieces) == 1).alias("opens"))
    return rows.join(heads, ["trace_id", "family", "piece"]).select("trace_id", "span_id", "up", "family", F.coalesce("after", "sewn").alias("after"), (F.col("leads") & F.col("opens")).alias("first"))


def preorder(spans: DataFrame, large: int = LARGE) -> DataFrame:
    """Depth and position (from 1) of each span id in its trace's tree, parents before children, siblings and roots by start_time, then id.

    One row a trace and span id; rows without either are left out. Orphans are roots. On a cycle or below one both are null.
    """
    ids = written(spans.select(*[F.col(c).cast("string").alias(c) for c in ("trace_id", "span_id", "parent_span_id")], "start_time"))
    return _settled(ids, trees.preorder, "trace_id string, span_id string, depth int, position long", _preorder_by_joins, large)


def _preorder_by_joins(ids: DataFrame) -> DataFrame:
    """The walk enters and leaves each span once, and is a linked list of these steps: what is left of it from a
    span on gives its place and depth, so neither depth nor size of a trace is bounded by a task.
    """
    tree = written(_siblings(_nodes(ids)))
    step = lambda side, c: F.concat(F.lit(side), c)
    child = tree.where("first and up is not null").select("trace_id", F.col("up").alias("span_id"), F.col("span_id").alias("child"))
    enter = tree.join(child, ["trace_id", "span_id"], "left").select("trace_id", step("+", F.col("span_id")).alias("node"), F.coalesce(step("+", F.col("child")), step("-", F.col("span_id"))).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("net"))
    leave = tree.select("trace_id", step("-", F.col("span_id")).alias("node"), F.coalesce(step("+", F.col("after")), step("-", F.col("up"))).alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("net"))
    done = to_end(enter.union(leave), "entered", "net").where("node like '+%'")
    whole = done.where("next is null").groupBy("trace_id").agg(F.max("entered").alias("whole"))
    ended = F.col("next").isNull()
    return done.join(whole, "trace_id", "left").select("trace_id", F.expr("substr(node, 2)").alias("span_id"), F.when(ended, -F.col("net")).cast("int").alias("depth"), F.when(ended, F.col("whole") - F.col("entered") + 1).alias("position"))
