"""Threshold alerts over a stream: counts by rule and tick close with the watermark, and a ring of them is each rule's state.

Logs meet the rules of their level, service and project by equality (any-service and any-project rules under a wildcard), never rule by
rule. Counts by rule and tick are a native aggregation, whose partial counts leave each task, so a rule that fits a third
of all logs is no hot key. Its rows come out once, in order of time, as the watermark passes a tick's end; rows later than `late`
are left out. What a rule keeps is the counts of the ticks inside its window since it last fired: no batch looks at older logs.
A rule is evaluated at the end of each tick that has logs of it; elsewhere its count can only fall.

A tick counts the logs of [its end - window, its end) since the last trigger, if they reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.alerts import RULE, matched
from logloom.session import ship
from logloom.streaming.tables import Batches, append, run

TICK = 60
TICKS = "rule_id int, tick long, n long, threshold int, time_window int"
TOLD = "rule_id int, triggered_at timestamp_ntz, log_count long"


def advanced(held: tuple, counts_in: list[tuple[int, int, int, int]]) -> tuple[tuple, list[tuple[int, int]]]:
    """A rule's state (ends and counts of its window's ticks, when it last fired) after ticks (end, count, threshold, minutes), and what it fires (end, count)."""
    (ends, counts, fired), out = held, []
    for end, n, threshold, window in sorted(counts_in):
        since = end - 60 * window if fired is None else max(end - 60 * window, fired)
        keep = [i for i, e in enumerate(ends) if e > since]
        ends, counts = [*(ends[i] for i in keep), end], [*(counts[i] for i in keep), n]
        if sum(counts) >= threshold:
            out.append((end, sum(counts)))
            ends, counts, fired = [], [], end
    return (ends, counts, fired), out


def ring(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One rule's closed ticks of a batch."""
    ends, counts, fired = state.get if state.exists else ([], [], -1)
    new = [row for part in parts for row in part[["tick", "n", "threshold", "time_window"]].itertuples(index=False, name=None)]
    held, out = advanced(([int(e) for e in ends], [int(c) for c in counts], None if fired < 0 else int(fired)), [tuple(map(int, row)) for row in new])
    state.update((held[0], held[1], -1 if held[2] is None else held[2]))
    yield pd.DataFrame({"rule_id": [key[0]] * len(out), "tick": [end for end, _ in out], "log_count": [n for _, n in out]})


def closed_ticks(logs: DataFrame, rules: DataFrame, late: str = "10 minutes") -> DataFrame:
    """rule_id, tick (the second at which it ends), n, threshold, time_window of each tick with logs of a rule, once it has closed; for append mode."""
    rows = matched(logs.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late), rules.select(*RULE, "threshold", "time_window"))
    counts = rows.groupBy(F.window("time", f"{TICK} seconds").alias("w"), "rule_id", "threshold", "time_window").agg(F.count("*").alias("n"))
    return counts.select("rule_id", F.unix_seconds("w.end").alias("tick"), "n", "threshold", "time_window")


def triggers(ticks: DataFrame) -> DataFrame:
    """rule_id, triggered_at, log_count of closed ticks, each batch's later than those before; for append mode. A rule's window is a whole number of minutes."""
    ship(ticks.sparkSession)
    fired = ticks.groupBy("rule_id").applyInPandasWithState(ring, "rule_id int, tick long, log_count long", "ends array<long>, counts array<long>, fired long", "append", GroupStateTimeout.NoTimeout)
    return fired.select("rule_id", F.timestamp_seconds("tick").cast("timestamp_ntz").alias("triggered_at"), "log_count")


def history(spark: SparkSession, path: str) -> Batches:
    return Batches(spark, f"{path}/history", TOLD)


def evaluate(logs: DataFrame, rules: DataFrame, path: str, late: str = "10 minutes") -> None:
    """Evaluates what is new in a stream of logs into path/history, by way of closed ticks in the exactly-once table path/ticks.

    A batch that is run again, after a loss or a restart, replaces its own rows, so nothing fires twice.
    """
    spark = logs.sparkSession
    append(closed_ticks(logs, rules, late), f"{path}/ticks", f"{path}/state/ticks")
    run(triggers(spark.readStream.schema(TICKS).parquet(f"{path}/ticks")), history(spark, path).put, f"{path}/state/rules")
