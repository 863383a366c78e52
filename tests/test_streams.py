"""Streams in several batches: restarts, batches that are run again, late rows, and what state and tables hold afterwards."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.operators import analytics, sigma, traces
from logloom.session import folders
from logloom.streaming import alarms, casework, rollups, spanstore, streams
from logloom.streaming.tables import Latest

START = datetime(2024, 1, 1)
LOG = "id long, time timestamp_ntz, project_id int, service string, level string, message string, metadata string, trace_id string"
RULES = "rule_id int, service string, levels string, project_id int, threshold int, time_window int, enabled boolean"


class Source:
    """A folder that grows, read as a stream."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def log(i, seconds, level="error", service="s", project=1, message="m", trace=None):
    return (i, START + timedelta(seconds=seconds), project, service, level, message, None, trace)


# alerts


def brute_alerts(rows, rules, late):
    """Every tick in order, on all logs."""
    newest, out = max(r[1] for r in rows), []
    for rule, service, levels, project, threshold, window, enabled in rules:
        fits = [r[1] for r in rows if r[4] in levels.split(",") and (service is None or r[3] in (service, "unknown")) and (project is None or r[2] == project)]
        tick, fired = START, None
        while enabled and tick <= newest - late:
            since = tick - timedelta(minutes=window)
            n = sum(max(since, fired or since) <= t < tick for t in fits)
            if n >= threshold and any(tick - timedelta(minutes=1) <= t < tick for t in fits):
                out.append((rule, tick, n))
                fired = tick
            tick += timedelta(minutes=1)
    return Counter(out)


def test_alerts_in_batches_with_restarts(spark, tmp_path):
    source, out = Source(spark, tmp_path / "in", LOG), str(tmp_path / "out")
    rules = [(1, None, "error,error", None, 3, 5, True), (2, "auth", "error,warn", None, 2, 1, True), (3, None, "warn", 2, 1, 60, True), (4, None, "error", None, 1, 5, False), (5, "unknown", "error", 1, 2, 30, True)]
    rows, sent = [], spark.createDataFrame(rules, RULES)
    for part in range(4):
        new = [log(part * 100 + i, part * 1200 + i * 13, ("error", "warn", "info")[i % 3], ("auth", "unknown", "s", None)[i % 4], i % 3) for i in range(90)]
        alarms.evaluate(source.add(new), sent, out, "2 minutes")
        rows += new
    stream = source.add([log(999, 200)])  # far too late: left out
    alarms.evaluate(stream, sent, out, "2 minutes")
    alarms.evaluate(stream, sent, out, "2 minutes")  # nothing new: nothing fires twice
    told = alarms.history(spark, out).rows()
    assert Counter((r["rule_id"], r["triggered_at"], r["log_count"]) for r in told.collect()) == brute_alerts(rows, rules, timedelta(minutes=2))
    assert told.select("batch").distinct().count() > 2


def test_a_batch_run_again_replaces_its_history(spark, tmp_path):
    told = alarms.history(spark, str(tmp_path))
    batch = spark.createDataFrame([(1, START, 5)], alarms.TOLD)
    told.put(batch, 0)
    told.put(batch, 1)
    told.put(batch, 1)
    assert told.rows().count() == 2 and told.rows(after=0).count() == 1


def test_a_rules_state_is_as_large_as_its_window():
    held = ([], [], None)
    for minute in range(500):
        held, fired = alarms.advanced(held, [(60 * minute, 1, 1000, 7)])
        assert not fired
    assert len(held[0]) == 7 == sum(held[1])


# traces


def span(trace, name, minute, parent=None, service="s", status="OK"):
    at = START + timedelta(minutes=minute)
    return (trace, name, parent, service, f"op-{name}", at, at + timedelta(seconds=30), status)


def test_a_trace_stays_one_row(spark, tmp_path):
    source, out = Source(spark, tmp_path / "in", spanstore.SPANS), str(tmp_path / "out")
    parts = [
        [span("t1", "b", 1, "a", "db"), span("t2", "x", 2), span("t2", "y", 3, "x")],
        [span("t1", "a", 0, None, "web"), span(None, "z", 5)],
        [span("t1", "c", 4000, "a", "mail", "ERROR")],  # after days of silence
    ]
    for n, part in enumerate(parts):
        spanstore.follow(source.add(part), out)
        every = spark.createDataFrame([x for p in parts[: n + 1] for x in p], spanstore.SPANS)
        table = spanstore.traces(spark, out)
        want = traces.assemble(every.where("trace_id is not null")).select(*spanstore.names(spanstore.TRACES))
        assert Counter(table.rows().collect()) == Counter(want.collect())
        assert spanstore.spans(spark, out).rows().count() == every.count()
        if n == 1:
            table.compact()
    assert spanstore.traces(spark, out).changes.numbers()  # what has changed since the snapshot, t1 alone
    assert [r["trace_id"] for r in spanstore.traces(spark, out).changes.rows().collect()] == ["t1"]


def test_latest_rows_survive_compaction_at_any_point(spark, tmp_path):
    table = Latest(spark, str(tmp_path), "k string, v int", ["k"])
    put = lambda n, *rows: table.put(spark.createDataFrame(rows, "k string, v int"), n)
    assert table.rows().collect() == []
    table.compact()
    put(0, ("a", 1), ("b", 1))
    put(1, ("a", 2))
    table.compact()
    table.compact()
    assert sorted(map(tuple, table.rows().collect())) == [("a", 2), ("b", 1)] and table.changes.numbers() == []
    put(2, ("b", 3), ("c", 3), (None, 4))
    put(2, ("b", 4), ("c", 3), (None, 4))
    assert sorted(map(tuple, table.rows().collect()), key=str) == [("a", 2), ("b", 4), ("c", 3), (None, 4)]
    table.compact()
    assert folders(spark, f"{tmp_path}/snapshots") == ["upto=2"] and table.rows().count() == 4


# incidents


def test_incidents_and_their_feed(spark, tmp_path):
    source, out = Source(spark, tmp_path / "in", LOG), str(tmp_path / "out")
    bad, worse = "../../etc/passwd requested", "select * from users where id=1 or 1=1 --"
    parts = [
        [log(1, 0, message=bad, trace="t1"), log(2, 10, message=bad, trace="t2"), log(3, 20, message="fine", trace="t1")],
        [log(4, 30, message=worse, trace="t1"), log(5, 40, message=bad), log(6, 50, message=bad, project=2)],
        [log(7, 60, message=bad, project=3), log(8, 70, message=bad, trace="t1", service="u"), log(9, 4000, message=bad)],
    ]
    for part in parts:
        casework.follow(source.add(part), out)
    rows = spark.createDataFrame([x for p in parts for x in p], LOG)
    found = {r["incident"]: r for r in casework.incidents(spark, out).rows().collect()}
    hits = sigma.detect(rows)
    want = hits.where("trace_id is not null").groupBy("trace_id", "project_id").agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("z"), F.array_sort(F.collect_set("service")).alias("s")).where("n > 1").collect()
    assert {(r["trace_id"], r["project_id"], r["n"], r["a"], r["z"], tuple(r["s"])) for r in want} == {(r["trace_id"], r["project_id"], r["n"], r["start_time"], r["end_time"], tuple(r["services"])) for r in found.values() if r["kind"] == "trace"}
    burst = [r for r in found.values() if r["kind"] == "burst"]
    least = hits.where("trace_id is null and log_id < 9").groupBy("service", "severity").count().where("count >= 3").collect()
    assert {(r["severity"], r["n"]) for r in burst} == {(r["severity"], r["count"]) for r in least} and all(r["project_id"] == 1 for r in burst)
    feed = casework.events(spark, out).collect()
    assert [r["type"] for r in feed if r["id"] == "t1/1"] == ["incident_created", "incident_updated"]
    assert all(sum(r["type"] == "incident_created" for r in feed if r["id"] == i) == 1 for i in found)
    assert casework.detections(spark, out).count() == hits.count()
    first = casework.events(spark, out, limit=1)
    seen = max(r["batch"] for r in first.collect())
    assert first.count() + casework.events(spark, out, after=seen).count() == len(feed)


def test_detections_are_folded_before_they_move(spark):
    rows = [log(i, i % 50, message="../../etc/passwd", trace="hot") for i in range(2000)]
    some = casework.folded(casework.grouped(sigma.detect(spark.createDataFrame(rows, LOG).repartition(4)))).collect()
    assert sum(r["n"] for r in some) == sigma.detect(spark.createDataFrame(rows, LOG)).count()
    assert len(some) <= 4 * len({(r["severity"], r["tactics"], r["techniques"]) for r in some})


def brute_incidents(parts):
    """Incidents and the events of each part, by plain loops over its detections."""
    weight, least, held, events = {"critical": 4, "high": 3, "medium": 2, "low": 1}, {"trace": 2, "burst": 3}, {}, []
    for part in parts:
        before = {k: len(v) for k, v in held.items()}
        for r in part:
            bucket = int((r["time"] - datetime(1970, 1, 1)).total_seconds()) // 300 * 300
            own = "" if r["project_id"] is None else f"/{r['project_id']}"
            key = ("trace", r["trace_id"] + own) if r["trace_id"] is not None else ("burst", "/".join(x for x in ("burst", r["service"], r["severity"], str(bucket)) if x is not None))
            held.setdefault(key, []).append(r)
        events.append({(("incident_updated" if before.get(k, 0) >= least[k[0]] else "incident_created"), k[1]) for k, v in held.items() if len(v) > before.get(k, 0) and len(v) >= least[k[0]]})
    found = {}
    for (kind, name), rows in held.items():
        first = min(rows, key=lambda r: (r["time"], r["log_id"], r["rule_id"]))
        told = lambda c: tuple(sorted({x for r in rows for x in r[c]}))  # noqa: B023, E731
        heaviest = max(rows, key=lambda r: weight.get(r["severity"], 0))["severity"]
        if len(rows) >= least[kind]:
            found[name] = (kind, first["trace_id"], first["project_id"], heaviest, len(rows), min(r["time"] for r in rows), max(r["time"] for r in rows), tuple(sorted({r["service"] for r in rows if r["service"]})), told("tactics"), told("techniques"))
    return found, [x for x in events if x]


def test_many_incidents_in_parts(spark, tmp_path, monkeypatch):
    """Totals and events as by plain loops, also after a batch that failed between its two tables is run again."""
    import random

    rnd, source, out = random.Random(3), Source(spark, tmp_path / "in", LOG), str(tmp_path / "out")
    texts = ["../../etc/passwd requested", "select * from users where id=1 or 1=1 --", "<script>alert(1)</script>", "sudo: unauthorized privilege escalation", "fine"]
    parts = [[log(p * 1000 + i, rnd.randrange(2400), "error", rnd.choice(["a", "b", "", None]), rnd.choice([1, 2, None]), rnd.choice(texts), rnd.choice([None, *[f"t{j}" for j in range(120)]])) for i in range(150)] for p in range(4)]
    put, fails = casework.Batches.put, [True]

    def once(self, batch, number):
        if self.path.endswith("/feed") and number == 2 and fails:
            fails.pop()
            raise OSError("lost")
        put(self, batch, number)

    monkeypatch.setattr(casework.Batches, "put", once)
    for part in parts:
        stream = source.add(part)
        try:
            casework.follow(stream, out)
        except Exception:
            casework.follow(stream, out)
    want, events = brute_incidents([sigma.detect(spark.createDataFrame(p, LOG)).collect() for p in parts])
    assert not fails and len(want) > 60
    assert {r["incident"]: tuple(tuple(x) if isinstance(x, list) else x for x in r[1:]) for r in casework.incidents(spark, out).rows().collect()} == want
    told = casework.events(spark, out).collect()
    assert [{(r["type"], r["id"]) for r in told if r["batch"] == b} for b in sorted({r["batch"] for r in told})] == events and len(told) == sum(map(len, events))


def test_no_call_of_python_for_each_incident(spark, tmp_path):
    stream = spark.readStream.schema(casework.SEEN).parquet(str(tmp_path))
    plan = casework.changes(stream)._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "FlatMapGroups" not in plan and "TransformWithState" not in plan


# rollups


def test_late_rows_rewrite_only_their_buckets(spark, tmp_path):
    source, out = Source(spark, tmp_path / "in", LOG), str(tmp_path / "out")
    hour = 3600
    first = [log(i, i * 600) for i in range(60)]  # ten hours
    kept = rollups.follow(source.add(first), out)
    files = lambda: {r["f"]: (r["part"], r["n"]) for r in spark.read.parquet(f"{out}/hourly").groupBy(F.input_file_name().alias("f"), "part").agg(F.sum("log_count").alias("n")).collect()}
    before = files()
    newest = START + timedelta(seconds=59 * 600)
    late = [log(100, 7.5 * hour), log(101, 2 * hour)]  # one within three hours, one beyond
    rollups.follow(source.add([*late, log(102, 10.9 * hour)]), out)
    after = files()
    gone = {before[f][0] for f in before.keys() - after.keys()}
    assert gone == {"2024-01-01-07"} and {after[f][0] for f in after.keys() - before.keys()} == {"2024-01-01-07", "2024-01-01-08"} | ({"2024-01-01-09"} if newest >= START + timedelta(hours=11) else set())
    stored = {r["bucket"].hour: r["log_count"] for r in kept.stored().collect()}
    assert stored[7] == 7 and stored[2] == 6  # the latter row waits for a refresh
    kept.refresh(rollups.HOURLY, F.col("bucket") < F.lit(START + timedelta(hours=3)).cast("timestamp_ntz"))
    assert {r["bucket"].hour: r["log_count"] for r in kept.stored().collect()}[2] == 7
    every = spark.createDataFrame([*first, *late, log(102, 10.9 * hour)], LOG)
    assert Counter(kept.counts().collect()) == Counter(analytics.rollup(every, "1h").select("bucket", "project_id", "level", "service", "log_count").collect())


def test_daily_rollups_reach_back_three_days_and_batches_may_repeat(spark, tmp_path):
    kept = rollups.Rollups(spark, str(tmp_path))
    day = 86400
    batch = lambda *rows: spark.createDataFrame([log(*r) for r in rows], LOG)
    assert kept.stored() is None and kept.counts().count() == 0
    kept.put(batch(*[(i, i * day / 2) for i in range(14)]), 0)
    some = batch((50, 4.2 * day), (51, 1.1 * day), (52, 7.6 * day))
    for _ in range(2):
        kept.put(some, 1)
    stored = {r["bucket"].day: r["log_count"] for r in kept.stored(rollups.DAILY).collect()}
    assert stored == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 2}
    kept.put(batch(), 2)
    assert {r["bucket"].day: r["log_count"] for r in kept.stored(rollups.DAILY).collect()} == stored


# live tail


def test_notifications_lose_nothing_across_restarts(spark, tmp_path):
    source, out, state = Source(spark, tmp_path / "in", LOG), str(tmp_path / "out"), str(tmp_path / "state")
    first = [log(i, i, project=i % 2) for i in range(15_000)] + [log(99_999, 5, project=None)]
    stream = source.add(first)
    streams.fan_out(stream, out, state)
    streams.fan_out(stream, out, state)
    seen = max(streams.notices(spark, out).numbers())
    streams.fan_out(source.add([log(20_000, 9), log(20_001, 8)]), out, state)
    told = streams.notices(spark, out)
    assert Counter(i for r in told.rows().collect() for i in r["ids"]) == Counter([*range(15_000), 20_000, 20_001])
    assert max(len(r["ids"]) for r in told.rows().collect()) <= streams.CHUNK
    assert [(r["project_id"], i) for r in told.rows(after=seen).collect() for i in sorted(r["ids"])] in ([(1, 20_000), (1, 20_001)], [(1, 20_001), (1, 20_000)])


def test_pages_of_a_poll(spark):
    rows = spark.createDataFrame([log(i, i // 3) for i in range(250)], LOG)
    ids, after = [], None
    while True:
        page = streams.polled(rows, after).collect()
        ids += [r["id"] for r in page]
        if len(page) < 100:
            break
        after = (str(page[-1]["time"]), page[-1]["id"])
    assert ids == list(range(250)) and streams.polled(rows, limit=1000).count() == 100
