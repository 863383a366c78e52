"""What only showed on larger tables: values that doubles can't hold, and steps whose cost grew faster than their input."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import rule_catalogue, sigma, traces
from logloom.plans import catalogue, flows, protocols
from logloom.sources import ingest, logstore


def test_nanoseconds_beyond_doubles(spark):
    values = [648_741_594_641_000_000 + i * 1_000_000 + extra for i in range(1000) for extra in (0, 999_999)] + [-1_999_999, -1, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in values], "n long").select("n", X.ns_to_ms(F.col("n")).alias("ms")).collect()
    assert all(r["ms"] == (abs(r["n"]) // 1_000_000) * (1 if r["n"] > 0 else -1) for r in rows)


def test_nanoseconds_beyond_64_bits(spark, tmp_path):
    """Order keys of a large table make nanoseconds that no long holds: exact times, not an overflow."""
    keys = [0, 7_470_931, 7_470_932, 9_000_000, 54_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = {k: (datetime(1970, 1, 1) + timedelta(milliseconds=k * 1_234_567_891_011 // 1_000_000)).isoformat(timespec="milliseconds") + "Z" for k in keys}
    assert {r["o_orderkey"]: r["iso"] for r in catalogue.QUERIES["ns_to_iso"](spark, str(tmp_path)).collect()} == want
    odd = spark.createDataFrame([("x",), ("9" * 40,), (str(1 << 63),), ("-1",)], "n string").select(X.ns_to_iso(F.col("n")).alias("iso")).collect()
    assert [r["iso"] for r in odd] == [None, None, "2262-04-11T23:47:16.854Z", "1970-01-01T00:00:00.000Z"]


def test_trees_within_tasks_and_by_joins(spark):
    """Random forests with repeated ids, orphans, cycles and nulls: both ways give the same, and small traces aren't joined."""
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c", None]) if i % 9 else f"t{i % 50}", rnd.choice([None, *[f"s{j}" for j in range(60)]]), rnd.choice([None, *[f"s{j}" for j in range(80)]]), None if i % 11 == 0 else i * 7919 % 13) for i in range(600)]
    rows += [("chain", f"{i}", f"{i - 1}" if i else None, 0) for i in range(3000)] + [("wide", f"{i:05}", "00000" if i else "", i % 3) for i in range(3000)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_time int").repartition(7).cache()
    seen = lambda df: sorted(df.collect(), key=str)
    for fn in (traces.depths, traces.preorder):
        within = seen(fn(spans, large=10_000))
        assert within == seen(fn(spans, large=0)) == seen(fn(spans, large=1000))
    assert max(r["depth"] or 0 for r in within) == 2999 and any(r["depth"] is None for r in within)


def test_small_traces_are_shuffled_once(spark):
    few = spark.createDataFrame([("t", "a", None, 0), ("t", "b", "a", 0)], "trace_id string, span_id string, parent_span_id string, start_time int")
    for fn in (traces.depths, traces.preorder):
        plan = fn(few)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("RepartitionByExpression") == 1 and "Window" not in plan


def test_filters_are_made_within_tasks(spark, tmp_path):
    """Bitmaps, not trigrams, leave the tasks; they hold every trigram of their rows, and little else."""
    texts = ["Worker heartbeat", "", "ab", None, "Ünïcode 50%_off", "x" * 5000]
    bits = logstore.grams([t.lower().encode() for t in texts if t is not None])
    assert all((bits & logstore.grams([w.encode()])).sum() == logstore.grams([w.encode()]).sum() > 0 for w in ("heart", "ünï", "50%", "xxx"))
    assert not logstore.grams([b"ab", b"", b"c"]).any() and bits.sum() < sum(len((t or "").encode()) for t in texts[:5]) + 1
    kept = logstore.LogStore(spark, str(tmp_path / "s"))
    rows = [(i, datetime(2024, 1, 1), 0, "s", "info", f"{texts[i % 6]} {i}", None, None) for i in range(2000)]
    kept.add(spark.createDataFrame(rows, "id long, time timestamp_ntz, project_id int, service string, level string, message string, metadata string, trace_id string"), spark.createDataFrame([(0, 1)], "id int, organization_id int"))
    assert kept.filters().count() == 2 * kept.rows().select(logstore.file_name()).distinct().count()
    assert [r["id"] for r in kept.containing("HEARTBEAT 1998").collect()] == [1998] and kept.candidates("no such thing").count() == 0
    (tmp_path / "s" / "filters").mkdir()
    assert [r["id"] for r in kept.containing("HEARTBEAT 1998").collect()] == [1998]


def test_rules_go_to_the_parser_in_c(monkeypatch):
    seen = []
    load = rule_catalogue.yaml.load_all
    monkeypatch.setattr(rule_catalogue.yaml, "load_all", lambda text, loader: seen.append(loader.__name__) or load(text, loader))
    assert list(rule_catalogue.documents("a: [1, 'x']\n---\nb: 2")) == [{"a": [1, "x"]}, {"b": 2}]
    try:
        list(rule_catalogue.documents("[" * 100_000))
    except RecursionError:
        pass
    assert seen == ["CSafeLoader" if rule_catalogue.yaml.__with_libyaml__ else "SafeLoader", "SafeLoader"]


def test_base64_text_is_cleaned_once(spark):
    told = sigma._leaf(F.col("c"), "hello", "base64")
    rows = spark.createDataFrame([("aGVs bG8=",), ("aGVsbG8",), ("aGVsbG8A=",), ("A",), ("",), (None,), ("aGVs~",)], "c string").select(told.alias("t"))
    assert [r["t"] for r in rows.collect()] == [True, True, True, False, False, False, False]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_nested_payloads_are_built_once(spark):
    one = spark.createDataFrame([("x",)], "c string").select(protocols.part(1, protocols.part(2, protocols.part(3, protocols.binary(F.col("c"))))).alias("b"))
    assert one._jdf.queryExecution().analyzed().toString().count("encode(") == 1
    assert one.first()["b"] == bytes.fromhex("0a8700" + "128400" + "1a8100") + b"x"
    bodies = spark.createDataFrame([('{"trace_id" : "a_b", "x_y": 1}',), ('{"traceId": "trace_id"}',), (None,)], "b string").select(ingest.camel(F.col("b")).alias("b"))
    assert [r["b"] for r in bodies.collect()] == ['{"traceId" : "a_b", "x_y": 1}', '{"traceId": "trace_id"}', None]


def test_parts_of_a_stream_are_made_once(spark):
    made, seen = spark.sparkContext.accumulator(0), []
    rows = spark.createDataFrame([(i,) for i in range(90)], "id long").mapInArrow(lambda batches: (made.add(b.num_rows) or b for b in batches), "id long")
    flows.in_parts(rows, "case when id < 60 then id % 2 * 2 end", lambda stream, path: seen.append(stream.isStreaming))
    assert made.value == 90 and seen == [True, True, True]
