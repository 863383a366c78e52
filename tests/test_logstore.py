"""The partitioned log store: exact searches that read few files, retention that leaves kept days alone."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.sources.logstore import LogStore

START = datetime(2024, 1, 1)
LOG = "id long, time timestamp_ntz, project_id int, service string, level string, message string, metadata string, trace_id string"


@pytest.fixture
def store(spark, tmp_path):
    kept = LogStore(spark, str(tmp_path / "store"))
    rows = [(i, START + timedelta(hours=6 * i), i % 3, "s", "info", f"Heartbeat {i} of the worker" if i != 41 else "NEEDLE-77 Ünïcode 50%_off", None, None) for i in range(80)]
    projects = spark.createDataFrame([(0, 1), (1, 2)], "id int, organization_id int")
    kept.add(spark.createDataFrame(rows, LOG), projects)
    kept.add(spark.createDataFrame([(100, START, 0, "s", "info", "late needle-78", None, None), (101, START, 2, "s", "info", None, None, None)], LOG), projects)
    return kept


def test_rare_texts_read_few_files(store):
    every = store.rows().select(F.input_file_name()).distinct().count()
    for text, ids in (("needle-77", [41]), ("ÜNÏCODE", [41]), ("50%_OFF", [41]), ("needle", [41, 100]), ("no such text", []), ("ne", [41, 100]), ("heartbeat 7 ", [7]), ("", None)):
        found = store.containing(text)
        want = ids if ids is not None else [r["id"] for r in store.rows().where("message is not null").collect()]
        assert sorted(r["id"] for r in found.collect()) == sorted(want)
    files = len(store.containing("needle-77").inputFiles())
    assert files <= 3 < every
    assert store.rows().count() == 82 and {r["organization_id"] for r in store.rows().select("organization_id").distinct().collect()} == {1, 2, -1}


def test_retention_drops_days_and_rewrites_one(spark, store):
    now = START + timedelta(days=20)
    files = lambda o: {r["f"]: (r["day"], r["n"]) for r in store.rows().where(F.col("organization_id") == o).groupBy(F.input_file_name().alias("f"), "day").agg(F.count("*").alias("n")).collect()}
    before, rows = {o: files(o) for o in (1, 2, -1)}, store.rows().collect()
    cut = {1: now - timedelta(days=10, hours=3), 2: now - timedelta(days=1000)}
    gone = store.retain({1: 10, 2: 1000, 7: 1}, now - timedelta(hours=3))
    left = store.rows().collect()
    assert sorted(r["id"] for r in left) == sorted(r["id"] for r in rows if r["organization_id"] != 1 or r["time"] >= cut[1])
    assert gone == {1: len(rows) - len(left), 2: 0, 7: 0}
    assert files(2) == before[2] and files(-1) == before[-1]
    after, edge = files(1), cut[1].date()
    assert {f: x for f, x in after.items() if x[0] != edge} == {f: x for f, x in before[1].items() if x[0] > edge}
    assert sorted(r["id"] for r in store.containing("heartbeat").collect()) == sorted(r["id"] for r in left if r["message"] and "Heartbeat" in r["message"])
    assert store.retain({1: 0}, now + timedelta(days=30))[1] == sum(r["organization_id"] == 1 for r in left) and store.rows().where("organization_id = 1").count() == 0
    assert store.containing("needle-78").count() == 0
