"""Table functions in SQL against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import tables
from logloom.operators import errors, identifiers

TRACE = 'Traceback (most recent call last):\n  File "/app/a.py", line 3, in f\n    g()\nValueError: bad'


@pytest.fixture
def logs(spark):
    rows = [(1, "user_id=5 req-abcdef12 USER_ID=5", '{"userId":"5","x":{"REQ_ID":"whole"},"note":"order_id=ORD-1234"}'), (2, None, None), (3, TRACE, "{"), (4, "ticket T-77 t-77", '{"ticket":"T-9"}'), (5, "", '{"exception":{"type":"E","message":"m","stacktrace":[{"file":"a","function":"f"}]}}')]
    df = spark.createDataFrame(rows, "id long, message string, metadata string").selectExpr("*", "timestamp_ntz'2024-01-01' as time", "1 as project_id", "'error' as level")
    df.createOrReplaceTempView("table_logs")
    tables.OWN.clear()
    tables.register(spark)
    return df


def test_identifiers(spark, logs):
    found = spark.sql("select l.id, x.* from table_logs l, lateral identifiers(l.message, l.metadata) x")
    want = identifiers.extract(logs).select("log_id", "type", "value", "source", "field")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    alone = spark.sql("select x.value from table_logs l, lateral identifiers(l.message) x where l.id = 1 and x.type = 'user_id'").collect()
    assert [r["value"] for r in alone] == ["user_id", "5"]
    with pytest.raises(Exception, match="identifiers"):
        spark.sql("select * from identifiers(1)").collect()


def test_exceptions(spark, logs):
    found = {r["id"]: r for r in spark.sql("select l.id, x.* from table_logs l, lateral exceptions(l.message, l.metadata) x").collect()}
    want = {r["log_id"]: r for r in errors.exceptions(logs).withColumn("functions", F.transform("frames", lambda f: f["function"])).collect()}
    assert {i: (r["type"], r["message"], r["language"], r["functions"]) for i, r in found.items()} == {i: (r["type"], r["message"], r["language"], r["functions"]) for i, r in want.items()} and set(found) == {3, 5}


def test_own_patterns(spark, logs):
    tables.register_pattern(spark, "ticket", r"(?i)\b(t-\d{1,9})\b", 10, ("ticket",))
    found = spark.sql("select x.* from table_logs l, lateral identifiers(l.message, l.metadata) x where l.id = 4").collect()
    assert [tuple(r) for r in found] == [("ticket", "T-77", "message", "message"), ("ticket", "T-9", "metadata", "metadata.ticket")]
    for bad in ("(a+)+b", "no group", "("):
        with pytest.raises(ValueError):
            tables.register_pattern(spark, "x", bad)
