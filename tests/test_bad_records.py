"""No record ends a job: one bad record among good ones gives a defined result, and the good ones theirs."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import errors, identifiers, siem, sigma
from logloom.sources import ingest

TRACE = 'Traceback (most recent call last):\n  File "/app/a.py", line 3, in f\n    g()\nValueError: bad'


def told(**exception):
    return json.dumps({"exception": {"type": "E", "message": "m"} | exception})


BAD = [
    told(language=7, stacktrace=[{"file": "a.js", "function": 5, "line": 1}]),
    told(stacktrace=[{"file": "a.js", "line": 1 << 40, "column": -(1 << 50)}]),
    told(raw=9, stacktrace=[{"file": ["x"], "function": {"a": 1}, "line": "7"}]),
    told(stacktrace=[1, None, "x"], cause={"type": 1, "cause": 5}),
    '{"exception": {"type": "E\\ud800", "message": "half \\udfff", "stacktrace": [{"file": "\\ud800", "function": "f"}]}}',
    '{"exception": ' * 100_000,
    '{"exception": [1, 2]}',
]


def test_exceptions_of_odd_metadata(spark):
    rows = [(i, "error", "boom", m) for i, m in enumerate(BAD)] + [(100, "error", TRACE, None), (101, "error", TRACE, told(raw=TRACE))]
    found = {r["log_id"]: r for r in errors.exceptions(spark.createDataFrame(rows, "id long, level string, message string, metadata string")).collect()}
    assert found[100]["type"] == found[101]["type"] == "ValueError"
    assert found[0]["language"] == "unknown" and found[0]["frames"][0]["function"] is None and found[0]["frames"][0]["line"] == 1
    assert found[1]["frames"][0]["line"] is None and found[1]["frames"][0]["column"] is None
    assert found[2]["frames"][0]["line"] is None and found[3]["frames"] == [] and found[4]["type"] == "E?"
    assert 5 not in found and 6 not in found


@pytest.mark.parametrize(
    "text",
    [
        "TypeError: x\n    at handle (/app/a.js:99999999999:5)",
        TRACE.replace("line 3", "line 99999999999999"),
        "java.lang.RuntimeException: x\n\tat org.a.B.c(D.java:99999999999)",
        "panic: x\n\ngoroutine 1 [running]:\nmain.f(0x1)\n\t/app/a.go:99999999999 +0x1d\n",
        "PHP Fatal error:  Uncaught RuntimeException: x in /a.php:3\nStack trace:\n#99999999999 /a.php(99999999999): f()\n#1 {main}",
    ],
)
def test_traces_with_places_beyond_32_bits(spark, text):
    rows = [(1, "error", text, None), (2, "error", TRACE, None)]
    found = {r["log_id"]: r for r in errors.exceptions(spark.createDataFrame(rows, "id long, level string, message string, metadata string")).collect()}
    assert found[1]["frames"][0]["line"] is None and found[2]["frames"][0]["line"] == 3


def test_adapters_of_numbers_that_are_none(spark):
    lines = spark.createDataFrame([(1, "<99999999999>Jan  5 10:00:00 h app: m"), (2, "<11>Jan  5 10:00:00 h app: m")], "id int, line string")
    assert {r["id"]: (r["pri"], r["level"], r["message"]) for r in ingest.syslog(lines).collect()} == {1: (None, "info", "m"), 2: (11, "error", "m")}
    fields = "SYSLOG_IDENTIFIER string, _SYSTEMD_UNIT string, _COMM string, _EXE string, PRIORITY string, MESSAGE string, __REALTIME_TIMESTAMP string"
    j = spark.createDataFrame([("a", None, None, None, "abc", "m", "x"), ("b", None, None, None, "3", "m", "1700000000123456")], fields)
    rows = {r["service"]: r for r in ingest.journald(j).collect()}
    assert (rows["b"]["level"], rows["b"]["time_ms"]) == ("error", 1700000000123) and rows["a"]["time_ms"] is None
    ns = spark.createDataFrame([("x",), ("9" * 40,), ("1999999",)], "n string").select(X.ns_to_ms(F.col("n")).alias("ms")).collect()
    assert [r["ms"] for r in ns] == [None, None, 1]


def test_otlp_of_odd_values(spark):
    odd = [
        {"intValue": "abc"}, {"intValue": 1 << 70}, {"stringValue": 5}, {"arrayValue": 7}, {"arrayValue": {"values": 3}}, {"kvlistValue": [1]}, {"stringValue": "\ud800"}, "text", 9, [1], None, {"arrayValue": {"values": [{"intValue": "9" * 5000}]}},
    ]
    record = lambda body, n: {"timeUnixNano": "x" if n % 2 else "1000000", "severityNumber": "y", "body": body, "attributes": [{"key": "a", "value": body}, {"key": 4}, 5, {"value": {}}], "traceId": "ab"}
    bodies = [json.dumps({"resourceLogs": [{"resource": {"attributes": 3}, "scopeLogs": [{"logRecords": [record(b, n)]}]}]}) for n, b in enumerate(odd)]
    good = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record({"stringValue": "fine"}, 0)]}]}]})
    messages = [r["message"] for r in ingest.otlp_logs(spark.createDataFrame([(b,) for b in [*bodies, good, "[" * 50_000, "nonsense", None]], "body string")).collect()]
    assert "fine" in messages and "5" in messages and "?" in messages and len(messages) >= 8
    spans = {"traceId": "a1", "spanId": "b1", "startTimeUnixNano": "x", "events": [{"timeUnixNano": "soon", "name": 3}, 4], "links": [{"traceId": "t", "spanId": "s", "attributes": 1}, "z"]}
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [spans]}]}]})
    row = ingest.otlp_spans(spark.createDataFrame([(body,)], "body string")).collect()[0]
    assert row["start_ms"] is None and json.loads(row["events"]) == [{"time_ms": None, "name": "3", "attributes": {}}] and json.loads(row["links"])[0]["trace_id"] == "t"


def test_a_rule_whose_expression_does_not_compile_matches_nothing(spark):
    logs = spark.createDataFrame([(1, "abc", "s")], "id long, message string, service string").selectExpr("*", "current_timestamp() as time", "1 as project_id", "'error' as level", "null as trace_id")
    rules = [sigma.Rule("bad", "b", "low", {"s": {"message|re": "(unclosed"}, "condition": "s"}), sigma.Rule("not", "n", "low", {"s": {"message|re": "*"}, "condition": "not s"}), sigma.Rule("good", "g", "low", {"s": {"message|re": "^a.c$"}, "condition": "s"})]
    assert sorted(r["rule_id"] for r in sigma.detect(logs, rules).collect()) == ["good", "not"]


def test_identifiers_at_any_depth_and_in_texts_with_brackets(spark):
    deep = '{"a":' * 300 + '{"user_id":"deep"}' + "}" * 300
    rows = [
        (1, "", '{"note":"[x] user_id=77 ok"}'), (2, "", '{"n":"{user_id=99}"}'), (3, "", '{"a":{"b":{"c":{"d":{"user_id":"five"}}}}}'), (4, "", deep), (5, "", '{"list":[{"user_id":"in a list"}],"user_id":8,"sid":""}'),
        (6, "user_id=5", '{"userId":"5","x":{"REQ_ID":"whole value, as it is"}}'), (7, None, "nonsense"), (8, "", None), (9, "", '{"a":' * 200_000), (10, "", '{"uid":"\\ud800"}'),
    ]
    logs = spark.createDataFrame(rows, "id long, message string, metadata string").selectExpr("*", "timestamp_ntz'2024-01-01' as time", "1 as project_id")
    found = {(r["log_id"], r["type"], r["value"], r["field"]) for r in identifiers.extract(logs).collect()}
    assert found == {
        (1, "user_id", "77", "metadata.note"), (2, "user_id", "99", "metadata.n"), (3, "user_id", "five", "metadata.a.b.c.d.user_id"), (4, "user_id", "deep", "metadata" + ".a" * 300 + ".user_id"),
        (1, "user_id", "user_id", "metadata.note"), (2, "user_id", "user_id", "metadata.n"), (6, "user_id", "user_id", "message"), (6, "user_id", "5", "message"), (6, "request_id", "whole value, as it is", "metadata.x.REQ_ID"), (10, "user_id", "?", "metadata.uid"),
    }


def test_marks_are_in_all_that_fits():
    import re

    shapes = {"uuid": "0f8fad5b-d9cb-469f-a165-70867728950e", "request_id": "Request-ID:abcdefgh1 req_abcdef1", "session_id": "SESSIONID=abcdefgh12345678 sess-abcdefgh", "user_id": "UID:7 user_7", "transaction_id": "txn_id=abcdefgh transactionId=abcdefgh1 TX-abcdef1", "order_id": "OrderId=abcd order-abcd ORD_abcd", "correlation_id": "x-correlation-id:abcdefgh corr_abcdef", "trace_id": "TraceId=" + "a" * 32, "span_id": "span-id=" + "b" * 16}
    for p in identifiers.PATTERNS:
        hits = [m.group(0).lower() for m in re.finditer(p.expression, shapes[p.type])]
        assert hits and all(any(mark in h for mark in p.marks) for h in hits)


def test_edited_rules_are_threats_of_their_own(spark):
    rows = [("r", "old", "low", ["a"], ["T1"])] * 2 + [("r", "new", "high", ["a"], ["T1"])] * 3
    found = siem.top_threats(spark.createDataFrame(rows, "rule_id string, title string, severity string, tactics array<string>, techniques array<string>")).collect()
    assert [(r["title"], r["severity"], r["n"]) for r in found] == [("new", "high", 3), ("old", "low", 2)]


def test_whole_exports_survive_quotes(spark):
    rows = [("2024-01-01 00:00:00", "s", "info", 'a "b", c\nd', '{"k": "v, \\"w\\""}', "t", 1), ("2024-01-01 00:00:01", "s", "info", "m", None, None, 2)]
    logs = spark.createDataFrame(rows, "time string, service string, level string, message string, metadata string, trace_id string, id int").withColumn("time", F.col("time").cast("timestamp_ntz"))
    found = ingest.exported(logs).orderBy("Time").collect()
    assert (found[0]["Message"], found[0]["Metadata"], found[0]["TraceID"], found[1]["Metadata"]) == ('a "b", c\nd', '{"k": "v, \\"w\\""}', "t", None)


def test_records_of_shippers_and_journald(spark):
    bodies = ['{"MESSAGE":null}', '{"_EXE":"/usr/bin/x y","level":"crit","time":"2024-01-05T10:00:00Z","metadata":"text","_UID":0}', '{"_SYSTEMD_UNIT":"a.service","PRIORITY":"odd","__REALTIME_TIMESTAMP":"soon","date":1.5}', '{"service":"","container_name":"c","message":5,"level":50}', "[1]", "nonsense", None, "{}", '{"_HOSTNAME":"","log":"l"}']
    rows = [r for r in ingest.shipped(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).orderBy("id").collect()]
    assert [(r["is_journald"], r["service"], r["level"], r["message"]) for r in rows] == [
        (True, "unknown", "info", ""), (True, "x y", "critical", ""), (True, "a", "debug", ""), (False, "c", "error", "5"), (False, "unknown", "info", ""), (False, "unknown", "info", ""), (False, "unknown", "info", ""), (False, "unknown", "info", ""), (False, "unknown", "info", "l"),
    ]
    assert str(rows[1]["time"]) == "2024-01-05 10:00:00" and str(rows[2]["time"]) == "1970-01-01 00:00:01.500000" and rows[3]["time"] is None
    assert json.loads(rows[1]["metadata"]) == {"_EXE": "/usr/bin/x y", "_UID": 0, "source": "journald"} and json.loads(rows[3]["metadata"]) == {}
