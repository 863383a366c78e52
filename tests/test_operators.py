"""Hand-made cases: Sigma conditions against a naive evaluator, stack traces, adapters, scalars, streams."""

import gzip
import json
import random
import struct

from pyspark.sql import functions as F

from logloom.functions import scalars as X
from logloom.operators import alerts, errors, identifiers, search, sigma
from logloom.sources import ingest
from logloom.streaming import streams


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).collect()[0]["x"]


def test_sigma_random_conditions(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["error", "warn", None]), rng.choice(["auth login failed", "all fine", "TIMEOUT login", None])) for i in range(40)]
    logs = spark.createDataFrame(rows, "id int, level string, message string")
    det = {"a": {"level": "error"}, "b": {"message|contains": "login"}, "c": {"message|startswith": "timeout"}}

    def leaf(n, level, message):
        m = (message or "").lower()
        return {"a": level == "error", "b": message is not None and "login" in m, "c": message is not None and m.startswith("timeout")}[n]

    for _ in range(12):
        terms = [(rng.choice(["", "not "]), rng.choice("abc")) for _ in range(3)]
        ops = [rng.choice(["and", "or"]) for _ in range(2)]
        text = f"{terms[0][0]}{terms[0][1]} {ops[0]} {terms[1][0]}{terms[1][1]} {ops[1]} {terms[2][0]}{terms[2][1]}"
        got = {r["id"] for r in logs.where(sigma.condition(text, det, dict(logs.dtypes))).collect()}
        want = set()
        for i, level, message in rows:
            v = [leaf(n, level, message) != bool(neg) for neg, n in terms]
            x = (v[0] and v[1]) if ops[0] == "and" else (v[0] or v[1])
            x = (x and v[2]) if ops[1] == "and" else (x or v[2])
            if x:
                want.add(i)
        assert got == want, text


def test_sigma_forms(spark):
    logs = spark.createDataFrame([("cmd.exe /c whoami", "web-1", json.dumps({"ip": "1.2.3.4"})), (None, "unknown", None)], "message string, service string, metadata string")
    fits = lambda det: [bool(r[0]) for r in logs.select(sigma.condition(det["condition"], det, dict(logs.dtypes))).collect()]
    assert fits({"s": {"message": "*.exe*"}, "condition": "s"}) == [True, False]
    assert fits({"s": {"ip": "1.2.3.4"}, "condition": "s"}) == [True, False]
    assert fits({"s": {"message|exists": True}, "condition": "not s"}) == [False, True]
    assert fits({"s1": {"service": "web-1"}, "s2": {"message|re": "whoami$"}, "condition": "all of s*"}) == [True, False]
    assert fits({"s": {}, "condition": "s or missing"}) == [False, False]


def test_stacks():
    py = 'Traceback (most recent call last):\n  File "/app/a.py", line 3, in f\n    g()\n  File "/usr/lib/python3/site-packages/x.py", line 9, in g\nValueError: bad\n'
    found = errors.parse_stack(py)
    assert (found.type, found.message, found.language) == ("ValueError", "bad", "python") and [(f["index"], f["code"]) for f in found.frames] == [(1, None), (0, "g()")]
    js = "TypeError: x is undefined\n    at run (/app/src/i.js:10:5)\n    at /app/src/j.js:2:1\n    at async go (/app/b.js:3:4)\n    at new Foo (<anonymous>)"
    assert [(f["file"], f["function"], f["line"]) for f in errors.parse_stack(js).frames] == [("/app/src/i.js", "run", 10), ("/app/src/j.js", None, 2), ("/app/b.js", "async go", 3)]
    java = "java.lang.IllegalStateException: no\n\tat com.x.A.go(A.java:5)\nCaused by: java.io.IOException: y\n\tat com.x.B.go(B.java:7)"
    assert errors.parse_stack(java).type == "IllegalStateException" and [f["file"] for f in errors.parse_stack(java).frames] == ["com/x/A.java"]
    go = "runtime error: index out of range\n\ngoroutine 1 [running]:\nmain.run(0x1)\n\t/app/main.go:12 +0x1d\n"
    assert errors.parse_stack(go).type == "runtime error" and errors.parse_stack(go).frames[0]["function"] == "main.run"
    php = "Fatal error: Uncaught DomainException: no in /app/x.php:3\nStack trace:\n#0 /app/y.php(9): run()\n#1 {main}"
    assert errors.parse_stack(php).message == "no" and errors.parse_stack(php).frames[0]["index"] == 0
    assert errors.parse_stack("TypeError: x") is None and errors.parse_stack("nothing") is None and errors.parse_stack(None) is None


def test_structured_exceptions():
    deep = {"type": "T0", "message": "m"}
    for i in range(1, 30):
        deep = {"type": f"T{i}", "message": "m", "cause": deep}
    found = errors.detect("x", json.dumps({"exception": {**deep, "stacktrace": [{"file": "a.rb", "line": 3}, {}, None, {"function": "f"}] + [{"file": "b"}] * 200}}))
    assert found.type == "T29" and found.language == "unknown" and found.raw.count("Caused by:") == errors.MAX_CAUSES - 1
    assert [f["index"] for f in found.frames[:2]] == [0, 3] and found.frames[1]["file"] == "<unknown>" and len(found.frames) == 98
    raw = "TypeError: x is undefined\n    at run (/app/src/i.js:10:5)"
    assert errors.detect(None, json.dumps({"exception": {"type": "E", "message": "m", "raw": raw}})).language == "nodejs"
    assert errors.detect(raw, "{broken \"exception\"").language == "nodejs" and errors.detect(raw, '{"exception": 3}').language == "nodejs"


def test_identifiers_in_metadata(spark):
    told = json.dumps({"userId": "Ann", "note": "order_id=A-1234 and req-abcdef12", "in": {"x-trace-id": "t", "deep": {"sid": "s1", "list": ["user_id=9"]}}, "empty": "", "uid": ""})
    rows = spark.createDataFrame([(1, "user_id=ann USER_ID=Ann", told), (2, "none", None), (3, "uuid 0B6F4A1E-7c1d-4f6e-9b3a-2f4d5e6a7b8c", "{bad")], "id long, message string, metadata string").selectExpr("*", "timestamp_ntz'2024-01-01' as time", "1 as project_id")
    got = {(r["log_id"], r["type"], r["value"], r["source"]) for r in identifiers.extract(rows).collect()}
    assert got == {(1, "user_id", "ann", "message"), (1, "user_id", "user_id", "message"), (1, "order_id", "A-1234", "metadata"), (1, "request_id", "req-abcdef12", "metadata"), (1, "trace_id", "t", "metadata"), (1, "session_id", "s1", "metadata"), (3, "uuid", "0B6F4A1E-7c1d-4f6e-9b3a-2f4d5e6a7b8c", "message")}
    maps = {r["log_id"]: r["found"] for r in identifiers.by_log(identifiers.extract(rows), [1]).collect()}
    assert set(maps) == {1} and maps[1]["user_id"] == ["ann", "user_id"]
    custom = [(70, "ticket", r"(T-\d+)", ())]
    assert [p[0] for p in identifiers.by_priority(custom)][4:8] == ["order_id", "ticket", "order_id", "transaction_id"] and len(identifiers.PRIORITIES) == len(identifiers.PATTERNS)


def test_sigma_rules_from_files(spark, tmp_path):
    good = {"title": "Bad login", "level": "high", "logsource": {"category": "proxy", "service": "x"}, "detection": {"sel": {"message|contains": ["a", "b"], "n": {"c": "d"}}, "condition": "sel"}, "tags": ["attack.t1110"]}
    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, [good, {**good, "title": " "}, {**good, "level": "odd"}, {**good, "detection": {"condition": "sel"}}])) + "\nnot json\n")
    rules = sigma.read_rules(spark, str(tmp_path / "rules.json"))
    assert [(r.id, r.level) for r in rules] == [("bad-login", "high")]
    told = sigma.alert_rule(rules[0])
    assert told["service"] is None and (told["threshold"], told["time_window"]) == (3, 300) and told["keywords"] == ["a", "b", "d"]
    assert sigma.packs(sigma.BUILT_IN) == {n: 5 for n in ("startup-reliability", "auth-security", "database-health", "payment-billing")}
    many = [sigma.Rule(f"r{i}", "t", "low", {"a": {"message|contains": f"word{i}."}, "condition": "a"}) for i in range(120)]
    logs = spark.createDataFrame([(1, "has word7. and word119.", "s", None)], "id long, message string, service string, trace_id string").selectExpr("*", "timestamp_ntz'2024-01-01' as time", "1 as project_id", "'info' as level")
    assert {r["rule_id"] for r in sigma.detect(logs, many).collect()} == {"r7", "r119"}


def test_otlp_values(spark):
    value = lambda **kw: dict(kw)
    attrs = [{"key": "a", "value": value(intValue="7")}, {"key": "b", "value": value(arrayValue={"values": [value(stringValue='q"\u0000'), value(boolValue=True), value(kvlistValue={"values": [{"key": "c", "value": value(doubleValue=1.5)}]})]})}, {"key": "a", "value": value(stringValue="last")}, {"key": "n"}]
    bodies = [value(stringValue="x\u0000y"), value(intValue="5"), value(boolValue=False), value(arrayValue={"values": [value(stringValue="s"), value(intValue=3)]}), value(kvlistValue={"values": [{"key": "k", "value": value(bytesValue="AA==")}]}), value(bytesValue="AAE="), None]
    record = lambda b: {"time_unix_nano": "1700000000123456789", "severity_text": "WARN", "body": b, "attributes": attrs, "traceId": "t"}
    told = {"resource_logs": [{"resource": {"attributes": [{"key": "service.name", "value": {"string_value": "api"}}]}, "scope_logs": [{"scope": {"name": "lib"}, "log_records": [record(b) for b in bodies]}]}]}
    rows = ingest.otlp_logs(spark.createDataFrame([(json.dumps(told),)], "body string")).collect()
    assert [r["message"] for r in rows] == ["xy", "5", "false", '["s","3"]', '{"k":"AA=="}', "[bytes: AAE=]", ""]
    assert json.loads(rows[0]["metadata"]) == {"service.name": "api", "otel.scope.name": "lib", "b": ['q"', True, {"c": 1.5}], "a": "last", "n": None, "otel.severity_text": "WARN"}
    assert rows[0]["service"] == "api" and rows[0]["time_ms"] == 1700000000123 and rows[0]["level"] == "warn"
    span = {"traceId": "a1", "spanId": "b1", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "events": [{"timeUnixNano": "2000000", "attributes": attrs[:1]}], "links": [{"traceId": "x", "spanId": "y"}, {"traceId": "x"}], "status": {"message": "bad"}}
    got = ingest.otlp_spans(spark.createDataFrame([(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}),)], "body string")).collect()[0]
    assert got["operation"] == "unknown" and got["status_message"] == "bad" and got["attributes"] == "{}"
    assert json.loads(got["events"]) == [{"time_ms": 2, "name": "event", "attributes": {"a": 7}}] and json.loads(got["links"]) == [{"trace_id": "x", "span_id": "y", "attributes": {}}]


def test_syslog_forms(spark):
    lines = ["<165>1 2024-01-15T10:00:00.5+02:00 host app 123 ID47 [x@1 a=\"b\"] hello there", "<11>1 2024-01-15T10:00:00Z - - - - - hi", "odd"]
    rows = ingest.syslog_5424(spark.createDataFrame(list(enumerate(lines)), "id int, line string")).orderBy("id").collect()
    assert [(r["service"], r["level"], r["message"], str(r["time"])) for r in rows] == [("app", "info", "hello there", "2024-01-15 08:00:00.500000"), ("syslog", "error", "hi", "2024-01-15 10:00:00"), ("syslog", "info", "odd", "None")]
    assert str(one(spark, ingest.syslog_time(F.col("v"), 2024, 3600), v="<11>Jan  5 10:00:00 h x: y")) == "2024-01-05 09:00:00"
    body = json.loads(ingest.wrapped(spark.createDataFrame([("s", "m")], "service string, message string")).collect()[0]["body"])
    assert body == {"logs": [{"service": "s", "message": "m"}]}
    assert [one(spark, ingest.body_kind(F.col("v")), v=v) for v in ("application/x-protobuf", "application/json; x", "text/plain")] == ["protobuf", "json", "json"]


def test_stream_state(spark, tmp_path):
    """Sessions close with the watermark."""
    rows = [("t1", "2024-01-01 00:00:00", "OK"), ("t1", "2024-01-01 00:10:00", "ERROR"), ("t2", "2024-01-01 00:20:00", "OK"), ("t3", "2024-01-03 00:00:00", "OK")]
    spans = spark.createDataFrame(rows, "trace_id string, start_time string, status_code string").withColumn("start_time", F.col("start_time").cast("timestamp")).withColumn("end_time", F.col("start_time"))
    spans.write.parquet(str(tmp_path / "spans"))
    found = streams.drain(streams.traces(spark.readStream.schema(spans.schema).parquet(str(tmp_path / "spans"))), "spans_seen", str(tmp_path / "c0")).collect()
    assert sorted((r["trace_id"], r["span_count"], r["error"]) for r in found) == [("t1", 2, True), ("t2", 1, False)]  # t3 may still go on


def test_scalars(spark):
    for raw, level in (("60", "critical"), ("30", "info"), ("10", "debug"), ("", "debug"), ("WARNING", "warn"), ("odd", "info")):
        assert one(spark, X.level_of(F.col("v")), v=raw) == level
    assert one(spark, X.id_to_hex(F.col("v")), v="q80=") == "abcd"
    assert one(spark, X.id_to_hex(F.col("v")), v="ABCD") == "abcd"
    assert one(spark, X.duration_text(F.col("v")), v=1500) == "1.50s"
    assert one(spark, X.public_ips(F.col("v")), v="10.0.0.1 8.8.8.8 300.1.1.1 8.8.8.8") == ["8.8.8.8"]
    assert one(spark, X.message_shape(F.col("v")), v="id 42 'x' [1] {2}") == "id N 'STRING' [ARRAY] {OBJECT}"


def test_adapters(spark):
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000123456789", "severityNumber": 17, "body": {"stringValue": "hi"}, "traceId": "00", "spanId": "ab"}]}]}]}
    row = ingest.otlp_logs(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()[0]
    assert (row["service"], row["time_ms"], row["level"], row["message"], row["trace_id"]) == ("api", 1700000000123, "error", "hi", None)
    spans = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "a1", "spanId": "b1", "name": "op", "kind": 2, "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "status": {"code": 2}}, {"traceId": "", "spanId": "b2"}]}]}]}
    rows = ingest.otlp_spans(spark.createDataFrame([(json.dumps(spans),)], "body string")).collect()
    assert len(rows) == 1 and (rows[0]["kind"], rows[0]["status"], rows[0]["service"]) == ("SERVER", "ERROR", "unknown")
    good, bad = ingest.validated(spark.createDataFrame([("2024-01-01T00:00:00Z", "s", "info", "m", None, None, None), ("x", "s", "info", "m", None, None, None)], ingest.LOG_SCHEMA))
    assert (good.count(), bad.count()) == (1, 1)
    j = spark.createDataFrame([(None, "nginx.service", None, None, "3", "boom", "1700000000123456")], "SYSLOG_IDENTIFIER string, _SYSTEMD_UNIT string, _COMM string, _EXE string, PRIORITY string, MESSAGE string, __REALTIME_TIMESTAMP string")
    assert tuple(ingest.journald(j).collect()[0]) == ("nginx", "error", "boom", 1700000000123)


def test_search_helpers():
    assert search.read_cursor(search.make_cursor("2024-01-01 00:00:00", 5)) == ("2024-01-01 00:00:00", 5)
    assert search.read_cursor("%%%") is None
    assert identifiers.safe_pattern(r"id=(\d{1,20})") and not identifiers.safe_pattern(r"(a+)+") and not identifiers.safe_pattern(r"(?=x)") and not identifiers.safe_pattern("(") and not identifiers.safe_pattern("((a+)b)+") and identifiers.safe_pattern(r"(T-\d{1,9})") and not identifiers.safe_pattern(r"a{1,}b") and not identifiers.safe_pattern(r"x{101}")


def test_preview_runs(spark):
    rows = [(f"2024-01-01 0{h}:00:00", n) for h, n in ((0, 10), (1, 21), (2, 32), (4, 1), (5, 9))]
    b = spark.createDataFrame(rows, "bucket string, n bigint").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    got = alerts.preview_incidents(b, 5, "1h").orderBy("start_time").collect()
    assert [(r["buckets"], r["peak"], r["average"]) for r in got] == [(3, 32, 21), (1, 9, 9)]


def test_streams_equal_batch(spark, sf, tmp_path):
    from logloom.operators import analytics
    from logloom.plans.views import view

    logs = view(spark, sf, "logs")
    logs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    found = streams.drain(streams.hourly_counts(stream), "hourly", str(tmp_path / "c1"), "complete")
    assert sorted(r["log_count"] for r in found.collect()) == sorted(r["log_count"] for r in analytics.rollup(logs, "1h").collect())
    tail = streams.drain(streams.live_tail(stream, levels=["critical"]), "tail", str(tmp_path / "c2"))
    assert tail.count() == logs.where("level = 'critical'").count()
    hits = streams.drain(streams.detections(stream), "hits", str(tmp_path / "c3"))
    assert hits.count() == sigma.detect(logs).count()


def test_depths_of_long_chains_and_cycles(spark):
    from logloom.operators import traces

    rows = [("a", f"s{i}", f"s{i - 1}" if i else None) for i in range(300)]
    rows += [("b", "x", "y"), ("b", "y", "x"), ("b", "z", "y"), ("b", "self", "self"), ("b", "root", None), ("b", "child", "root"), ("b", "orphan", "gone"), ("c", "s1", "s0"), ("d", None, None)]
    got = traces.depths(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")).collect()
    want = {("a", f"s{i}"): i for i in range(300)} | {("b", x): None for x in ("x", "y", "z", "self")}
    want |= {("b", "root"): 0, ("b", "child"): 1, ("b", "orphan"): 0, ("c", "s1"): 0, ("d", None): 0}
    assert len(got) == len(rows) and {(r["trace_id"], r["span_id"]): r["depth"] for r in got} == want
    assert traces.depths(spark.createDataFrame(rows[:0], "trace_id string, span_id string, parent_span_id string")).count() == 0


def test_preorder(spark):
    from logloom.operators import traces

    told = "trace_id string, span_id string, parent_span_id string, start_time int"
    rng = random.Random(4)
    rows, kids = [], {}
    for t in "abcdef":
        for n in range(rng.choice([1, 5, 60])):
            up = rng.choice([None, "gone", *[f"s{m}" for m in range(n)]])
            rows.append((t, f"s{n}", up, rng.randrange(4)))
    rows += [("chain", f"c{n}", f"c{n - 1}" if n else None, -n) for n in range(400)] + [("wide", f"w{n:04d}", "root", n % 7) for n in range(2000)] + [("wide", "root", None, 0)]
    rows += [("loop", "x", "y", 0), ("loop", "y", "x", 0), ("loop", "below", "x", 0), ("loop", "self", "self", 0), ("loop", "ok", None, 0), ("only", "q", "q", 1), ("none", None, None, 1)]
    known = {(t, s) for t, s, _, _ in rows}
    for t, s, up, at in rows:
        kids.setdefault((t, up if up is not None and (t, up) in known else None), []).append((at, s))
    want = {(t, s): (None, None) for t, s, _, _ in rows if s}
    for t in {r[0] for r in rows}:
        todo, place = [(0, s) for _, s in sorted(k for k in kids.get((t, None), []) if k[1])][::-1], 0
        while todo:
            depth, s = todo.pop()
            place += 1
            want[t, s] = (depth, place)
            todo += [(depth + 1, c) for _, c in sorted(kids.get((t, s), []))][::-1]
    rows += rows[:3]
    got = traces.preorder(spark.createDataFrame(rows, told)).collect()
    assert len(got) == len(want) and {(r["trace_id"], r["span_id"]): (r["depth"], r["position"]) for r in got} == want
    assert traces.preorder(spark.createDataFrame([], told)).count() == 0


def wire(number: int, payload: bytes) -> bytes:
    return bytes([number << 3 | 2, len(payload) & 127 | 128, len(payload) >> 7]) + payload


def test_protobuf_bodies(spark):
    from logloom.sources import otlp_protobuf

    text = lambda s: wire(1, s.encode())
    pair = lambda key, value: wire(1, key.encode()) + wire(2, value)
    nested = wire(5, wire(1, text("a")) + wire(1, bytes([3 << 3]) + b"\xff" * 9 + b"\x01"))
    record = b"\x09" + (17 * 10**6).to_bytes(8, "little") + b"\x10\x11" + wire(5, text("grün\0")) + wire(9, bytes(range(16))) + wire(6, pair("list", nested)) + wire(6, pair("pi", b"\x21" + struct.pack("<d", 3.5))) + b"\x45abcd"
    body = wire(1, wire(1, wire(1, pair("service.name", text("api")))) + wire(2, wire(2, record)))
    as_text = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": "j"}}]}]}]}).encode()
    kind = "application/x-protobuf"
    sent = [(kind, body), (kind, gzip.compress(body)), (kind, as_text), ("application/json", gzip.compress(as_text)), (None, as_text), ("text/odd", as_text), (kind, body[:-2]), (kind, b"\x1f\x8bno"), ("application/json", b"\xff"), (kind, None), (kind, b""), (kind, b"\x0b")]
    read = otlp_protobuf.decoded(spark.createDataFrame(sent, "content_type string, body binary").coalesce(1), "logs")
    assert [r["body"] is None for r in read.collect()] == [False] * 6 + [True] * 4 + [False, True]
    rows = ingest.otlp_logs(read).collect()
    assert [r["message"] for r in rows] == ["grün"] * 2 + ["j"] * 4
    r = rows[1]
    assert (r["service"], r["time_ms"], r["level"], r["trace_id"]) == ("api", 17, "error", bytes(range(16)).hex())
    assert json.loads(r["metadata"])["list"] == ["a", -1] and json.loads(r["metadata"])["pi"] == 3.5
    link = wire(1, b"\x01" * 16) + wire(2, b"\x02" * 8)
    span = wire(1, b"\x0a" * 16) + wire(2, b"\x0b" * 8) + wire(5, b"op") + b"\x30\x02" + wire(13, link) + wire(15, b"\x18\x02") + wire(11, wire(2, b"went"))
    requests = spark.createDataFrame([(kind, wire(1, wire(2, wire(2, span))))], "content_type string, body binary")
    s = ingest.otlp_spans(otlp_protobuf.decoded(requests, "spans")).collect()[0]
    assert (s["trace_id"], s["span_id"], s["operation"], s["kind"], s["status"]) == ("0a" * 16, "0b" * 8, "op", "SERVER", "ERROR")
    assert json.loads(s["links"])[0]["span_id"] == "02" * 8 and json.loads(s["events"])[0]["name"] == "went"


def test_incident_changes(spark):
    from logloom.operators import incidents

    rows = spark.createDataFrame([(1, "t", "open", "ann", 7), (2, "t", "open", "ann", 7), (3, None, None, None, 7), (4, "t", "open", None, 7)], "id int, title string, status string, assignee string, value int")
    told = [(1, 1, "status", "resolved"), (1, 2, "status", None), (1, 3, "title", ""), (1, 1, "assignee", None), (2, 5, "deleted", None), (3, 1, "title", "a"), (3, 1, "title", "b"), (3, 2, "odd", "x"), (None, 1, "status", "no"), (9, 1, "status", "no")]
    changes = spark.createDataFrame(told, "id int, changed_at int, field string, value string")
    got = sorted(incidents.updated(rows, changes, "id").collect())
    assert [tuple(r) for r in got] == [(1, "t", "resolved", None, 7), (3, "b", None, None, 7), (4, "t", "open", None, 7)]
    assert incidents.updated(rows, changes.limit(0), "id").count() == 4
