"""Registered queries of exceptions: a trace of each language made from every error log, and groups over them, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import errors
from logloom.plans.catalogue import logs, register

#: By language: trace, type, message, frames (index, file, function, line, column, app), and path:function of the application's frames.
CASES = {
    "nodejs": (
        "oops\nTypeError: bad {id}\n    at handle (/app/src/{service}.js:10:5)\n    at async  g (/home/u/b.js:3:4)\n    at /app/node_modules/x/i.js:1:2\n    at <anonymous>", "TypeError", "bad {id}",
        "0|/app/src/{service}.js|handle|10|5|true;1|/home/u/b.js|async g|3|4|true;2|/app/node_modules/x/i.js||1|2|false;3|<anonymous>|<anonymous>|||true", "src/{service}.js:handle|b.js:async g|<anonymous>:<anonymous>",
    ),
    "python": (
        'Traceback (most recent call last):\n  File "/var/www/{service}/a.py", line 3, in run\n    go({id})\n  File "/x/site-packages/y.py", line 9, in go\nValueError: bad {id}\n\nDuring handling of the above exception, another exception occurred:\n  File "/z.py", line 1, in z\nKeyError: no', "ValueError", "bad {id}",
        "1|/x/site-packages/y.py|go|9||false;0|/var/www/{service}/a.py|run|3||true", "{service}/a.py:run",
    ),
    "java": (
        "com.acme.web.BadException: bad {id}\n\tat com.acme.web.Api.call(Api.java:5)\n\tat java.util.List.get(Unknown Source)\n\tat org.apache.x.Y.z(Native Method)\n\t... 3 more\nCaused by: java.io.IOException: y\n\tat com.acme.B.go(B.java:7)", "BadException", "bad {id}",
        "0|com/acme/web/Api.java|Api.call|5||true;1|java.util.List (Unknown Source)|List.get|||false;2|org.apache.x.Y (Native Method)|Y.z|||false", "com/acme/web/Api.java:Api.call",
    ),
    "go": (
        "panic: bad {id}\n\ngoroutine 1 [running]:\nmain.run(0x1)\n\t/Users/me/{service}/main.go:12 +0x1d\ngithub.com/a/b.Serve(...)\n\t/root/go/pkg/mod/b/s.go:7 +0x2\n\nmain.late()\n\t/late.go:1 +0x1", "panic", "bad {id}",
        "0|/Users/me/{service}/main.go|main.run|12||true;1|/root/go/pkg/mod/b/s.go|b.Serve|7||false", "{service}/main.go:main.run",
    ),
    "php": (
        "Fatal error: Uncaught App\\RuntimeException: bad {id} in /var/www/a.php:3\nStack trace:\n#0 /var/www/{service}.php(9): App\\Job->run(1)\n#1 /srv/vendor/x.php(2): Tool::go()\n#2 /srv/p.php(4): plain()\n#3 {main}\n#4 /no.php(1): no()", "RuntimeException", "bad {id}",
        "0|/var/www/{service}.php|App\\Job::run|9||true;1|/srv/vendor/x.php|Tool::go|2||false;2|/srv/p.php|plain|4||true", "{service}.php:App\\Job::run|/srv/p.php:plain",
    ),
}


def filled(template: str):
    return F.replace(F.replace(F.lit(template), F.lit("{id}"), F.col("id").cast("string")), F.lit("{service}"), F.col("service"))


def filled_sql(template: str) -> str:
    return f"replace(replace('{template.replace(chr(39), chr(39) * 2)}', '{{id}}', cast(id as varchar)), '{{service}}', service)"


def told_frames():
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array_join(F.transform("frames", lambda f: F.concat_ws("|", f["index"].cast("string"), f["file"], text(f["function"]), text(f["line"]), text(f["column"]), text(f["app"]))), ";")


def told(found):
    return found.select("log_id", "type", "message", "language", told_frames().alias("frames"), "fingerprint")


def expected(language: str) -> str:
    _, kind, message, frames, paths = CASES[language]
    return f"select id as log_id, '{kind}' as type, {filled_sql(message)} as message, '{language}' as language, {filled_sql(frames)} as frames, sha256({filled_sql(kind + ':' + paths)}) as fingerprint"


BAD = "from logs where level in ('error', 'critical')"
for language, case in CASES.items():
    register(f"exceptions_{language}", logs(lambda x, t=case[0]: told(errors.exceptions(x.withColumn("message", filled(t)).drop("metadata")))), f"{expected(language)} {BAD}", "logs")


def structured(x):
    """metadata.exception of half of the logs; the others have a trace in their message, with metadata that holds no valid exception."""
    frames = F.array(F.struct(F.concat(F.lit("/app/"), "service", F.lit(".rb")).alias("file"), F.lit("call").alias("function"), F.lit(4).alias("line"), F.lit(2).alias("column")), F.struct(F.lit("/Library/x.rb").alias("file"), F.lit(None).cast("string").alias("function"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column")))
    whole = F.to_json(F.struct(F.struct(F.lit("Boom").alias("type"), F.concat(F.lit("at "), F.col("id").cast("string")).alias("message"), F.lit("ruby").alias("language"), frames.alias("stacktrace")).alias("exception")))
    return x.withColumn("metadata", F.when(F.col("id") % 2 == 0, whole).otherwise('{"exception": {"type": "", "message": "x"}}')).withColumn("message", filled(CASES["go"][0]))


register(
    "exceptions_structured", logs(lambda x: told(errors.exceptions(structured(x)))),
    f"select id as log_id, 'Boom' as type, concat('at ', cast(id as varchar)) as message, 'ruby' as language, concat('0|/app/', service, '.rb|call|4|2|true;1|/Library/x.rb||||false') as frames, sha256(concat('Boom:', service, '.rb:call')) as fingerprint {BAD} and id % 2 = 0 union all {expected('go')} {BAD} and id % 2 = 1", "logs",
)

NAMES = list(CASES)
SET = "case substr(fingerprint, 1, 1) when '0' then 'ignored' when '1' then 'resolved' when '2' then 'resolved' else 'open' end"


def mixed(x):
    message = filled(CASES[NAMES[-1]][0])
    for i, name in enumerate(NAMES[:-1]):
        message = F.when(F.col("id") % len(NAMES) == i, filled(CASES[name][0])).otherwise(message)
    return x.withColumn("message", message).drop("metadata")


def groups(x):
    found = errors.exceptions(mixed(x))
    open_or_not = errors.exception_groups(found, x)
    return open_or_not.withColumn("status", F.expr(SET))


EXCEPTIONS = " union all ".join(f"{expected(n)}, project_id, time, service {BAD} and id % {len(NAMES)} = {i}" for i, n in enumerate(NAMES))
GROUPED = f"select *, {SET} as status from (select project_id, fingerprint, arg_min(type, (time, log_id)) as type, arg_min(message, (time, log_id)) as message, arg_min(language, (time, log_id)) as language, count(*) as n, min(time) as first_seen, max(time) as last_seen, string_agg(distinct service, ',' order by service) as services, arg_min(log_id, (time, log_id)) as sample_log_id from ({EXCEPTIONS}) e group by 1, 2) g"
GROUP = ["project_id", "fingerprint", "type", "message", "language", "n", "first_seen", "last_seen", "services", "sample_log_id", "status"]
COLUMNS = ", ".join(GROUP)
register("exception_groups", logs(lambda x: groups(x).select(*GROUP)), f"select {COLUMNS} from ({GROUPED}) y", "logs")
register("exception_groups_list", logs(lambda x: errors.list_groups(groups(x), "open", "php", "RUNTIME").select(*GROUP, "total")), f"select {COLUMNS}, count(*) over () as total from ({GROUPED}) y where status = 'open' and language = 'php' and (type ilike '%runtime%' or message ilike '%runtime%') order by last_seen desc, project_id, fingerprint limit 20", "logs")
register("exception_groups_open_top", logs(lambda x: groups(x).where("status = 'open'").orderBy(F.col("n").desc(), "project_id", "fingerprint").limit(5).select(*GROUP)), f"select {COLUMNS} from ({GROUPED}) y where status = 'open' order by n desc, project_id, fingerprint limit 5", "logs")
PRINT = "sha256('panic:api-gateway/main.go:main.run')"
register("exception_group_by_print", logs(lambda x: groups(x).where(F.expr("fingerprint = sha2('panic:api-gateway/main.go:main.run', 256) and project_id = 5")).select(*GROUP)), f"select {COLUMNS} from ({GROUPED}) y where fingerprint = {PRINT} and project_id = 5", "logs")
for width, words in (("1h", "1 hour"), ("1d", "1 day")):
    joined = lambda x, w=width: errors.trend(errors.exceptions(mixed(x)).select("log_id", "fingerprint").join(x.select(F.col("id").alias("log_id"), "time"), "log_id"), F.expr("sha2('panic:api-gateway/main.go:main.run', 256)"), w)
    register(f"exception_trend_{width}", logs(joined), f"select time_bucket(interval '{words}', time) as bucket, count(*) as n from ({EXCEPTIONS}) e where fingerprint = {PRINT} group by 1", "logs")
