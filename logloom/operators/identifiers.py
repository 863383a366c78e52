"""Identifier extraction from messages and metadata, and correlation of logs by identifier."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.analytics import ntz
from logloom.session import ship

class Pattern(NamedTuple):
    """priority: the lowest number is tried first. fields: metadata fields whose whole value is of that type. marks: texts, lower-case, of which what fits holds one; none: unknown."""

    type: str
    priority: int
    expression: str
    fields: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()


#: The built-in identifier patterns.
PATTERNS = (
    Pattern("uuid", 100, r"(?i)\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b", ("id", "uuid", "guid"), ("-",)),
    Pattern("request_id", 90, r"""(?i)\b(?:req(?:uest)?[-_]?id|requestId)[:=\s]["']?([a-zA-Z0-9\-_]{8,64})["']?""", ("request_id", "requestId", "req_id", "reqId", "x-request-id"), ("req",)),
    Pattern("request_id", 89, r"(?i)\b(req[-_][a-zA-Z0-9\-_]{6,32})\b", (), ("req-", "req_")),
    Pattern("session_id", 85, r"""(?i)\b(?:sess(?:ion)?[-_]?id|sessionId)[:=\s]["']?([a-zA-Z0-9\-_]{16,128})["']?""", ("session_id", "sessionId", "sid", "session"), ("sess",)),
    Pattern("session_id", 84, r"(?i)\b(sess[-_][a-zA-Z0-9\-_]{8,64})\b", (), ("sess-", "sess_")),
    Pattern("user_id", 80, r"""(?i)\b(?:user[-_]?id|userId|uid)[:=\s]["']?([a-zA-Z0-9\-_]{1,64})["']?""", ("user_id", "userId", "uid", "user"), ("user", "uid")),
    Pattern("user_id", 79, r"(?i)\b(user[-_][a-zA-Z0-9\-_]{1,32})\b", (), ("user-", "user_")),
    Pattern("transaction_id", 75, r"""(?i)\b(?:tx(?:n)?[-_]?id|transactionId)[:=\s]["']?([a-zA-Z0-9\-_]{8,64})["']?""", ("transaction_id", "transactionId", "tx_id", "txId", "txn_id", "txnId"), ("tx", "transactionid")),
    Pattern("transaction_id", 74, r"(?i)\b(txn?[-_][a-zA-Z0-9\-_]{6,32})\b", (), ("tx",)),
    Pattern("order_id", 70, r"""(?i)\b(?:order[-_]?id|orderId)[:=\s]["']?([a-zA-Z0-9\-_]{4,64})["']?""", ("order_id", "orderId", "order"), ("order",)),
    Pattern("order_id", 69, r"(?i)\b(ord(?:er)?[-_][a-zA-Z0-9\-_]{4,32})\b", (), ("ord",)),
    Pattern("correlation_id", 65, r"""(?i)\b(?:corr(?:elation)?[-_]?id|correlationId|x-correlation-id)[:=\s]["']?([a-zA-Z0-9\-_]{8,64})["']?""", ("correlation_id", "correlationId", "corr_id", "x-correlation-id"), ("corr",)),
    Pattern("correlation_id", 64, r"(?i)\b(corr[-_][a-zA-Z0-9\-_]{6,32})\b", (), ("corr-", "corr_")),
    Pattern("trace_id", 60, r"""(?i)\b(?:trace[-_]?id|traceId)[:=\s]["']?([a-f0-9]{32})["']?""", ("trace_id", "traceId", "x-trace-id"), ("trace",)),
    Pattern("span_id", 55, r"""(?i)\b(?:span[-_]?id|spanId)[:=\s]["']?([a-f0-9]{16})["']?""", ("span_id", "spanId", "x-span-id"), ("span",)),
)


#: Their priorities, in order.
PRIORITIES = tuple(p.priority for p in PATTERNS)


def repeats(pattern) -> list[tuple[int, int, bool]]:
    """(least, most, whether inside another unbounded repeat) of every repeat of a compiled pattern's tree."""
    out = []

    def walk(items, inside: bool) -> None:
        for op, arg in items:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, body = arg
                many = int(most) > 1
                out.append((int(least), int(most), inside and many))
                walk(body, inside or many)
            elif name == "BRANCH":
                for body in arg[1]:
                    walk(body, inside)
            elif name == "SUBPATTERN":
                walk(arg[-1], inside)
            elif name == "ATOMIC_GROUP":
                walk(arg, inside)

    walk(pattern, False)
    return out


def safe_pattern(pattern: str) -> bool:
    """Whether a user's pattern may run: short, no look-around, small repeats, no repeat inside a repeat however deep, few repeats, and it compiles."""
    if len(pattern) > 500 or re.search(r"\(\?[=!<]", pattern):
        return False
    try:
        from re import _parser  # the tree, not the text: groups may nest

        found = repeats(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return False
    bounded = re.findall(r"\{(\d+)(?:,(\d*))?\}", pattern)
    if any(int(a) > 100 or pattern.find(f"{{{a},}}") >= 0 or b and int(b) > 100 for a, b in bounded):
        return False
    return len(found) <= 25 and not any(nested for _, _, nested in found)


def by_priority(custom, patterns=PATTERNS) -> list[Pattern]:
    """Custom patterns (priority, type, expression, fields) among the built-in ones; lowest number first, custom first on ties."""
    own = [Pattern(kind, priority, *rest) for priority, kind, *rest in custom]
    return sorted([*own, *patterns], key=lambda p: p.priority)


#: The built-in patterns in the order in which they are tried.
TRIED = tuple(by_priority([]))


def found_in(text: Column, patterns=TRIED) -> Column:
    """array<struct<type,value>> of a text, by pattern, then place. An expression runs only on texts that hold one of its marks."""

    def one(p: Pattern) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(p.expression), F.lit(1)), lambda v: F.struct(F.lit(p.type).alias("type"), v.alias("value")))
        if not p.marks:
            return found
        low = F.lower(text)
        return F.when(reduce(or_, [low.contains(m) for m in p.marks]), found).otherwise(F.array().cast(FOUND))

    return F.coalesce(F.flatten(F.array(*map(one, patterns))), F.array().cast(FOUND))


FOUND = "array<struct<type:string,value:string>>"
LEAVES = "array<struct<path:string,key:string,value:string>>"


def text_fields(metadata: str | None) -> list[dict]:
    """The fields of a JSON object, and of objects in it at any depth, whose values are texts, in order; objects in lists are passed over.

    Nothing for anything but an object, or one that is nested deeper than the parser reads (some thousands).
    """
    try:
        told = json.loads(metadata) if metadata else None
    except (ValueError, RecursionError):
        return []
    out, open_ = [], [("metadata", iter(told.items()))] if isinstance(told, dict) else []
    while open_:
        prefix, fields = open_[-1]
        if (field := next(fields, None)) is None:
            open_.pop()
        elif isinstance(field[1], str):
            out.append({"path": f"{prefix}.{field[0]}", "key": field[0], "value": field[1]})
        elif isinstance(field[1], dict):
            open_.append((f"{prefix}.{field[0]}", iter(field[1].items())))
    return [{k: v.encode("utf-8", "replace").decode() for k, v in x.items()} for x in out]


def leaves(metadata: Column) -> Column:
    """text_fields of a column."""

    @F.pandas_udf(LEAVES)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(text_fields)

    return read(metadata)


def from_metadata(fields: Column, patterns=TRIED) -> Column:
    """array<struct<type,value,field>> of text fields: one whose name is that of a type gives its whole value; the text of any other is searched."""
    kinds = {n.lower(): p.type for p in reversed(list(patterns)) for n in p.fields}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(kinds.items()) for x in pair]) if kinds else F.create_map(F.lit(""), F.lit(None).cast("string"))

    def of(e: Column) -> Column:
        kind = F.try_element_at(lookup, F.lower(e["key"]))
        own = F.array(F.struct(kind.alias("type"), e["value"].alias("value"), e["path"].alias("field")))
        searched = F.transform(found_in(e["value"], patterns), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), e["path"].alias("field")))
        return F.when(kind.isNotNull() & (e["value"] != ""), own).otherwise(searched)

    return F.flatten(F.transform(fields, of))


def extract(logs: DataFrame, patterns=TRIED) -> DataFrame:
    """log_id, time, project_id, type, value, source, field: distinct by type and lower-cased value, the first spelling; one scan, one explode.

    The message comes first, then the text fields of metadata (a JSON text column, if there is one) at any depth; source
    is `message` or `metadata`, field is `message` or the field's path. Only metadata that may hold such fields leaves the JVM.
    """
    every = F.transform(found_in(F.col("message"), patterns), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), F.lit("message").alias("field")))
    if "metadata" in logs.columns:
        ship(logs.sparkSession)
        told = F.col("metadata").cast("string")
        logs = logs.select("id", "time", "project_id", "message", leaves(F.when(told.rlike(':\\s*["{]'), told)).alias("_fields"))
        every = F.concat(every, from_metadata(F.col("_fields"), patterns))
    bound = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  inside a lambda, a bare expression would be computed for each element
    name = lambda x: F.concat(x["type"], F.lit(":"), F.lower(x["value"]))

    def firsts(found: Column) -> Column:
        return bound(F.transform(found, name), lambda names: F.filter(found, lambda x, i: F.array_position(names, name(x)) == i + 1))

    rows = logs.select(F.col("id").alias("log_id"), "time", "project_id", F.explode(bound(every, firsts)).alias("x"))
    return rows.select("log_id", "time", "project_id", "x.type", "x.value", F.split_part("x.field", F.lit("."), F.lit(1)).alias("source"), "x.field")


def by_log(identifiers: DataFrame, ids=None) -> DataFrame:
    """log_id, found: map of type to values of each log; of at most 100 logs if ids are given."""
    if ids is not None:
        identifiers = identifiers.where(F.col("log_id").isin(list(ids)[:100]))
    pairs = identifiers.groupBy("log_id", "type").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return pairs.groupBy("log_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "values")))).alias("found"))


def correlated(logs: DataFrame, identifiers: DataFrame, kind: str, value: str, at: str, minutes: int, limit: int) -> DataFrame:
    """Logs that carry an identifier within +-minutes of a time, newest `limit` identifier rows (1..100)."""
    limit = max(1, min(100, limit))
    near = identifiers.where((F.col("type") == kind) & (F.lower("value") == value.lower()) & F.col("time").between(ntz(at) - F.expr(f"interval {minutes} minutes"), ntz(at) + F.expr(f"interval {minutes} minutes")))
    ids = near.orderBy(F.col("time").desc(), F.col("log_id").desc()).limit(limit).select(F.col("log_id").alias("id"))
    return logs.join(F.broadcast(ids.distinct()), "id", "left_semi")  # at most 100 ids
