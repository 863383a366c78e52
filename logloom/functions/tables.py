"""Table functions for SQL: identifiers and exceptions of a log, by LATERAL join.

    tables.register(spark)
    spark.sql("select l.id, x.* from logs l, lateral identifiers(l.message, l.metadata) x")
    spark.sql("select l.id, x.type, x.message from logs l, lateral exceptions(l.message, l.metadata) x")

identifiers takes the message alone as well. Patterns of one's own are added by register_pattern(), for the session.
DataFrame users have operators.identifiers.extract and operators.errors.exceptions, which stay in the JVM where they can.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from logloom.operators import errors, identifiers
from logloom.session import ship

#: Patterns of one's own by application: (priority, type, expression, fields).
OWN: dict[str, list[tuple]] = {}
FOUND = StructType().add("type", StringType()).add("value", StringType()).add("source", StringType()).add("field", StringType())
STACK = StructType().add("type", StringType()).add("message", StringType()).add("language", StringType()).add("functions", ArrayType(StringType()))


def matches(message: str | None, metadata: str | None, patterns) -> Iterator[tuple[str, str, str, str]]:
    """(type, value, source, field), distinct by type and lower-cased value: the message's first, then those of metadata's text fields."""
    kinds = {n.lower(): p.type for p in reversed(list(patterns)) for n in p.fields}
    seen = set()
    search = lambda text, field: ((p.type, m.group(1), field) for p in patterns for m in re.finditer(p.expression, text, re.A))
    found = list(search(message or "", "message"))
    for f in identifiers.text_fields(metadata):
        kind = kinds.get(f["key"].lower())
        found += [(kind, f["value"], f["path"])] if kind and f["value"] else search(f["value"], f["path"])
    for kind, value, field in found:
        if (name := (kind, value.lower())) not in seen:
            seen.add(name)
            yield kind, value, field.split(".")[0], field


def texts(name: str, *args: AnalyzeArgument) -> None:
    if not 1 <= len(args) <= 2 or any(not isinstance(a.dataType, StringType) for a in args):
        raise ValueError(f"{name}(message string[, metadata string])")


def identifier_function(patterns):
    class Identifiers:
        @staticmethod
        def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
            texts("identifiers", *args)
            return AnalyzeResult(FOUND)

        def eval(self, message, metadata=None):
            yield from matches(message, metadata, patterns)

    return udtf(Identifiers)


class Exceptions:
    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        texts("exceptions", *args)
        return AnalyzeResult(STACK)

    def eval(self, message, metadata=None):
        if found := errors.detect(message, metadata):
            told = [errors.whole_text(x) for x in (found.type, found.message, found.language)]
            yield *told, [errors.whole_text(f["function"]) for f in found.frames[: errors.MAX_FRAMES]]


def register(spark: SparkSession) -> None:
    """identifiers() and exceptions() for the session's SQL."""
    ship(spark)
    own = OWN.get(spark.sparkContext.applicationId, [])
    spark.udtf.register("identifiers", identifier_function(tuple(identifiers.by_priority(own))))
    spark.udtf.register("exceptions", udtf(Exceptions))


def register_pattern(spark: SparkSession, kind: str, expression: str, priority: int = 50, fields: tuple[str, ...] = ()) -> None:
    """Adds a pattern, whose first group is the value; ValueError for one that may run away, doesn't compile or has no group."""
    if not identifiers.safe_pattern(expression) or re.compile(expression).groups < 1:
        raise ValueError(f"no safe pattern with a group: {expression}")
    OWN.setdefault(spark.sparkContext.applicationId, []).append((priority, kind, expression, fields))
    register(spark)
