"""Log search, paging, context and point lookups."""

from __future__ import annotations

import base64

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from logloom.functions import english
from logloom.session import ship

def search(logs: DataFrame, projects=None, services=None, levels=None, trace_id=None, since=None, until=None, text=None, mode="substring", cursor=None) -> DataFrame:
    """All criteria hold; both time bounds are inclusive. Filters are on raw columns, so they reach the scan."""
    for column, wanted in (("project_id", projects), ("service", services), ("level", levels)):
        if wanted is not None:
            logs = logs.where(F.col(column).isin(list(wanted)))
    if trace_id is not None:
        logs = logs.where(F.col("trace_id") == trace_id)
    if since is not None:
        logs = logs.where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        logs = logs.where(F.col("time") <= F.lit(until).cast("timestamp_ntz"))
    if text:
        ship(logs.sparkSession)
        logs = logs.where(F.lower("message").contains(text.lower()) if mode == "substring" else has_words(F.col("message"), text))
    if cursor is not None and (at := read_cursor(cursor)):
        t = F.lit(at[0]).cast("timestamp_ntz")
        logs = logs.where((F.col("time") < t) | ((F.col("time") == t) & (F.col("id") < at[1])))
    return logs


def has_words(message: Column, query: str) -> Column:
    """Every word of the query, stop words aside, is in the message as far as their English stems go; a query without such words fits nothing.

    Only messages with the beginnings of all these words are stemmed; the rest never leave the JVM.
    """
    wanted = english.lexemes(query)

    @F.pandas_udf(BooleanType())
    def stemmed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: wanted <= english.lexemes(text)).astype(bool)

    begins = [F.lower(message).contains(english.common_start(w)) for w in sorted(wanted)]
    return reduce(and_, begins, F.lit(bool(wanted))) & stemmed(message)


def make_cursor(time: str, row_id: int) -> str:
    return base64.b64encode(f"{time},{row_id}".encode()).decode()


def read_cursor(cursor: str):
    """(time, id), or None for a malformed one, which is ignored."""
    try:
        time, _, row_id = base64.b64decode(cursor, validate=True).decode().rpartition(",")
        return (time, int(row_id)) if time else None
    except ValueError:
        return None


def page(logs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; the limit is clamped to 1..1000."""
    ordered = logs.orderBy(F.col("time").desc(), F.col("id").desc())
    return (ordered.offset(offset) if offset else ordered).limit(max(1, min(1000, limit)))


def context(logs: DataFrame, time: str, k: int) -> DataFrame:
    """k rows before a time, all at it... and k after, with their place: before, at, after."""
    t = F.lit(time).cast("timestamp_ntz")
    before = logs.where(F.col("time") < t).orderBy(F.col("time").desc(), F.col("id").desc()).limit(k)
    after = logs.where(F.col("time") > t).orderBy("time", "id").limit(k)
    at = logs.where(F.col("time") == t)
    mark = lambda df, place: df.withColumn("place", F.lit(place))
    return mark(before, "before").unionByName(mark(at, "at")).unionByName(mark(after, "after"))


def page_and_next(logs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page with has_next: one row more than the page is looked for, and left out."""
    limit = max(1, min(1000, limit))
    ordered = logs.orderBy(F.col("time").desc(), F.col("id").desc())
    rows = (ordered.offset(offset) if offset else ordered).limit(limit + 1)
    ranked = rows.withColumn("_n", F.row_number().over(Window.orderBy(F.col("time").desc(), F.col("id").desc())))
    return ranked.withColumn("has_next", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


#: Names of a log in the API; span_id and created_at stay inside.
API = {"id": "id", "time": "time", "project_id": "projectId", "service": "service", "level": "level", "message": "message", "metadata": "metadata", "trace_id": "traceId"}


def api_rows(logs: DataFrame) -> DataFrame:
    return logs.select(*[F.col(c).alias(name) for c, name in API.items()])
