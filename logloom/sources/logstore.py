"""A store of logs by organization and day, with a trigram filter for each file, and retention by dropping partitions.

A search for a text of three characters and more asks the filters first and reads only files that hold all its
trigrams; the text itself is then looked for in their rows, so the result is exact whatever the filters let through.
A filter is a bitmap of the hashes of a file's trigrams (of UTF-8 bytes), case aside: 8 KB a file, one for each file of a
task, so no trigram leaves its task.

Retention deletes the folders of days that have passed as a whole, and rewrites the one day that the limit cuts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import exists, folders, remove, ship, written

ROWS = "id long, time timestamp_ntz, project_id int, service string, level string, message string, metadata string, trace_id string, organization_id long, day date"
FILTERS = "file string, bucket long, bits binary, organization_id long, day date"
KEYS = ["organization_id", "day"]
#: Bits of a filter, and of one of the built-in bitmaps that it consists of. Beyond so many files the whole store is read.
BITS, WIDTH, FILES = 1 << 16, 1 << 15, 10_000


def grams(texts: Iterable[bytes]) -> np.ndarray:
    """Which of the bits texts' trigrams set."""
    data = np.frombuffer(b"\xff".join(texts), dtype=np.uint8).astype(np.uint32)  # a byte that no text has
    three = [data[i : max(0, len(data) - 2) + i] for i in range(3)]
    within = (three[0] != 255) & (three[1] != 255) & (three[2] != 255)
    hashed = (three[0] | three[1] << 8 | three[2] << 16)[within] * np.uint32(2_654_435_761) >> 16
    out = np.zeros(BITS, dtype=bool)
    out[hashed] = True
    return out


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (file, low, organization_id, day) as its files' bitmaps, in buckets."""
    found: dict[tuple, np.ndarray] = {}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for key in rows.group_by(["file", *KEYS]).aggregate([]).to_pylist():  # a task's files have one name in all folders
            here = reduce(pc.and_, [pc.equal(batch.column(c), pa.scalar(v, batch.column(c).type)) for c, v in key.items()])
            bits = grams(batch.filter(here).column("low").drop_null().cast(pa.binary()).to_pylist())
            at = tuple(key.values())
            found[at] = found[at] | bits if at in found else bits
    out = [(file, b, np.packbits(bits[b * WIDTH : (b + 1) * WIDTH], bitorder="little").tobytes(), o, day) for (file, o, day), bits in found.items() for b in range(BITS // WIDTH)]
    target = [("file", pa.string()), ("bucket", pa.int64()), ("bits", pa.binary()), ("organization_id", pa.int64()), ("day", pa.date32())]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), target, strict=True)], schema=pa.schema(target))


def file_name() -> Column:
    return F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)


class LogStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All rows; conditions on organization_id and day prune folders."""
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows") if exists(self.spark, f"{self.path}/rows") else self.spark.createDataFrame([], ROWS)

    def add(self, logs: DataFrame, projects: DataFrame) -> None:
        """Stores logs, and the filters of the new files. Logs of projects (id, organization_id) that aren't there belong to organization -1."""
        of = projects.select(F.col("id").alias("project_id"), F.col("organization_id").cast("long").alias("organization_id"))
        names = [c.split()[0] for c in ROWS.split(", ")][:-2]
        rows = logs.join(of, "project_id", "left").select(*names, F.coalesce("organization_id", F.lit(-1).cast("long")).alias("organization_id"), F.to_date("time").alias("day"))
        self._write(written(rows))

    def _write(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Few files for each organization and day (rebalancing splits large ones), and the filters of the days that have changed."""
        writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else df.write.mode("append")
        writer(rows.hint("rebalance", *KEYS)).partitionBy(*KEYS).parquet(f"{self.path}/rows")
        touched = [(r["organization_id"], r["day"]) for r in rows.select(*KEYS).distinct().collect()]  # folders, not rows
        files = self.rows().where(F.struct(*KEYS).isin([F.struct(F.lit(o).cast("long"), F.lit(d)) for o, d in touched])) if touched else self.rows().limit(0)
        ship(self.spark)
        found = files.select(file_name().alias("file"), F.lower("message").alias("low"), *KEYS).mapInArrow(bitmaps, FILTERS)
        whole = found.groupBy("file", "bucket", *KEYS).agg(F.bitmap_or_agg("bits").alias("bits"))  # a large file is several tasks'
        if touched:
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{self.path}/trigrams")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/trigrams") if exists(self.spark, f"{self.path}/trigrams") else self.spark.createDataFrame([], FILTERS)

    def candidates(self, text: str) -> DataFrame:
        """file, organization_id, day of the files whose filters have every trigram of a text."""
        low = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
        wanted: dict[int, list[int]] = {}
        for bit in np.flatnonzero(grams([low.encode()])).tolist():
            wanted.setdefault(bit // WIDTH, []).append(bit % WIDTH)
        holds = F.lit(False)
        for bucket, places in wanted.items():  # two at most
            every = reduce(and_, [F.conv(F.hex(F.substring("bits", F.lit(a // 8 + 1), F.lit(1))), 16, 10).cast("int").bitwiseAND(1 << a % 8) > 0 for a in places])
            holds = holds | (F.col("bucket") == bucket) & every
        return self.filters().where(holds).groupBy("file", *KEYS).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")

    def containing(self, text: str) -> DataFrame:
        """Rows whose message holds a text, case aside."""
        rows = self.rows()
        if len(text) > 2 and not exists(self.spark, f"{self.path}/filters"):  # that is a store from before, whose filters were others
            files = self.candidates(text).limit(FILES + 1).collect()
            if not files:
                return rows.limit(0)
            if len(files) <= FILES:
                paths = [f"{self.path}/rows/organization_id={r['organization_id']}/day={r['day']}/{r['file']}" for r in files]
                rows = self.spark.read.schema(ROWS).option("basePath", f"{self.path}/rows").parquet(*paths)
        return rows.where(F.lower("message").contains(text.lower()))

    def retain(self, days: dict[int, int], now: datetime) -> dict[int, int]:
        """Deletes what is older than its organization's number of days; how many rows went, by organization. Others keep everything."""
        gone = {}
        for organization, keep in sorted(days.items()):
            cut, top = now - timedelta(days=keep), f"{self.path}/rows/organization_id={organization}"
            old = [d for d in folders(self.spark, top) if d < f"day={cut:%Y-%m-%d}"]
            edge = f"day={cut:%Y-%m-%d}" in folders(self.spark, top)
            mine = self.rows().where(F.col("organization_id") == organization)
            expired = mine.where((F.col("day") <= F.lit(cut.date())) & (F.col("time") < F.lit(cut).cast("timestamp_ntz")))
            gone[organization] = expired.count() if old or edge else 0
            for d in old:
                remove(self.spark, f"{top}/{d}")
                remove(self.spark, f"{self.path}/trigrams/organization_id={organization}/{d}")
            if edge:
                kept = written(mine.where((F.col("day") == F.lit(cut.date())) & (F.col("time") >= F.lit(cut).cast("timestamp_ntz"))))
                if kept.isEmpty():
                    remove(self.spark, f"{top}/day={cut:%Y-%m-%d}")
                    remove(self.spark, f"{self.path}/trigrams/organization_id={organization}/day={cut:%Y-%m-%d}")
                else:
                    self._write(kept, overwrite=True)
        return gone
