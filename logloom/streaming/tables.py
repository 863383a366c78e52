"""Tables that streams keep up to date: batches that may be run again, and the latest row of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import exists, folders, remove

def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """each(batch, number) on all that is new since the checkpoint, in micro-batches.

    A batch that failed is run again with the same number, so `each` overwrites what it has written under that number.
    State is kept where the session's spark.sql.streaming.stateStore.providerClass says: for many keys, in RocksDB.
    """
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is new since the checkpoint, to a Parquet table whose log sees to it that no row comes twice; other streams may read it."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


class Batches:
    """Rows in a folder for each batch; writing a batch again replaces it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.schema, self.by = spark, path, schema, by

    def put(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.path}/batch={number}")

    def numbers(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in folders(self.spark, self.path) if n.startswith("batch=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def rows(self, after: int = -1, before: int | None = None) -> DataFrame:
        """Rows with their batch, of batches after one and before another."""
        paths = [f"{self.path}/batch={n}" for n in self.numbers() if n > after and (before is None or n < before)]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        return self.spark.read.schema(f"{self.schema}, batch int").option("basePath", self.path).parquet(*paths)


class Latest:
    """The latest row of each key: each batch adds the rows it has changed, and a reader takes the newest of a key.

    A batch costs what it changes, whatever the table's size. compact() folds all batches into one snapshot; readers take the
    newest snapshot that is complete, and the batches after it, so they never meet half a change.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.changes = Batches(spark, f"{path}/changes", schema)

    def put(self, changed: DataFrame, number: int) -> None:
        """changed: one row a key at most."""
        self.changes.put(changed, number)

    def snapshot(self) -> int:
        """The number of the newest complete snapshot, -1 without any."""
        done = [int(n.removeprefix("upto=")) for n in folders(self.spark, f"{self.path}/snapshots") if exists(self.spark, f"{self.path}/snapshots/{n}/_SUCCESS")]
        return max(done, default=-1)

    def rows(self) -> DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        upto = self.snapshot()
        some = self.changes.rows(upto).select("batch", *names)
        if upto >= 0:
            some = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/upto={upto}").select(F.lit(upto).alias("batch"), *names).unionByName(some)
        newest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.col("batch").desc()))
        return some.withColumn("_n", newest).where("_n = 1").select(*names)

    def compact(self) -> None:
        """Folds what is there; the folders that the new snapshot replaces go once it is complete."""
        numbers, old = self.changes.numbers(), self.snapshot()
        if not numbers or numbers[-1] <= old:
            return
        self.rows().write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={numbers[-1]}")
        for n in numbers:
            remove(self.spark, f"{self.path}/changes/batch={n}")
        if old >= 0:
            remove(self.spark, f"{self.path}/snapshots/upto={old}")
