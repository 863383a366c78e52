"""Exact duplicates [native]: an extendible-hash index of normalised texts, kept on shared files.

Texts are equal when they are identical without blanks, as `BLANKS` lists them; null counts as empty.

1. One scan of the texts writes narrow rows: id, length, 63-bit key, digest. No text is kept.
2. Rows are folded by key (partial counts leave each task, so a key of a third of all rows is one row a task) into
   entries. The directory starts at the depth at which buckets would hold `capacity` entries on average, and
   doubles while a bucket is overfull: only that bucket's entries are split by their next bit.
3. Owner tasks, as many as the session's shuffle partitions, take ranges of buckets, sort their entries by key and write
   the index, a file for each range.
4. Keys with more than one row are a chain until their bytes are compared: their texts are read again and folded by key
   and text. A key with two texts has collided; its rows are told apart by their texts, all others by their key.
5. Every row meets its entry. Entries of more than a HEAVY-th of all rows, which are fewer than HEAVY, are
   broadcast, so that no key gathers its rows in one task; the others are joined by key.

Texts move between machines only in step 4: those of the keys with several rows while these are few enough to be broadcast
(BROADCAST_KEYS, counted first), else every distinct text once.

Cases: an empty table gives no rows. A null doc_id is a document of its own and loses against any other id on equal lengths.
Rows that repeat a document are copies of each other: one stays. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What is deleted before texts are compared, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BITS = 63
CAPACITY = 1 << 16
HEAVY = 1024
BROADCAST_KEYS = 1_000_000
FOUND = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@dataclass
class Index:
    """rows: (row, doc_id, n, key, text_sha256), one a document. entries: (bucket, depth, key, rows, best), sorted files by ranges of buckets."""

    rows: DataFrame
    entries: DataFrame
    directory: DataFrame
    depth: int


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def key_of(text: Column, bits: int = BITS) -> Column:
    """The first `bits` bits (63 at most, so it has no sign) of a text's hash."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def slot(depth: int, bits: int) -> Column:
    return F.shiftright("key", bits - depth)


def texts_of(docs: DataFrame, bits: int) -> DataFrame:
    read = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), normalised(F.col("text")).alias("body"))
    return read.withColumn("key", key_of(F.col("body"), bits))


def numbered(texts: DataFrame, *more: str) -> DataFrame:
    """Rows with their digest, written, so that their number stays the same whoever reads them again."""
    return written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "key", F.sha2("body", 256).alias("text_sha256"), *more))


def folded(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each class, and the one that stays: the longest text, then the smallest doc_id, then the first row."""
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), best.alias("best"))


def directory(entries: DataFrame, bits: int, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, depth): a pointer for each slot of the global depth, and that depth.

    A bucket is the range of keys that begin with its `depth` bits, named by its first key. Slots of deeper buckets are
    counted anew only for the entries of buckets that were overfull, until none is, or no bit is left.
    """
    depth = min(bits, max(0, ceil(log2(max(1, entries.count()) / capacity))))
    left, leaves = entries.select("key"), []
    while True:
        fill = written(left.groupBy(slot(depth, bits).alias("slot")).agg(F.count("*").alias("fill")))
        over = F.col("fill") > capacity if depth < bits else F.lit(False)
        leaves.append((depth, fill.where(~over)))
        full = fill.where(over).select("slot")
        if full.isEmpty():
            break
        left = left.withColumn("slot", slot(depth, bits)).join(full, "slot", "left_semi").select("key")
        depth += 1
    pointers = None
    for own, buckets in leaves:
        span = 1 << depth - own
        some = buckets.select(F.shiftleft("slot", bits - own).alias("bucket"), F.lit(own).alias("depth"), F.explode(F.sequence(F.col("slot") * span, F.col("slot") * span + (span - 1))).alias("slot"))
        pointers = some if pointers is None else pointers.unionByName(some)
    return pointers, depth


def build(texts: DataFrame, bits: int = BITS, capacity: int = CAPACITY) -> Index:
    """The index of texts (doc_id, n, body, key) in the shared folder."""
    rows = numbered(texts)
    entries = written(folded(rows, ["key"]))
    pointers, depth = directory(entries, bits, capacity)
    owned = entries.withColumn("slot", slot(depth, bits)).join(pointers, "slot").drop("slot")
    owners = max(1, min(pointers.count(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return Index(rows, written(owned.repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key")), pointers, depth)


def collided(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys under which more than one text is found, by comparing the bytes of all texts whose key has several rows."""
    several = entries.where("rows > 1").select("key")
    if several.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(several), "key", "left_semi")
    chains = texts.groupBy("key", "body").agg(F.count("*").alias("rows")).groupBy("key").agg(F.count("*").alias("links"))
    return written(chains.where("links > 1").select("key"))


def judged(rows: DataFrame, classes: DataFrame, by: list[str], total: int) -> DataFrame:
    """Rows with what their class says; rows without a class there are alone."""
    told = classes.select(*by, "rows", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"))
    heavy = F.broadcast(told.where(F.col("rows") > total / HEAVY))
    out = rows.join(heavy, by).unionByName(rows.join(heavy, by, "left_anti").join(told.where(F.col("rows") <= total / HEAVY), by, "left"), allowMissingColumns=True)
    alone = F.col("rows").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def exact_duplicates(docs: DataFrame, bits: int = BITS, capacity: int = CAPACITY) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    texts = texts_of(docs, bits)
    index = build(texts, bits, capacity)
    total = index.rows.count()
    clash = collided(texts, index.entries)
    if clash.isEmpty():
        return judged(index.rows, index.entries.where("rows > 1"), ["key"], total)
    apart = index.rows.join(clash, "key", "left_anti")
    plain = judged(apart, index.entries.where("rows > 1").join(clash, "key", "left_anti"), ["key"], total)
    met = numbered(texts.join(clash, "key", "left_semi"), "body")
    return plain.unionByName(judged(met, written(folded(met, ["key", "body"])), ["key", "body"], total))


def oracle() -> str:
    return r"""with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
 w as (select *, row_number() over o as place, first_value(doc_id) over o as keep_id, count(*) over (partition by body) as group_size from t window o as (partition by body order by n desc, doc_id nulls last))
 select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from w"""
