"""Ranked lexical search by bag deduplication: documents with the same terms of interest and length class are scored once.

1. Items (queries) are dealt into blocks of at most `PAIRS` item-term pairs; an item of more is a block of its own. A block's
   vocabulary is all that executors are sent, so its size is bounded by the block, not by the documents.
2. One scan of the documents for each block counts every document's terms and keeps its bag: the frequencies of vocabulary terms.
3. Bags with equal frequencies and equal m are one class: rows are grouped by a hash and by the bag and m themselves, which
   verifies it. Equal rows are folded before they are shuffled, so a bag that a third of all documents share is a row a task.
4. Document frequencies are the classes' sizes, added by term. Each class is scored once against the items of its terms;
   a task keeps an item's `k` best classes by score and smallest member, which hold its `k` best documents.
5. The best classes are expanded by ascending doc_id: the first `k` members of each are enough.

Scores are 64-bit integers; only a term's weight is taken from a logarithm.

Cases: null and empty texts, and texts without terms, take no part. Rows are documents: one that is repeated counts, and is ranked, as often
as it is there. A null doc_id counts in all totals, but is never returned. Rows of one item_id are one item; null items are left
out, items without a known term return nothing. Empty tables give no rows. Other columns, whatever their names, take no part.
Texts of any length are read in pieces of a few MB.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, ship, utf8, values, written

K = 50
#: Item-term pairs of a block; cells of a score matrix, and candidates that a task holds before it drops those beyond the k-th.
PAIRS, CELLS, HELD = 200_000, 1 << 21, 400_000
PIECE = 1 << 22
FOUND = ["item_id", "rank", "doc_id", "score"]

#: Bytes of terms: digits, letters (A-Z lower-cased) and all that UTF-8 has beyond ASCII; the rest parts them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists; pieces end between terms."""
    at, plain = 0, text.translate(TERM_BYTES)
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PIECE else plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def bag_of(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, bytes]:
    """The number of terms of a text, and (term, frequency) of those in the vocabulary as pairs of 32-bit integers, by term."""
    n, counts = 0, Counter()
    for terms in term_lists(text):
        n += len(terms)
        counts.update(map(vocabulary.get, terms))
    counts.pop(None, None)
    return n, np.array(sorted(counts.items()), dtype=np.int32).tobytes()


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, bag: one row for each row of docs with a term."""

    def read(batch: pa.RecordBatch, _state: dict, known: dict[bytes, int]) -> dict:
        found = [bag_of(text, known) for text in utf8(batch, "text")]
        return {"doc_id": values(batch, "doc_id"), "n": [n for n, _ in found], "bag": [bag for _, bag in found]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read, "doc_id long, n long, bag binary", vocabulary).where("n > 0")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term), terms as bytes."""

    def read(batch: pa.RecordBatch, _state: dict) -> dict:
        ids, terms = [], []
        for item, text in zip(values(batch, "item_id").to_pylist(), utf8(batch, "text"), strict=True):
            own = {t for some in term_lists(text) for t in some}
            ids += [item] * len(own)
            terms += own
        return {"item_id": ids, "term": terms}

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_columns(rows, read, "item_id long, term binary", step=64).distinct()


def blocks(pairs: DataFrame, limit: int = PAIRS) -> list[DataFrame]:
    """Pairs by blocks of whole items, of at most `limit` pairs or one item each."""
    sizes = written(pairs.groupBy("item_id").agg(F.count("*").alias("size")))
    some, n = sizes.count(), 1
    dealt = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while n < some and not sizes.groupBy(dealt(n).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("items")).where(f"size > {limit} and items > 1").isEmpty():
        n *= 2
    return [pairs.where(dealt(n) == b) for b in range(n)] if some else []


def classes_of(found: DataFrame) -> DataFrame:
    """cls, hash, bag, m, first, members: classes of equal bags and m, numbered; first is the smallest doc_id."""
    same = found.where(F.length("bag") > 0).groupBy("hash", "bag", "m").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    return written(same.select(F.monotonically_increasing_id().alias("cls"), "*"))


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of every pair in a batch's bags."""
    bags = values(batch, "bag").to_pylist()
    pairs = np.frombuffer(b"".join(bags), dtype=np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags]), pairs[:, 0], pairs[:, 1].astype(np.int64)


def frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of a vocabulary of `size` terms: a count for each term leaves every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            row, term, _ = unpacked(batch)
            np.add.at(held, term, values(batch, "members").to_numpy()[row])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(held[some], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in classes.select("bag", "members").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Best:
    """The k best classes of each item so far: by score, then smallest member, then number."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least, self.parts, self.held = k, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, first: np.ndarray, cls: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.parts.append((item, scores[row, item], first[row], cls[row]))
        self.held += len(row)
        if self.held > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, first, cls = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((cls, first, -score, item))
        item, score, first, cls = item[order], score[order], first[order], cls[order]
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begins, np.diff(begins, append=len(item)))
        last = place == self.k - 1
        self.least[item[last]] = score[last]  # equal scores still count: their members may come first
        keep = place < self.k
        self.parts, self.held = [(item[keep], score[keep], first[keep], cls[keep])], int(keep.sum())
        return self.parts[0]


def scored(classes: DataFrame, weight: np.ndarray, start: np.ndarray, items_of: np.ndarray, items: int, k: int) -> DataFrame:
    """item (its number), score, first, cls: every task's k best classes of each item. Term t is in items_of[start[t]:start[t + 1]]."""
    schema = pa.schema([("item", pa.int32()), ("score", pa.int64()), ("first", pa.int64()), ("cls", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(items, k), max(1, CELLS // items)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, tf = unpacked(batch)
                m = values(batch, "m").to_numpy()
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                scores = np.zeros((batch.num_rows, items), np.int64)
                fans = start[term + 1] - start[term]
                for lo, hi in pieces(fans, CELLS):
                    fan = fans[lo:hi]
                    own = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                    np.add.at(scores, (np.repeat(row[lo:hi], fan), items_of[np.repeat(start[term[lo:hi]], fan) + own]), np.repeat(part[lo:hi], fan))
                best.add(scores, values(batch, "first").to_numpy(), values(batch, "cls").to_numpy())
        item, scores, first, cls = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((item, scores, first, cls), schema, strict=True)], schema=schema)

    return classes.where("first is not null").select("cls", "bag", "m", "first").mapInArrow(score, "item int, score long, first long, cls long")


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole entries whose sizes add up to about `limit` at most."""
    ends = np.searchsorted(np.cumsum(sizes), np.arange(limit, sizes.sum() + limit, limit), side="right") if len(sizes) else []
    at = 0
    for end in [*ends, len(sizes)]:
        if (end := max(int(end), at)) > at:
            yield at, end
            at = end


def search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """The ranked documents of one block of items; None where the block is empty or no document has a term."""
    spark = docs.sparkSession
    asked = [(r["item_id"], bytes(r["term"])) for r in pairs.collect()]  # PAIRS at most, or those of one item
    if not asked:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in asked}))}
    item_ids = sorted({i for i, _ in asked})
    number = {i: n for n, i in enumerate(item_ids)}
    found = written(bags(docs, vocabulary))
    totals = found.agg(F.count("*").alias("n"), F.sum("n").alias("l")).head()
    if not totals["n"]:
        return None
    m = F.expr(f"50 + (cast(n as decimal(13, 0)) * 50 * {totals['n']}) div {totals['l']}").alias("m")
    found = found.select("doc_id", "bag", m).select(F.xxhash64("bag", "m").alias("hash"), "*")
    classes = classes_of(found)
    df = frequencies(classes, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    by_term = np.array(sorted((vocabulary[t], number[i]) for i, t in asked), np.int64)
    start = np.searchsorted(by_term[:, 0], np.arange(len(vocabulary) + 1))
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), "first", "cls")
    top = written(scored(classes, weight, start, by_term[:, 1], len(item_ids), k).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).select("item", "score", "cls"))
    chosen = written(classes.join(top.select("cls").distinct(), "cls", "left_semi").select("cls", "hash", "bag", "m"))
    # bags of the chosen hashes only are verified; of each class the first k members count, and this limit also runs before the shuffle
    near = found.where("doc_id is not null").join(chosen.select("hash").distinct(), "hash", "left_semi")
    early = near.withColumn("place", F.row_number().over(Window.partitionBy("hash", "bag", "m").orderBy("doc_id"))).where(F.col("place") <= k)
    members = early.join(chosen, ["hash", "bag", "m"]).select("cls", "doc_id")
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(item_ids)), pa.int32()), "item_id": pa.array(item_ids, pa.int64())}))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    out = top.join(members, "cls").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.join(names, "item").select(*FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, limit: int = PAIRS) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ship(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(written(item_terms(items)), limit):
        if (some := search_block(docs, block, k)) is not None:
            out = out.unionByName(some)
    return out


def oracle() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with d as materialized (select row_number() over () as r, doc_id, {terms} as ts from documents), s as (select count(*) as big_n, sum(len(ts)) as big_l from d where len(ts) > 0),
 q as materialized (select distinct item_id, unnest({terms}) as term from benchmark where item_id is not null),
 p as materialized (select r, doc_id, term, n, count(*) as tf from (select r, doc_id, len(ts) as n, unnest(ts) as term from d) x where term in (select term from q) group by all),
 w as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term, big_n),
 c as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * big_n) // big_l)))) as c from p join w using (term), s),
 z as (select item_id, doc_id, r, cast(sum(c) as bigint) as score from c join q using (term) where doc_id is not null group by all)
 select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from z where score > 0 qualify rank <= {K}"""
