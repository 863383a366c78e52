"""Packing: optimal length buckets and token-budget batches.

The histogram of token counts over all pieces (texts longer than MAX_LEN are cut into pieces of MAX_LEN
and a rest) has at most MAX_LEN + 1 bins, so it reaches the driver with a proven bound. Dynamic
programming over it chooses the bucket boundaries with the least total padding. Inside each bucket,
pieces in a pseudo-random but reproducible order are dealt to batches of as many pieces as the token
budget holds at the bucket's length. Ranks are found per shard of a bucket and shifted by the sizes of
the shards before it, so no task ever holds a bucket. Equal pieces of one id (or of none) are counted before
anything is shuffled by it, and travel as runs of at most SHARD, so an id that many rows share is no hot key.

Defined results: null or empty text is one piece of 0 tokens. One row per piece of each input row;
equal ids are equal pieces, all kept. Columns besides id and text are ignored. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_LEN, BUCKETS, BUDGET, SHARD = 2048, 8, 32_768, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def optimal_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Ascending bucket lengths (the last is the greatest length) that minimise the total padding.

    cost(i, j): padding if lengths i+1..j share a bucket; best[k][j] = min over i of best[k-1][i] + cost(i, j).
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    x = np.array(lengths, np.int64)
    n = np.concatenate([[0], np.cumsum([histogram[v] for v in lengths])])
    t = np.concatenate([[0], np.cumsum([histogram[v] * v for v in lengths])])
    m = len(x)
    cost = x[None, :] * (n[None, 1:] - n[:-1, None]) - (t[None, 1:] - t[:-1, None])  # [i, j]: bins i..j
    cost = np.where(np.arange(m)[:, None] <= np.arange(m)[None, :], cost, np.iinfo(np.int64).max // 4)
    best, choice = cost[0], []
    for _ in range(min(buckets, m) - 1):
        total = np.concatenate([[0], best[:-1]])[:, None] + cost
        choice.append(total.argmin(axis=0))
        best = total.min(axis=0)
    bounds, j = [], m - 1
    for cuts in reversed(choice):
        bounds.append(int(x[j]))
        j = int(cuts[j]) - 1
        if j < 0:
            break
    else:
        bounds.append(int(x[j]))
    return sorted(set(bounds))


def piece_lengths(docs: DataFrame, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, piece, n_tokens."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    counted = docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("_n"))
    pieces = counted.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / max_len).cast("int") - 1))).alias("piece"))
    return pieces.select("doc_id", "piece", F.least(F.lit(max_len), F.col("_n") - F.col("piece") * max_len).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, n_tokens, bucket, bucket_len, batch (within the bucket), slot (within the batch), padding."""
    pieces = piece_lengths(docs, max_len, id_col, text_col)
    units = written(pieces.groupBy("doc_id", "piece", "n_tokens").agg(F.count("*").alias("_c")))
    histogram = {r["n_tokens"]: r["n"] for r in units.groupBy("n_tokens").agg(F.sum("_c").alias("n")).collect()}
    bounds = optimal_bounds(histogram, buckets)
    sizes = [sum(n for v, n in histogram.items() if lo < v <= hi) for lo, hi in zip([-1, *bounds], bounds, strict=False)]
    told = lambda xs: F.array(*[F.lit(int(x)) for x in xs or [1]])
    runs = units.select("doc_id", "piece", "n_tokens", "_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / shard).cast("int"))).alias("_run"))
    spot = F.xxhash64("doc_id", "piece", "n_tokens", "_run")
    rows = runs.withColumn("bucket", F.size(F.filter(told(bounds), lambda b: b < F.col("n_tokens"))))
    rows = rows.select(
        "doc_id", "piece", "n_tokens", "_run", F.least(F.lit(shard), F.col("_c") - F.col("_run") * shard).cast("long").alias("_c"), "bucket", F.get(told(bounds), F.col("bucket")).cast("long").alias("bucket_len"), spot.alias("_spot"),
        F.pmod(spot, F.get(told([max(1, -(-s // shard)) for s in sizes]), F.col("bucket"))).alias("_shard"),
    )
    ahead = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("bucket", "_shard").agg(F.sum("_c").alias("_c"))
    offsets = counts.select("bucket", "_shard", ahead(Window.partitionBy("bucket").orderBy("_shard")).alias("_before"))
    own = ahead(Window.partitionBy("bucket", "_shard").orderBy("_spot", "doc_id", "piece", "n_tokens", "_run"))
    ranked = rows.withColumn("_own", own).join(offsets, ["bucket", "_shard"])
    ranked = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_copy")).withColumn("_rank", F.col("_own") + F.col("_copy"))
    at, room = F.col("_rank") + F.col("_before"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len"))))
    return ranked.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "n_tokens", F.col("bucket").cast("long").alias("bucket"), "bucket_len",
        F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
