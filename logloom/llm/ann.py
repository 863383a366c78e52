"""Approximate nearest neighbours by largest cosine: stable projections, kd-trees, a chi-square stop.

Unit vectors are projected on M Gaussian directions. For a pair at distance d the squared projected
distance divided by d^2 is chi-square with M degrees of freedom. Projected neighbours of a query are
therefore verified on the original vectors in order of projected distance, until the next one lies so
far out that a point closer than the query's present k-th best would be found there only with
probability 1 - CONFIDENCE: r^2 >= quantile(CONFIDENCE) * d_k^2.

The kd-tree has two levels. Its top cells are split at medians of a bounded sample (SAMPLE rows at
most, of which only projections reach the driver); every vector is filed under its cell, and cells above CELL rows are dealt to salted blocks. A
block builds its own lower tree. Round one takes each query to its own cell, which gives d_k; round two
takes it, with that bound, to every other cell whose box isn't beyond the stop radius. The queries that ask a
cell are counted; where there are more than CHUNK, they come in chunks, and only such a cell is copied.
There are as many cells as the vectors need, up to CELLS; beyond that, cells grow, in blocks.

Equal vectors are filed once, with their k + 1 smallest ids: no more can be among a query's k nearest.
Vectors that differ by a power of two count as equal. Scores are computed in double precision on the original vectors, the same way for every row.

Defined results: vectors that are null, zero, of another length than the commonest (of equally common
ones the longest), or hold null or non-finite components take no part. Of the rows of a repeated id, the one with the smallest bytes
(once scaled) counts, as query and as neighbour. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

M, SEED, CONFIDENCE = 8, 11, 0.97
SAMPLE, CELLS, CELL, BLOCK, LEAF, CHUNK = 100_000, 4096, 512, 4096, 64, 20_000
SLICE = 128  # queries measured against all boxes at a time
PROJECTED = [f"p{i}" for i in range(M)]
PAIRS = 65_536  # scored exactly at a time


def chi2_cdf(x: float, m: int = M) -> float:
    """For even m."""
    term, total = 1.0, 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int = M) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, m))


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A balanced kd-tree as (dimension, threshold) in heap order; leaves is a power of two."""
    tree: list[tuple[int, float]] = [(0, 0.0)] * (leaves - 1)
    todo = [(0, points)]
    while todo:
        at, pts = todo.pop()
        if at < leaves - 1:
            d = int(np.argmax(pts.max(axis=0) - pts.min(axis=0))) if len(pts) else 0
            t = float(np.median(pts[:, d])) if len(pts) else 0.0
            tree[at] = (d, t)
            todo += [(2 * at + 1, pts[pts[:, d] < t]), (2 * at + 2, pts[pts[:, d] >= t])]
    return tree


def cell_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if tree:
        dims, cuts = (np.array(x) for x in zip(*tree, strict=True))
        for _ in range((len(tree) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= cuts[at])
    return at - len(tree)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of queries to boxes: queries x boxes."""
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0)
    return (gap * gap).sum(axis=2)


def leaves_of(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree, split at the middle of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        pts = points[rows]
        d = int(np.argmax(pts.max(axis=0) - pts.min(axis=0)))
        order = np.argsort(pts[:, d], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def search_block(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, score) of the block's best per query, not below the query's bound (a cosine)."""
    r = directions(data.shape[1])
    norm_d, norm_q = np.sqrt((data * data).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    unit_d, unit_q = data / norm_d[:, None], queries / norm_q[:, None]
    p_d, p_q = unit_d @ r, unit_q @ r
    leaves = leaves_of(p_d)
    low, high = np.stack([p_d[x].min(axis=0) for x in leaves]), np.stack([p_d[x].max(axis=0) for x in leaves])
    near = box_distance(p_q, low, high)
    order = np.argsort(near, axis=1, kind="stable")
    keep = min(k, len(data))
    best = np.full((len(queries), keep), -np.inf)
    rows = np.full((len(queries), keep), -1)
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        # stop: the next leaf is beyond the radius in which a closer point would still project
        leaf = order[active, step]
        kth = np.maximum(best[active, k - 1] if keep >= k else np.full(len(active), -np.inf), bound[active])
        going = ~(near[active, leaf] > stop * np.maximum(2 - 2 * kth, 0) + 1e-9)
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        for one in np.unique(leaf):
            who = active[leaf == one]
            members = leaves[one]
            score = unit_q[who] @ unit_d[members].T
            score[query_ids[who][:, None] == ids[members][None]] = -np.inf
            # all within rounding of the k-th go to the exact score, so that ties are settled by id
            both = np.concatenate([best[who], score], axis=1)
            kth = np.partition(both, both.shape[1] - keep, axis=1)[:, -keep]
            i, j = np.nonzero(np.isfinite(score) & (score >= kth[:, None] - 1e-9))
            score[:] = -np.inf
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                score[a, b] = (queries[who[a]] * data[members[b]]).sum(axis=1) / (norm_q[who[a]] * norm_d[members[b]])
            s = np.concatenate([best[who], score], axis=1)
            m = np.concatenate([rows[who], np.broadcast_to(members, score.shape)], axis=1)
            top = np.lexsort((ids[m], -s), axis=1)[:, :keep]
            best[who], rows[who] = np.take_along_axis(s, top, 1), np.take_along_axis(m, top, 1)
    i, j = np.nonzero(np.isfinite(best) & (best >= bound[:, None] - 1e-9))
    row = rows[i, j]
    exact = (queries[i] * data[row]).sum(axis=1) / (norm_q[i] * norm_d[row])
    rank = np.lexsort((ids[row], -exact, i))
    i, row, exact = i[rank], row[rank], exact[rank]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    ok = nth < k
    return i[ok], row[ok], exact[ok]


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v as packed doubles) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size(v) > 0) & finite & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of every row for which `is_query` (on vec_id) holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = clean(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).head()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = int(lengths["n"])
    rows = rows.where(F.size("v") == dim)
    # one row an id comes first: repeats must not use up the places of other ids with an equal vector
    packed = written(spark_pack(rows).groupBy("vec_id").agg(F.min("v").alias("v")))
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    filed = packed.withColumn("_r", copies).where(F.col("_r") <= k + 1).select("vec_id", "v")
    filed = written(filed)
    total = filed.count()
    keep = max(1, total // SAMPLE + 1)
    sample = with_cell(filed.where(F.pmod(F.xxhash64("vec_id"), F.lit(keep)) == 0).limit(SAMPLE), [], dim).select(*PROJECTED).collect() if total else []
    cells = 1 << max(0, min(CELLS, max(1, total // CELL)).bit_length() - 1)
    tree = split_tree(np.array(sample, np.float64).reshape(-1, M), cells) if sample else []
    placed = written(with_cell(filed, tree, dim))
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in PROJECTED for f in (F.min, F.max)]).collect()
    low, high = (np.array([[b[f"{f}_{c}"] for c in PROJECTED] for b in boxes]).reshape(-1, M) for f in ("min", "max"))
    cell_ids = np.array([int(b["cell"]) for b in boxes], np.int64)
    salts = {int(b["cell"]): -(-b["n"] // BLOCK) for b in boxes}
    stop = chi2_quantile(CONFIDENCE)
    queries = written(with_cell(packed.where(is_query(F.col("vec_id"))), tree, dim))

    def search(_key, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, qids = mine["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        i, row, score = search_block(unpack(mine["v"], dim), ids, unpack(asked["v"], dim), qids, asked["bound"].to_numpy(), k, stop)
        return pd.DataFrame({"query_id": qids[i], "vec_id": ids[row], "score": score})

    def visit(asked: DataFrame, counts: DataFrame) -> DataFrame:
        """asked: vec_id, v, bound, cell; each goes to every salt of its cell. counts (cell, n): how many ask there.

        Only cells that more than CHUNK queries ask are copied, once for each chunk of them.
        """
        chunks = {int(r["cell"]): -(-r["n"] // CHUNK) for r in counts.collect()}
        # as many rows as cells, so at most CELLS
        parts = F.broadcast(spark.createDataFrame([(c, n, chunks.get(c, 0)) for c, n in salts.items()], "cell long, salts long, chunks long"))
        data = placed.join(parts, "cell").where("chunks > 0").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("salts")).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v")
        asked = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("vec_id"), F.col("chunks")).alias("chunk"), "vec_id", "v", "bound")
        on = ["cell", "salt", "chunk"]
        return data.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(search, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = written(best(visit(queries.withColumn("bound", F.lit(-2.0)), queries.groupBy("cell").agg(F.count("*").alias("n")))).drop("rank"))
    kth = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("bound"))
    bounded = written(queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0))))

    def going(pdf: pd.DataFrame):
        """(row, cell) numbers of the cells each query must still visit, a slice of queries at a time."""
        for at in range(0, len(pdf), SLICE):
            part = pdf.iloc[at : at + SLICE]
            far = box_distance(part[PROJECTED].to_numpy(), low, high)
            go = (far <= stop * np.maximum(2 - 2 * part["bound"].to_numpy()[:, None], 0) + 1e-9) & (cell_ids[None] != part["cell"].to_numpy()[:, None])
            i, j = np.nonzero(go)
            yield i + at, j

    def others(batches):
        for pdf in batches:
            for i, j in going(pdf):
                out = pdf.iloc[i][["vec_id", "v", "bound"]].copy()
                out["cell"] = cell_ids[j]
                yield out

    def how_many(batches):
        for pdf in batches:
            n = np.zeros(len(cell_ids), np.int64)
            for _, j in going(pdf):
                n += np.bincount(j, minlength=len(n))
            yield pd.DataFrame({"cell": cell_ids[n > 0], "n": n[n > 0]})

    counts = bounded.select("cell", "bound", *PROJECTED).mapInPandas(how_many, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    away = visit(bounded.mapInPandas(others, "vec_id long, v binary, bound double, cell long"), counts)
    found = home.select("query_id", "vec_id", "score").union(away)
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def spark_pack(rows: DataFrame) -> DataFrame:
    """(vec_id, v as the bytes of its doubles); -0.0 as 0.0, so that equal vectors have equal bytes.

    Vectors are scaled by a power of two, so that the largest component lies between 1/2 and 1: no cosine changes by
    it, and neither squares nor products overflow.
    """

    def scaled(v) -> bytes:
        v = np.asarray(v, np.float64)
        return (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) + 0.0).tobytes()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [scaled(v) for v in pdf["v"]]})

    return rows.mapInPandas(run, "vec_id long, v binary")


def with_cell(packed: DataFrame, tree: list, dim: int) -> DataFrame:
    """Adds the projections p0.. and the top cell."""

    def run(batches):
        for pdf in batches:
            v = unpack(pdf["v"], dim)
            p = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ directions(dim)
            yield pd.concat([pdf[["vec_id", "v"]].reset_index(drop=True), pd.DataFrame({"cell": cell_of(p, tree)}), pd.DataFrame(p, columns=PROJECTED)], axis=1)

    return packed.mapInPandas(run, "vec_id long, v binary, cell long, " + ", ".join(f"{c} double" for c in PROJECTED))
