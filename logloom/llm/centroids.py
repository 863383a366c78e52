"""Centroid clustering: k-means in exact integers, nearest centroids by a vantage-point tree.

A component x counts as floor(scale * x). Each round builds a tree over the centroids, broadcasts it (k centroids,
whatever the number of vectors), and finds every vector's nearest one by best-first branch and bound;
sums and counts of each cluster leave a task as a row for each component. Means are floor(sum / count), rounded down.

The search of all vectors of a batch runs in lockstep: each vector takes its own most promising node, measures the
vantage point or the leaf's centroids in 64-bit integers, and files the children under their least possible distance.
A node is passed over only if that bound lies above the best distance found; at equality, and within rounding, it is
visited, so ties always come to light and go to the smaller number.

Components of 2^26 and more (LARGE) don't fit this arithmetic: such vectors are compared with all centroids in Python's
integers, and so are centroids of that kind wherever a lower bound by doubles doesn't rule them out. Limbs of 30 bits carry
sums of any size to their totals.

Cases: vectors that are null, of another length, or hold a null or non-finite component are left out. Rows are vectors: repeated
ones count as often as they are there. A null vec_id is clustered, but starts no centroid while there are `k` with ids; equal
hashes are started from by their components. Fewer than `k` vectors make as many centroids. Clusters without vectors keep
their centroid. A distance or sum beyond 64 bits is null. Empty tables give no rows. Other columns, whatever their names,
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, values, written

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
LEAF = 2
LARGE = 1 << 26
#: Vectors searched together, and bits of a limb of a sum.
STEP, LIMB = 2048, 30
MOST = (1 << 63) - 1
#: Share by which bounds are widened: far more than the rounding of a square root and a difference.
SLACK = 1e-9
#: Beyond this, doubles decide nothing.
VAST = 10**150
FOUND = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


class Tree:
    """A vantage-point tree of centroids (lists of integers), with their numbers.

    points[i]: the numbers measured at node i. children[i]: (node, lo, hi) with the range of its centroids' distances from
    node i's point. Centroids with large components are kept apart.
    """

    def __init__(self, centroids: list[list[int]]) -> None:
        small = [i for i, c in enumerate(centroids) if all(abs(x) < LARGE for x in c)]
        self.exact = centroids
        self.apart = sorted(set(range(len(centroids))) - set(small))
        self.at = np.array([c if i in set(small) else [0] * len(c) for i, c in enumerate(centroids)], np.int64)
        self.points: list[list[int]] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if small:
            self.grow(small)

    def grow(self, members: list[int]) -> int:
        node = len(self.points)
        self.points.append(members if len(members) <= LEAF else members[:1])
        self.children.append([])
        if len(members) > LEAF:
            far = np.sqrt(squares(self.at[members[1:]] - self.at[members[0]]).astype(float))
            order = np.argsort(far, kind="stable")
            half = (len(order) + 1) // 2
            for some in (order[:half], order[half:]):
                if len(some):
                    lo, hi = float(far[some[0]]), float(far[some[-1]])
                    self.children[node].append((self.grow([members[1 + i] for i in sorted(some)]), lo * (1 - SLACK), hi * (1 + SLACK)))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid in the tree, the smaller number on ties; -1 without any."""
        best, label = np.full(len(x), MOST), np.full(len(x), -1)
        if not self.points:
            return label, best
        bound = np.full((len(x), len(self.points)), np.inf)
        bound[:, 0] = 0
        active = np.arange(len(x))
        while len(active):
            node = bound[active].argmin(1)
            low = bound[active, node]
            go = low <= np.sqrt(best[active].astype(float)) * (1 + SLACK)
            active, node, low = active[go], node[go], low[go]
            bound[active, node] = np.inf
            for n in np.unique(node):
                here = node == n
                rows, under = active[here], low[here]
                for c in self.points[n]:
                    d = squares(x[rows] - self.at[c])
                    closer = (d < best[rows]) | (d == best[rows]) & ((c < label[rows]) | (label[rows] < 0))
                    best[rows[closer]], label[rows[closer]] = d[closer], c
                for child, lo, hi in self.children[n]:
                    away = np.sqrt(d.astype(float))
                    bound[rows, child] = np.maximum(under, np.maximum(away * (1 - SLACK) - hi, lo - away * (1 + SLACK)))
        return label, best


def squares(difference: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", difference, difference)


def distance(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def scaled(x: np.ndarray, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x), and the rows of it that hold large components, which are zeros in the first."""
    product = np.floor(x * float(scale))
    large = ~(np.abs(product) < LARGE).all(axis=1)
    exact = {int(i): [floor_product(float(v), scale) for v in x[i]] for i in np.flatnonzero(large)}
    product[large] = 0
    return product.astype(np.int64), exact


def floor_product(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def doubles(numbers: list[int]) -> np.ndarray:
    """The nearest doubles; what is beyond VAST counts as that."""
    return np.array([float(max(-VAST, min(VAST, n))) for n in numbers])


def assign(tree: Tree, small: np.ndarray, exact: dict[int, list[int]]) -> tuple[np.ndarray, list[int]]:
    """Nearest centroid and squared distance of every row; `exact` holds the rows of large components."""
    label, best = tree.nearest(small)
    found = best.tolist()
    for c in tree.apart:
        about = ((small - doubles(tree.exact[c])) ** 2).sum(axis=1) * (1 - SLACK)
        for i in np.flatnonzero((about <= doubles(found)) | (about >= VAST) | (label < 0)):
            d = distance(small[i].tolist(), tree.exact[c])
            if label[i] < 0 or (d, c) < (found[i], label[i]):
                found[i], label[i] = d, c
    for i, row in exact.items():
        found[i], label[i] = min((distance(row, c), n) for n, c in enumerate(tree.exact))
    return label, found


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sent(vectors: DataFrame, centroids: list[list[int]]) -> Broadcast:
    """The tree of this round's centroids, on every executor: k vectors and as many nodes at most."""
    ship(vectors.sparkSession)
    return vectors.sparkSession.sparkContext.broadcast(Tree(centroids))


def limbs(total: int) -> list[int]:
    """A sum in pieces of LIMB bits, the last one with the sign."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & (1 << LIMB) - 1)
        total >>= LIMB
    return [*out, total]


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: k x components sums come to the driver, whatever the number of vectors."""
    k, dim, tree = len(centroids), len(centroids[0]), sent(vectors, centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * dim for _ in range(k)]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                small, exact = scaled(matrix(values(whole.slice(at, STEP), "vector")), scale)
                label, _ = assign(tree.value, small, exact)
                for c in np.unique(label):
                    count[c] += int((label == c).sum())
                    total[c] = [a + b for a, b in zip(total[c], small[label == c].sum(axis=0).tolist(), strict=True)]
                for i, row in exact.items():
                    total[label[i]] = [a + b for a, b in zip(total[label[i]], row, strict=True)]
        told = [(c, -1, 0, count[c]) for c in range(k) if count[c]]
        told += [(c, i, j, v) for c in range(k) if count[c] for i, x in enumerate(total[c]) for j, v in enumerate(limbs(x))]
        columns = list(zip(*told, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "component", "limb", "value"])

    parts = vectors.select("vector").mapInArrow(sums, "cluster int, component int, limb int, value long")
    count, total = [0] * k, [[0] * dim for _ in range(k)]
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():
        if r["component"] < 0:
            count[r["cluster"]] = r["value"]
        else:
            total[r["cluster"]][r["component"]] += r["value"] << LIMB * r["limb"]
    return [[x // count[c] for x in total[c]] if count[c] else centroids[c] for c in range(k)]


def assigned(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    tree = sent(vectors, centroids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                label, found = assign(tree.value, *scaled(matrix(values(part, "vector")), scale))
                yield pa.RecordBatch.from_arrays([values(part, "vec_id"), pa.array(label, pa.int32()), pa.array([d if d <= MOST else None for d in found], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(search, "vec_id long, cluster int, distance long")


def kept(embeddings: DataFrame, dim: int) -> DataFrame:
    """vec_id, vector: those of `dim` finite components."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where((F.size("vector") == dim) & F.coalesce(fine, F.lit(False)))


def started(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest digests of '<seed>:<vec_id>'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("digest", digest).orderBy(F.col("digest").asc_nulls_last(), "vector").limit(k).collect()
    return [[floor_product(float(x), scale) for x in r["vector"]] for r in first]


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of the vectors in embeddings (vec_id, embedding), and the centroids."""
    vectors = written(kept(embeddings, dim))
    centroids = started(vectors, k, seed, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    return written(assigned(vectors, centroids, scale)), centroids


def clusters(embeddings: DataFrame, **how) -> DataFrame:
    """The result with its inertia, by cluster and in all, and the digest of each centroid."""
    found, centroids = cluster(embeddings, **how)
    spark = found.sparkSession
    told = F.when(F.count_if(F.col("distance").isNull()) == 0, F.try_sum("distance"))
    by = found.groupBy("cluster").agg(told.alias("cluster_inertia"))
    whole = by.agg(F.when(F.count_if(F.col("cluster_inertia").isNull()) == 0, F.try_sum("cluster_inertia")).alias("inertia"))
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    # one row for each of the k clusters
    return found.join(F.broadcast(by.join(digests, "cluster").join(F.broadcast(whole))), "cluster").select(*FOUND)


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    nearest = "select r, min(struct_pack(d := d, c := c)) as b from (select r, c, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{0} c using (i) group by r, c) z group by r"
    mean = "(s - ((s % n) + n) % n) // n"
    step = "select c, i, cast({1} as bigint) as x from (select b.c as c, i, sum(x) as s, count(*) as n from v join a{0} using (r) group by all) y union all select c, i, x from c{0} where c not in (select b.c from a{0})"
    parts = [
        f"e as materialized (select r, vec_id, embedding from (select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = {dim}) x where (select count(*) from unnest(x.embedding) as u(y) where isfinite(y)) = {dim})",
        f"v as materialized (select r, unnest(range({dim})) as i, cast(floor({scale} * cast(unnest(embedding) as double)) as bigint) as x from e)",
        f"c0 as materialized (select c, i, x from v join (select r, row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)), embedding) - 1 as c from e qualify c < {k}) f using (r))",
    ]
    for n in range(rounds):
        parts += [f"a{n} as materialized ({nearest.format(n)})", f"c{n + 1} as materialized ({step.format(n, mean)})"]
    return f"""with {", ".join(parts)}, a{rounds} as materialized ({nearest.format(rounds)}),
 h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by c)
 select vec_id, cast(b.c as int) as cluster, cast(b.d as bigint) as distance, cast(sum(b.d) over (partition by b.c) as bigint) as cluster_inertia, cast(sum(b.d) over () as bigint) as inertia, centroid_sha256
 from e join a{rounds} a on e.r = a.r join h on h.c = a.b.c"""
