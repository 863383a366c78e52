"""Near-duplicate detection by min-max hashing.

1. Each text becomes the set of its 64-bit word shingle hashes (of SHINGLE words, or as asked). For each of
   PERMS permutations both the minimum and the maximum are kept: 2 * PERMS signature values from PERMS evaluations.
2. Texts with equal sets are one class (`digest`), represented by its smallest id; only representatives
   go on. The smallest id is found with a limit that also runs before the shuffle, so a class that
   holds a third of all rows costs each task one row.
3. Signatures are cut into bands (24 of 5 values at 85 %; see Likeness). A pair at the limit shares no band
   with a probability below 1e-6. The smallest id of a bucket is its lead. Each text is first paired with one
   lead only, the one it shares most buckets with. Pairs whose sizes or estimated similarity rule the
   threshold out are dropped (five standard deviations below it); the rest is confirmed on full sets.
4. Connected components of these links. A large group of near copies is one component by now. Only
   buckets whose members still lie in several components can hold links that matter: there, every pair
   across components is estimated in blocks of BLOCK rows. Texts that this leaves are paired by the rarest
   shingles of their sets (prefix filter), so a family of texts with one frame and different fillings makes no
   pairs, and confirmed like the others; lists that would make too many pairs are met in blocks. Nothing is
   capped.
5. Components over all links; each class member gets its representative's component.

Intermediate tables are written to the shared checkpoint folder, so lost executors cost recomputation
of one step at most.

Defined results: null and empty texts have no shingles, and are alone in their component. Rows that
repeat a doc_id are one document. A null doc_id takes no part: component null, kept true. Columns
besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, utf8, values, written

SHINGLE, PERCENT = 3, 85
PERMS = 60
BLOCK = 128
SKETCH = 1 << 18  # counters of shingle frequencies
LISTED = 65_536  # most pairs that a shingle's prefix list may make; beyond, its documents meet in blocks
#: Ids of candidate documents are broadcast up to this many (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 200_000
WORDS = 500_000  # word hashes kept per task

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values spread."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Likeness:
    """Words a shingle, the similarity in percent, and what follows for bands and estimates."""

    words: int = SHINGLE
    percent: int = PERCENT

    @property
    def rows(self) -> int:
        """The longest bands by which a pair at the limit is missed with a probability of 1e-6 at most."""
        fit = [r for r in range(1, 13) if (1 - (self.percent / 100) ** r) ** (2 * PERMS // r) <= 1e-6]
        return max(fit, default=1)

    @property
    def bands(self) -> int:
        return 2 * PERMS // self.rows

    @property
    def least_estimate(self) -> float:
        """Estimated similarity below which a pair can't reach the limit: five standard deviations of 2 * PERMS values."""
        p = self.percent / 100
        return p - 5 * (p * (1 - p) / (2 * PERMS)) ** 0.5

    def need(self, n: int, prefix: bool) -> int:
        """How many rarest shingles of a set of n to look at: at least one is shared with every smaller set (prefix), or larger one, at the limit."""
        p = self.percent
        return n - (-(-p * n // 100) if prefix else -(-2 * p * n // (100 + p))) + 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(raw: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words cut at ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    out = mixed(np.full(len(h) - width + 1, width, np.uint64))
    for i in range(width):
        out = mixed(out * _M3 + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def permutations(n: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minmax(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """[min, max] under each permutation, alternating."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), chunk):
        x = a[:, None] * shingles[None, at : at + chunk] + b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def signed(docs: DataFrame, id_col: str, text_col: str, how: Likeness) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, one byte of each signature value."""
    bands, band_rows = how.bands, how.rows

    def run(batch, state):
        hashes = state.setdefault("hashes", WordHashes())
        a, b = permutations()
        out: dict = {"doc_id": values(batch, "_id"), "n_shingles": [], "digest": [], "bands": [], "sig": []}
        for raw in utf8(batch, "_text"):
            s = shingle_set(raw, hashes, how.words)
            out["n_shingles"].append(len(s))
            if not len(s):
                out["digest"].append(None)
                out["bands"].append([])
                out["sig"].append(None)
                continue
            sig = minmax(s, a, b)
            key = mixed(np.arange(1, bands + 1, dtype=np.uint64))
            for col in sig[: bands * band_rows].reshape(bands, band_rows).T:
                key = mixed(key * _M3 + col)
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out["bands"].append(key.view(np.int64))
            out["sig"].append((mixed(sig) & np.uint64(255)).astype(np.uint8).tobytes())
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return map_columns(rows, run, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles (array<long>) of docs (doc_id, text)."""

    def run(batch, state):
        hashes = state.setdefault("hashes", WordHashes())
        return {"doc_id": values(batch, "doc_id"), "shingles": [shingle_set(raw, hashes, words).view(np.int64) for raw in utf8(batch, "text")]}

    return map_columns(docs, run, "doc_id long, shingles array<long>", step=128)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in links (a, b).

    Every node points to its smallest neighbour, or itself; pointers are followed twice, links are
    redrawn between what they point to, and so on until no link is left.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).select("id", F.least("id", "up").alias("up"))
        for _ in range(2):
            up = written(up)
            over = up.select(F.col("id").alias("up"), F.col("up").alias("over"))
            up = up.join(over, "up", "left").select("id", F.coalesce("over", "up").alias("up"))
        up = written(up)
        if labels is None:
            labels = up.select("id", F.col("up").alias("component"))
        else:
            step = up.select(F.col("id").alias("component"), "up")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        of = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("up_a <> up_b")
        edges = written(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        labels = written(labels)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels


def _estimated(n_a, n_b, sig_a: np.ndarray, sig_b: np.ndarray, how: Likeness) -> np.ndarray:
    """Whether sizes and one-byte signatures leave the limit possible; arrays broadcast, signatures on the last axis."""
    same = (sig_a == sig_b).mean(axis=-1)
    return (100 * np.minimum(n_a, n_b) >= how.percent * np.maximum(n_a, n_b)) & ((same - 1 / 256) / (255 / 256) >= how.least_estimate)


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PERMS)


def likely(pairs: DataFrame, reps: DataFrame, how: Likeness) -> DataFrame:
    """Those of pairs (a, b) that estimates don't rule out."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))

    def run(batch, _):
        n_a, n_b = (values(batch, c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        ok = _estimated(n_a, n_b, _signature_rows(values(batch, "sig_a")), _signature_rows(values(batch, "sig_b")), how)
        return {c: values(batch, c).to_numpy(zero_copy_only=False)[ok] for c in ("a", "b")}

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {how.percent} * greatest(n_a, n_b)")
    return map_columns(sized, run, "a long, b long", step=10_000)


def sets_of(ids: DataFrame, docs: DataFrame, how: Likeness) -> DataFrame:
    """(doc_id, shingles) of the documents in ids (doc_id, distinct)."""
    ids = written(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return shingle_sets(docs.join(ids, "doc_id", "left_semi"), how.words)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links: those of pairs (a, b) whose full shingle sets (doc_id, shingles) reach the similarity."""
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(f"100 * common >= {percent} * (size(s_a) + size(s_b) - common)").select("a", "b")


def block_sides(members: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y): rows (key, ob, ab, row) that meet block by block; row is (rep, c, payload) of a bucket (key, rep, c).

    In a bucket the component of most members is its bulk, the others are outsiders. Outsiders (x) meet
    all members (y); members of the bulk don't meet each other.
    """
    by_component = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    split = by_component.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("bulk"), F.count("*").alias("k")).where("k > 1")
    keys = written(split.select("key", F.col("bulk.c").alias("bulk"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("bulk.n")) / BLOCK).alias("outs")))
    rows = members.join(keys, "key").join(payload, "rep").select("key", "c", "blocks", "outs", "bulk", F.struct("rep", "c", *payload.drop("rep").columns).alias("row"))
    spot = F.xxhash64("row.rep")
    left = rows.where("c <> bulk").select("key", F.pmod(spot, "outs").alias("ob"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("ab"), "row")
    right = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1)).alias("ob"), F.pmod(spot, "blocks").alias("ab"), "row")
    return left, right


def block_pairs(members: DataFrame, payload: DataFrame) -> DataFrame:
    """(x, y): the blocks as arrays."""
    left, right = block_sides(members, payload)
    on = ["key", "ob", "ab"]
    return left.groupBy(*on).agg(F.collect_list("row").alias("x")).join(right.groupBy(*on).agg(F.collect_list("row").alias("y")), on).select("x", "y")


def _field(rows, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _likely_block(x, y, how: Likeness) -> np.ndarray:
    """Which pairs of two blocks differ in component and aren't ruled out."""
    ok = _estimated(_field(x, "n_shingles")[:, None], _field(y, "n_shingles")[None], _signature_rows(x.field("sig"))[:, None], _signature_rows(y.field("sig"))[None], how)
    return ok & (_field(x, "c")[:, None] != _field(y, "c")[None])


def _sets(rows) -> list[np.ndarray]:
    lists = rows.field("shingles")
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at, at[1:], strict=False)]


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every x with every y, by products of incidence matrices."""
    vocabulary = np.unique(np.concatenate(xs + ys))
    out = np.zeros((len(xs), len(ys)))
    coded = [[np.sort(np.searchsorted(vocabulary, s)) for s in side] for side in (xs, ys)]
    for at in range(0, len(vocabulary), width):
        m = [np.zeros((len(side), width), np.float32) for side in coded]
        for rows, side in zip(m, coded, strict=True):
            for row, codes in zip(rows, side, strict=True):
                lo, hi = np.searchsorted(codes, (at, at + width))
                row[codes[lo:hi] - at] = 1
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (ids) that connect what the bipartite matrix `linked` connects: a breadth-first forest."""
    n = len(left)
    names = np.concatenate([left, right])
    same = names[:, None] == names[None]
    near = same.copy()
    near[:n, n:] |= linked
    near[n:, :n] |= linked.T
    todo, out = np.ones(len(names), bool), []
    for root in range(len(names)):
        queue = [root] if todo[root] else []
        todo[root] = False
        while queue:
            node = queue.pop()
            for other in np.nonzero(near[node] & todo)[0]:
                todo[other] = False
                queue.append(int(other))
                if names[node] != names[other]:
                    out.append((int(names[node]), int(names[other])))
    return out


def prefixes(full: DataFrame, seen: np.ndarray, how: Likeness) -> DataFrame:
    """(t, rep, n, index): the rarest shingles of each set; `index` marks those that larger sets look for.

    Any one order of all shingles will do; by `seen`, the counts of a sketch, rare ones come first, so that
    what a family of texts has in common stays out of its members' prefixes.
    """

    def run(batch, _):
        lists = values(batch, "shingles")
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ts, ns, index = [], [], []
        for i, j in zip(at, at[1:], strict=False):
            t = flat[i:j]
            n = len(t)
            k, first = how.need(n, True), how.need(n, False)
            t = t[np.lexsort((t, seen[(t.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64)]))[:k]]
            ts.append(t)
            ns.append(np.full(len(t), n))
            index.append(np.arange(len(t)) < first)
        size = [len(t) for t in ts]
        joined = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return {"t": joined(ts, np.int64), "rep": np.repeat(values(batch, "rep").to_numpy(zero_copy_only=False), size), "n": joined(ns, np.int64), "index": joined(index, bool)}

    return map_columns(full.select("rep", "shingles"), run, "t long, rep long, n long, index boolean", step=256)


def hidden_links(buckets: DataFrame, reps: DataFrame, comps: DataFrame, docs: DataFrame, how: Likeness) -> DataFrame | None:
    """Links (a, b) across components within buckets (key, rep); None if estimates leave none.

    Documents that estimates leave are paired by the rarest shingles of their sets: two sets at the limit share
    one of these. Shingles whose lists would make more than LISTED pairs are left to blocks.
    """
    label = comps.select(F.col("id").alias("rep"), "component")
    members = buckets.join(label, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    sig = reps.select("rep", "n_shingles", "sig")

    def texts(batch, _):
        out = [np.zeros(0, np.int64)]
        for x, y in zip(values(batch, "x"), values(batch, "y"), strict=True):
            ok = _likely_block(x.values, y.values, how)
            out += [_field(x.values, "rep")[ok.any(axis=1)], _field(y.values, "rep")[ok.any(axis=0)]]
        return {"rep": np.unique(np.concatenate(out))}

    some = written(map_columns(block_pairs(members, sig), texts, "rep long", step=64).distinct())
    if some.isEmpty():
        return None
    sets = sets_of(some.select(F.col("rep").alias("doc_id")), docs, how).dropDuplicates(["doc_id"])
    full = written(sig.join(sets.withColumnRenamed("doc_id", "rep"), "rep"))
    seen = np.zeros(SKETCH, np.int64)
    for r in full.select(F.explode("shingles").alias("t")).groupBy(F.pmod("t", F.lit(SKETCH)).cast("int").alias("s")).agg(F.count("*").alias("n")).collect():  # SKETCH rows at most
        seen[r["s"]] = r["n"]
    listed = written(prefixes(full, seen, how))
    sizes = listed.groupBy("t").agg(F.count_if("index").alias("ci"), F.count("*").alias("cp")).where("ci > 0 and cp > 1")
    lists = written(listed.join(sizes, "t").withColumn("hot", F.col("ci") * F.col("cp") > LISTED).drop("ci", "cp"))
    side = lambda c: lists.where("not hot").select("t", F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("index").alias(f"index_{c}"))
    ordered = "(n_a, a) < (n_b, b)"
    met = side("a").where("index_a").join(side("b"), "t").where(f"{ordered} and 100 * n_a >= {how.percent} * n_b").select("a", "b").distinct()
    found = confirmed(written(likely(met, reps, how)), full.select(F.col("rep").alias("doc_id"), "shingles"), how.percent)
    hot = written(lists.where("hot").select("rep").distinct())
    if hot.isEmpty():
        return written(found)

    def links(x: pa.Table, y: pa.Table) -> pa.Table:
        pairs = []
        if x.num_rows and y.num_rows:
            x, y = (t.column("row").combine_chunks() for t in (x, y))
            ok = _likely_block(x, y, how)
            i, j = np.nonzero(ok.any(axis=1))[0], np.nonzero(ok.any(axis=0))[0]
            if len(i):
                xs, ys = _sets(x), _sets(y)
                common = common_counts([xs[k] for k in i], [ys[k] for k in j])
                total = _field(x, "n_shingles")[i][:, None] + _field(y, "n_shingles")[j][None] - common
                pairs = _forest(ok[np.ix_(i, j)] & (100 * common >= how.percent * total), _field(x, "rep")[i], _field(y, "rep")[j])
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    on = ["key", "ob", "ab"]
    left, right = block_sides(members.join(hot, "rep", "left_semi"), full)
    left, right = left.toDF("key", "ob", "ab", "row"), right.toDF("key", "ob", "ab", "row")  # both stem from one table: new names tell them apart
    return written(found.union(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(links, "a long, b long")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row. Shingles of `words` words, linked from `percent` on."""
    how = Likeness(words, percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_docs = written(signed(docs, "doc_id", "text", how))
    known = all_docs.where("doc_id is not null and digest is not null")
    first = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    reps = written(known.withColumn("_r", first).where("_r = 1").select(F.col("doc_id").alias("rep"), "digest", "n_shingles", "bands", "sig"))
    banded = reps.select("rep", F.explode("bands").alias("key"))
    leads = written(banded.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead"))
    buckets = written(banded.join(leads, "key"))
    shared = buckets.where("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    pairs = shared.groupBy(F.col("rep").alias("b")).agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("most")).select((-F.col("most.lead")).alias("a"), "b")
    pairs = written(likely(pairs, reps, how))
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, how))
    links = written(confirmed(pairs, sets, how.percent))
    if (hidden := hidden_links(buckets, reps, components(links), docs, how)) is not None:
        links = links.union(hidden)
    # repeated ids with unlike texts are one document: their classes are linked as well
    own = known.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest")
    own = written(own)
    links = links.union(own.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comps = components(links).select(F.col("id").alias("doc_id"), "component")
    out = all_docs.select("doc_id", "n_shingles").join(comps, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
