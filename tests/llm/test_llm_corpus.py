"""Neighbours, packing, toxicity, near duplicates and the pipeline against brute force and held-out accuracy."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import ann, near_dedup, packing, queries, secrets, toxicity

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, base int, _score double, `two words` string, _all int"


def messy_rows():
    texts = [None, "", "one", "one two", "one two", "ONE two", "a b c d e f g", "a b c d e f g", "word " * 30_000, "a b c d e f g h"]
    return [(i, t, "en", "s", 1, 7, 0.5, "z", 1) for i, t in enumerate(texts)] + [(3, "one two", "en", "s", 1, 7, 0.5, "z", 1), (None, "b", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), EXTRA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# nearest neighbours


def brute_neighbours(rows, step=50, k=5):
    use = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in use:
        if q % step == 0:
            score = [(-float(use[q] @ v / np.sqrt((use[q] @ use[q]) * (v @ v))), i) for i, v in use.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in score)[:k]]
    return out


def recall(df, want):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    found = total = 0
    for q, best in want.items():
        assert [x[2] for x in got[q]] == list(range(1, len(best) + 1))
        assert all(a[1] >= b[1] for a, b in itertools.pairwise(got[q]))
        found += len({i for i, _ in best} & {i for i, _, _ in got[q]})
        total += len(best)
    assert set(got) == {q for q, b in want.items() if b}
    return found / max(1, total)


@pytest.mark.parametrize("cell", [512, 64])
def test_recall(spark, sf, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "BLOCK", 100)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(queries.QUERIES["op2_nearest_neighbours"](spark, sf), brute_neighbours(rows)) >= 0.9


def test_recall_in_chunks(spark, sf, monkeypatch):
    for name, n in (("CELL", 64), ("BLOCK", 50), ("CHUNK", 3), ("SLICE", 2)):
        monkeypatch.setattr(ann, name, n)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = ann.neighbours(spark.read.parquet(f"{sf}/embeddings.parquet"), lambda i: i % 10 == 0)
    assert recall(got, brute_neighbours(rows, 10)) >= 0.9


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(6)
    plain = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(120)]
    rows = [(i, [x * 10.0 ** (0, 200, -200, 300)[i % 4] for x in v]) for i, v in plain]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
    want = brute_neighbours(plain)
    assert recall(got, want) == 1
    for r in got.collect():
        assert abs(r["score"] - want[r["query_id"]][r["rank"] - 1][1]) < 1e-12


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(12)] + [(150, [2.0, 0.0, 0.0, 0.0])]
    rows += [(200, None), (250, [0.0] * 4), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4), (400, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, v int")
    got = ann.neighbours(df, lambda i: i % 50 == 0)
    assert recall(got, brute_neighbours(rows)) == 1
    ties = [(r["vec_id"], r["score"]) for r in got.where("query_id = 100").orderBy("rank").collect()]
    assert [i for i, _ in ties] == [101, 102, 103, 104, 105] and all(s == 1.0 for _, s in ties)
    few = ann.neighbours(df.where("vec_id in (0, 1, 2)"), lambda i: i % 50 == 0)
    assert few.count() == 2 and ann.neighbours(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_repeated_ids_in_a_class_of_equal_vectors(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 0.0, 1.0]
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 40)] + [(100 + i, same) for i in range(12)]
    rows = rows * 2 + [(100, same)] * 6 + [(50, [0.0, 1.0, 0.0, 0.0]), (50, [0.0, 0.0, 1.0, 0.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == [101, 102, 103, 104, 105]
    # id 50 is the row with the smallest bytes: little-endian 0.0 starts as 1.0 does, so the later place of 1.0 decides
    fixed = [(i, v) for i, v in dict(rows[:51]).items()] + [(50, [0.0, 0.0, 1.0, 0.0])]
    want = brute_neighbours(fixed)[50]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50] == [i for i, _ in want]


def test_commonest_length_and_many_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 40)] + [(100 + i, [2.0 ** (i % 30), 0.0, 0.0, 2.0 ** (i % 30)]) for i in range(30)][::-1]
    got = ann.neighbours(spark.createDataFrame([*rows, (999, [1.0] * 9)], "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == [101, 102, 103, 104, 105]
    data = np.array([[2.0**i, 2.0**i * 3] for i in range(100)])
    ids = np.arange(100)[::-1].copy()
    _, row, _ = ann.search_block(data, ids, np.array([[1.0, 3.0]]), np.array([-1]), np.array([-2.0]), 5, ann.chi2_quantile(ann.CONFIDENCE))
    assert sorted(ids[row].tolist()) == [0, 1, 2, 3, 4]


# packing


def words(text):
    return len(re.findall(packing.WORD, text or ""))


def least_padding(lengths, buckets):
    distinct = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(distinct))):
        for cut in itertools.combinations(distinct[:-1], k):
            bounds = [*cut, distinct[-1]]
            pad = sum(min(b for b in bounds if b >= n) - n for n in lengths)
            best = pad if best is None else min(best, pad)
    return best


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        buckets = rng.randint(1, 4)
        bounds = packing.optimal_bounds(dict(Counter(lengths)), buckets)
        assert len(bounds) <= buckets and bounds[-1] == max(lengths)
        assert sum(min(b for b in bounds if b >= n) - n for n in lengths) == least_padding(lengths, buckets)
    assert packing.optimal_bounds({}) == []


def check_plan(plan, rows, max_len, budget):
    """plan: rows of pack(); rows: (doc_id, text)."""
    want = Counter()
    for i, t in rows:
        n = words(t)
        for p in range(max(1, -(-n // max_len))):
            want[i, p, min(max_len, n - p * max_len)] += 1
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in plan) == want
    slots, lens = defaultdict(list), {}
    for r in plan:
        assert 0 <= r["n_tokens"] <= r["bucket_len"] and r["padding"] == r["bucket_len"] - r["n_tokens"]
        assert lens.setdefault(r["bucket"], r["bucket_len"]) == r["bucket_len"]
        slots[r["bucket"], r["batch"]].append(r["slot"])
    last = {b: max(n for x, n in slots if x == b) for b in lens}
    for (bucket, batch), got in slots.items():
        room = max(1, budget // max(1, lens[bucket]))
        assert sorted(got) == list(range(len(got))) and len(got) <= room
        assert len(got) == room or batch == last[bucket]


@pytest.mark.parametrize("shard", [20_000, 7])
def test_pack(docs, messy, shard):
    for df, max_len, budget in ((docs, 2048, 32_768), (messy, 5, 20)):
        plan = packing.pack(df, max_len=max_len, budget=budget, shard=shard).collect()
        check_plan(plan, [(r["doc_id"], r["text"]) for r in df.collect()], max_len, budget)
    assert packing.pack(docs.limit(0)).count() == 0


def test_pack_ids_that_many_rows_share(spark):
    rows = [(None, "a b")] * 300 + [(None, "a " * n) for n in range(100)] + [(7, "a b c")] * 90
    plan = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), max_len=40, budget=100, shard=16)
    check_plan(plan.collect(), rows, 40, 100)


# toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.QUERIES["op6_toxicity"](spark, d).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    right = np.mean([r["predicted"] == r["toxic"] for r in got])
    assert len(pos) > 20 and auc > 0.95 and right > 0.95


def test_toxicity_forms(spark, sf, docs, messy):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).collect()
    import zlib

    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    odd = toxicity.score_toxicity(messy, labels.limit(0)).collect()
    assert len(odd) == messy.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(messy, labels).columns == messy.columns
    assert toxicity.without_toxic(messy, labels.limit(0)).count() == messy.count()


def test_toxicity_ignores_held_out_labels(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, x).collect()}
    assert score(labels) == score(flipped)


# near duplicates


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k=3, percent=85):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, k)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            where[s].add(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in where[s] if j > i)
        for j, common in shared.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def check_near(df, rows, k=3, percent=85):
    want = brute_components([x for x in rows if x[0] is not None], k, percent)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    return want


def test_near_brute(spark, sf, docs, messy):
    check_near(queries.QUERIES["op10_near_dedup"](spark, sf), [(r["doc_id"], r["text"]) for r in docs.collect()])
    check_near(near_dedup.near_duplicates(messy), [(r[0], r[1]) for r in messy_rows()])
    assert near_dedup.near_duplicates(messy.limit(0)).count() == 0


def test_near_chains_and_groups(spark, monkeypatch):
    """Chains of near copies, a large group, and pairs close to the limit on either side."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []

    def add(w):
        rows.append((len(rows), " ".join(w)))

    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(25):
        add(chain)
        chain = [*chain[4:], *(rng.choice(vocabulary) for _ in range(4))]
    group = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(120):
        add([rng.choice(vocabulary) if rng.random() < 0.01 else w for w in group])
    for share in (2, 3, 4, 5, 6):
        for _ in range(12):
            base = [rng.choice(vocabulary) for _ in range(120)]
            add(base)
            for at in rng.sample(range(120), share):
                base[at] = rng.choice(vocabulary)
            add(base)
    rng.shuffle(rows)
    want = check_near(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert 20 < len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("listed", [near_dedup.LISTED, 0])
def test_near_family_of_one_frame(spark, monkeypatch, listed):
    """Texts that share three quarters and more of their shingles, mostly below the limit."""
    monkeypatch.setattr(near_dedup, "LISTED", listed)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = random.Random(12)
    frame, rows = [f"f{i}" for i in range(200)], []
    for i in range(150):
        filling = [f"x{i}y{j}" for j in range(rng.choice((8, 14, 20)))]
        at = rng.randint(20, 180)
        rows.append((len(rows), " ".join(frame[:at] + filling + frame[at:])))
        if i % 10 == 0:
            rows.append((len(rows), " ".join(frame[:at] + filling[:-1] + ["other"] + frame[at:])))
    want = check_near(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert 10 < len({c for _, c in want.values()}) < len(rows) - 10


def test_near_other_width_and_limit(spark, sf, docs):
    check_near(near_dedup.near_duplicates(docs, words=5, percent=80), [(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert (near_dedup.Likeness().rows, near_dedup.Likeness().bands, near_dedup.Likeness(5, 80).rows) == (5, 24, 4)


def test_minmax_estimates():
    rng = np.random.default_rng(2)
    a, b = near_dedup.permutations()
    s = near_dedup.mixed(rng.integers(0, 2**63, 1100, np.uint64))
    x, y = near_dedup.minmax(s[:1000], a, b), near_dedup.minmax(s[100:], a, b)
    assert len(x) == 2 * near_dedup.PERMS and abs((x == y).mean() - 900 / 1100) < 0.12
    assert (near_dedup.minmax(s, a, b, chunk=7) == near_dedup.minmax(s, a, b)).all()


# pipeline


def test_pipeline_stages(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    have = docs
    flagged = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        have = stage(spark, have, sf).cache()
        after[name] = have.collect()
        if name != "packing":
            assert have.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in after["toxicity"]}
    assert kept == {i: t for i, t in texts.items() if i not in flagged}
    leads = {c for _, c in brute_components(kept.items(), corpus_pipeline.WORDS, corpus_pipeline.PERCENT).values()}
    assert {r["doc_id"] for r in after["near_dedup"]} == leads
    for r in after["secrets"]:
        assert r["n_chars"] == len(r["text"])
    clean = spark.createDataFrame([(r["doc_id"], r["text"]) for r in after["secrets"]], "doc_id long, text string")
    assert secrets.scan_secrets(clean).where("n_access + n_hex > 0").count() == 0
    check_plan(after["packing"], [(r["doc_id"], r["text"]) for r in after["secrets"]], packing.MAX_LEN, packing.BUDGET)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(after["packing"])


def test_pipeline_empty_and_messy(spark, sf, messy):
    plain = messy.select(*corpus_pipeline.COLUMNS)
    for df in (plain, plain.limit(0)):
        have = df
        for _, stage in corpus_pipeline.STAGES:
            have = stage(spark, have, sf)
        have.collect()
