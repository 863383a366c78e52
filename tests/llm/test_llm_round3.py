"""Exact duplicates, centroid clustering and lexical search: edge cases and brute force; whole tables are held against DuckDB elsewhere."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import centroids, exact_dedup, html_extract, lexical_search

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key int, row double, `body` string, best int, hash int"


def rows_of(texts):
    return [(i, t, "en", "s", 1, 7, 0.5, "z", 1, 2) for i, t in texts]


MESSY = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a b"), (7, "A b"), (8, "a  b"), (8, "a  b"), (None, "ab"), (9, "word " * 50_000), (10, "word" * 50_000), (None, None), (11, "é"), (12, "é"), (13, "ab\x1f"), (14, " a b"),
]


# exact duplicates


def brute_duplicates(rows):
    groups = defaultdict(list)
    for place, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, place))
    out = []
    for body, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(rows[m[3]][0], keep, len(members), n == 0, digest) for n, m in enumerate(members)]
    return Counter(out)


@pytest.mark.parametrize(("bits", "capacity"), [(63, 1 << 16), (3, 2), (1, 1), (20, 1)])
def test_exact_duplicates(spark, bits, capacity):
    """Few bits make keys collide, so that texts under one key are chained; little capacity makes the directory double."""
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows_of(MESSY), EXTRA).repartition(3), bits, capacity)
    assert Counter(tuple(r) for r in found.select(*exact_dedup.FOUND).collect()) == brute_duplicates(MESSY)


def test_exact_duplicates_hot_group_and_empty_table(spark):
    rows = [(i, "the same " + " " * (i % 3)) for i in range(3000)] + [(i, f"text {i // 2}") for i in range(3000, 6000)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert Counter(tuple(r) for r in found.select(*exact_dedup.FOUND).collect()) == brute_duplicates(rows)
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_directory_splits_overfull_buckets_only(spark):
    rng = random.Random(5)
    keys = sorted({rng.randrange(1 << 8) for _ in range(400)} | {rng.randrange(1 << 12) for _ in range(200)})  # most begin with zeros
    pointers, depth = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), 12, 30)
    bucket_of = {}
    for r in pointers.collect():
        assert r["slot"] not in bucket_of
        bucket_of[r["slot"]] = (r["bucket"], r["depth"])
    fill = Counter(bucket_of[k >> 12 - depth] for k in keys)
    assert max(fill.values()) <= 30 and len({d for _, d in fill}) > 1
    start = math.ceil(math.log2(len(keys) / 30))
    for (bucket, d), _ in fill.items():
        assert all(k >> 12 - d == bucket >> 12 - d for k in keys if bucket_of[k >> 12 - depth] == (bucket, d))
        if d > start:  # its parent was overfull
            assert sum(k >> 13 - d == bucket >> 13 - d for k in keys) > 30


def test_index_files_hold_ranges_of_buckets(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 4000).cast("string")).alias("text"))
    index = exact_dedup.build(exact_dedup.texts_of(docs, 63), capacity=100)
    files = index.entries.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert index.entries.count() == 4000 and len(files) > 1
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:], strict=False))
    assert index.entries.groupBy("bucket").count().agg(F.max("count")).head()[0] <= 100


# centroid clustering


def brute_clusters(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = [(i, [float(x).as_integer_ratio() for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [a * scale // b for a, b in v]) for i, v in kept]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    cents = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        got = defaultdict(list)
        for _, v in kept:
            got[near(v)[1]].append(v)
        cents = [[sum(x) // len(got[n]) for x in zip(*got[n], strict=True)] if got[n] else c for n, c in enumerate(cents)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    fits = lambda x: x if x <= centroids.MOST else None
    inertia = [sum(d for _, c, d in out if c == n) for n in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, fits(d), fits(inertia[c]), fits(sum(inertia)), digest[c]) for i, c, d in out)


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) + (i % 11)]) for i in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (3, rows[3][1]), (4, rows[5][1]), (None, rows[6][1])]
    rows += [(n + 2, None), (n + 3, []), (n + 4, [1.0] * 63), (n + 5, [1.0] * 63 + [None]), (n + 6, [float("nan")] + [0.0] * 63), (n + 7, [float("inf")] + [0.0] * 63), (n + 8, [0.0] * 64)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, vector string, cluster int, distance string"


@pytest.mark.parametrize(("seed", "k", "more"), [(1, 8, []), (2, 40, []), (3, 8, [1e30]), (4, 8, [1e300, -1e300, 3e6])])
def test_clusters(spark, seed, k, more):
    rows = vectors(seed) + [(10_000 + i, [x] + [0.5] * 63) for i, x in enumerate(more)]
    df = spark.createDataFrame([(i, v, 1, "v", 2, "d") for i, v in rows], SCHEMA).repartition(5)
    found = Counter(tuple(r) for r in centroids.clusters(df, k=k).select(*centroids.FOUND).collect())
    assert found == brute_clusters(rows, k=k)


def test_clusters_of_few_and_none(spark):
    assert centroids.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, [float(i // 2)] * 64) for i in range(5)]
    found = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select(*centroids.FOUND).collect()
    assert Counter(map(tuple, found)) == brute_clusters(rows)


def test_tree_finds_the_nearest_with_ties():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 8, 100):
        cents = rng.integers(-6, 7, size=(size, 3))
        x = rng.integers(-8, 9, size=(500, 3))
        label, best = centroids.Tree(cents.tolist()).nearest(x)
        d = ((x[:, None] - cents[None]) ** 2).sum(2)
        assert (label == d.argmin(1)).all() and (best == d.min(1)).all()


# lexical search


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        if item is None:
            continue
        got = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // length if b else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if score > 0 and i is not None:
                got.append((-score, i))
        out += [(item, n, i, -s) for n, (s, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(out)


WORDS = "the of and heron Über naïve x9 42 été Ærø 語 zoo".split()


@pytest.mark.parametrize(("k", "limit"), [(5, 200_000), (3, 6)])
def test_search(spark, monkeypatch, k, limit):
    rng = random.Random(k)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    docs += [(i, "The heron, the zoo!") for i in range(1000, 1060)] + [(2000, None), (2001, ""), (2002, " .,-"), (None, "heron zoo"), (5, "heron"), (2003, "of " * 40_000 + "heron"), (2004, "a\x00heron\x7fzoo_x9")]
    items = [(1, "the heron"), (2, "ZOO; über"), (2, "42"), (3, None), (4, ""), (None, "the"), (5, "unheard"), (6, " ".join(WORDS))]
    d = spark.createDataFrame(rows_of(docs), EXTRA).repartition(4)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, cls int")
    assert sorted(tuple(r) for r in lexical_search.search(d, q, k, limit).collect()) == brute_search(docs, items, k)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items, empty = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(none, items).collect() == [] and lexical_search.search(one, empty).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.search(one, items).collect()] == [(1, 1, 1)]


def test_pieces_of_long_texts(monkeypatch):
    text = ("Word " * 100 + "x" * 50 + ",").encode() * 3
    whole = [t for some in lexical_search.term_lists(text) for t in some]
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    assert [t for some in lexical_search.term_lists(text) for t in some] == whole == text.lower().replace(b",", b" ").split()


def test_a_tasks_best_classes_keep_ties():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 4, size=(500, 3))
    best, first = lexical_search.Best(3, 7), rng.permutation(500)
    for at in range(0, 500, 50):
        best.add(scores[at : at + 50], first[at : at + 50], np.arange(at, at + 50))
        best.settle()
    item, score, low, cls = best.settle()
    for i in range(3):
        want = sorted((-scores[c, i], first[c], c) for c in range(500) if scores[c, i] > 0)[:7]
        assert [(-s, f, c) for n, s, f, c in zip(item, score, low, cls, strict=True) if n == i] == want


# HTML extraction: broken markup, wrappers, and clusters inside articles

P = "<p>This is a long paragraph of the article, with many words in it, to be kept as it is.</p>"
KEPT = P[3:-4]
WHOLE = P * 3
#: page, the article's blocks beside its three paragraphs
WRAPPERS = [
    f"<div class='layout with-sidebar'><article>{WHOLE}</article></div>", f"<div class='content-sidebar-wrap'><div>{WHOLE}</div></div>", f"<div class='content-sidebar-wrap'><article>{WHOLE}</article><div class='sidebar'><p>side side</p></div></div>",
    f"<div id='page' class='site has-sidebar'><main>{WHOLE}</main></div>", f"<div class='no-nav'><main>{WHOLE}</main></div>", f"<div id='main-content' class='widget-area'>{WHOLE}</div>",
    f"<article>{WHOLE}</article><section id='comments'><article>{WHOLE}{WHOLE}</article></section>", f"<main>{WHOLE}<div class='comments'><p>Bob: nice!</p></div></main>", f"<div id=x>{WHOLE}</div><div class=sidebar>{WHOLE}{WHOLE}</div>",
]


@pytest.mark.parametrize("page", WRAPPERS)
def test_wrappers_of_the_article_are_not_silenced(page):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == "\n".join([KEPT] * 3)


@pytest.mark.parametrize(
    "block",
    [
        "<section id='discussion'><h2>Discussion</h2><p>What these results mean is told here, at some length, as it is in papers.</p></section>", "<p class='share-price'>The share price rose by three percent to forty.</p>",
        "<p class='related-work'>Others have done related work in this field before.</p>", "<section class='social-science'><p>Social science has another view of the matter, told in this section.</p></section>", "<div class='hero-banner'><h1>The title</h1></div>",
    ],
)
def test_names_that_only_sound_like_furniture(block):
    want = re.sub(r"<[^>]+>", "\n", block).split("\n")
    found = html_extract.main_text(f"<article>{P}{block}{P}{P}</article>").split("\n")
    assert all(x in found for x in want if x) and found.count(KEPT) == 3


def test_clusters_decide_inside_an_article(monkeypatch):
    page = f"<main><ul><li><a href=x>Home</a></li><li><a href=y>Blog</a></li></ul><h1>Title</h1>{WHOLE}<div><div>Bob: nice!</div></div></main>"
    assert html_extract.main_text(page) == "\n".join(["Title"] + [KEPT] * 3)
    monkeypatch.setattr(html_extract, "content_lines", lambda lines: (np.array([x.doubt == 0 for x in lines]),) * 2)
    assert "Home" in html_extract.main_text(page) and "nice" in html_extract.main_text(page)


def test_broken_markup_never_raises():
    assert html_extract.main_text("<article><p>hello</p><![foo[x]]><p>more</p></article>") == "hello\nmore"
    assert html_extract.main_text("<p>x</p><![>y").startswith("x")
    rng = random.Random(11)
    parts = ["<p>", "</p>", "<div class='a b'>", "</div>", "<![", "<![CDATA[x]]>", "<![if x]>", "<!", "<!x>", "<!--", "-->", "<?php", "?>", "<!DOCTYPE", ">", "]]>", "&#x110000;", "&#;", "&", "<a href=", "\"", "'", "words and words ", "\x00", "<script>", "</script", "<article>", "<li>", "é", "<", "/>", "<!ELEMENT x [", "<![foo[x]]>"]
    for _ in range(1500):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        assert isinstance(html_extract.main_text(page), str)
