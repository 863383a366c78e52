"""Secret scans [native].

Base spans come from three fixed patterns. On top, candidate strings (runs of 20 and more characters
of the base64 alphabet) are put into a character class, and the Shannon entropy of every window of
WINDOW characters is followed along the string by incremental counts: one character's count falls,
another's rises, and the sum of c*log2(c) is corrected by the difference. A candidate whose highest
window entropy reaches its class's threshold becomes an `entropy` span, unless an allow-list
expression fits the whole of it or a base span already contains it. Windows that touch a word of WORDS
(example, placeholder, the alphabet, ...) don't count; the rest of the run is judged all the same.
Neither the allow-list nor the words touch base spans.

Lower-case runs are judged from a digit and a letter beyond f on. With + / _ or - inside, they are judged
if a piece of WINDOW characters between these is such a run; slugs, lower-case paths and UUIDs have none.
No class, so no entropy span: runs without digits or without letters, lower-case hex broken by + / _ -
(its pieces of 24 are base spans), upper-case runs broken by these.

Offsets are code points, end exclusive. All column expressions: no shuffle, no Python. Time grows with a
text's length and its number of matches, not with their squares.

Defined results: null or empty text has no spans (the digest is that of the empty string). One row per
input row, repeated ids included; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in order, (kind, expression, group whose length counts, least length).
#: hex and access keys take the least length into the expression: their greedy runs are maximal, so
#: the matches that pass are the same.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Character classes in order (expression, alphabet, entropy in bits that a window needs).
CLASSES = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 2.9),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 2.9),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.4),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
    (r"^(?=.*[0-9])(?=.*[g-z])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4),
    (r"^(?=[a-z0-9+/_-]+$).*(?<![a-z0-9])(?=[a-z]*[0-9])(?=[0-9a-f]*[g-z])[a-z0-9]{20}", "abcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.4),
)
_PIECE = r"(?:[A-Z]?[a-z]{1,19}(?:[A-Z][a-z]{2,19})*+[0-9]{0,8}|[A-Z]{1,19}[0-9]{0,8}|[0-9]{1,8})"
_SEGMENT = rf"[-_]*+{_PIECE}(?:[-_]++{_PIECE})*+[-_]*+"
#: Candidates that are no secret, whatever their entropy: UUIDs, paths whose every segment is made
#: of words and short numbers, the example key of AWS's manuals. Possessive, so long ones need no deep stack.
ALLOW = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    rf"^(?=[^/]*/[^/]*/[^/]*/)/*+{_SEGMENT}(?:/++{_SEGMENT})*+/*+$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
)
#: Fixed value: words that are no part of a secret; only the windows that touch one are passed over.
WORDS = r"EXAMPLE|[Ee]xample|(?i:0123456789abcdef(?:ghijklmnopqrstuvwxyz)?|abcdefghijklmnopqrst(?:uvwxyz)?|placeholder|changeme)"

SPAN = "array<struct<s:int,k:int,e:int>>"
SCAN, PIECE = 256, 1024


def _matches(text: Column, regex: str, group: int) -> Column:
    """Array of (piece before a match, match, the group that counts); one element more for the rest."""
    return F.when(
        F.regexp_like(text, F.lit(regex)),
        F.arrays_zip(
            F.split(text, regex, -1).alias("p"),
            F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("g"),
        ),
    )


def bound(value: Column, fn) -> Column:
    """fn(value), with value computed once: inside a lambda, an expression is computed again wherever it stands."""
    return F.transform(F.array(value), fn)[0]


def running(values: Column, fold, zero: int) -> Column:
    """For each element of an array<int>, the fold of those before it.

    In blocks of SCAN: appending to an array copies it, so one pass over n elements would take time n * n.
    """

    def scan(xs: Column) -> Column:
        start = F.struct(F.lit(zero).alias("t"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(fold(acc["t"], x).cast("int").alias("t"), F.concat(acc["out"], F.array(acc["t"])).alias("out")))

    def over(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / SCAN).cast("int"))
        return bound(F.transform(numbers, lambda b: scan(F.slice(v, b * SCAN + 1, SCAN))), joined)

    def joined(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: b["t"]))["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, t: F.transform(b["out"], lambda x: fold(t, x).cast("int"))))

    return bound(values, over)


def _located(found: Column, names: tuple[str, str, str], keep, kind: int) -> Column:
    """Spans of the matches that `keep` holds for, by running sums of lengths."""
    p, m, g = names
    length = lambda c: F.coalesce(F.length(c), F.lit(0))

    def span(x: Column, at: Column) -> Column:
        s = at + length(x[p])
        return F.when(x[m].isNotNull() & keep(x[m], x[g]), F.struct(s.cast("int").alias("s"), F.lit(kind).alias("k"), (s + length(x[m])).cast("int").alias("e")))

    def spans(f: Column) -> Column:
        return F.array_compact(F.zip_with(f, running(F.transform(f, lambda x: length(x[p]) + length(x[m])), lambda a, b: a + b, 0), span))

    return F.coalesce(F.when(found.isNotNull(), bound(found, spans)), F.array().cast(SPAN))


def _xlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, alphabet: Column, window: int = WINDOW) -> Column:
    """Highest entropy over all windows of a string of at least `window` characters of `alphabet`; linear in its length."""
    codes = F.transform(F.split(text, ""), lambda c: F.position(c, alphabet) - 1)

    def follow(code: Column) -> Column:
        first = F.slice(code, 1, window)
        counts = F.transform(F.sequence(F.lit(0), F.length(alphabet) - 1), lambda a: F.size(F.filter(first, lambda c: c == a)))
        rest = F.size(code) - window
        moves = F.zip_with(F.slice(code, F.lit(1), rest), F.slice(code, F.lit(window + 1), rest), lambda out, into: F.struct(out.alias("o"), into.alias("i")))

        def begun(c: Column) -> Column:
            total = F.aggregate(c, F.lit(0.0), lambda acc, n: acc + _xlog(n))
            return F.aggregate(moves, F.struct(c.alias("c"), total.alias("t"), total.alias("low")), step, lambda acc: acc["low"])

        return bound(counts, begun)

    def step(acc, x):
        out, into = x["o"], x["i"]
        gone, there = F.get(acc["c"], out), F.get(acc["c"], into)
        changed = acc["t"] - _xlog(gone) + _xlog(gone - 1) - _xlog(there) + _xlog(there + 1)
        t = F.when(out == into, acc["t"]).otherwise(changed)
        counts = F.transform(acc["c"], lambda c, j: c - (j == out).cast("int") + (j == into).cast("int"))
        return bound(t, lambda t: F.struct(counts.alias("c"), t.alias("t"), F.least(acc["low"], t).alias("low")))

    return F.log2(F.lit(float(window))) - bound(codes, follow) / float(window)


def is_high(text: Column) -> Column:
    """Whether a candidate's class has a threshold and its entropy reaches it, and nothing allows it."""
    alphabet, least = F.lit(None).cast("string"), F.lit(None).cast("double")
    for regex, chars, bits in reversed(CLASSES):
        fits = F.regexp_like(text, F.lit(regex))
        alphabet, least = F.when(fits, chars).otherwise(alphabet), F.when(fits, bits).otherwise(least)
    allowed = F.lit(False)
    for regex in ALLOW:
        allowed = allowed | F.regexp_like(text, F.lit(regex))
    kind = F.when(~allowed, F.struct(alphabet.alias("a"), least.alias("b")))
    pieces = F.filter(F.split(text, WORDS, -1), lambda p: F.length(p) >= WINDOW)
    return bound(kind, lambda k: F.when(k["a"].isNull(), False).otherwise(F.exists(pieces, lambda p: window_entropy(p, k["a"]) >= k["b"])))


def _uncovered(spans: Column) -> Column:
    """Spans by start, then kind, without the entropy spans that a base span holds: one that starts no later and reaches as far."""
    added = lambda x: x["k"] == len(BASE)

    def kept(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: F.when(added(x), -1).otherwise(x["e"])), lambda a, b: F.greatest(a, b), -1)
        return F.array_compact(F.zip_with(xs, reach, lambda x, r: F.when(~(added(x) & (r >= x["e"])), x)))

    return bound(spans, kept)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_base` and `_all`: arrays of spans (s, k: number of the kind, e) by start, then kind."""
    out = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    for i, (_, regex, group, _least) in enumerate(BASE):
        out = out.withColumn(f"_m{i}", _matches(F.col("_t"), regex, group))
    out = out.withColumn("_m3", _matches(F.col("_t"), CANDIDATE, 0))
    for i, (_, _, _, least) in enumerate(BASE):
        out = out.withColumn(f"_s{i}", _located(F.col(f"_m{i}"), ("p", "m", "g"), lambda m, g, n=least: F.length(g) >= n, i))
    out = out.withColumn("_s3", _located(F.col("_m3"), ("p", "m", "g"), lambda m, g: is_high(m), 3))
    out = out.withColumn("_base", F.array_sort(F.concat("_s0", "_s1", "_s2")))
    out = out.withColumn("_all", _uncovered(F.array_sort(F.concat("_base", "_s3"))))
    return out.drop("_m0", "_m1", "_m2", "_m3", "_s3")


def spans_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, counts by base kind, digest of the base spans, all spans as text, and their number."""
    df = find_secrets(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    return df.select(
        id_col,
        F.size("_s0").cast("long").alias("n_assign"), F.size("_s1").cast("long").alias("n_access"), F.size("_s2").cast("long").alias("n_hex"),
        F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"),
        spans_text(F.col("_all")).alias("spans"),
        F.size("_all").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text_col` replaced by `mark`; overlapping spans are replaced as one.

    All columns stay, whatever their names: they are renamed by position meanwhile.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    told = f"c{names.index(text_col)}"
    t = F.col("_t")

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, from its pieces of PIECE characters: to find a place in a whole text takes time in its length."""
        lo = lambda j: F.greatest(a - j * PIECE, F.lit(0))
        part = lambda j: F.substr(F.get(pieces, j), lo(j) + 1, F.least(b - j * PIECE, F.lit(PIECE)) - lo(j))
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        return F.when(b <= a, "").otherwise(F.array_join(F.transform(F.sequence(first, last), part), ""))

    def kept(pieces: Column) -> Column:
        reach = running(F.transform("_all", lambda x: x["e"]), lambda a, b: F.greatest(a, b), 0)
        gaps = F.array_compact(F.zip_with("_all", reach, lambda x, r: F.when(x["s"] >= r, F.struct(r.alias("a"), x["s"].alias("b")))))
        rest = F.struct(F.array_max(F.transform("_all", lambda x: x["e"])).alias("a"), F.length(t).alias("b"))
        return F.array_join(F.transform(F.concat(gaps, F.array(rest)), lambda g: between(pieces, g["a"], g["b"])), mark)

    done = bound(F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), kept)
    changed = find_secrets(plain, told).withColumn(told, F.when(F.size("_all") > 0, done).otherwise(F.col(told)))
    return changed.select(*plain.columns).toDF(*names)
