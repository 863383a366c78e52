"""URL filters [native].

Host rules: a rule `host/path` fits its host and every subdomain when the url's path starts with
the rule's path; the longest rule wins. Pattern rules: each is filed under the literal token of it
that is rarest in the table's urls. The tokens of a url fetch its candidate rules from that index,
and only candidates run their regular expression. The index is a literal array of SLOTS slots by a
token's CRC-32, so its look-up takes the same time for any number of rules. Everything is a column
expression: no shuffle besides the count of rule tokens, no join, no Python.

Defined results: a null url, or one without `://`, has empty host and path, fits no host rule, and
is judged by the patterns alone (null: allow). Rows are judged one by one, so repeated ids stay
repeated. Only the id and url columns are read; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower


@dataclass(frozen=True)
class Pattern:
    """`tokens` are whole [a-z0-9]+ tokens that every url matching `regex` contains."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


#: Host rules (rule, verdict).
HOST_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

#: Topics of pattern rules, and words that make a topic's word an offer when joined to it.
TOPICS = {
    "gambling": "casino casinos poker bets betting bingo blackjack jackpot lottery roulette slots sportsbook".split(),
    "pharmacy": "cialis pharmacy pills steroids tramadol viagra".split(),
    "adult": "adult cams escort escorts hentai nude porn sex xxx".split(),
    "finance": "airdrop forex giveaway loans payday".split(),
    "piracy": "crack cracked keygen nulled serial torrent torrents warez".split(),
    "replica": "handbags replica watches".split(),
    "links": "backlinks link seo spam".split(),
    "tracking": "ads adserver clicks popunder tracker".split(),
}
OFFERS = "best bonus buy cheap club deals download farm free hot live online shop top track win world x".split()
_CUT, _END = "[^a-z0-9]", "([^a-z0-9]|$)"


def offer_patterns(topics: dict[str, list[str]] = TOPICS, offers: list[str] = OFFERS) -> tuple[Pattern, ...]:
    """A rule for each topic word and offer word: either order, joined by one of `- _ . / +`."""
    rule = lambda topic, w, o: Pattern(f"{topic}:{w}+{o}", "block", f"{_CUT}({w}[-_./+]{o}|{o}[-_./+]{w}){_END}", (w, o))
    return tuple(rule(t, w, o) for t, ws in topics.items() for w in ws for o in offers)


#: Pattern rules, judged where no host rule fits; the first that fits decides. The first five are fixed values.
PATTERNS = (
    Pattern("ad-path", "block", r"/ads/", ("ads",)),
    Pattern("adserver-path", "block", r"/adserver/", ("adserver",)),
    Pattern("popunder", "block", r"[^a-z0-9]popunder([^a-z0-9]|$)", ("popunder",)),
    Pattern("tracker-host", "block", r"://([^/?#]*\.)?tracker\.", ("tracker",)),
    Pattern("session-id", "block", r"[?&;]phpsessid=[0-9a-f]{16,}", ("phpsessid",)),
    *offer_patterns(),
)
SLOTS = 1024


def host_and_path(url):
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits_any(patterns: tuple[Pattern, ...], text: str, i: str) -> str:
    """SQL: whether pattern number `i` fits `text`, found by halving; only that one runs, and each keeps its compiled expression."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pick(low: int, high: int) -> str:
        mid = (low + high) // 2
        return f"regexp_like({text}, {quoted(patterns[low].regex)})" if high - low == 1 else f"if({i} < {mid}, {pick(low, mid)}, {pick(mid, high)})"

    return pick(0, len(patterns))


def rarest_tokens(urls: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, url: str = "url") -> dict[str, list[int]]:
    """Index token -> pattern numbers. Counts only tokens that occur in rules, so what reaches the driver is bounded by the rules."""
    names = sorted({t for p in patterns for t in p.tokens})
    if not names:
        return {}
    tokens = urls.select(F.explode(F.array_intersect(F.split(ascii_lower(F.col(url)), "[^a-z0-9]+"), F.array(*map(F.lit, names)))).alias("token"))
    seen = {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        index.setdefault(min(p.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(i)
    return index


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns: tuple[Pattern, ...] = PATTERNS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict, and the pattern that decided (null if none)."""
    index = rarest_tokens(pages, patterns, url_col)
    df = pages.select(F.col(id_col), F.col(url_col).alias("_u"))
    host, path = host_and_path(F.col("_u"))
    df = df.select(id_col, "_u", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def fits(rule: str):
        rule_host, slash, rule_path = rule.partition("/")
        return (F.col("host").eqNullSafe(rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(slash + rule_path)

    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, verdict in sorted(host_rules, key=lambda r: len(r[0])):
        rule, ruled = F.when(fits(name), name).otherwise(rule), F.when(fits(name), verdict).otherwise(ruled)
    if index:
        slots: list[list[dict]] = [[] for _ in range(SLOTS)]
        for token, ids in sorted(index.items()):
            slots[zlib.crc32(token.encode()) % SLOTS].append({"t": token, "ids": ids})
        filed = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,ids:array<int>>>>")
        tokens = F.array_distinct(F.split("_low", "[^a-z0-9]+"))
        fetched = F.transform(tokens, lambda t: F.filter(F.get(filed, (F.crc32(t) % SLOTS).cast("int")), lambda e: e["t"] == t))
        df = df.withColumn("_low", ascii_lower(F.col("_u"))).withColumn("_ids", F.flatten(F.transform(F.flatten(fetched), lambda e: e["ids"])))
        hit = F.expr(f"array_min(filter(_ids, i -> {fits_any(patterns, '_low', 'i')}))")  # as text: a thousand column objects are slow to build
        df = df.withColumn("_hit", hit)
        of_hit = lambda told: F.get(F.from_json(F.lit(json.dumps(told)), "array<string>"), F.col("_hit"))
        name, method = of_hit([p.name for p in patterns]), of_hit([p.verdict for p in patterns])
    else:
        name = method = F.lit(None).cast("string")
    df = df.withColumn("rule", rule).withColumn("_ruled", ruled)
    return df.select(
        id_col, "host", "path", "rule",
        F.coalesce("_ruled", method, F.lit(default)).alias("verdict"),
        F.when(F.col("_ruled").isNull(), name).alias("pattern"),
    )


def oracle(host_rules=HOST_RULES, patterns=PATTERNS) -> str:
    """The same judgement in plain SQL: every rule on every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    fits = lambda r: f"(host = {quote(r.partition('/')[0])} or ends_with(host, {quote('.' + r.partition('/')[0])})) and starts_with(path, {quote('/' + r.partition('/')[2])})"
    ordered = sorted(host_rules, key=lambda r: -len(r[0]))
    rule = "case " + " ".join(f"when {fits(r)} then {quote(r)}" for r, _ in ordered) + " end"
    ruled = "case " + " ".join(f"when {fits(r)} then {quote(v)}" for r, v in ordered) + " end"
    hit = "case " + " ".join(f"when regexp_matches({low}, {quote(p.regex)}) then {quote(p.name)}" for p in patterns) + " end"
    method = "case " + " ".join(f"when regexp_matches({low}, {quote(p.regex)}) then {quote(p.verdict)}" for p in patterns) + " else 'allow' end"
    return f"""
with parts as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, url,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), judged as (select *, {rule} as rule, {ruled} as ruled, {hit} as hit, {method} as method from cut)
select page_id, host, path, rule, coalesce(ruled, method) as verdict, case when ruled is null then hit end as pattern from judged"""
