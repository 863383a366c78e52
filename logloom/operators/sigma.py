"""Sigma rules compiled to column expressions; all rules are judged in one scan.

Two-valued: every leaf is coalesced to false, so `not selection` holds where a field is missing. AND
and OR have equal precedence and associate to the left, unless `strict_precedence`.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import get_active_spark_context

from logloom.functions.scalars import SIGMA_THRESHOLD


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    detection: dict
    logsource: dict = field(default_factory=dict)
    tags: tuple[str, ...] = ()
    pack: str = ""


def _words(pack: str, rule: str, title: str, level: str, words: list[str], *tags: str) -> Rule:
    """A rule for messages that contain one of some words."""
    return Rule(f"{pack}-{rule}", title, level, {"selection": {"message|contains": words}, "condition": "selection"}, {"product": "any"}, tuple(f"attack.{t}" for t in tags), pack)


def _levels(pack: str, rule: str, title: str, level: str, levels: list[str], *tags: str) -> Rule:
    return Rule(f"{pack}-{rule}", title, level, {"selection": {"level": levels}, "condition": "selection"}, {"product": "any"}, tuple(f"attack.{t}" for t in tags), pack)


#: The four built-in packs of five rules each.
BUILT_IN = (
    _levels("startup-reliability", "high-error-rate", "High Error Rate Detection", "high", ["error", "critical"], "impact", "t1499"),
    _levels("startup-reliability", "critical-errors", "Critical System Errors", "critical", ["critical"], "impact"),
    _words("startup-reliability", "oom-crashes", "Out of Memory Detection", "critical", ["out of memory", "OutOfMemory", "OOM", "heap space", "memory exhausted", "ENOMEM", "Cannot allocate memory"], "impact", "t1499.004"),
    _words("startup-reliability", "unhandled-exceptions", "Unhandled Exceptions", "high", ["unhandled exception", "uncaught exception", "UnhandledException", "UncaughtException", "fatal error", "panic:", "FATAL"], "impact"),
    _words("startup-reliability", "service-crash", "Service Crash Detection", "critical", ["crashed", "terminated unexpectedly", "segmentation fault", "SIGSEGV", "SIGKILL", "core dumped", "process exited"], "impact", "t1489"),
    _words("auth-security", "failed-login-attempts", "Failed Login Attempts", "medium", ["failed login", "login failed", "authentication failed", "invalid password", "invalid credentials", "wrong password", "access denied", "unauthorized"], "credential_access", "t1110", "t1110.001"),
    _words("auth-security", "brute-force-detection", "Brute Force Attack Detection", "high", ["too many attempts", "account locked", "temporarily blocked", "rate limited", "brute force", "multiple failed"], "credential_access", "t1110.001", "t1110.003"),
    _words("auth-security", "suspicious-user-agent", "Suspicious User Agent", "high", ["sqlmap", "nikto", "nmap", "masscan", "burp", "dirbuster", "gobuster", "hydra", "medusa"], "reconnaissance", "t1595", "t1592"),
    _words("auth-security", "privilege-escalation", "Privilege Escalation Attempt", "high", ["privilege escalation", "unauthorized admin", "forbidden", "insufficient permissions", "not authorized", "access violation", "elevated privileges"], "privilege_escalation", "t1078", "t1548"),
    _words("auth-security", "session-hijacking", "Session Hijacking Detection", "high", ["session hijack", "token stolen", "invalid session", "session expired", "session mismatch", "concurrent session", "session replay"], "credential_access", "t1539", "t1550"),
    _words("database-health", "slow-query-detection", "Slow Query Detection", "medium", ["slow query", "query timeout", "long running query", "execution time exceeded", "query took"], "impact", "t1499.001"),
    _words("database-health", "connection-pool-exhaustion", "Connection Pool Exhaustion", "high", ["connection pool", "pool exhausted", "no available connections", "connection timeout", "max connections", "too many connections"], "impact", "t1499"),
    _words("database-health", "deadlock-detection", "Database Deadlock Detection", "high", ["deadlock", "lock wait timeout", "transaction aborted", "lock conflict", "concurrent update"], "impact"),
    _words("database-health", "replication-issues", "Replication Issues", "high", ["replication lag", "replica behind", "sync failed", "replication error", "slave lag", "standby lag"], "impact"),
    _words("database-health", "sql-injection-attempt", "SQL Injection Attempt", "critical", ["sql injection", "syntax error", "malformed query", "UNION SELECT", "OR 1=1", "' OR '", "-- -", "DROP TABLE"], "initial_access", "t1190", "t1059.005"),
    _words("payment-billing", "payment-failure", "Payment Failure Detection", "high", ["payment failed", "transaction declined", "card declined", "insufficient funds", "payment error", "charge failed"], "impact"),
    _words("payment-billing", "webhook-failure", "Payment Webhook Failure", "medium", ["webhook failed", "webhook error", "stripe webhook", "payment notification failed", "IPN failed"], "impact"),
    _words("payment-billing", "fraud-indicators", "Fraud Indicator Detection", "critical", ["fraud", "suspicious transaction", "velocity check", "risk score", "blocked transaction", "card testing"], "impact", "t1657"),
    _words("payment-billing", "chargeback-refund", "Chargeback/Refund Activity", "medium", ["chargeback", "refund", "dispute", "reversed", "money back"], "impact"),
    _words("payment-billing", "payment-gateway-error", "Payment Gateway Errors", "high", ["gateway error", "payment gateway", "stripe error", "paypal error", "gateway timeout", "payment timeout"], "impact"),
)

#: Own rules by pack.
PACKS = (
    Rule("auth-1", "Failed login", "medium", {"sel": {"message|contains": ["failed login", "authentication failure"]}, "condition": "sel"}, tags=("attack.credential_access", "attack.t1110"), pack="auth"),
    Rule("auth-2", "Privilege escalation", "high", {"sel": {"message|contains": ["sudo:", "privilege escalation"]}, "err": {"level": ["debug"]}, "condition": "sel and not err"}, tags=("attack.privilege_escalation", "attack.t1068"), pack="auth"),
    Rule("web-1", "SQL injection", "critical", {"sel": {"message|re": r"(or 1=1|union select)"}, "condition": "sel"}, tags=("attack.initial_access", "attack.t1190"), pack="web"),
    Rule("web-2", "Path traversal", "high", {"sel": {"message|contains": ["../../", "/etc/passwd"]}, "condition": "sel"}, tags=("attack.discovery", "attack.t1083"), pack="web"),
    Rule("web-3", "Script injection", "high", {"sel": {"message": "*<script>*"}, "condition": "1 of sel*"}, tags=("attack.execution", "attack.t1059.007"), pack="web"),
    Rule("ops-1", "Timeouts", "low", {"kw": ["timeout", "timed out"], "lvl": {"level": ["error", "critical"]}, "condition": "all of them"}, pack="ops"),
    Rule("ops-2", "Payment failure", "medium", {"sel": {"service": "payment-service"}, "lvl": {"level|startswith": "err"}, "condition": "sel and lvl"}, pack="ops"),
)


def compiles(pattern: str) -> bool:
    """Whether the engine takes a regular expression; a rule with another one matches nothing, and the rest are none the worse for it."""
    try:
        get_active_spark_context()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def _leaf(c: Column, value, modifier: str) -> Column:
    if modifier == "exists":
        return c.isNotNull() if value in (True, "true") else c.isNull()
    v, low = str(value), F.lower(c)
    if modifier == "contains":
        out = low.contains(v.lower())
    elif modifier == "startswith":
        out = low.startswith(v.lower())
    elif modifier == "endswith":
        out = low.endswith(v.lower())
    elif modifier == "re":
        out = F.regexp_like(low, F.lit(v.lower()) if v.lower() == v else F.lit("(?i)" + v)) if compiles(v) else F.lit(False)
    elif modifier == "all":
        out = F.lit(True)
        for word in v.lower().split():
            out = out & low.contains(word)
    elif modifier in ("base64", "base64offset"):
        # any text decodes: foreign characters are passed over, so padding in front of it (an offset) changes nothing; the
        # cleaned text is bound once, as every mention of a column repeats its work
        plain = F.regexp_replace(F.translate(c, "-_", "+/"), "[^A-Za-z0-9+/]+", "")
        whole = F.transform(F.array(plain), lambda p: F.substring(p, F.lit(1), F.length(p) - F.when(F.length(p) % 4 == 1, 1).otherwise(0)))
        out = F.lower(F.unbase64(F.get(whole, F.lit(0))).cast("string")).contains(v.lower())
    elif modifier:
        out = F.lit(False)
    elif "*" in v or "?" in v:
        parts = [{"*": ".*", "?": "."}.get(x) or re.escape(x) for x in re.split(r"([*?])", v.lower()) if x]
        out = F.regexp_like(low, F.lit("(?s)^" + "".join(parts) + r"\z"))
    else:
        out = low == v.lower()
    return F.coalesce(out, F.lit(False))


def field_of(name: str, columns: dict[str, str]) -> Column:
    """A column; else a field of metadata: at any depth as `metadata.a.b`, at the top by its own name."""
    if name in columns:
        return F.col(name)
    if "metadata" not in columns:
        return F.lit(None).cast("string")
    parts = name.split(".")[1:] if name.startswith("metadata.") else [name]
    return F.get_json_object("metadata", "$" + "".join(f"['{p}']" for p in parts))


def fields_of(rule: Rule) -> list[str]:
    """Names of the fields that a rule's selections name, modifiers aside, in order."""
    maps = [m for k, s in rule.detection.items() if k not in ("condition", "timeframe") for m in (s if isinstance(s, list) else [s]) if isinstance(m, dict)]
    return list(dict.fromkeys(key.split("|")[0] for m in maps for key in m))


def selection(spec, columns: dict[str, str]) -> Column:
    """A map: all fields; a list of maps: any; a list of words: keywords in any text column."""
    if isinstance(spec, list) and all(not isinstance(x, dict) for x in spec):
        out = F.lit(False)
        for name, kind in columns.items():
            for word in spec if kind == "string" else ():
                out = out | _leaf(F.col(name), word, "contains")
        return out
    if isinstance(spec, list):
        out = F.lit(False)
        for x in spec:
            out = out | selection(x, columns)
        return out
    if not spec:
        return F.lit(False)
    out = F.lit(True)
    for key, wanted in spec.items():
        name, *modifiers = key.split("|")
        c = field_of(name, columns)
        one = F.lit(False)
        for value in wanted if isinstance(wanted, list) else [wanted]:
            one = one | (_leaf(c, value, modifiers[0] if modifiers else "") if value is not None else F.lit(False))
        out = out & one
    return out


def condition(text: str, detection: dict, columns: dict[str, str], strict_precedence: bool = False) -> Column:
    names = {k.lower(): v for k, v in detection.items() if k not in ("condition", "timeframe")}
    tokens = re.findall(r"\(|\)|[^\s()]+", text.lower())
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def matching(pattern: str) -> list[Column]:
        keep = list(names) if pattern == "them" else [n for n in names if re.fullmatch(pattern.replace("*", ".*"), n)]
        return [selection(names[n], columns) for n in keep]

    def term() -> Column:
        t = take() if peek() else ""
        if t == "not":
            return ~term()
        if t == "(":
            inner = expression()
            if peek() == ")":
                take()
            return inner
        if (t.isdigit() or t in ("all", "any")) and peek() == "of":
            take()
            found = matching(take() if peek() else "them")
            need = len(found) if t == "all" else 1 if t == "any" else int(t)
            hits = F.lit(0)
            for f in found:
                hits = hits + f.cast("int")
            return (hits >= need) if found else F.lit(False)
        return selection(names[t], columns) if t in names else F.lit(False)

    def chain(ops: tuple[str, ...], below) -> Column:
        out = below()
        while peek() in ops:
            op, right = take(), below()
            out = (out & right) if op == "and" else (out | right)
        return out

    def expression() -> Column:
        return chain(("or",), lambda: chain(("and",), term)) if strict_precedence else chain(("and", "or"), term)

    return expression()


def source_gate(logsource: dict, columns: dict[str, str]) -> Column:
    """Service, product and category that a rule names must be the log's, case aside; `*` stands for anything.

    A log whose own value is `unknown` passes, and so does every log where the rule says product `any`. Product
    and category are looked for in metadata, then in columns; the category falls back to the service.
    """
    inner = lambda name: F.get_json_object("metadata", f"$.{name}") if "metadata" in columns else F.lit(None).cast("string")
    column = lambda name: F.nullif(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit(None).cast("string")
    told = {
        "service": column("service"),
        "product": F.coalesce(F.nullif(inner("product"), F.lit("")), column("product")),
        "category": F.coalesce(F.nullif(inner("category"), F.lit("")), column("category"), column("service")),
    }
    out = F.lit(True)
    for name, value in told.items():
        wanted = str(logsource.get(name) or "").lower()
        if wanted and (name, wanted) != ("product", "any"):
            have = F.lower(F.coalesce(value, F.lit("")))
            fits = F.regexp_like(have, F.lit("(?s)^" + ".*".join(map(re.escape, wanted.split("*"))) + r"\z")) if "*" in wanted else have == wanted
            out = out & (fits | (have == "unknown"))
    return out


def compiled(rule: Rule, logs: DataFrame) -> Column:
    columns = dict(logs.dtypes)
    return source_gate(rule.logsource, columns) & condition(rule.detection.get("condition", ""), rule.detection, columns)


LEVELS = ("informational", "low", "medium", "high", "critical")
#: Categories whose logs come from services of any name.
GENERIC = frozenset("webserver proxy firewall dns antivirus".split())


def parsed(told: dict) -> Rule:
    """A rule as read from a file; ValueError says what is wrong with it."""
    detection, logsource = told.get("detection"), told.get("logsource") or {}
    wrong = [name for name, ok in (
        ("title", isinstance(told.get("title"), str) and told["title"].strip()), ("detection", isinstance(detection, dict) and isinstance(detection.get("condition"), str) and len(detection) > 1),
        ("logsource", isinstance(logsource, dict)), ("level", (told.get("level") or "medium") in LEVELS),
    ) if not ok]
    if wrong:
        raise ValueError("no proper " + ", ".join(wrong))
    title = told["title"].strip()
    return Rule(str(told.get("id") or title.lower().replace(" ", "-")), title, told.get("level") or "medium", detection, logsource, tuple(map(str, told.get("tags") or ())), str(told.get("pack") or ""))


def read_rules(spark, path: str) -> list[Rule]:
    """Rules of JSON lines; those that aren't proper are passed over. As many as users write, so the driver holds them."""
    out = []
    for r in spark.read.text(path).collect():
        try:
            out.append(parsed(json.loads(r["value"])))
        except ValueError:
            continue
    return out


def selected(rules: DataFrame, organization: int, project: int | None = None) -> DataFrame:
    """Enabled, converted rules of an organization: those of a project and those of none, or all."""
    mine = rules.where((F.col("organization_id") == organization) & F.col("status").isin("success", "partial") & F.col("enabled"))
    return mine if project is None else mine.where((F.col("project_id") == project) | F.col("project_id").isNull())


def keywords(spec) -> list[str]:
    """All texts of a detection, its condition aside, each once."""
    def walk(x):
        if isinstance(x, str):
            yield x
        elif isinstance(x, list | tuple | dict):
            for y in x.values() if isinstance(x, dict) else x:
                yield from walk(y)

    return list(dict.fromkeys(walk({k: v for k, v in spec.items() if k != "condition"})))


def alert_rule(rule: Rule) -> dict:
    """The threshold alert that stands for a rule: any level, its service unless the category is generic, threshold and window by level."""
    threshold, window = SIGMA_THRESHOLD[rule.level]
    service = None if rule.logsource.get("category") in GENERIC else rule.logsource.get("service") or rule.logsource.get("product")
    return {"rule_id": rule.id, "name": rule.title, "service": service, "levels": "debug,info,warn,error,critical", "threshold": threshold, "time_window": window, "keywords": keywords(rule.detection)}


def alert_rules(spark, rules) -> DataFrame:
    return spark.createDataFrame([alert_rule(r) for r in rules], "rule_id string, name string, service string, levels string, threshold int, time_window int, keywords array<string>")


def packs(rules) -> dict[str, int]:
    """Rules by pack."""
    return dict(Counter(r.pack for r in rules))


def pack_counts(enabled: DataFrame, names: list[str]) -> DataFrame:
    """pack, n: enabled rules (rule_id) by the first of the packs whose name and a dash their id starts with."""
    pack = F.lit(None).cast("string")
    for name in reversed(names):
        pack = F.when(F.col("rule_id").startswith(name + "-"), name).otherwise(pack)
    return enabled.withColumn("pack", pack).where("pack is not null").groupBy("pack").agg(F.count("*").alias("n"))


def mitre(tags) -> tuple[list[str], list[str]]:
    """(tactics, techniques) of attack.* tags: techniques look like t1234 or t1234.001, the rest are tactics."""
    found = [t[7:] for t in tags if t.startswith("attack.")]
    technique = re.compile(r"t\d{4}(\.\d{3})?$")
    return [t for t in found if not technique.match(t)], [t.upper() for t in found if technique.match(t)]


def matched(logs: DataFrame, rules=PACKS) -> DataFrame:
    """log_id, rule_id, title, severity, tags, fields: as detect, with a rule's tags and the log's values of the fields it names (JSON)."""
    columns, told = dict(logs.dtypes), []
    for r in rules:
        values = [field_of(n, columns).cast("string").alias(n) for n in fields_of(r)]
        fields = F.to_json(F.struct(*values)) if values else F.lit("{}")
        told.append(F.when(compiled(r, logs), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("title"), F.lit(r.level).alias("severity"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"), fields.alias("fields"))))
    return logs.select(F.col("id").alias("log_id"), F.explode(F.array_compact(F.array(*told))).alias("_hit")).select("log_id", "_hit.*")


def with_stored_mitre(detections: DataFrame, stored: DataFrame) -> DataFrame:
    """Detections whose rule has stored tactics and techniques (rule_id, tactics, techniques) take these in place of the tags'."""
    own = stored.select("rule_id", F.col("tactics").alias("_ta"), F.col("techniques").alias("_te"))
    pick = lambda mine, tags: F.when(F.size(F.coalesce(mine, F.array())) > 0, F.col(mine)).otherwise(F.col(tags)).alias(tags)
    joined = detections.join(own, "rule_id", "left")
    return joined.select(*[pick({"tactics": "_ta", "techniques": "_te"}[c], c) if c in ("tactics", "techniques") else c for c in detections.columns])


def detect(logs: DataFrame, rules=PACKS) -> DataFrame:
    """One row for each log and rule that fits it. All rules are boolean columns of one scan; no join."""
    told = []
    for r in rules:
        tactics, techniques = mitre(r.tags)
        array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        told.append(F.when(compiled(r, logs), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("title"), F.lit(r.level).alias("severity"), array(tactics).alias("tactics"), array(techniques).alias("techniques"))))
    hits = logs.withColumn("_hit", F.explode(F.array_compact(F.array(*told))))
    return hits.select(F.col("id").alias("log_id"), "time", "project_id", "service", "level", "message", "trace_id", "_hit.*")
