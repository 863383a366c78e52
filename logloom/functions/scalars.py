"""Scalar functions of the log, trace and detection model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level aliases, OTLP severities, span kinds, statuses, severity weights, Sigma thresholds (count, seconds).
LEVEL_ALIASES = {"fatal": "critical", "panic": "critical", "emerg": "critical", "emergency": "critical", "alert": "critical", "crit": "critical", "critical": "critical", "err": "error", "error": "error", "warning": "warn", "warn": "warn", "notice": "info", "information": "info", "info": "info", "trace": "debug", "verbose": "debug", "debug": "debug"}
SEVERITY_WORDS = (("trace", "debug"), ("debug", "debug"), ("info", "info"), ("warn", "warn"), ("error", "error"), ("fatal", "critical"), ("critical", "critical"))
SPAN_KINDS = ("INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUSES = ("UNSET", "OK", "ERROR")
SEVERITY_WEIGHT = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}
SIGMA_THRESHOLD = {"critical": (1, 60), "high": (3, 300), "medium": (5, 600), "low": (10, 1800), "informational": (20, 3600)}


def _mapped(c: Column, pairs, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(pairs)):
        out = F.when(c == k, v).otherwise(out)
    return out


def level_of(raw: Column) -> Column:
    """Level from a number (pino scale) or a name; a null or unknown name is info, an empty string debug."""
    n = F.trim(raw).try_cast("double")
    by_number = F.when(n >= 60, "critical").when(n >= 50, "error").when(n >= 40, "warn").when(n >= 30, "info").otherwise("debug")
    return F.when(F.trim(raw) == "", "debug").when(n.isNotNull(), by_number).otherwise(_mapped(F.lower(raw), LEVEL_ALIASES.items(), "info"))


def level_of_priority(p: Column) -> Column:
    return F.when(p <= 2, "critical").when(p == 3, "error").when(p == 4, "warn").when(p <= 6, "info").otherwise("debug")


def level_of_otlp(text: Column, number: Column) -> Column:
    """Severity text first, by the first word it contains; else the number's band; 0 or null: info."""
    out = F.when(number >= 21, "critical").when(number >= 17, "error").when(number >= 13, "warn").when(number >= 9, "info").when(number >= 1, "debug").otherwise("info")
    for word, level in reversed(SEVERITY_WORDS):
        out = F.when(F.lower(text).contains(word), level).otherwise(out)
    return out


def span_kind(n: Column) -> Column:
    return _mapped(n, enumerate(SPAN_KINDS, 1))


def span_status(n: Column) -> Column:
    return _mapped(n, enumerate(STATUSES))


def severity_weight(s: Column) -> Column:
    return _mapped(s, SEVERITY_WEIGHT.items(), 0)


def sigma_threshold(level: Column) -> Column:
    """struct(matches, seconds) of a rule's level; nulls for an unknown one."""
    part = lambda i: _mapped(level, [(k, v[i]) for k, v in SIGMA_THRESHOLD.items()])
    return F.struct(part(0).alias("matches"), part(1).alias("seconds"))


TECHNIQUE = r"^t[0-9]{4}(\.[0-9]{3})?\z"


def _attack(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: t.startswith("attack.")), lambda t: F.substring(t, 8, 1_000_000))


def mitre_tactics(tags: Column) -> Column:
    """attack.* tags that aren't techniques."""
    return F.filter(_attack(tags), lambda t: ~t.rlike(TECHNIQUE))


def mitre_techniques(tags: Column) -> Column:
    return F.transform(F.filter(_attack(tags), lambda t: t.rlike(TECHNIQUE)), F.upper)


def ns_to_ms(n: Column) -> Column:
    """Whole milliseconds, truncated toward zero; null for what is no 64-bit number."""
    return F.call_function("div", n.try_cast("bigint"), F.lit(1_000_000).cast("bigint"))


def valid_trace_id(t: Column) -> Column:
    return F.when((t == "") | t.rlike(r"^0+\z"), None).otherwise(t)


def id_to_hex(t: Column) -> Column:
    """Hex stays (lower-cased); anything else is base64 of the bytes; what is neither is null."""
    return F.when(t.rlike(r"^[0-9a-fA-F]+\z"), F.lower(t)).otherwise(F.lower(F.hex(F.try_to_binary(t, F.lit("base64")))))


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1, "<1ms").when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.2fs", ms / 1000.0)).otherwise(F.format_string("%.2fm", ms / 60000.0))


#: Folders before the part of a path that stays the same on every machine, dropped in this order.
MACHINE_FOLDERS = (r"/app/", r"/home/[^/]+/", r"/var/www/", r"C:\\[^\\]+\\", r"/Users/[^/]+/")
#: Variable parts of a message and what stands for them, in this order (so the digits of a hex number are gone before it is looked for).
VARIABLE_PARTS = ((r"[0-9]+", "N"), (r"(?i)0x[0-9a-f]+", "0xHEX"), (r"'[^']*'", "'STRING'"), (r'"[^"]*"', '"STRING"'), (r"\[[^\]]*\]", "[ARRAY]"), (r"\{[^}]*\}", "{OBJECT}"), (r"^\s+|\s+$", ""))


def stack_path(p: Column) -> Column:
    """Normalised path of a stack frame: without a machine's own folders, with slashes."""
    for folder in MACHINE_FOLDERS:
        p = F.regexp_replace(p, "^" + folder, "")
    return F.replace(p, F.lit("\\"), F.lit("/"))


def message_shape(m: Column) -> Column:
    """Message with its variable parts replaced."""
    for part, name in VARIABLE_PARTS:
        m = F.regexp_replace(m, part, name)
    return m


#: Numbers of levels in OTLP.
OTLP_NUMBERS = {"debug": 5, "info": 9, "warn": 13, "error": 17, "critical": 21}


def otlp_of_level(level: Column) -> Column:
    return _mapped(level, OTLP_NUMBERS.items(), 9)


def ns_to_iso(n: Column) -> Column:
    """UTC time of nanoseconds since 1970, to the millisecond; beyond 64 bits (the year 2262) as decimals, up to 8.64e15 ms as Date in JavaScript."""
    wide = n.try_cast("decimal(38, 0)")
    ms = F.coalesce(ns_to_ms(n), F.when(F.abs(wide) <= F.lit("8640000000000000000000").cast("decimal(38, 0)"), F.call_function("div", wide, F.lit(1_000_000).cast("decimal(38, 0)"))))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def severity_label(s: Column) -> Column:
    return F.when(s.isin(*SEVERITY_WEIGHT), F.initcap(s)).otherwise(s)


def time_ago(then: Column, now: Column) -> Column:
    """just now, or whole minutes, hours or days ago."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    whole = lambda s: F.floor(seconds / (s * 1_000_000)).cast("bigint")
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    return F.when(whole(60) < 1, "just now").when(whole(60) < 60, told(whole(60), "minute")).when(whole(3600) < 24, told(whole(3600), "hour")).otherwise(told(whole(86_400), "day"))


#: ATT&CK tactics (number, name by id).
TACTICS = {
    "reconnaissance": ("TA0043", "Reconnaissance"), "resource_development": ("TA0042", "Resource Development"), "initial_access": ("TA0001", "Initial Access"), "execution": ("TA0002", "Execution"),
    "persistence": ("TA0003", "Persistence"), "privilege_escalation": ("TA0004", "Privilege Escalation"), "defense_evasion": ("TA0005", "Defense Evasion"), "credential_access": ("TA0006", "Credential Access"),
    "discovery": ("TA0007", "Discovery"), "lateral_movement": ("TA0008", "Lateral Movement"), "collection": ("TA0009", "Collection"), "command_and_control": ("TA0011", "Command and Control"),
    "exfiltration": ("TA0010", "Exfiltration"), "impact": ("TA0040", "Impact"),
}


def tactic_name(t: Column) -> Column:
    """Name of a tactic by id or number; other ids with words in capitals."""
    known = [(k, n) for k, (_, n) in TACTICS.items()] + [(number.lower(), n) for number, n in TACTICS.values()]
    return F.coalesce(_mapped(F.lower(t), known), F.array_join(F.transform(F.split(t, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " "))


def tactic_url(t: Column) -> Column:
    return F.concat(F.lit("https://attack.mitre.org/tactics/"), _mapped(F.lower(t), [(k, n) for k, (n, _) in TACTICS.items()], "TA0000"), F.lit("/"))


def technique_url(t: Column) -> Column:
    """Sub-techniques have a page below their technique's."""
    return F.concat(F.lit("https://attack.mitre.org/techniques/"), F.array_join(F.slice(F.split(t, r"\."), 1, 2), "/"), F.lit("/"))


def fingerprint(kind: Column, frames: Column) -> Column:
    """SHA-256 of the type and the first ten application frames' path:function. frames: array<struct<path,func,app>>."""
    own = F.slice(F.filter(frames, lambda f: f["app"]), 1, 10)
    return F.sha2(F.concat(kind, F.lit(":"), F.array_join(F.transform(own, lambda f: F.concat(f["path"], F.lit(":"), f["func"])), "|")), 256)


def public_ips(text: Column) -> Column:
    """Distinct public IPv4 addresses of a text, in order."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?:{octet}\.){{3}}{octet}\b"), F.lit(0)))
    return F.filter(found, lambda ip: ~F.regexp_like(ip, F.lit(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$)")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole)).otherwise(0.0)


def trend(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) * 100.0 / before).otherwise(0.0)
