"""A catalogue of Sigma rules kept in step with a folder of YAML files.

Files are parsed where they are read; a document that is no proper rule becomes a row with its error, and ends nothing.
sync() parses only what is new or comes with another commit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import sigma
from logloom.session import ship, written

try:
    import yaml
except ImportError:  # rules as JSON are read without it: JSON is YAML
    yaml = None

#: Characters that nest (or seem to) up to which a file goes to the fast parser in C, whose stack deep nesting would overrun.
NESTING = 2000
STATUSES = ("experimental", "test", "stable", "deprecated", "unsupported")
#: Nodes that a document may have once its aliases are spelt out.
NODES = 100_000
RULES = "path string, commit string, place int, rule_id string, title string, description string, author string, date string, level string, status string, tags array<string>, tactics array<string>, techniques array<string>, logsource string, detection string, error string"
COLUMNS = [c.split()[0] for c in RULES.split(", ")]


def files(spark: SparkSession, path: str, commit: str) -> DataFrame:
    """path, commit, content of the files at a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.lit(commit).alias("commit"), F.col("value").alias("content"))


def size(x, seen: dict | None = None) -> int:
    """Nodes of a value with every alias spelt out, found without doing so."""
    seen = {} if seen is None else seen
    if not isinstance(x, dict | list):
        return 1
    if id(x) not in seen:
        seen[id(x)] = NODES + 1  # inside itself it has no end
        seen[id(x)] = 1 + sum(size(y, seen) for y in (x.values() if isinstance(x, dict) else x))
    return seen[id(x)]


def documents(content: str) -> Iterator:
    """The documents of a YAML file."""
    if yaml is None:
        yield json.loads(content)
        return
    shallow = sum(map(content.count, "[{-:?")) <= NESTING
    for told in yaml.load_all(content, getattr(yaml, "CSafeLoader", yaml.SafeLoader) if shallow else yaml.SafeLoader):
        if size(told) > NODES:
            raise ValueError("too large with its aliases")
        yield told


def faults(told) -> list[str]:
    """What keeps a document from being a rule."""
    if not isinstance(told, dict):
        return ["no mapping"]
    detection = told.get("detection")
    checks = {
        "title": isinstance(told.get("title"), str) and bool(told["title"].strip()), "logsource": isinstance(told.get("logsource"), dict), "detection": isinstance(detection, dict),
        "detection.condition": not isinstance(detection, dict) or bool(detection.get("condition")), "level": not told.get("level") or told["level"] in sigma.LEVELS, "status": not told.get("status") or told["status"] in STATUSES,
    }
    return [f"no proper {name}" for name, ok in checks.items() if not ok]


def text(x) -> str | None:
    return None if x is None else str(x).encode("utf-8", "replace").decode()


def row(told, path: str, commit: str, place: int) -> dict:
    out = dict.fromkeys(COLUMNS) | {"path": path, "commit": commit, "place": place}
    if wrong := faults(told):
        return out | {"error": ", ".join(wrong)}
    tags = [text(t) for t in told.get("tags") or [] if t is not None] if isinstance(told.get("tags") or [], list) else [text(told["tags"])]
    tactics, techniques = sigma.mitre(tags)
    as_json = lambda x: text(json.dumps(x, ensure_ascii=False, default=str, skipkeys=True))
    plain = {k: text(told.get(k)) for k in ("description", "author", "date")}
    return out | plain | {
        "rule_id": text(told.get("id")) or told["title"].strip().lower().replace(" ", "-"), "title": text(told["title"].strip()), "level": told.get("level") or "medium", "status": told.get("status") or "stable",
        "tags": tags, "tactics": tactics, "techniques": techniques, "logsource": as_json(told["logsource"]), "detection": as_json(told["detection"]),
    }


def parsed(found: DataFrame) -> DataFrame:
    """A row for each document of files (path, commit, content): a rule, or an error."""

    def rows(path: str, commit: str, content: str | None) -> list[dict]:
        out = []
        try:
            for told in documents(content or ""):
                out.append(row(told, path, commit, len(out)))
        except Exception as e:  # noqa: BLE001  whatever a parser makes of a text that anybody may have written
            out.append(dict.fromkeys(COLUMNS) | {"path": path, "commit": commit, "place": len(out), "error": text(f"{type(e).__name__}: {e}".split("\n")[0])})
        return out or [row(None, path, commit, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [r for x in batch.to_pylist() for r in rows(x["path"], x["commit"], x["content"])]
            yield pa.RecordBatch.from_pylist(told, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(RULES))
    ship(found.sparkSession)
    return found.select("path", "commit", "content").mapInArrow(run, RULES)


def sync(catalogue: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the catalogue with what files (path, commit, content) bring, how many files were imported, skipped and failed).

    A file with the commit that the catalogue has it at is skipped unread; another replaces its rules. A file that fails leaves
    the rules that it had. Rules of files that aren't found stay.
    """
    have = catalogue.select("path", "commit").distinct()
    new = written(parsed(found.join(have, ["path", "commit"], "left_anti").repartition("path")))  # few files may hold many rules; each is parsed once
    failed = new.groupBy("path").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    good = new.join(failed.where("not failed"), "path", "left_semi")
    counts = failed.agg(F.count_if(~F.col("failed")).alias("imported"), F.count_if("failed").alias("failed"))
    skipped = found.join(have, ["path", "commit"], "left_semi").agg(F.count("*").alias("skipped"))
    one = F.lit(1).alias("_one")
    told = counts.select("*", one).join(skipped.select("*", one), "_one").select("imported", "skipped", "failed")
    return catalogue.join(good.select("path").distinct(), "path", "left_anti").unionByName(good).select(*COLUMNS), told


def titled(catalogue: DataFrame, words: str, limit: int = 50) -> DataFrame:
    """Rules whose title holds a text, case aside, by title."""
    return catalogue.where("error is null").where(F.lower("title").contains(words.lower())).orderBy("title", "rule_id", "path").limit(limit)


def rules(catalogue: DataFrame) -> list[sigma.Rule]:
    """The rules for detect(): as many as users keep, on the driver."""
    told = catalogue.where("error is null").select("rule_id", "title", "level", "detection", "logsource", "tags").orderBy("rule_id").collect()
    return [sigma.Rule(r["rule_id"], r["title"], r["level"], json.loads(r["detection"]), json.loads(r["logsource"]), tuple(r["tags"])) for r in told]
