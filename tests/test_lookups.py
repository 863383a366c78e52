"""MMDB files with networks of both families, and rule files good and bad."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import rule_catalogue, sigma
from logloom.sources import mmdb

CITY = {"country": {"iso_code": "IT", "names": {"en": "Italy"}}, "city": {"names": {"en": "Rome"}}, "location": {"latitude": 41.9, "longitude": 12.5, "time_zone": "Europe/Rome", "accuracy_radius": 20}, "subdivisions": [{"names": {"en": "Lazio"}}], "postal": {"code": "00100"}}


@pytest.mark.parametrize(("bits", "version"), [(24, 6), (28, 6), (32, 6), (28, 4)])
def test_networks_round_trip(bits, version):
    rng = random.Random(bits)
    places = {f"10.{i}.{rng.randrange(256)}.0/{rng.randrange(24, 33)}": {"n": i, "big": 1 << 70, "neg": -1.5, "yes": True, "list": [1, "x" * 400]} for i in range(60)}
    places = {str(ipaddress.ip_network(k, strict=False)): v for k, v in places.items()}
    if version == 6:
        places |= {"2001:db8::/32": CITY, "2001:db9:1::/48": {}, "::ffff:0:0/97": {"n": -0.5}}
    own = lambda name: (n := ipaddress.ip_network(name), int(n.network_address), n.prefixlen + (96 if n.version == 4 else 0))[1:]
    found = {(int.from_bytes(p, "big"), length): told for p, length, told in mmdb.networks(mmdb.written(places, bits, version))}
    assert found == {own(k): v for k, v in places.items()}


def test_pointers_and_long_values():
    section = mmdb.encoded("here") + bytes([1 << 5 | 0, 0]) + bytes([7 << 5 | 1]) + mmdb.encoded("k") + bytes([1 << 5, 0])
    assert mmdb.Data(section).at(5) == ("here", 7) and mmdb.Data(section).at(7) == ({"k": "here"}, len(section))
    long = "x" * 70_000
    assert mmdb.Data(mmdb.encoded(long)).at(0)[0] == long and mmdb.Data(mmdb.encoded({"a": "y" * 285})).at(0)[0] == {"a": "y" * 285}
    with pytest.raises(ValueError):
        list(mmdb.networks(b"nothing of the kind"))


def test_addresses_of_both_families(spark, tmp_path):
    path = tmp_path / "db.mmdb"
    path.write_bytes(mmdb.written({"203.0.113.0/24": CITY, "198.51.100.7/32": {"continent": {}}, "2001:db8::/32": CITY, "2001:db9::/128": {"country": {"iso_code": "FR"}}}))
    ips = ["203.0.113.9", "198.51.100.7", "198.51.100.8", "2001:db8:1::5", "2001:DB9::0", "2001:db9::1", "::ffff:203.0.113.9", "nonsense", "", None, "203.0.113.9"]
    rows = spark.createDataFrame(list(enumerate(ips)), "id int, ip string")
    found = {r["id"]: r for r in mmdb.locate(rows, mmdb.read(spark, str(path))).collect()}
    assert len(found) == len(ips) and [found[0][c] for c in ("country", "country_code", "city", "latitude", "longitude", "timezone", "accuracy", "subdivision", "postal_code")] == ["Italy", "IT", "Rome", 41.9, 12.5, "Europe/Rome", 20, "Lazio", "00100"]
    assert (found[1]["country"], found[1]["country_code"], found[1]["city"], found[1]["latitude"], found[1]["timezone"]) == ("Unknown", "XX", None, 0.0, None)
    assert found[3]["city"] == "Rome" and (found[4]["country"], found[4]["country_code"]) == ("Unknown", "FR") and found[10]["city"] == "Rome"
    assert all(found[i]["country_code"] is None for i in (2, 5, 6, 7, 8, 9))


GOOD = """title: Odd login
id: 1f
status: test
level: high
date: 2024-01-05
author: Ann
tags: [attack.initial_access, attack.t1078.001, other]
logsource: {product: linux, service: auth}
detection:
  sel:
    message|contains:
      - login
      - logon
  condition: sel
"""


def test_rule_files(spark, tmp_path):
    bomb = "a: &a [x, x]\n" + "".join(f"{chr(98 + i)}: &{chr(98 + i)} [*{chr(97 + i)}, *{chr(97 + i)}]\n" for i in range(24))
    texts = {"good.yml": GOOD, "two.yml": GOOD + "---\n" + GOOD.replace("1f", "2f").replace("Odd", "Even"), "open.yml": "title: [", "list.yml": "- a", "none.yml": "# nothing", "bomb.yml": bomb, "self.yml": "a: &a [*a]", "deep.yml": "[" * 3000, "tag.yml": "!!python/object:os.system x", "level.yml": GOOD.replace("high", "huge"), "nocond.yml": GOOD.replace("  condition: sel\n", "")}
    for name, content in texts.items():
        (tmp_path / name).write_text(content)
    found = rule_catalogue.parsed(rule_catalogue.files(spark, str(tmp_path), "c1")).collect()
    by = {}
    for r in found:
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert {n for n, rows in by.items() if all(r["error"] is None for r in rows)} == {"good.yml", "two.yml"} and set(by) == set(texts)
    good = by["good.yml"][0]
    assert (good["rule_id"], good["status"], good["date"], good["author"], good["tactics"], good["techniques"]) == ("1f", "test", "2024-01-05", "Ann", ["initial_access"], ["T1078.001"])
    assert [r["place"] for r in by["two.yml"]] == [0, 1] and "level" in by["level.yml"][0]["error"] and "condition" in by["nocond.yml"][0]["error"]


def test_sync_reads_what_has_changed(spark):
    make = lambda *rows: spark.createDataFrame(rows, "path string, commit string, content string")
    none = spark.createDataFrame([], rule_catalogue.RULES)
    first, told = rule_catalogue.sync(none, make(("a", "1", GOOD), ("b", "1", GOOD.replace("1f", "2f")), ("c", "1", "x")))
    assert tuple(told.head()) == (2, 0, 1)
    again, told = rule_catalogue.sync(first, make(("a", "1", "not read again"), ("b", "2", GOOD.replace("1f", "3f")), ("c", "2", GOOD.replace("1f", "4f")), ("d", "2", "y")))
    assert tuple(told.head()) == (2, 1, 1)
    assert sorted((r["path"], r["commit"], r["rule_id"]) for r in again.collect()) == [("a", "1", "1f"), ("b", "2", "3f"), ("c", "2", "4f")]
    kept, _ = rule_catalogue.sync(again, make(("b", "3", "broken: [")))
    assert sorted(r["rule_id"] for r in kept.collect()) == ["1f", "3f", "4f"]
    assert [r["title"] for r in rule_catalogue.titled(kept, "ODD", 2).collect()] == ["Odd login"] * 2
    logs = spark.createDataFrame([(1, "a logon", "auth"), (2, "none", "auth")], "id long, message string, service string").select("*", F.lit(None).cast("timestamp_ntz").alias("time"), F.lit(1).alias("project_id"), F.lit("info").alias("level"), F.lit(None).cast("string").alias("trace_id"), F.lit('{"product":"linux","service":"auth"}').alias("metadata"))
    rules = rule_catalogue.rules(kept)
    assert [r.id for r in rules] == ["1f", "3f", "4f"] and rules[0].detection["sel"]["message|contains"] == ["login", "logon"]
    assert sigma.detect(logs, [sigma.Rule("x", "t", "low", rules[0].detection)]).count() == 1
