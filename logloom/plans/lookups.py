"""Registered queries of address databases, rule files and stores made from the given tables, with their DuckDB twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logloom.functions import tables
from logloom.operators import rule_catalogue
from logloom.plans.catalogue import ORACLES, C, COLS, logs, register
from logloom.plans.flows import logs_in_parts
from logloom.plans.more import LAST, ips
from logloom.plans.views import NOW, view
from logloom.session import put, scratch, table
from logloom.sources import mmdb
from logloom.sources.logstore import LogStore
from logloom.streaming import streams


def located(spark, sf_dir, rows):
    """Each nation has eight addresses; every fifth record has no names or place."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    record = lambda r: {"continent": {"code": "XX"}} if r["n_nationkey"] % 5 == 4 else {"country": {"iso_code": r["n_name"][:2], "names": {"de": "-", "en": r["n_name"]}}, "location": {"latitude": r["n_nationkey"] + 0.5, "accuracy_radius": 300 + r["n_nationkey"]}, "subdivisions": [{"names": {"en": "north"}}]}
    path = f"{scratch(spark)}/places.mmdb"
    put(spark, path, mmdb.written({f"203.0.113.{8 * r['n_nationkey']}/29": record(r) for r in nations}))
    return mmdb.locate(ips(rows), mmdb.read(spark, path)).select("id", "ip", "country", "country_code", "city", "latitude", "longitude", "accuracy", "subdivision")


register("geo_locate", lambda s, d: logs(lambda x: located(s, d, x))(s, d), f"""select id, ip, case when n % 5 = 4 then 'Unknown' else n_name end as country, case when n % 5 = 4 then 'XX' else substr(n_name, 1, 2) end as country_code, cast(null as varchar) as city, case when n % 5 = 4 then 0 else n + 0.5 end::double as latitude,
 case when n is not null then 0 end::double as longitude, case when n % 5 < 4 then 300 + n end as accuracy, case when n % 5 < 4 then 'north' end as subdivision
 from (select id, ip, n_nationkey as n, n_name from (select id, unnest(regexp_extract_all(message, '203\\.0\\.113\\.[0-9]+')) as ip from logs) x left join nation on n_nationkey = {LAST} // 8) y""", "logs")

#: A rule for each part; of the keys that end in 3 none is a rule, and those that end in 6 break with the second commit.
LEVEL = "case p_size % 5 when 0 then 'informational' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end"
CONTENT = f"""concat('title: Part ', cast(p_partkey as string), ' ', commit, '\\nid: part-', cast(p_partkey as string), '\\nlevel: ', {LEVEL}, '\\nlogsource:\\n  product: any\\n',
 case when p_partkey % 10 = 3 then 'tags: [' when p_partkey % 10 = 6 and commit = 'b' then 'detection: none\\n' else concat('detection:\\n  sel:\\n    message|contains: [', '"', p_type, '"', ']\\n  condition: sel\\ntags:\\n  - attack.execution\\n  - attack.t', lpad(cast(p_size as string), 4, '0'), '\\n') end)"""


def synced(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "p_type", "concat('rules/', cast(p_partkey as string), '.yml') as path")
    at = lambda some, commit: some.withColumn("commit", F.expr(commit)).select("path", "commit", F.expr(CONTENT).alias("content"))
    none = spark.createDataFrame([], rule_catalogue.RULES)
    first, _ = rule_catalogue.sync(none, at(parts.where("p_partkey % 2 = 0"), "'a'"))
    return rule_catalogue.sync(first, at(parts, "case when p_partkey % 4 = 0 then 'a' else 'b' end"))


KEPT = "p_partkey % 10 <> 3 and (p_partkey % 2 = 0 or p_partkey % 10 <> 6)"
AT = "case when p_partkey % 4 = 0 or p_partkey % 10 = 6 then 'a' else 'b' end"
register("rule_catalogue_synced", lambda s, d: synced(s, d)[0].select("path", "commit", "rule_id", "title", "level", "status", F.array_join("techniques", ",").alias("techniques"), F.get_json_object("detection", "$.sel['message|contains'][0]").alias("word")), f"select concat('rules/', cast(p_partkey as varchar), '.yml') as path, {AT} as commit, concat('part-', cast(p_partkey as varchar)) as rule_id, concat('Part ', cast(p_partkey as varchar), ' ', {AT}) as title, {LEVEL} as level, 'stable' as status, concat('T', lpad(cast(p_size as varchar), 4, '0')) as techniques, p_type as word from part where {KEPT}")
register("rule_catalogue_counts", lambda s, d: synced(s, d)[1], "select count(*) filter (p_partkey % 4 > 0 and p_partkey % 10 not in (3, 6)) as imported, count(*) filter (p_partkey % 4 = 0) as skipped, count(*) filter (p_partkey % 4 > 0 and p_partkey % 10 in (3, 6)) as failed from part")
register("rule_catalogue_search", lambda s, d: rule_catalogue.titled(synced(s, d)[0], "PART 1", 20).select("title", "level"), f"select title, level from (select concat('Part ', cast(p_partkey as varchar), ' ', {AT}) as title, {LEVEL} as level from part where {KEPT}) x where contains(lower(title), 'part 1') order by title limit 20")


def filed(spark, sf_dir) -> LogStore:
    store = LogStore(spark, scratch(spark))
    store.add(view(spark, sf_dir, "logs"), view(spark, sf_dir, "projects"))
    return store


def retained(spark, sf_dir):
    """Retention is 7 days and the organization's number more."""
    store = filed(spark, sf_dir)
    store.retain({o: 7 + o for o in range(5)}, datetime.fromisoformat(NOW))
    return store.rows().select("organization_id", *COLS)


register("log_search_indexed", lambda s, d: filed(s, d).containing("USER_ID=7 ").select(*COLS), f"select {C} from logs where contains(lower(message), 'user_id=7 ')", "logs")
register("retention_by_partition", retained)
ORACLES["retention_by_partition"] = ORACLES["retention_survivors"]


def notified(spark, sf_dir):
    def follow(x, path):
        streams.fan_out(x, f"{path}/notices", f"{path}/state")

    return streams.notices(spark, f"{logs_in_parts(spark, sf_dir, follow)}/notices").rows().select("project_id", F.explode("ids").alias("id"))


register("stream_notifications", notified, "select project_id, id from logs", "logs")


def in_sql(text: str):
    def query(spark, sf_dir):
        tables.register(spark)
        return spark.sql(text, logs=view(spark, sf_dir, "logs"))

    return query


register("identifiers_lateral", in_sql("select l.id as log_id, x.type, x.value, x.source from {logs} l, lateral identifiers(l.message, l.metadata) x"))
ORACLES["identifiers_lateral"] = ORACLES["identifiers_extract"].replace("select id as log_id, time, project_id, ", "select id as log_id, ")
