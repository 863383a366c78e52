"""Log, span and tenant tables derived from the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.session import table

NOW = "2024-01-30 23:57:13"

PHRASE = """case event_id % 10 when 0 then concat('failed login user_id=', cast(user_id as string))
  when 1 then concat('connection timeout to 10.0.0.', cast(user_id % 250 as string), ' from 203.0.113.', cast(event_id % 250 as string))
  when 2 then 'sudo: unauthorized privilege escalation' when 3 then concat('select * from users where id=1 or 1=1 -- ', cast(event_id as string))
  when 4 then concat('payment ok order_id=ORD-', lpad(cast(event_id as string), 8, '0')) when 5 then '../../etc/passwd requested'
  when 6 then concat('mail to user', cast(user_id as string), '@example.com sent') when 7 then '<script>alert(1)</script> in form'
  when 8 then concat('cache miss 50%_off session_id=s', lpad(cast(user_id as string), 12, '0')) else 'worker heartbeat' end"""

LOGS = f"""select event_id as id, ts as time, cast(user_id % 25 as int) as project_id,
  case user_id % 5 when 0 then 'api-gateway' when 1 then 'auth-service' when 2 then 'payment-service' when 3 then 'user-service' else 'unknown' end as service,
  case when event_type = 'error' and value >= 100 then 'critical' when event_type = 'error' then 'error' when event_type = 'signup' then 'warn' when event_type = 'view' then 'debug' else 'info' end as level,
  concat(event_type, ' ', {PHRASE}, ' req-', lpad(cast(event_id as string), 8, '0')) as message, props as metadata,
  case when event_id % 3 = 0 then concat('trace-', cast(user_id as string), '-', cast(cast(ts as date) as string)) end as trace_id
from events"""

#: The same within a day, to the second: events come often enough for bursts.
BUSY_TIME = "date_trunc('second', (select min(ts) from events) + (ts - (select min(ts) from events)) / 31)"
BUSY = LOGS.replace("ts as time", f"{BUSY_TIME} as time")

SPANS = """select concat('t', cast(o_orderkey as string)) as trace_id, concat('o', cast(o_orderkey as string)) as span_id, cast(null as string) as parent_span_id,
  concat('orders-', substr(o_orderpriority, 1, 1)) as service_name, 'place_order' as operation_name, cast(o_orderdate as timestamp) as start_time, 0 as minutes,
  case when o_orderstatus = 'F' then 'ERROR' else 'OK' end as status_code from orders
union all
select concat('t', cast(l_orderkey as string)), concat('l', cast(l_orderkey as string), '-', cast(seq as string)),
  case when seq = 1 then concat('o', cast(l_orderkey as string)) else concat('l', cast(l_orderkey as string), '-', cast(seq - 1 as string)) end,
  concat('warehouse-', lower(l_returnflag)), 'ship_line', cast(l_shipdate as timestamp), cast(seq as int), case when l_linestatus = 'F' then 'ERROR' else 'UNSET' end
from (select l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as seq from lineitem l) x"""

ALERT_RULES = """select * from (values (0, cast(null as string), 'error,critical', cast(null as int), 3, 1440, true), (1, 'auth-service', 'error,critical', null, 2, 4320, true),
  (2, 'payment-service', 'critical', 2, 1, 10080, true), (3, 'api-gateway', 'warn,error,critical', 5, 1, 2880, true), (4, null, 'critical', 7, 1, 60, true), (5, 'user-service', 'error', null, 1, 1440, false)
) as t(rule_id, service, levels, project_id, threshold, time_window, enabled)"""

ALERT_HISTORY = "select event_id as id, event_id % 6 as rule_id, ts - interval '1 day' * (event_id % 6) as triggered_at, cast(floor(value) as int) as log_count, event_id % 2 = 1 as notified, case when event_id % 5 = 0 then 'smtp refused' end as error from events"

ORGS = "select r_regionkey as id, r_name as name from region"
PROJECTS = "select cast(n_nationkey as int) as id, n_regionkey as organization_id, n_name as name from nation"

TEXTS = {"logs": LOGS, "busy_logs": BUSY, "spans": SPANS, "alert_rules": ALERT_RULES, "alert_history": ALERT_HISTORY, "organizations": ORGS, "projects": PROJECTS}
SOURCES = {"logs": ("events",), "busy_logs": ("events",), "spans": ("orders", "lineitem"), "alert_rules": (), "alert_history": ("events",), "organizations": ("region",), "projects": ("nation",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEXTS[name].replace(BUSY_TIME, f"cast({BUSY_TIME} as timestamp_ntz)")
    for source in SOURCES[name]:
        text = text.replace(f"from {source}", f"from {{{source}}}")
    return spark.sql(text, **{s: table(spark, sf_dir, s) for s in SOURCES[name]})


def twin(query: str, *names: str) -> str:
    """A DuckDB query over the named views."""
    return "with " + ", ".join(f"{n} as ({TEXTS[n]})" for n in names) + "\n" + query
