"""Suppression, rate control, numbering, batches, retention."""

from pyspark.sql import functions as F

from tidelog.operators import numbering, suppress
from tidelog.specs import Scoped
from workload import LOGS_SQL, logs, query, table

COLUMNS = "source, level, ts, id, user_id, value, props"


def leaders_sql(name: str, rows: str, key: str, hours, strict: bool = False, origin: str | None = None) -> str:
    """The anchored windows of ``rows`` as a recursive CTE ``name(k, t)``."""
    test = ">" if strict else ">="
    first = f"SELECT {key} AS k, min(ts) AS t FROM {rows} GROUP BY 1" if origin is None else f"SELECT {key} AS k, {origin} AS t FROM {rows} GROUP BY 1"
    return f"""{name}(k, t) AS ({first} UNION ALL
        SELECT l.k, min(e.ts) FROM {name} l JOIN {rows} e ON e.{key} = l.k AND e.ts {test} l.t + INTERVAL {hours}
        GROUP BY l.k, l.t)"""


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED ({LOGS_SQL}), {leaders_sql("lead_", "rows_", "source", "1 HOUR")}
    SELECT {COLUMNS} FROM rows_ JOIN lead_ ON source = k AND ts = t
""")
def dedupe_by_type(spark, sf):
    return suppress.dedupe(logs(spark, sf), {"fields": ["source"], "window": "1h"})


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED ({LOGS_SQL}), {leaders_sql("lead_", "rows_", "user_id", "12 HOUR")}
    SELECT {COLUMNS} FROM rows_ JOIN lead_ ON user_id = k AND ts = t
""")
def dedupe_by_user(spark, sf):
    return suppress.dedupe(logs(spark, sf), {"fields": ["user_id"], "window": "12h"})


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT o_orderkey, o_orderstatus, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * o_orderkey AS ts FROM orders),
    {leaders_sql("lead_", "rows_", "o_orderstatus", "200 SECOND")}
    SELECT o_orderkey, o_orderstatus FROM rows_ JOIN lead_ ON o_orderstatus = k AND ts = t
""")
def dedupe_dense(spark, sf):
    """Few keys of many rows, most about six tenths of a window apart: nearly each second row opens one."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.timestamp_micros(F.lit(1704067200000000) + F.col("o_orderkey") * 60_000_000).alias("ts"))
    return suppress.dedupe(rows, {"fields": ["o_orderstatus"], "window": "200s"}, row_id="o_orderkey").select("o_orderkey", "o_orderstatus")


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED ({LOGS_SQL}),
    err AS MATERIALIZED (SELECT *, user_id AS k0 FROM rows_ WHERE source = 'error'),
    rest AS MATERIALIZED (SELECT *, source AS k0 FROM rows_ WHERE source NOT IN ('error', 'view')),
    {leaders_sql("lead_err", "err", "k0", "24 HOUR")}, {leaders_sql("lead_rest", "rest", "k0", "2 HOUR")}
    SELECT {COLUMNS} FROM err JOIN lead_err ON k0 = k AND ts = t
    UNION ALL SELECT {COLUMNS} FROM rest JOIN lead_rest ON k0 = k AND ts = t
    UNION ALL SELECT {COLUMNS} FROM rows_ WHERE source = 'view' AND id IN (
        SELECT arg_min(id, ts) FROM rows_ WHERE source = 'view' GROUP BY props)
""")
def dedupe_scoped(spark, sf):
    """A default and two source rules, all in one pass."""
    rules = Scoped(
        {"fields": ["source"], "window": "2h"},
        {"error": {"fields": ["user_id"], "window": "24h"}, "view": {"fields": ["props"], "window": 10_000_000}},
    )
    return suppress.dedupe(logs(spark, sf), rules)


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, CASE WHEN source = 'view' THEN '<nil>' ELSE CAST(user_id AS VARCHAR) END AS k0 FROM ({LOGS_SQL})),
    {leaders_sql("lead_", "rows_", "k0", "8 HOUR")}
    SELECT id, source FROM rows_ JOIN lead_ ON k0 = k AND ts = t
""")
def debounce_users(spark, sf):
    """Views have no host: they share one key."""
    rows = logs(spark, sf).withColumn("host", F.when(F.col("source") != "view", F.col("user_id")))
    return suppress.debounce(rows, {"field": "host", "window": "8h"}).select("id", "source")


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, CAST(user_id AS VARCHAR) AS k0 FROM ({LOGS_SQL}) WHERE source <> 'view'),
    {leaders_sql("lead_", "rows_", "k0", "8 HOUR")}
    SELECT id, source FROM rows_ JOIN lead_ ON k0 = k AND ts = t
    UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'view'
""")
def uniq_users(spark, sf):
    """Views have no host: all are kept."""
    rows = logs(spark, sf).withColumn("host", F.when(F.col("source") != "view", F.col("user_id").cast("string")))
    return suppress.uniq(rows, {"field": "host", "window": "8h"}).select("id", "source")


def _limited(rows: str, hours: str, limit, strict: bool) -> str:
    return f"""
    WITH RECURSIVE rows_ AS MATERIALIZED ({rows}), {leaders_sql("lead_", "rows_", "k0", hours, strict)},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t)
    SELECT {COLUMNS} FROM w QUALIFY row_number() OVER (PARTITION BY k0, t ORDER BY ts, id) <= {limit}"""


@query(_limited(f"SELECT *, source AS k0 FROM ({LOGS_SQL})", "6 HOUR", 5, True))
def rate_limit_by_type(spark, sf):
    return suppress.rate_limit(logs(spark, sf), {"limit": 5, "window": "6h"})


@query(_limited(f"SELECT *, source AS k0 FROM ({LOGS_SQL})", "1 HOUR", "CASE WHEN source = 'error' THEN 1 ELSE 2 END", True))
def rate_limit_scoped(spark, sf):
    rules = Scoped({"limit": 2, "window": "1h"}, {"error": {"limit": 1, "window": "1h"}})
    return suppress.rate_limit(logs(spark, sf), rules)


@query(_limited(f"SELECT *, 'all' AS k0 FROM ({LOGS_SQL})", "1 HOUR", 10, False))
def ceiling_shared(spark, sf):
    """One scope for all sources."""
    return suppress.ceiling(logs(spark, sf), {"limit": 10, "window": "1h"})


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, 'all' AS k0 FROM ({LOGS_SQL})),
    {leaders_sql("lead_", "rows_", "k0", "3 HOUR", origin="TIMESTAMP '2023-12-31 23:00:00'")},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t)
    SELECT {COLUMNS} FROM w QUALIFY row_number() OVER (PARTITION BY k0, t ORDER BY ts, id) <= 25
""")
def ceiling_from_origin(spark, sf):
    origin = 1704063600 * 1_000_000  # 2023-12-31 23:00:00 UTC
    return suppress.ceiling(logs(spark, sf), {"limit": 25, "window": "3h"}, origin_us=origin)


@query("SELECT DISTINCT event_type AS source, user_id FROM events")
def distinct_keys(spark, sf):
    return suppress.distinct_records(logs(spark, sf).select("source", "user_id"), ["source", "user_id"])


@query(f"SELECT {COLUMNS} FROM ({LOGS_SQL}) QUALIFY row_number() OVER (PARTITION BY source, user_id ORDER BY ts, id) = 1")
def first_per_key(spark, sf):
    return suppress.first_records(logs(spark, sf), ["source", "user_id"])


@query(f"SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY ts, id) + 99 AS seq FROM ({LOGS_SQL})")
def sequence_per_source(spark, sf):
    return numbering.sequence(logs(spark, sf), {"start": 100}, per_source="source").select("id", "source", "seq")


@query(f"""
    SELECT id, CASE WHEN source <> 'error' THEN row_number() OVER (PARTITION BY source = 'error' ORDER BY ts, id) END AS seq,
           CASE WHEN source = 'error' THEN row_number() OVER (PARTITION BY source = 'error' ORDER BY ts, id) + 499 END AS err_no
    FROM ({LOGS_SQL})
""")
def sequence_shared(spark, sf):
    """One counter for all sources but errors."""
    rules = Scoped({"field": "seq"}, {"error": {"field": "err_no", "start": 500}})
    return numbering.sequence(logs(spark, sf), rules).select("id", "seq", "err_no")


@query(f"""
    WITH t AS (SELECT id, ts, epoch_us(ts) // 7200000000 AS tick FROM ({LOGS_SQL}))
    SELECT id, tick, (row_number() OVER (PARTITION BY tick ORDER BY ts, id) - 1) // 10 AS batch FROM t
""")
def batch_numbers(spark, sf):
    return numbering.assign_batches(logs(spark, sf), 10, "2h").select("id", "tick", "batch")


@query(f"""
    WITH t AS (SELECT source, id, ts, epoch_us(ts) // 43200000000 AS tick FROM ({LOGS_SQL})),
    b AS (SELECT *, (row_number() OVER (PARTITION BY source, tick ORDER BY ts, id) - 1) // 10 AS batch FROM t)
    SELECT source, tick, batch, count(*) AS n_rows FROM b GROUP BY ALL
""")
def batch_sizes(spark, sf):
    return numbering.batches(logs(spark, sf), 10, "12h", scope="source")


@query(f"SELECT {COLUMNS} FROM ({LOGS_SQL}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) <= 50")
def retain_latest(spark, sf):
    return numbering.retain_bounded(logs(spark, sf), 50)


@query(f"SELECT {COLUMNS} FROM ({LOGS_SQL}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts, id) <= 1500")
def retain_earliest(spark, sf):
    return numbering.retain_bounded(logs(spark, sf), 1500, drop_new=True)


@query("SELECT event_type AS source, least(count(*), 1900) AS kept, greatest(count(*) - 1900, 0) AS dropped FROM events GROUP BY 1")
def retention_totals(spark, sf):
    return numbering.retention_counts(logs(spark, sf), 1900)
