"""Windowed aggregates, counters, alerts."""

from pyspark.sql import functions as F

from tidelog.operators import aggregates, counters, filters, parse, suppress
from tidelog.plans.sizing import staged
from workload import LOGS_SQL, logs, query
from workload.stateful import leaders_sql


@query("""
    WITH RECURSIVE e AS MATERIALIZED (SELECT *, user_id AS k0 FROM events WHERE event_type = 'error'),
    """ + leaders_sql("lead_", "e", "k0", "12 HOUR") + """
    SELECT date_trunc('day', ts) AS day, event_type AS source, count(*) AS errors, round(sum(value), 4) AS total
    FROM e JOIN lead_ ON k0 = k AND ts = t GROUP BY ALL
""")
def errors_per_day(spark, sf):
    """Parse logfmt lines, keep errors, drop a user's repeats within 12 h, count per day."""
    rows = logs(spark, sf)
    line = F.concat_ws(
        " ", F.concat(F.lit("level="), "level"), F.concat(F.lit("user="), "user_id"), F.concat(F.lit("value="), "value")
    )
    lines = rows.select("ts", "id", "source", line.alias("line"))
    records = parse.promote(parse.parse_lines(lines, "logfmt"), ["level", "user", "value"])
    errors = filters.filter_rules(records, [{"field": "level", "pattern": "^error$"}])
    # Parse once: the passes of the duplicate filter read the parsed errors.
    kept = suppress.dedupe(staged(errors.drop("line", "fields", "_error")), {"fields": ["user"], "window": "12h"})
    kept = kept.withColumn("value", F.col("value").try_cast("double"))
    daily = aggregates.tumbling_agg(kept, {"errors": ("count", "value"), "total": ("sum", "value")}, "24h")
    return daily.select(
        F.col("window_start").cast("timestamp_ntz").alias("day"), "source", F.col("errors"), F.round("total", 4).alias("total")
    )


def _anchored(select: str) -> str:
    return f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, source AS k0 FROM ({LOGS_SQL})),
    {leaders_sql("lead_", "rows_", "k0", "3 HOUR", strict=True)},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t)
    {select}"""


@query(_anchored("""
    SELECT source, 'value' AS field, unnest(['count', 'sum', 'min', 'max']) AS op, t AS window_start,
           10800000000 AS width_us,
           unnest([round(count(*)::DOUBLE, 4), round(sum(value), 4), min(value), max(value)]) AS value
    FROM w GROUP BY source, t"""))
def anchored_totals(spark, sf):
    rules = [{"field": "value", "op": op, "window": "3h"} for op in ("count", "sum", "min", "max")]
    return aggregates.anchored_agg(logs(spark, sf), rules).withColumn("value", F.round("value", 4))


MOMENT = "2024-01-30 18:00:00"


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, source AS k0 FROM ({LOGS_SQL}) WHERE ts <= TIMESTAMP '{MOMENT}'),
    {leaders_sql("lead_", "rows_", "k0", "3 HOUR", strict=True)},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t),
    latest AS (SELECT source, max(t) AS t FROM w GROUP BY 1)
    SELECT w.source, 'value' AS field, 'sum' AS op,
           CASE WHEN latest.t + INTERVAL 3 HOUR >= TIMESTAMP '{MOMENT}' THEN round(sum(value), 4) ELSE 0.0 END AS value
    FROM w JOIN latest ON w.source = latest.source AND w.t = latest.t GROUP BY w.source, latest.t""")
def snapshot_at(spark, sf):
    """The last window of each source as of a moment: later records don't count."""
    state = aggregates.snapshot(logs(spark, sf), [{"field": "value", "op": "sum", "window": "3h"}], MOMENT)
    return state.withColumn("value", F.round("value", 4))


@query("""
    SELECT event_type AS source, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
           count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high
    FROM events GROUP BY ALL
""")
def tumbling_totals(spark, sf):
    aggs = {"n": ("count", "value"), "total": ("sum", "value"), "low": ("min", "value"), "high": ("max", "value")}
    out = aggregates.tumbling_agg(logs(spark, sf), aggs, "6h")
    return out.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _sliding(step_minutes: int, buckets: int, key: str, total: str) -> str:
    return f"""
    WITH e AS (SELECT *, time_bucket(INTERVAL {step_minutes} MINUTE, ts, TIMESTAMP '1970-01-01') AS slot FROM events),
    x AS (SELECT *, slot - unnest(range({buckets})) * INTERVAL {step_minutes} MINUTE AS window_start FROM e)
    SELECT window_start, window_start + INTERVAL {step_minutes * buckets} MINUTE AS window_end, {key} {total} AS n
    FROM x GROUP BY ALL"""


@query(_sliding(30, 6, "CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS value,", "count(*)"))
def value_counts(spark, sf):
    rows = logs(spark, sf).withColumn("level", F.when(F.col("level") != "view", F.col("level")))
    return aggregates.value_frequency(rows, "level", "3h", 6)


@query(_sliding(60, 12, "", "CAST(sum(user_id) AS BIGINT)"))
def sliding_totals(spark, sf):
    return aggregates.sliding_count(logs(spark, sf), "12h", 12, n="user_id")


@query("""
    SELECT event_id AS id, count(*) OVER w AS count, round(sum(value) OVER w, 4) AS total FROM events
    WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)
""")
def trailing_totals(spark, sf):
    """Rows and sum of the six hours up to each row, over all sources: one shared order, cut into slices."""
    out = aggregates.trailing_totals(logs(spark, sf), "6h", value="value", rows_per_task=2_000)
    return out.select("id", "count", F.round("total", 4).alias("total"))


@query("""
    SELECT event_id AS id, event_type AS source, count(*) OVER w AS count, CAST(sum(user_id) OVER w AS BIGINT) AS total FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
""")
def trailing_by_source(spark, sf):
    return aggregates.trailing_totals(logs(spark, sf), "24h", value="user_id", keys=["source"]).select("id", "source", "count", "total")


@query("SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1")
def counter_totals(spark, sf):
    return counters.stage_counters(logs(spark, sf), "source")


# Every counter at every tick from its first on; an hour is short enough for some to stand still.
REPORT = """SELECT tick, name, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY name ORDER BY tick) AS BIGINT) AS value FROM (
      SELECT name, unnest(generate_series(min(tick), any_value(last_tick), INTERVAL 1 HOUR)) AS tick
      FROM (SELECT event_type AS name, date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick, (SELECT date_trunc('hour', max(ts)) + INTERVAL 1 HOUR FROM events) AS last_tick FROM events)
      GROUP BY name)
    LEFT JOIN (SELECT event_type AS name, date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick, count(*) AS n FROM events GROUP BY ALL) USING (name, tick)"""


@query(REPORT)
def counter_reports(spark, sf):
    return counters.counter_report(logs(spark, sf), "source", "1h")


@query(f"""
    WITH RECURSIVE high AS MATERIALIZED (SELECT tick AS ts, name AS k0, value FROM ({REPORT})
        WHERE (name = 'error' AND value >= 100) OR (name = 'click' AND value >= 500)),
    hot AS MATERIALIZED (SELECT * FROM high WHERE k0 = 'error'), cool AS MATERIALIZED (SELECT * FROM high WHERE k0 = 'click'),
    {leaders_sql("l1", "hot", "k0", "36 HOUR")}
    SELECT ts AS tick, k0 AS name, value FROM hot JOIN l1 ON k0 = k AND ts = t
    UNION ALL SELECT ts, k0, value FROM cool
""")
def alerts_on_counters(spark, sf):
    rules = [{"counter": "error", "threshold": 100, "cooldown": "36h"}, {"counter": "click", "threshold": 500}]
    return counters.threshold_alerts(counters.counter_report(logs(spark, sf), "source", "1h"), rules)


@query("""
    WITH m AS (SELECT event_type AS source, event_id AS id, ts, unnest([0, 1]) AS rule, props FROM events),
    h AS (SELECT *, row_number() OVER (PARTITION BY source, rule ORDER BY ts, id) AS count FROM m
          WHERE (rule = 0 AND source <> 'error' AND regexp_matches(props, '7}$')) OR (rule = 1 AND source = 'error'))
    SELECT source, id, CAST(rule AS INTEGER) AS rule, count FROM h WHERE (rule = 0 AND count = 40) OR (rule = 1 AND count % 100 = 0)
""")
def alerts_on_matches(spark, sf):
    from tidelog.specs import Scoped

    rules = Scoped(
        [{"field": "props", "pattern": "7}$", "threshold": 40}],
        {"error": [{"field": "level", "pattern": "err", "threshold": 100, "repeat": True}]},
    )
    return counters.match_alerts(logs(spark, sf), rules).select("source", "id", "rule", "count")


@query("""
    WITH l AS (SELECT user_id, arg_max(event_type, ts) AS e, arg_max(props, ts) AS p FROM events GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS component, CASE WHEN e = 'error' THEN 'degraded' ELSE 'ok' END AS status, p AS message,
           (SELECT CASE WHEN bool_or(e = 'error') THEN 'degraded' ELSE 'ok' END FROM l) AS overall
    FROM l
""")
def status_of_users(spark, sf):
    rows = logs(spark, sf).select(
        "ts", F.col("user_id").cast("string").alias("component"), F.col("props").alias("message"),
        F.when(F.col("level") == "error", "degraded").otherwise("ok").alias("status"),
    )
    return counters.status_rollup(rows)
