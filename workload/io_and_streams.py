"""Sources, sinks and streaming twins, run over the whole tables."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidelog.operators import filters, multiline, parse, route
from tidelog.plans.flow import Flow, run_flow, run_stage
from tidelog.session import configure_streaming
from tidelog.sources import readers, sinks
from tidelog.specs import Scoped
from tidelog.streaming import closing, native, observed, state, stepped
from workload import LOGS_SQL, logs, query, scratch, table
from workload.enrichment import _paired
from workload.stateful import leaders_sql


@query(f"SELECT source, level, id, user_id, value FROM ({LOGS_SQL})")
def json_sink(spark, sf):
    path = scratch(spark, "json")
    sinks.write_json(logs(spark, sf).select("source", "level", "id", "user_id", "value"), path)
    schema = "source string, level string, id bigint, user_id bigint, value double"
    return readers.read_records(spark, "json", path, schema=schema)


@query("""
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(9) || event_type || chr(9) ||
           CASE WHEN event_type <> 'view' THEN props ELSE '' END AS line FROM events
""")
def text_sink(spark, sf):
    path = scratch(spark, "text")
    rows = logs(spark, sf).select(
        F.when(F.col("level") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"),
        "level", F.when(F.col("level") != "view", F.col("props")).alias("message"), "ts",
    )
    sinks.write_text(rows, path, ingest="ts")
    return readers.read_lines(spark, path).select("line")


@query("SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '] ' || event_type || ': ' || props AS line FROM events")
def entry_sink(spark, sf):
    entries = logs(spark, sf).select("source", F.col("props").alias("line"), F.col("ts").alias("timestamp"))
    return sinks.entry_lines(entries).withColumnRenamed("value", "line")


@query("""
    SELECT 'json' AS kind, event_id AS id, event_type AS level, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, props AS message FROM events
    UNION ALL SELECT 'text', NULL, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), props FROM events
""")
def fan_out_sinks(spark, sf):
    """The same rows to a JSON and a text sink, computed once; both read back."""
    one, two = scratch(spark, "json"), scratch(spark, "text")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = logs(spark, sf).select("id", "level", F.col("props").alias("message"), time.alias("time"))
    sinks.fan_out(rows, {"json": sinks.json_sink(one), "text": sinks.text_sink(two)})
    held = spark.read.schema("id bigint, level string, time string, message string").json(one).withColumn("kind", F.lit("json"))
    parts = F.split("value", "\t", 3)
    lines = spark.read.text(two).select(F.lit(None).cast("bigint").alias("id"), parts[1].alias("level"), parts[0].alias("time"), parts[2].alias("message"), F.lit("text").alias("kind"))
    return held.unionByName(lines)


@query("""
    SELECT unnest(CASE WHEN event_type = 'error' THEN ['alerts', 'all'] WHEN event_type = 'purchase' THEN ['sales'] ELSE ['all'] END) AS sink,
           event_id AS id FROM events
""")
def routed_sink(spark, sf):
    """Routed rows below one folder per sink."""
    path = scratch(spark, "routed")
    rules = [
        {"source_pattern": "^error$", "sinks": ["alerts", "all"]},
        {"field": "level", "field_pattern": "^purch", "sinks": ["sales"]},
    ]
    sinks.write_routed(route.route(logs(spark, sf), rules, ["all"]).select("id", "sink"), path)
    return spark.read.schema("id bigint, sink string").json(path)


@query("SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
def read_text_lines(spark, sf):
    """Documents written as text files, read back line by line."""
    path = scratch(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.read_lines(spark, path).select("line")


@query("""
    SELECT 'docs' AS source, unnest(string_split(text, chr(10))) AS line FROM documents
    UNION ALL SELECT 'talk', unnest(string_split(text, chr(10))) FROM conversations
""")
def read_many_sources(spark, sf):
    """Two named sources; a third that does not exist is reported, not fatal."""
    docs, talk = scratch(spark, "docs"), scratch(spark, "talk")
    table(spark, sf, "documents").select("text").write.text(docs)
    table(spark, sf, "conversations").select("text").write.text(talk)
    lines, errors = readers.read_many(spark, {"docs": docs, "talk": [talk], "gone": docs + "-gone/*"})
    assert list(errors) == [docs + "-gone/*"]
    return lines.select("source", "line")


@query("SELECT event_id AS id, 'WARN ' || event_type AS line FROM events WHERE event_type IN ('error', 'click')")
def composed_steps(spark, sf):
    """A rule list given as plain data, run as one plan."""
    flow = Flow([
        {"op": "filter", "rules": [{"field": "level", "pattern": "^(error|click)$"}]},
        {"op": "transform", "rules": [{"op": "rename", "field": "level", "new_name": "message"}, {"op": "add", "field": "level", "value": "warn"}]},
        {"op": "render", "style": "text", "names": ["level", "message"]},
    ])
    return flow(logs(spark, sf)).select("id", "line")


@query("SELECT 'user=' || user_id || ' level=' || event_type AS line FROM events WHERE event_type = 'error'")
def line_flow(spark, sf):
    """Lines through field extraction and rules to a text sink."""
    path = scratch(spark, "flow")
    lines = logs(spark, sf).select(F.concat(F.lit("user="), "user_id", F.lit(" level="), "level").alias("line"))
    run_flow(lines, [{"field": "level", "pattern": "^error$"}], lambda df: df.select("line").write.text(path))
    return readers.read_lines(spark, path).select("line")


@query("SELECT event_id AS id, upper(event_type) AS level FROM events WHERE event_type <> 'view'")
def stage_run(spark, sf):
    path = scratch(spark, "stage")
    run_stage(
        logs(spark, sf), "events", lambda df: df.write.parquet(path),
        allow=lambda df: filters.filter_rules(df, [{"field": "level", "pattern": "^view$", "invert": True}]),
        change=lambda df: df.select("id", F.upper("level").alias("level")),
    )
    return spark.read.parquet(path)


def events_stream(spark, sf, **options):
    configure_streaming(spark)
    schema = table(spark, sf, "events").schema
    # A stream takes a folder or a glob; the table may be a single file.
    rows = readers.stream_records(spark, "parquet", f"{sf}/[e]vents.parquet", schema, **options)
    return rows.select(
        F.col("event_type").alias("source"), F.col("event_type").alias("level"), "ts", F.col("event_id").alias("id"),
        "user_id", "value", "props",
    )


# Events of these values have lost their time.
UNTIMED = "value < 2"
SLICES = 3
# Slices of the stream lie within this much of time, so rows of two files of one slice are never late.
DELAY = "16 days"

# The stream's rows as a table.
STREAM_LOGS = f"SELECT event_type AS source, event_type AS level, CASE WHEN NOT {UNTIMED} THEN ts END AS ts, event_id AS id, user_id, value, props FROM events"
TIMED = f"SELECT * FROM ({STREAM_LOGS}) WHERE ts IS NOT NULL"


def arriving(spark, sf):
    """The logs as a stream of several files, later ones with later times, one file a batch; some rows have no time."""
    configure_streaming(spark)
    inbox = scratch(spark, "inbox")
    rows = logs(spark, sf)
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    lost = F.expr(UNTIMED)
    if span["a"] is not None:
        step = (span["b"] - span["a"]) / SLICES
        for i in range(SLICES):
            inside = (F.col("ts") >= F.lit(span["a"] + i * step)) if i else F.lit(True)
            before = (F.col("ts") < F.lit(span["a"] + (i + 1) * step)) if i + 1 < SLICES else F.lit(True)
            part = rows.filter(inside & before).withColumn("ts", F.when(~lost, F.col("ts")))
            part.repartition(2).write.mode("append").parquet(inbox)
    else:
        rows.write.parquet(inbox)
    return readers.stream_records(spark, "parquet", inbox, rows.schema, max_files=1)


def drained(spark, stream):
    """Run a stream without state to the end of its input and return what it wrote."""
    out, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    sinks.resume_ingest(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def ended(spark, sf, build):
    """What ``build`` makes of the arriving logs, up to their end."""
    out, checkpoint, folder = (scratch(spark, n) for n in ("stream", "stream-state", "closing"))
    stream = build(closing.closable(arriving(spark, sf), folder))
    closing.ingest_to_end(stream, out, checkpoint, folder)
    return spark.read.schema(stream.schema).parquet(out)


def stepped_to_end(spark, sf, start):
    """What ``start(stream, path, checkpoint)`` writes of the arriving logs, up to their end."""
    out, checkpoint, folder = (scratch(spark, n) for n in ("stepped", "stepped-state", "closing"))
    stream = closing.closable(arriving(spark, sf), folder)
    start(stream, out, checkpoint).awaitTermination()
    closing.close(spark, folder)
    start(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED ({TIMED}), {leaders_sql("lead_", "rows_", "source", "1 HOUR")}
    SELECT id, source, ts, props FROM rows_ JOIN lead_ ON source = k AND ts = t
    UNION ALL SELECT id, source, ts, props FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_dedupe(spark, sf):
    return ended(spark, sf, lambda rows: state.dedupe(rows, {"fields": ["source"], "window": "1h"}, delay=DELAY).select("id", "source", "ts", "props"))


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, CASE WHEN source = 'view' THEN '<nil>' ELSE CAST(user_id AS VARCHAR) END AS k0 FROM ({TIMED})),
    {leaders_sql("lead_", "rows_", "k0", "8 HOUR")}
    SELECT id, source FROM rows_ JOIN lead_ ON k0 = k AND ts = t
    UNION ALL SELECT id, source FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_debounce(spark, sf):
    """Views have no host: they share one key."""

    def build(rows):
        hosts = rows.withColumn("host", F.when(F.col("source") != "view", F.col("user_id")))
        return state.debounce(hosts, {"field": "host", "window": "8h"}, delay=DELAY).select("id", "source")

    return ended(spark, sf, build)


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, CAST(user_id AS VARCHAR) AS k0 FROM ({TIMED}) WHERE source <> 'view'),
    {leaders_sql("lead_", "rows_", "k0", "8 HOUR")}
    SELECT id, source FROM rows_ JOIN lead_ ON k0 = k AND ts = t
    UNION ALL SELECT id, source FROM ({STREAM_LOGS}) WHERE ts IS NULL OR source = 'view'
""")
def stream_uniq(spark, sf):
    """Views have no host: all are kept."""

    def build(rows):
        hosts = rows.withColumn("host", F.when(F.col("source") != "view", F.col("user_id").cast("string")))
        return state.uniq(hosts, {"field": "host", "window": "8h"}, delay=DELAY).select("id", "source")

    return ended(spark, sf, build)


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, source AS k0 FROM ({TIMED})), {leaders_sql("lead_", "rows_", "k0", "6 HOUR", True)},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t)
    SELECT id, source FROM w QUALIFY row_number() OVER (PARTITION BY k0, t ORDER BY ts, id) <= 5
    UNION ALL SELECT id, source FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_rate_limit(spark, sf):
    return ended(spark, sf, lambda rows: state.rate_limit(rows, {"limit": 5, "window": "6h"}, delay=DELAY).select("id", "source"))


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, 'all' AS k0 FROM ({TIMED})), {leaders_sql("lead_", "rows_", "k0", "1 HOUR")},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t)
    SELECT id, source FROM w QUALIFY row_number() OVER (PARTITION BY k0, t ORDER BY ts, id) <= 10
    UNION ALL SELECT id, source FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_ceiling_shared(spark, sf):
    """One limit for all sources, batch by batch."""
    start = lambda rows, path, checkpoint: stepped.start_ceiling(rows, {"limit": 10, "window": "1h"}, path, checkpoint, delay=16 * 86_400)
    return stepped_to_end(spark, sf, start).select("id", "source")


@query(f"""
    SELECT id, row_number() OVER (PARTITION BY source ORDER BY ts, id) + 9 AS seq FROM ({TIMED})
    UNION ALL SELECT id, NULL FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_sequence(spark, sf):
    return ended(spark, sf, lambda rows: state.sequence(rows, {"start": 10}, per_source="source", delay=DELAY).select("id", "seq"))


@query(f"""
    SELECT id, CASE WHEN source <> 'error' THEN row_number() OVER (PARTITION BY source = 'error' ORDER BY ts, id) END AS seq,
           CASE WHEN source = 'error' THEN row_number() OVER (PARTITION BY source = 'error' ORDER BY ts, id) + 499 END AS err_no
    FROM ({TIMED})
    UNION ALL SELECT id, NULL, NULL FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_sequence_shared(spark, sf):
    """One counter for all sources but errors, batch by batch."""
    rules = Scoped({"field": "seq"}, {"error": {"field": "err_no", "start": 500}})
    start = lambda rows, path, checkpoint: stepped.start_sequence(rows, rules, path, checkpoint, delay=16 * 86_400)
    return stepped_to_end(spark, sf, start).select("id", "seq", "err_no")


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, source AS k0 FROM ({TIMED})),
    {leaders_sql("lead_", "rows_", "k0", "3 HOUR", strict=True)},
    w AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN lead_ l ON r.k0 = l.k AND r.ts >= l.t)
    SELECT source, t AS window_start, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max
    FROM w GROUP BY source, t
""")
def stream_anchored_totals(spark, sf):
    out = ended(spark, sf, lambda rows: state.anchored_totals(rows, "value", "3h", delay=DELAY))
    return out.withColumn("sum", F.round("sum", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""
    WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, source AS k0 FROM ({TIMED})),
    {leaders_sql("short_", "rows_", "k0", "3 HOUR", strict=True)}, {leaders_sql("long_", "rows_", "k0", "12 HOUR", strict=True)},
    a AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN short_ l ON r.k0 = l.k AND r.ts >= l.t),
    b AS (SELECT r.*, l.t FROM rows_ r ASOF JOIN long_ l ON r.k0 = l.k AND r.ts >= l.t)
    SELECT source, 'value' AS field, 'count' AS op, t AS window_start, 10800000000::BIGINT AS width_us, count(*)::DOUBLE AS value FROM a WHERE source <> 'error' GROUP BY source, t
    UNION ALL SELECT source, 'value', 'max', t, 43200000000, max(value) FROM b WHERE source <> 'error' GROUP BY source, t
    UNION ALL SELECT source, 'user_id', 'min', t, 43200000000, min(user_id)::DOUBLE FROM b WHERE source = 'error' GROUP BY source, t
""")
def stream_anchored_rules(spark, sf):
    """Several fields and widths, with own rules for errors, in one pass."""
    rules = Scoped(
        [{"field": "value", "op": "count", "window": "3h"}, {"field": "value", "op": "max", "window": "12h"}],
        {"error": [{"field": "user_id", "op": "min", "window": "12h"}]},
    )
    return ended(spark, sf, lambda rows: state.anchored_agg(rows, rules, delay=DELAY))


@query(f"SELECT left_id, right_id FROM ({_paired(24).replace('FROM events', f'FROM (SELECT * REPLACE (CASE WHEN NOT {UNTIMED} THEN ts END AS ts) FROM events)')})")
def stream_pairs(spark, sf):
    rule = {"left_source": "click", "right_source": "purchase", "key_field": "user_id", "window": "24h"}
    return ended(spark, sf, lambda rows: state.pair_join(rows, rule, delay=DELAY).select(F.col("left.id").alias("left_id"), F.col("right.id").alias("right_id")))


@query(f"""
    WITH s AS (SELECT *, sum(CASE WHEN NOT regexp_matches(props, '[02468]}}$') OR gap >= 900 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY source ORDER BY ts, id) AS seg
               FROM (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY source ORDER BY ts, id) AS gap
                     FROM ({TIMED})))
    SELECT source, min(ts) AS ts, arg_min(id, (ts, id)) AS id, count(*) AS n_lines, string_agg(props, chr(10) ORDER BY ts, id) AS message
    FROM s GROUP BY source, seg
    UNION ALL SELECT source, ts, id, 1, props FROM ({STREAM_LOGS}) WHERE ts IS NULL
""")
def stream_multiline(spark, sf):
    def build(rows):
        lines = rows.select("source", "ts", "id", F.col("props").alias("line"))
        return state.assemble_multiline(lines, {"continue_pattern": "[02468]}$", "timeout": "15m"}, delay=DELAY)

    return ended(spark, sf, build)


SCOPED_MULTILINE = f"""
    WITH s AS (SELECT *, sum(CASE WHEN source = 'view' OR (source = 'error' AND regexp_matches(props, '[05]}}$')) OR
                                       (source NOT IN ('view', 'error') AND NOT regexp_matches(props, '[02468]}}$')) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY source ORDER BY ts, id) AS seg FROM ({TIMED})),
    g AS (SELECT source, min(ts) AS ts, arg_min(id, (ts, id)) AS id, count(*) AS n_lines, string_agg(props, chr(10) ORDER BY ts, id) AS text
          FROM s GROUP BY source, seg
          UNION ALL SELECT source, ts, id, 1, props FROM ({STREAM_LOGS}) WHERE ts IS NULL)
    SELECT source, ts, id, n_lines, CASE WHEN source <> 'error' THEN text END AS message, CASE WHEN source = 'error' THEN text END AS trace FROM g
"""
SCOPED_RULES = Scoped(
    {"continue_pattern": "[02468]}$"},
    {"error": {"start_pattern": "[05]}$", "field": "trace"}, "view": {"start_pattern": "^"}},
)


@query(SCOPED_MULTILINE)
def multiline_scoped(spark, sf):
    """A default rule and two sources' own, one with its own field; lines without a time stand alone."""
    rows = logs(spark, sf).select("source", F.when(~F.expr(UNTIMED), F.col("ts")).alias("ts"), "id", F.col("props").alias("line"))
    return multiline.assemble_multiline(rows, SCOPED_RULES)


@query(SCOPED_MULTILINE)
def stream_multiline_scoped(spark, sf):
    def build(rows):
        return state.assemble_multiline(rows.select("source", "ts", "id", F.col("props").alias("line")), SCOPED_RULES, delay=DELAY)

    return ended(spark, sf, build)


@query(f"""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS n FROM ({TIMED}) WHERE source <> 'error' AND regexp_matches(props, '7'))
    SELECT id, source, 0 AS rule, n AS count FROM s WHERE n % 5 = 0
    UNION ALL SELECT id, source, 1, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS n FROM ({TIMED}) WHERE source = 'error' AND value > 9.5) WHERE n = 3
""")
def stream_match_alerts(spark, sf):
    """Each fifth seven of a source, and the third large error."""
    rules = Scoped([{"field": "props", "pattern": "7", "threshold": 5, "repeat": True}], {"error": [{"field": "large", "pattern": "true", "threshold": 3}]})
    alerts = ended(spark, sf, lambda rows: state.match_alerts(rows.withColumn("large", F.col("value") > 9.5), rules, delay=DELAY).select("id", "source", "rule", "count"))
    return alerts


@query(f"""
    WITH e AS (SELECT *, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS tick FROM ({TIMED}) WHERE source IN ('error', 'purchase')),
    c AS (SELECT source AS name, tick, sum(count(*)) OVER (PARTITION BY source ORDER BY tick) AS value FROM e GROUP BY source, tick),
    r AS (SELECT * FROM c WHERE value >= CASE name WHEN 'error' THEN 40 ELSE 200 END)
    SELECT name, make_timestamp(arg_min(tick, tick)) AS first_tick, arg_min(value, tick)::BIGINT AS first_value FROM r GROUP BY name
""")
def stream_alerts(spark, sf):
    """When each counter first reached its threshold. A closed stream's clock runs on, so the cooldown is long."""
    rules = [{"counter": "error", "threshold": 40, "cooldown": "240000h"}, {"counter": "purchase", "threshold": 200, "cooldown": "240000h"}]
    alerts = ended(spark, sf, lambda rows: state.threshold_alerts(rows, rules, "1h", name="source", delay=DELAY))
    return alerts.groupBy("name").agg(F.min("tick").cast("timestamp_ntz").alias("first_tick"), F.min_by("value", "tick").alias("first_value"))


def nearest_sql(rows):
    return f"""
    WITH e AS ({rows}), l AS (SELECT * FROM e WHERE source = 'purchase'), r AS (SELECT * FROM e WHERE source = 'click'),
    m AS (SELECT l.id AS left_id, r.id AS right_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS far, r.ts AS rts
          FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 43200000000)
    SELECT l.id AS left_id, arg_min(m.right_id, (m.far, m.rts, m.right_id)) AS right_id FROM l LEFT JOIN m ON l.id = m.left_id GROUP BY l.id"""


@query(nearest_sql(TIMED))
def stream_nearest(spark, sf):
    """Each purchase with its user's nearest click within twelve hours, or none."""
    start = lambda rows, path, checkpoint: stepped.start_nearest(
        rows.filter("source IS NULL OR source IN ('purchase', 'click')"), F.col("source") == "purchase", "user_id", "12h", path, checkpoint, keep_unmatched=True, delay=16 * 86_400)
    return stepped_to_end(spark, sf, start).select("left_id", "right_id")


@query(f"""
    SELECT source, window_start, count(*) AS count
    FROM (SELECT source, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM ({TIMED})) GROUP BY ALL
""")
def stream_tumbling(spark, sf):
    out = ended(spark, sf, lambda rows: native.tumbling_totals(rows, "value", "6h", delay=DELAY).select("source", "window_start", "count"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""
    WITH e AS (SELECT *, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS slot FROM ({TIMED})),
    x AS (SELECT *, slot - unnest(range(6)) * INTERVAL 60 MINUTE AS window_start FROM e)
    SELECT window_start, level, count(*) AS n FROM x GROUP BY ALL
""")
def stream_value_counts(spark, sf):
    out = ended(spark, sf, lambda rows: native.sliding_counts(rows, "6h", 6, keys=["level"], delay=DELAY).select("window_start", "level", "n"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_type AS source, user_id FROM events")
def stream_distinct(spark, sf):
    keys = events_stream(spark, sf).select("source", "user_id")
    return drained(spark, native.distinct_records(keys, ["source", "user_id"]))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe_within_watermark(spark, sf):
    """One batch holds all rows, so each user passes once."""
    kept = native.dedupe_within_watermark(events_stream(spark, sf), ["user_id"], delay="12 hours")
    return drained(spark, kept.select("user_id"))


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error'")
def stream_stateless(spark, sf):
    """Parsing and filters run unchanged on a stream."""
    rows = filters.filter_rules(events_stream(spark, sf), [{"field": "level", "pattern": "^error$"}])
    parsed = parse.promote(parse.parse_lines(rows.withColumnRenamed("props", "line"), "json"), ["k"])
    return drained(spark, parsed.select("id", "k"))


TWO_SINKS = "SELECT sink, event_id AS id, event_type AS level FROM events, (SELECT unnest(['a', 'b']) AS sink)"


def _read_sinks(spark, paths):
    both = None
    for name, path in paths.items():
        part = spark.read.schema("id bigint, level string").json(path).select("id", "level", F.lit(name).alias("sink"))
        both = part if both is None else both.unionByName(part)
    return both


@query(TWO_SINKS)
def stream_fan_out(spark, sf):
    """Each micro-batch to two sinks."""
    paths = {name: scratch(spark, name) for name in ("a", "b")}
    writers = {name: sinks.json_sink(path) for name, path in paths.items()}
    running = sinks.start_fan_out(arriving(spark, sf).select("id", "level"), writers, scratch(spark, "fan-state"))
    running.awaitTermination()
    return _read_sinks(spark, paths)


@query(TWO_SINKS)
def stream_fan_out_replay(spark, sf):
    """The second sink fails once in every batch, after the first has taken it; the stream is started again each time."""
    paths = {name: scratch(spark, name) for name in ("a", "b")}
    second, failed = sinks.json_folders(paths["b"]), set()

    def failing(df, where):
        # The folder's name ends in the batch's number.
        second.write(df, where)
        if where not in failed:
            failed.add(where)
            raise OSError("the sink went away")

    stream, checkpoint = arriving(spark, sf).select("id", "level"), scratch(spark, "fan-state")
    for attempt in range(4 * SLICES + 2):
        running = sinks.start_fan_out(stream, {"a": sinks.json_folders(paths["a"]), "b": sinks.BatchFolders(paths["b"], failing)}, checkpoint)
        try:
            running.awaitTermination()
            break
        except StreamingQueryException:
            continue
    assert failed
    return _read_sinks(spark, paths)


@query("""
    SELECT stage, name, value FROM (
        SELECT 'read' AS stage, 'rows' AS name, count(*) AS value FROM events
        UNION ALL SELECT 'read', 'errors', count(*) FILTER (event_type = 'error') FROM events
        UNION ALL SELECT 'kept', 'rows', count(*) FROM events WHERE event_type IN ('error', 'click')
        UNION ALL SELECT 'kept', 'large', count(*) FILTER (value > 50) FROM events WHERE event_type IN ('error', 'click'))
""")
def stream_stage_counters(spark, sf):
    """Counts at two stages of a stream of several batches, from its progress."""
    listener = observed.StageCounters().start(spark)
    try:
        read = observed.counted(arriving(spark, sf), "read", {"rows": None, "errors": F.col("level") == "error"})
        kept = filters.filter_rules(read, [{"field": "level", "pattern": "^(error|click)$"}])
        out = observed.counted(kept, "kept", {"rows": None, "large": F.col("value") > 50}).select("id")
        running = out.writeStream.format("parquet").option("path", scratch(spark, "counted")).option("checkpointLocation", scratch(spark, "counted-state")).trigger(availableNow=True).start()
        listener.finish(running)
        return listener.totals(spark)
    finally:
        listener.stop(spark)


@query(f"""
    WITH RECURSIVE reached AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 16 * 86400000000 AS t FROM ({TIMED})),
    rows_ AS MATERIALIZED (SELECT e.* FROM ({TIMED}) e, reached WHERE epoch_us(e.ts) <= reached.t), {leaders_sql("lead_", "rows_", "user_id", "12 HOUR")},
    last AS (SELECT k, max(t) AS t FROM lead_ GROUP BY k)
    SELECT k AS user_id, epoch_us(last.t) AS opened_us FROM last, reached WHERE epoch_us(last.t) + 43200000000 > reached.t
""")
def state_after_purge(spark, sf):
    """The state that a stream of twelve-hour windows holds at its end, read as a table: open windows, nothing of expired keys."""
    checkpoint = scratch(spark, "purge-state")
    kept = state.dedupe(arriving(spark, sf), {"fields": ["user_id"], "window": "12h"}, delay=DELAY)
    sinks.resume_ingest(kept.select("id"), scratch(spark, "purged"), checkpoint)
    held = state.held_state(spark, checkpoint, "state")
    return held.select(F.get_json_object("key.key", "$[0]").cast("bigint").alias("user_id"), F.col("value.start").alias("opened_us"))


@query("SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT unnest(string_split(text, chr(10))) FROM conversations")
def stream_resume(spark, sf):
    """Lines arrive in two steps; the second run reads only what is new."""
    configure_streaming(spark)
    inbox, out, checkpoint = (scratch(spark, n) for n in ("inbox", "resumed", "resume-state"))
    for name, df in (("documents", table(spark, sf, "documents")), ("conversations", table(spark, sf, "conversations"))):
        df.select("text").write.mode("append").text(inbox)
        sinks.resume_ingest(readers.stream_lines(spark, inbox).select("line"), out, checkpoint)
    return spark.read.parquet(out)
