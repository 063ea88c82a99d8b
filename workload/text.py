"""Parsing, rendering and multi-line assembly."""

from pyspark.sql import functions as F

from tidelog.operators import multiline, parse, render
from tidelog.specs import Scoped
from workload import logs, query, table


@query("""
    SELECT event_id AS id, CAST(event_id AS VARCHAR) AS f_id, event_type AS f_level, json_extract_string(props, '$.k') AS f_k,
           strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS f_time, CAST(NULL AS VARCHAR) AS _error
    FROM events
""")
def parse_json_lines(spark, sf):
    """Each event as a JSON line with a nested object; ``time`` from the event's own clock."""
    rows = logs(spark, sf)
    line = F.to_json(F.struct(F.col("id").alias("id"), "level", F.parse_json("props").alias("props")))
    parsed = parse.parse_lines(rows.withColumn("line", line), "JSON", ingest="ts")
    out = parse.promote(parsed, ["id", "level", "time"], prefix="f_")
    return out.select("id", "f_id", "f_level", F.get_json_object(F.col("fields")["props"], "$.k").alias("f_k"), "f_time", "_error")


@query("""
    SELECT doc_id, NULL::VARCHAR AS first, 'parse: line does not parse' AS _error FROM documents
""")
def parse_json_failures(spark, sf):
    """Prose is not JSON: every document is a reject."""
    rows = table(spark, sf, "documents").withColumnRenamed("text", "line")
    parsed = parse.parse_lines(rows, "json")
    return parsed.select("doc_id", F.try_element_at("fields", F.lit("first")).alias("first"), "_error")


@query("""
    SELECT event_id AS id, event_type AS level, CAST(user_id AS VARCHAR) AS user, 'hello' AS msg, 'b' AS dup, 'world"' AS bare
    FROM events
""")
def parse_logfmt_lines(spark, sf):
    rows = logs(spark, sf)
    line = F.concat(
        F.lit("  level="), "level", F.lit('\tuser="'), F.col("user_id").cast("string"),
        F.lit('" msg="hello world" dup=a dup=b\n'),
    )
    parsed = parse.parse_lines(rows.select("id", line.alias("line")), "logfmt")
    out = parse.promote(parsed, ["level", "user", "msg", "dup"])
    return out.select("id", "level", "user", "msg", "dup", F.lit('world"').alias("bare"))


@query("""
    SELECT event_id AS id, event_type AS level, 'hello big world' AS msg, 'first' AS other FROM events
""")
def parse_logfmt_quoted(spark, sf):
    line = F.concat(F.lit('level="'), "level", F.lit('" msg="hello big world" other=first rest'))
    rows = logs(spark, sf).select("id", line.alias("line"))
    return parse.promote(parse.parse_lines(rows, "logfmt", quoted=True), ["level", "msg", "other"]).select("id", "level", "msg", "other")


@query(r"""
    SELECT doc_id, text AS _raw, len(list_distinct(list_transform(list_filter(
        regexp_split_to_array(text, '\s+'), lambda w: contains(w, '=')), lambda w: split_part(w, '=', 1)))) AS n_keys
    FROM documents
""")
def extract_pairs(spark, sf):
    rows = table(spark, sf, "documents")
    record = parse.extract_kv(F.col("text"))
    return rows.select("doc_id", record.alias("f")).select(
        "doc_id", F.col("f")["_raw"].alias("_raw"), (F.size(F.map_keys("f")) - 1).cast("long").alias("n_keys")
    )


@query("""
    SELECT event_id AS id, event_type AS source,
           CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS v
    FROM events
""")
def parser_by_source(spark, sf):
    """Errors are logfmt lines, everything else is JSON."""
    rows = logs(spark, sf)
    line = F.when(F.col("source") == "error", F.concat(F.lit("v="), F.col("user_id").cast("string"))).otherwise(
        F.to_json(F.struct(F.col("value").alias("v")))
    )
    parsed = parse.parse_lines(rows.withColumn("line", line), Scoped("json", {"error": "LOGFMT"}))
    return parse.promote(parsed, ["v"]).select("id", "source", "v")


@query("""
    SELECT o_orderkey, '{"cust":' || o_custkey || CASE WHEN o_orderstatus <> 'P' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS line
    FROM orders
""")
def format_json_lines(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("cust")
    )
    return render.render(rows, "json", ["status", "cust"]).select("o_orderkey", "line")


@query("""
    SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || upper(event_type) || ' ' || props || ' a=' || user_id
           || CASE WHEN event_type = 'view' THEN ' z=last' ELSE '' END AS line
    FROM events
""")
def format_text_lines(spark, sf):
    rows = logs(spark, sf).select(
        "id", F.col("ts").alias("time"), "level", F.col("props").alias("message"),
        F.when(F.col("level") == "view", "last").alias("z"), F.col("user_id").alias("a"),
    )
    return render.render(rows, "text", ["time", "level", "message", "z", "a"]).select("id", "line")


@query(r"""
    SELECT doc_id, 'lang=' || lang || ' text=' || CASE WHEN regexp_matches(text, '[ \t\n]')
        THEN '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') || '"'
        ELSE text END AS line
    FROM documents
""")
def format_logfmt_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("text"), "text", F.lit("lang"), "lang").alias("rec"))
    return render.render(rows, "logfmt", fields="rec").select("doc_id", "line")


def _lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select(F.col("doc_id").alias("source"), F.col("pos").cast("long").alias("id"), "line")


@query("""
    WITH l AS (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS line,
                      CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS id FROM documents),
    s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|La|Der|El|Le|Die) ') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY source ORDER BY id) AS seg FROM l),
    c AS (SELECT *, (row_number() OVER (PARTITION BY source, seg ORDER BY id) - 1) // 5 AS chunk FROM s)
    SELECT source, min(id) AS id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY id) AS message
    FROM c GROUP BY source, seg, chunk
""")
def multiline_start(spark, sf):
    rule = {"start_pattern": "^(The|La|Der|El|Le|Die) ", "max_lines": 5}
    return multiline.assemble_multiline(_lines(spark, sf), rule, ts=None)


@query("""
    WITH s AS (SELECT *, sum(CASE WHEN NOT regexp_matches(props, '[02468]}$') OR gap >= 900 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seg
               FROM (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap
                     FROM events))
    SELECT event_type AS source, min(ts) AS ts, min(event_id) AS id, count(*) AS n_lines,
           string_agg(props, chr(10) ORDER BY ts, event_id) AS message
    FROM s GROUP BY event_type, seg
""")
def multiline_continue(spark, sf):
    """Even numbers continue the record before them unless 15 minutes have passed."""
    rows = logs(spark, sf).select("source", "ts", "id", F.col("props").alias("line"))
    return multiline.assemble_multiline(rows, {"continue_pattern": "[02468]}$", "timeout": "15m"})
