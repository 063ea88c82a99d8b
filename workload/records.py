"""Stateless record operators."""

from pyspark.sql import functions as F

from tidelog.operators import filters, route, shape, values
from tidelog.specs import Scoped
from workload import LOGS_SQL, logs, query, table


@query(f"""
    SELECT source, CASE WHEN source = 'error' THEN 'err!' ELSE level END AS level, ts, id, value,
           user_id AS uid, 'prod' AS env, CASE WHEN source = 'click' THEN 'front' END AS tier
    FROM ({LOGS_SQL})
""")
def transform_fields(spark, sf):
    """Add, remove, rename, replace; clicks get one more rule."""
    rules = [
        {"op": "add", "field": "env", "value": "prod"},
        {"op": "remove", "field": "props"},
        {"op": "rename", "field": "user_id", "new_name": "uid"},
        {"op": "replace", "field": "level", "pattern": "^(err)or$", "value": "${1}!"},
    ]
    extra = [{"op": "add", "field": "tier", "value": "front"}]
    return shape.transform(logs(spark, sf), Scoped(rules, {"click": extra}))


@query(f"SELECT source, 'fixed' AS level, ts, id, user_id, value, props, 'a' AS team FROM ({LOGS_SQL})")
def tag_fields(spark, sf):
    rules = [
        {"field": "team", "value": "a"},
        {"field": "team", "value": "b"},
        {"field": "source", "value": "kept"},
        {"field": "level", "value": "fixed", "overwrite": True},
    ]
    return shape.tag(logs(spark, sf), rules)


@query(f"""
    SELECT *, CASE WHEN source = 'error' THEN 'staging' ELSE 'prod' END AS env,
           CASE WHEN source = 'error' THEN 'app' END AS service
    FROM ({LOGS_SQL})
""")
def enrich_constants(spark, sf):
    constants = Scoped({"env": "prod", "source": "never"}, {"error": {"env": "staging", "service": "app"}})
    return shape.enrich(logs(spark, sf), constants)


@query("""
    SELECT o_orderkey,
           COALESCE(NULLIF(a, ''), NULLIF(b, ''), c) AS best,
           CASE WHEN COALESCE(NULLIF(a, ''), NULLIF(b, ''), c) IS NULL THEN a END AS a,
           CASE WHEN COALESCE(NULLIF(a, ''), NULLIF(b, ''), c) IS NULL THEN b END AS b,
           CASE WHEN COALESCE(NULLIF(a, ''), NULLIF(b, ''), c) IS NULL THEN c END AS c
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS a,
                 CASE WHEN o_totalprice > 300000 THEN o_orderstatus END AS b,
                 CASE WHEN o_totalprice > 100000 THEN 'big' END AS c FROM orders)
""")
def coalesce_first(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("a"),
        F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus")).alias("b"),
        F.when(F.col("o_totalprice") > 100000, "big").alias("c"),
    )
    return shape.coalesce_fields(rows, [{"sources": ["a", "b", "c"], "dest": "best"}])


def _nested(spark, sf):
    return logs(spark, sf).select(
        "id", F.struct("user_id", F.struct("value", F.col("level").alias("kind")).alias("deep")).alias("meta")
    )


@query('SELECT event_id AS id, user_id AS "meta.user_id", value AS "meta.deep.value", event_type AS "meta.deep.kind" FROM events')
def flatten_struct(spark, sf):
    return shape.flatten(_nested(spark, sf), [{"field": "meta", "prefix": "@field", "drop_source": True}])


@query("""SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "p.k" FROM events""")
def flatten_open_record(spark, sf):
    rows = logs(spark, sf).select("id", F.parse_json("props").alias("props"))
    return shape.flatten_variant(rows, "props", {"k": "bigint"}, prefix="p").drop("props")


@query("""
    SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS k, 3 AS n_leaves FROM events
""")
def flatten_undeclared(spark, sf):
    """Leaves of an open record whose fields are not declared."""
    line = F.to_json(F.struct("id", F.struct("user_id", F.parse_json("props").alias("props")).alias("meta")))
    rows = logs(spark, sf).select("id", shape.open_leaves(F.parse_json(line), "rec").alias("leaves"))
    return rows.select(
        "id", F.col("leaves")["rec.meta.user_id"].alias("user_id"), F.col("leaves")["rec.meta.props.k"].alias("k"),
        F.size("leaves").alias("n_leaves"),
    )


@query("SELECT event_id AS id, user_id AS m_user_id, value AS v_value, event_type AS v_kind FROM events")
def unwrap_struct(spark, sf):
    rules = [
        {"field": "meta.deep", "prefix": "v_"},
        {"field": "meta", "prefix": "m_", "remove": True},
    ]
    return shape.unwrap(_nested(spark, sf), rules).drop("m_deep")


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def unwrap_map(spark, sf):
    rows = logs(spark, sf).select("id", F.from_json("props", "map<string,string>").alias("props"))
    return shape.unwrap(rows, [{"field": "props", "keys": ["k", "absent"], "remove": True}])


@query("""
    SELECT doc_id, lang, unnest(w) AS words, CAST(unnest(range(len(w))) AS VARCHAR) AS word_index
    FROM (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents)
""")
def split_words(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.split("text", " ").alias("words"))
    return shape.split_array(rows, "words", "word")


@query("""
    SELECT o_orderkey, sha256(COALESCE(o_orderstatus, '<nil>') || '|' || COALESCE(kind, '<nil>') || '|' || o_custkey || '|<nil>') AS fingerprint
    FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS kind FROM orders)
""")
def fingerprint_orders(spark, sf):
    rows = table(spark, sf, "orders").withColumn("kind", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    marked = shape.fingerprint(rows, ["o_orderstatus", "kind", "o_custkey", "no_such_field"])
    return marked.select("o_orderkey", "fingerprint")


@query("""
    SELECT event_id AS id, TRY_CAST(k AS BIGINT) AS k,
           CAST(trunc(value) AS BIGINT) AS whole, value AS real,
           CASE WHEN flag IN ('1','t','T','TRUE','true','True') THEN true
                WHEN flag IN ('0','f','F','FALSE','false','False') THEN false END AS flag,
           CASE WHEN flag NOT IN ('1','t','T','TRUE','true','True','0','f','F','FALSE','false','False')
                THEN 'cast: field flag is not bool: ' || flag END AS _error,
           CAST(user_id AS VARCHAR) AS user_id
    FROM (SELECT *, json_extract_string(props, '$.k') AS k,
                 CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'F' WHEN 'error' THEN '1' ELSE event_type END AS flag
          FROM events)
""")
def cast_fields(spark, sf):
    rows = logs(spark, sf).select(
        "id",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("value").cast("string").alias("whole"),
        F.col("value").cast("string").alias("real"),
        F.when(F.col("level") == "click", "true").when(F.col("level") == "view", "F")
        .when(F.col("level") == "error", "1").otherwise(F.col("level")).alias("flag"),
        "user_id",
    )
    types = {"k": "int", "whole": "int", "real": "float", "flag": "bool", "user_id": "string"}
    return values.cast(rows, [{"field": f, "type": t} for f, t in types.items()])


@query(r"""
    SELECT doc_id, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS text, upper(lang) AS lang, source
    FROM (SELECT doc_id, ' ' || chr(9) || text || chr(10) AS text, lang, source FROM documents)
""")
def normalize_text(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("text"), "lang", "source"
    )
    rules = [{"field": "text", "op": "lowercase"}, {"field": "text", "op": "trim_space"}, {"field": "lang", "op": "uppercase"}]
    return values.normalize(rows, rules)


@query("""
    SELECT doc_id, CASE WHEN strlen(text) > 500
        THEN left(text, CAST(len(list_filter(range(1, 501), lambda k: strlen(left(text, CAST(k AS BIGINT))) <= 500)) AS BIGINT)) || '...'
        ELSE text END AS text
    FROM documents
""")
def truncate_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return values.truncate(rows, [{"field": "text", "max_len": 500, "suffix": "..."}])


@query("""
    SELECT event_id AS id, CASE event_type
        WHEN 'click' THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ')
        WHEN 'view' THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ')
        WHEN 'error' THEN strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ')
        ELSE 'no time ' || event_type END AS stamp
    FROM events
""")
def normalize_timestamps(spark, sf):
    rows = logs(spark, sf).select(
        "id",
        F.when(F.col("level") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("level") == "view", F.date_format("ts", "yyyy/MM/dd HH:mm:ss'+0200'"))
        .when(F.col("level") == "error", F.date_format("ts", "dd MMM yyyy"))
        .otherwise(F.concat(F.lit("no time "), "level"))
        .alias("stamp"),
    )
    layouts = ["2006-01-02T15:04:05Z07:00", "2006/01/02 15:04:05-0700", "02 Jan 2006"]
    return values.normalize_timestamp(rows, [{"field": "stamp", "layouts": layouts}])


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"""
    SELECT doc_id, regexp_replace(text, '{EMAIL}', '[mail]', 'g') AS text, '***' AS lang,
           regexp_replace(source, '\d+', '***', 'g') AS source
    FROM documents
""")
def redact_text(spark, sf):
    rules = [
        {"field": "text", "pattern": EMAIL, "placeholder": "[mail]"},
        {"field": "lang"},
        {"field": "source", "pattern": r"\d+", "style": "stars"},
        {"field": "absent"},
    ]
    return values.redact(table(spark, sf, "documents").drop("n_chars"), rules)


@query(r"""
    SELECT event_id AS id, CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) ELSE regexp_replace(CAST(user_id AS VARCHAR), '^\d', 'u', 'g') END AS user_id,
           CASE WHEN event_type = 'error' THEN '#' ELSE props END AS props
    FROM events
""")
def mask_values(spark, sf):
    rules = Scoped([{"field": "user_id", "pattern": r"^\d", "placeholder": "u"}], {"error": [{"field": "props", "placeholder": "#"}]})
    return values.mask(logs(spark, sf), rules).select("id", "user_id", "props")


@query(r"""
    SELECT doc_id,
           CASE WHEN regexp_matches(text, '(?i)the ') THEN 'english'
                WHEN regexp_matches(source, '[13579]$') THEN NULL
                WHEN regexp_matches(lang, '^(fr|es)$') THEN 'romance' END AS category,
           CASE WHEN regexp_matches(text, '(?i)the ') THEN NULL
                WHEN regexp_matches(source, '[13579]$') THEN 'odd' END AS parity
    FROM documents
""")
def classify_documents(spark, sf):
    rules = [
        {"field": "text", "pattern": "(?i)the ", "label": "english"},
        {"field": "source", "pattern": "[13579]$", "label": "odd", "dest": "parity"},
        {"field": "lang", "pattern": "^(fr|es)$", "label": "romance"},
        {"field": "absent", "pattern": ".", "label": "never"},
    ]
    return values.classify(table(spark, sf, "documents"), rules).select("doc_id", "category", "parity")


@query("""
    SELECT page_id, url FROM pages
    WHERE regexp_matches(url, '^https://') AND NOT regexp_matches(url, '[?]') AND regexp_matches('', '^$')
""")
def filter_pages(spark, sf):
    rules = [
        {"field": "url", "pattern": "^https://"},
        {"field": "url", "pattern": "[?]", "invert": True},
        {"field": "absent", "pattern": "^$"},
    ]
    return filters.filter_rules(table(spark, sf, "pages"), rules).select("page_id", "url")


@query("""
    SELECT o_orderkey, CASE WHEN kind IS NULL THEN 'schema: required field "kind" is missing'
                            WHEN note IS NOT NULL THEN 'schema: field "note" must be a number' END AS _error
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS kind,
                 CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS note FROM orders)
""")
def validate_orders(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("kind"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority")).alias("note"),
    )
    rules = [
        {"name": "kind", "type": "string", "required": True},
        {"name": "o_totalprice", "type": "number", "required": True},
        {"name": "note", "type": "float"},
        {"name": "absent", "type": "bool"},
    ]
    return filters.validate_schema(rows, rules).select("o_orderkey", "_error")


@query("""
    SELECT o_orderkey FROM orders
    WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND o_totalprice IS NOT NULL
""")
def valid_rows(spark, sf):
    rows = table(spark, sf, "orders").withColumn("kind", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    checked = filters.validate_schema(rows, [{"name": "kind", "type": "string", "required": True}])
    return filters.split_valid(checked)[0].select("o_orderkey")


@query("SELECT o_orderkey, 'schema: required field \"kind\" is missing' AS _error FROM orders WHERE o_orderstatus = 'P'")
def rejected_rows(spark, sf):
    rows = table(spark, sf, "orders").withColumn("kind", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    checked = filters.validate_schema(rows, [{"name": "kind", "type": "string", "required": True}])
    return filters.split_valid(checked)[1].select("o_orderkey", "_error")


@query(f"""
    SELECT id, source FROM ({LOGS_SQL})
    WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0
          < CASE WHEN source = 'view' THEN 0.05 WHEN source = 'error' THEN 1.0 ELSE 0.3 END
""")
def sample_rows(spark, sf):
    return filters.sample(logs(spark, sf), "id", Scoped(0.3, {"view": 0.05, "error": 1.0})).select("id", "source")


@query(r"""
    SELECT page_id, unnest(CASE WHEN regexp_matches(url, '^http:') THEN ['plain', 'audit']
                                WHEN regexp_matches(url, 'com') AND regexp_matches(html, 'lang="fr"') THEN ['french']
                                ELSE ['rest'] END) AS sink
    FROM pages
""")
def route_pages(spark, sf):
    rules = [
        {"source_pattern": "^http:", "sinks": ["plain", "audit"]},
        {"source_pattern": "com", "field": "html", "field_pattern": 'lang="fr"', "sinks": ["french"]},
    ]
    return route.route(table(spark, sf, "pages"), rules, ["rest"], source="url").select("page_id", "sink")


# A record of each event, nested by as many levels as its user's number says.
DEEPEST = 14


def _deep(spark, sf):
    levels = F.pmod("user_id", F.lit(DEEPEST)).cast("int")
    path = F.transform(F.sequence(F.lit(0), levels), lambda i: F.concat(F.lit("l"), i.cast("string")))
    opening = F.array_join(F.transform(path, lambda name: F.concat(F.lit('{"at":"'), name, F.lit('","'), name, F.lit('":'))), "")
    line = F.concat(opening, F.col("props"), F.repeat(F.lit("}"), levels + 1))
    return logs(spark, sf).select("id", F.concat(F.array_join(path, "."), F.lit(".k")).alias("path"), F.parse_json(line).alias("record"), (levels + 2).alias("n"))


@query(f"""
    SELECT event_id AS id, json_extract_string(props, '$.k') AS k, user_id % {DEEPEST} + 2 AS n_leaves, 'l' || user_id % {DEEPEST} AS last
    FROM events
""")
def flatten_deep(spark, sf):
    """All leaves of records up to fifteen levels deep, undeclared."""
    flat = shape.flatten_open(_deep(spark, sf), "record", "leaves")
    last = F.element_at("leaves", F.concat(F.regexp_extract("path", r"^(.*\.)?l\d+\.k$", 1), F.lit("at")))
    return flat.select("id", F.element_at("leaves", F.col("path")).alias("k"), F.size("leaves").cast("long").alias("n_leaves"), last.alias("last"))


@query(f"""
    SELECT event_id AS id, {", ".join(f"CASE WHEN user_id % {DEEPEST} = {n} THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k{n}" for n in range(DEEPEST))},
           CASE WHEN user_id % {DEEPEST} >= 10 THEN 'l10' END AS at9
    FROM events
""")
def flatten_variant_rule(spark, sf):
    """The same records through a flatten rule: every leaf that occurs becomes a column."""
    flat = shape.flatten(_deep(spark, sf), [{"field": "record", "prefix": "@field", "drop_source": True}])
    name = lambda n: "record." + ".".join(f"l{i}" for i in range(n + 1))
    have = lambda c, kind: F.col(f"`{c}`") if c in flat.columns else F.lit(None).cast(kind)
    return flat.select("id", *[have(name(n) + ".k", "bigint").cast("bigint").alias(f"k{n}") for n in range(DEEPEST)], have(name(9) + ".at", "string").alias("at9"))


@query("""
    SELECT event_id AS id,
           CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE value END AS number,
           CASE WHEN event_type IN ('click', 'view') THEN 'cast: field text is not float: ' || CASE event_type WHEN 'click' THEN '1e400' ELSE '-9' || repeat('0', 400) END END AS _error,
           CASE event_type WHEN 'click' THEN '1e400' WHEN 'view' THEN '-9' || repeat('0', 400) ELSE CAST(value AS VARCHAR) END AS text
    FROM events
""")
def cast_edges(spark, sf):
    """Numbers too large for the type don't read; the value goes to a column of its own, the text stays."""
    level = F.col("level")
    text = F.when(level == "click", "1e400").when(level == "view", F.concat(F.lit("-9"), F.repeat(F.lit("0"), 400))).otherwise(F.col("value").cast("string"))
    rows = logs(spark, sf).select("id", text.alias("text"))
    return values.cast(rows, [{"field": "text", "type": "float", "dest": "number"}])


@query(r"""
    SELECT event_id AS id, regexp_matches(props, '^\{"k": \d+\}$') AS quoted, event_type = 'click' AS lines, false AS blanks,
           event_type IN ('click', 'error') AS outer_end
    FROM events
""")
def filter_dialect(spark, sf):
    """Quoted text, flags that end with their group, and white space without the vertical tab, in filter rules."""
    level = F.col("level")
    rows = logs(spark, sf).select(
        "id", F.col("props").alias("quoted"), F.concat(F.lit("a\n"), level, F.lit("\nb")).alias("lines"),
        F.concat(level, F.lit("\x0b"), level).alias("blanks"), F.concat(level, F.lit("\n"), F.when(level.isin("click", "error"), "end").otherwise("end\nmore")).alias("outer_end"),
    )
    patterns = {"quoted": r'^\Q{"k": \E\d+\Q}\E$', "lines": "(?m:^click$)", "blanks": r"[\s,]", "outer_end": r"(?m:[a-z]$)\nend$"}
    hits = None
    for name, pattern in patterns.items():
        kept = filters.filter_rules(rows, [{"field": name, "pattern": pattern}]).select("id", F.lit(name).alias("rule"))
        hits = kept if hits is None else hits.unionByName(kept)
    found = hits.groupBy("id").agg(F.collect_set("rule").alias("rules"))
    marked = rows.select("id").join(found, "id", "left")
    return marked.select("id", *[F.coalesce(F.array_contains("rules", name), F.lit(False)).alias(name) for name in patterns])
