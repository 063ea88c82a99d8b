"""Stateless operators on small tables: usual cases, missing fields, wrong types, scopes, bad rules."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import filters, route, shape, values
from tidelog.specs import Scoped, duration_us


def one(df):
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def rec(spark):
    return spark.createDataFrame([("info", "hello world", "srv-01")], "level string, message string, host string")


def test_transform(rec):
    rules = [
        {"op": "add", "field": "env", "value": "prod"},
        {"op": "remove", "field": "host"},
        {"op": "remove", "field": "absent"},
        {"op": "rename", "field": "level", "new_name": "severity"},
        {"op": "rename", "field": "absent", "new_name": "x"},
        {"op": "replace", "field": "message", "pattern": "o", "value": "0"},
    ]
    assert one(shape.transform(rec, rules)) == {"message": "hell0 w0rld", "env": "prod", "severity": "info"}


@pytest.mark.parametrize("rule", [{"op": "nope", "field": "a"}, {"op": "add", "field": ""}, {"op": "replace", "field": "a", "pattern": "("}, {"op": "add", "field": "a", "extra": 1}])
def test_transform_errors(spark, rule):
    with pytest.raises(ValueError):
        shape.TransformRule.parse(rule)


def test_scoped_layers(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "X"), (None, "X")], "source string, m string")
    rules = Scoped([{"field": "m", "op": "lowercase"}], {"b": [{"field": "m", "op": "uppercase"}]})
    assert [r["m"] for r in values.normalize(df, rules).orderBy("source").collect()] == ["x", "x", "X"]
    only = Scoped(None, {"b": [{"field": "m", "placeholder": "#"}]})
    assert sorted((r["source"] or "", r["m"]) for r in values.redact(df, only).collect()) == [("", "X"), ("a", "X"), ("b", "#")]


def test_tag_enrich(spark):
    df = spark.createDataFrame([("hello", None), ("bye", "qa")], "message string, env string")
    tagged = shape.tag(df, [{"field": "env", "value": "prod"}, {"field": "message", "value": "m", "overwrite": True}])
    assert [tuple(r) for r in tagged.collect()] == [("m", "prod"), ("m", "qa")]
    got = shape.enrich(df.withColumn("source", F.lit("app")), Scoped({"env": "prod", "team": "x"}, {"app": {"env": "staging"}}))
    assert [(r["env"], r["team"]) for r in got.collect()] == [("staging", "x"), ("qa", "x")]
    with pytest.raises(ValueError):
        shape.tag(df, [])


def test_coalesce(spark):
    df = spark.createDataFrame([("hello", "", "fallback"), ("", None, "t"), (None, "", None)], "msg string, message string, text string")
    got = shape.coalesce_fields(df, [{"sources": ["msg", "message", "text"], "dest": "out"}])
    assert [tuple(r) for r in got.collect()] == [(None, None, None, "hello"), (None, None, None, "t"), (None, "", None, None)]
    same = shape.coalesce_fields(df, [{"sources": ["msg", "text"], "dest": "msg"}])
    assert [tuple(r) for r in same.collect()] == [("hello", "", None), ("t", None, None), (None, "", None)]
    kept = shape.coalesce_fields(df, [{"sources": ["msg", "text"], "dest": "out", "keep_sources": True}])
    assert [r["text"] for r in kept.collect()] == ["fallback", "t", None]


def test_flatten_unwrap(spark):
    df = spark.sql("SELECT 'hi' AS message, named_struct('host', 'srv1', 'deep', named_struct('b', 'x')) AS meta")
    flat = shape.flatten(df, [{"field": "meta", "prefix": "@field", "drop_source": True}, {"field": "message"}, {"field": "no"}])
    assert one(flat) == {"message": "hi", "meta.host": "srv1", "meta.deep.b": "x"}
    bare = shape.flatten(df, [{"field": "meta", "separator": "_"}])
    assert set(bare.columns) == {"message", "meta", "host", "deep_b"}
    un = shape.unwrap(df, [{"field": "meta", "prefix": "m_", "remove": True}])
    assert set(un.columns) == {"message", "m_host", "m_deep"}
    merged = spark.sql("SELECT map('a', '1') AS f, map('a', '2', 'b', '3') AS n").select(shape.merge_map("f", "n").alias("m"))
    assert one(merged)["m"] == {"a": "2", "b": "3"}
    with pytest.raises(ValueError):
        shape.FlattenRule(field=" ")


def test_open_leaves(spark):
    lines = ['{"a":1,"b":{"c":"x","d":{"e":[1,2],"f":null}},"g":{}}', "[1]", None]
    df = spark.createDataFrame([(line,) for line in lines], "line string").select(F.parse_json("line").alias("v"))
    got = [r[0] for r in df.select(shape.open_leaves("v", "p", "_")).collect()]
    assert got == [{"p_a": "1", "p_b_c": "x", "p_b_d_e": "[1,2]", "p_b_d_f": None}, None, None]
    with pytest.raises(Exception, match="more than 1 levels"):
        df.select(shape.open_leaves("v", depth=1)).collect()


@pytest.mark.parametrize("levels", [4, 9])
def test_flatten_open_goes_as_deep_as_the_data(spark, levels):
    def nested(depth, leaf):
        return leaf if depth == 0 else '{"a.%d":%s,"x":[{"y":{"z":%d}}]}' % (depth, nested(depth - 1, leaf), depth)

    rows = [(i, nested(i, '"end"')) for i in range(1, 24)] + [(30, nested(3, "{}")), (31, "[]"), (32, None), (33, nested(2, "null")), (34, "5")]
    df = spark.createDataFrame(rows, "i int, line string").select("i", F.parse_json("line").alias("v"), F.lit("kept").alias("other"))
    got = {r["i"]: r["leaves"] for r in shape.flatten_open(df, "v", "leaves", "p", "/", levels=levels).collect()}

    def want(depth, leaf):
        path, out = "p", {}
        for d in range(depth, 0, -1):
            out[f"{path}/x"] = '[{"y":{"z":%d}}]' % d
            path += f"/a.{d}"
        return out if leaf == () else {**out, path: leaf}

    assert got == {**{i: want(i, "end") for i in range(1, 24)}, 30: want(3, ()), 31: None, 32: None, 33: want(2, None), 34: None}
    with pytest.raises(Exception, match="more than 8 levels"):
        df.select(shape.open_leaves("v")).collect()


def test_flatten_rule_on_a_variant(spark):
    lines = ['{"a":1,"deep":{"b":{"c":true},"l":[1,{"m":2}]},"mixed":1}', '{"a":2.5,"mixed":"text","only null":null}', "7", None, '{"deep":5}']
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string").select("i", F.parse_json("line").alias("v"), F.lit("old").alias("v.a"))
    flat = shape.flatten(df, [{"field": "v", "prefix": "@field", "drop_source": True}]).orderBy("i")
    assert set(flat.columns) == {"i", "v.a"} | {c for c in flat.columns if c.startswith("v.")}
    rows = [r.asDict() for r in flat.collect()]
    assert [None if r["v.a"] is None else float(r["v.a"]) for r in rows] == [1.0, 2.5, None, None, None]  # a double, so the column "v.a" of another type is replaced
    assert [r["v.mixed"] for r in rows] == ["1", "text", None, None, None] and rows[1]["v.only null"] is None
    assert [(r["v.deep"], r["v.deep.b.c"], r["v.deep.l"]) for r in rows] == [(None, True, '[1,{"m":2}]'), *[(None, None, None)] * 3, (5, None, None)]
    deep = shape.flatten(df.filter("i = 0"), [{"field": "v", "separator": "/"}]).first()
    assert (deep["deep/b/c"], deep["deep/l"], deep["a"]) == (True, '[1,{"m":2}]', 1)
    nothing = shape.flatten(df.filter("i IN (2, 3)"), [{"field": "v"}])
    assert nothing.columns == ["i", "v", "v.a"]


def test_split(spark):
    df = spark.createDataFrame([("s", ["a", "b"]), ("t", []), ("u", None)], "source string, tags array<string>")
    got = shape.split_array(df, "tags").collect()
    assert sorted((r["source"], r["tags"] or "", r["_index"] or "") for r in got) == [("s", "a", "0"), ("s", "b", "1"), ("u", "", "")]
    assert "tag_index" in shape.split_array(df, "tags", "tag").columns
    assert shape.split_array(df, "source").columns == df.columns


def test_fingerprint(spark, rec):
    import hashlib

    want = hashlib.sha256(b"info|<nil>|srv-01").hexdigest()
    assert one(shape.fingerprint(rec, ["level", "absent", "host"]))["fingerprint"] == want
    everything = hashlib.sha256(b"srv-01|info|hello world").hexdigest()
    assert one(shape.fingerprint(rec))["fingerprint"] == everything
    with pytest.raises(ValueError):
        shape.fingerprint(rec, [" "])


def test_cast(spark):
    texts = ["42", "3.9", "-3.9", " 7 ", "abc", None, "true", "yes", "1e3", "99999999999999999999", "+5", "0x10"]
    df = spark.createDataFrame([(t, t, t) for t in texts], "i string, f string, b string")
    got = values.cast(df, [{"field": "i", "type": "int"}, {"field": "f", "type": "float"}, {"field": "b", "type": "bool"}]).collect()
    assert [r["i"] for r in got] == [42, 3, -3, None, None, None, None, None, 1000, None, 5, None]
    assert [r["f"] for r in got][:5] == [42.0, 3.9, -3.9, None, None]
    assert [r["b"] for r in got] == [None] * 6 + [True] + [None] * 5
    assert got[5]["_error"] is None and got[3]["_error"].startswith("cast: field i is not int")
    kept = values.cast(df, [{"field": "i", "type": "int", "dest": "n"}])
    assert kept.columns[0] == "i" and dict(kept.dtypes)["n"] == "bigint"
    with pytest.raises(ValueError):
        values.CastRule(field="a", type="date")


def test_normalize_truncate(spark):
    df = spark.createDataFrame([("INFO", "  hello\t\n", 42)], "level string, message string, count int")
    rules = [{"field": "level", "op": "lowercase"}, {"field": "message", "op": "trim_space"}, {"field": "count", "op": "uppercase"}]
    assert tuple(values.normalize(df, rules).first()) == ("info", "hello", 42)
    texts = ["hello world", "hello", "héé", "日本語", "", None, "a😀b"]
    cut = spark.createDataFrame([(t,) for t in texts], "m string")
    for size in range(1, 9):
        got = [r["m"] for r in values.truncate(cut, [{"field": "m", "max_len": size, "suffix": "..."}]).collect()]
        for text, short in zip(texts, got):
            if text is None or len(text.encode()) <= size:
                assert short == text
            else:
                assert short == text.encode()[:size].decode(errors="ignore") + "..."


def test_timestamps(spark):
    texts = ["2024-03-15T10:30:00Z", "2024-03-15T10:30:00.123+02:00", "2024-03-15", "15/Mar/2024:10:30:00 -0700", "junk", None]
    df = spark.createDataFrame([(t,) for t in texts], "ts string")
    layouts = ["2006-01-02T15:04:05Z07:00", "2006-01-02", "02/Jan/2006:15:04:05 -0700"]
    got = [r["ts"] for r in values.normalize_timestamp(df, [{"field": "ts", "layouts": layouts}]).collect()]
    assert got == ["2024-03-15T10:30:00Z", "2024-03-15T08:30:00Z", "2024-03-15T00:00:00Z", "2024-03-15T17:30:00Z", "junk", None]
    other = values.normalize_timestamp(df, [{"field": "ts", "layouts": layouts, "output_field": "day", "output_layout": "Jan 2, 2006"}])
    assert [r["day"] for r in other.collect()][0] == "Mar 15, 2024" and other.first()["ts"] == texts[0]


def test_redact_mask(spark):
    df = spark.createDataFrame([("alice", "s3cr3t", "alice@example.com", 5)], "user string, password string, email string, n int")
    red = values.redact(df, [{"field": "password"}, {"field": "email", "pattern": r"[^@]+$"}, {"field": "no"}, {"field": "user", "pattern": ".*", "placeholder": "[x]"}])
    assert tuple(red.first()) == ("[x]", "***", "alice@***", 5)
    stars = values.redact(df, [{"field": "user", "pattern": "l.c", "placeholder": "[cut]", "style": "stars"}])
    assert stars.first()["user"] == "a*****e"
    masked = values.mask(df, [{"field": "n", "pattern": r"\d", "placeholder": "#"}, {"field": "user"}, {"field": "email", "pattern": "(.)@(.)", "placeholder": "$2@$1x"}])
    # "$1x" names a group "1x", which does not exist.
    assert tuple(masked.first())[0] == "***" and masked.first()["n"] == "#" and masked.first()["email"] == "alic" + "e@" + "xample.com"
    with pytest.raises(ValueError):
        values.RedactRule(field="a", pattern="[")


def test_classify(spark):
    df = spark.createDataFrame([("user login failed", "error"), ("ok", "info"), (None, "warn")], "message string, level string")
    rules = [
        {"field": "message", "pattern": "failed", "label": "auth"},
        {"field": "level", "pattern": "^warn$", "label": "w", "dest": "kind"},
        {"field": "absent", "pattern": ".", "label": "never"},
    ]
    got = values.classify(df, rules).collect()
    assert [(r["category"], r["kind"]) for r in got] == [("auth", None), (None, None), (None, "w")]


def test_filter(spark):
    df = spark.createDataFrame([(" error ", "api"), ("warn\n", None), ("info", "api")], "level string, service string")
    assert filters.filter_rules(df, [{"field": "level", "pattern": "^(error|warn)$"}]).count() == 2
    assert filters.filter_rules(df, [{"field": "service", "pattern": "^$"}]).count() == 1
    assert filters.filter_rules(df, [{"field": "level", "pattern": "info", "invert": True}]).count() == 2
    assert filters.filter_rules(df, []).count() == 3


def test_validate(spark):
    df = spark.createDataFrame([("hello", 42.0, True), (None, 1.0, None)], "msg string, latency double, ok boolean")
    rules = [{"name": "msg", "type": "string", "required": True}, {"name": "latency", "type": "number"}, {"name": "ok", "type": "bool"}]
    checked = filters.validate_schema(df, rules)
    assert [r["_error"] for r in checked.collect()] == [None, 'schema: required field "msg" is missing']
    good, bad = filters.split_valid(checked)
    assert good.columns == df.columns and bad.count() == 1
    wrong = filters.validate_schema(df, [{"name": "latency", "type": "string"}])
    assert wrong.first()["_error"] == 'schema: field "latency" must be a string'
    open_record = spark.sql("SELECT parse_json('1.5') AS a UNION ALL SELECT parse_json('\"x\"')")
    got = filters.validate_schema(open_record, [{"name": "a", "type": "number"}]).collect()
    assert sorted(r["_error"] or "" for r in got) == ["", 'schema: field "a" must be a number']
    with pytest.raises(ValueError):
        filters.FieldRule(name="a", type="date")


def test_sample(spark):
    df = spark.range(10000).withColumn("source", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    assert filters.sample(df, "id").count() == 10000
    assert filters.sample(df, "id", 0.01).count() <= 300
    kept = filters.sample(df, "id", Scoped(1.0, {"a": 0.1})).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in kept}
    assert counts["b"] == 5000 and 400 < counts["a"] < 600
    assert 300 < filters.sample_random(df, 0.05, seed=3).count() < 700
    again = [filters.sample(df.repartition(n), "id", 0.2).agg(F.sum("id")).first()[0] for n in (1, 7)]
    assert again[0] == again[1]
    with pytest.raises(ValueError):
        filters.sample(df, "id", 0)


def test_route(spark):
    df = spark.createDataFrame([("app.log", "error"), ("svc.log", "info"), ("other", None)], "source string, level string")
    rules = [{"source_pattern": "^app", "sinks": ["a", "b"]}, {"field": "level", "field_pattern": "^info$", "sinks": ["c"]}]
    got = {r["source"]: r["s"] for r in df.withColumn("s", route.route_sinks(df, rules, ["d"])).collect()}
    assert got == {"app.log": ["a", "b"], "svc.log": ["c"], "other": ["d"]}
    everything = df.withColumn("s", route.route_sinks(df, rules)).collect()
    assert [r["s"] for r in everything if r["source"] == "other"] == [["a", "b", "c"]]
    assert route.route(df, rules, ["d"]).count() == 4
    for bad in ({"source_pattern": "a", "sinks": []}, {"sinks": ["a"]}):
        with pytest.raises(ValueError):
            route.RouteRule.parse(bad)


def test_durations():
    assert duration_us("1h30m") == 5_400_000_000 and duration_us("250ms") == 250_000 and duration_us(2) == 2_000_000
    for bad in ("", "5", "1x", "h"):
        with pytest.raises(ValueError):
            duration_us(bad)
