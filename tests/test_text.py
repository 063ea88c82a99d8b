"""Parsing, rendering, patterns, multi-line assembly."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions.patterns import java_pattern, replace_all, search
from tidelog.operators import multiline, parse, render
from tidelog.specs import Scoped


def values_of(spark, texts, column):
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    return [r[0] for r in df.select(column(F.col("line"))).collect()]


def test_json(spark):
    lines = ['{"level":"info","n":1.5,"big":12345678901234567890,"o":{"a":[1]},"z":null}', "not json", "[1]", ""]
    got = values_of(spark, lines, parse.parse_json)
    assert got[0] == {"level": "info", "n": "1.5", "big": "12345678901234567890", "o": '{"a":[1]}', "z": None}
    assert got[1:] == [None, None, None]


def test_logfmt(spark):
    lines = ['level=info msg="hello world" code=200', "ERROR", "", "  \t ", "a=1 a=2", "msg=x bare", "bare msg=x", 'k="" e==v', "one two"]
    got = values_of(spark, lines, parse.parse_logfmt)
    assert got == [
        {"level": "info", "msg": "hello", "code": "200"}, {"msg": "ERROR"}, None, None, {"a": "2"},
        {"msg": "x"}, {"msg": "x"}, {"k": "", "e": "=v"}, {"msg": "one"},
    ]
    quoted = values_of(spark, ['a="x y" b=c', 'msg="hi there" z'], lambda c: parse.parse_logfmt(c, quoted=True))
    assert quoted == [{"a": "x y", "b": "c"}, {"msg": "hi there"}]


def test_extract(spark):
    assert values_of(spark, ['x a=1 b="q"', "none"], parse.extract_kv) == [
        {"_raw": 'x a=1 b="q"', "a": "1", "b": "q"}, {"_raw": "none"}]


def test_parse_lines(spark):
    df = spark.createDataFrame([("a", '{"x":"1"}'), ("b", "x=2 time=t"), ("a", "bad")], "source string, line string")
    df = df.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = parse.promote(parse.parse_lines(df, Scoped("json", {"b": "LogFmt"}), ingest="at"), ["x", "time"]).collect()
    assert [(r["x"], r["time"], r["_error"] is None) for r in got] == [
        ("1", "2024-01-01T00:00:00Z", True), ("2", "t", True), (None, None, False)]
    with pytest.raises(ValueError):
        parse.parse_lines(df, "xml")


def test_render(spark):
    df = spark.createDataFrame([("warn", "disk full", "srv1", None)], "level string, message string, host string, z string")
    assert render.render(df, "text").first()["line"] == "WARN disk full host=srv1"
    assert render.render(df, "json").first()["line"] == '{"host":"srv1","level":"warn","message":"disk full"}'
    assert render.render(df, "logfmt").first()["line"] == 'host=srv1 level=warn message="disk full"'
    rec = df.select(F.create_map(F.lit("b"), F.lit('q"\\\n'), F.lit("a"), F.lit("1")).alias("m"))
    assert render.render(rec, "logfmt", fields="m").first()["line"] == 'a=1 b="q\\"\\\\\\n"'
    assert render.render(rec, "text", fields="m").first()["line"].startswith("a=1 b=q")
    with pytest.raises(ValueError):
        render.render(df, "xml")


@pytest.mark.parametrize("pattern,text,found", [
    ("a$", "a\n", False), ("(?m)a$", "a\nb", True), ("^[[:alpha:]]+$", "abc", True), ("^[[:alpha:]]+$", "ab1", False),
    ("(?P<x>b)", "abc", True), ("(?i)É", "é", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), (r"[&&a]", "&", True),
    (r"\$", "cost $5", True), ("[]x]", "]", True), ("[$]", "$", True), ("", "x", True), (r"^\s$", "\x0b", False), ("[[]", "[", True),
])
def test_search(spark, pattern, text, found):
    assert values_of(spark, [text], lambda c: search(c, pattern)) == [found]


@pytest.mark.parametrize("pattern,replacement,text,want", [
    (".*", "X", "abc", "X"), ("a*", "X", "baac", "XbXcX"), ("b*", "-", "abc", "-a-c-"), ("", "-", "ab", "-a-b-"), ("(a)(b)", "$2$1", "ab", "ba"),
    ("(a)", "${1}1", "a", "a1"), ("(a)", "$1x", "a", ""), ("(?P<n>a)", "<$n>", "a", "<a>"), ("a", "$$", "a", "$"), ("a", r"\n", "a", r"\n"),
    ("(a)(?:b)(c)", "$2", "abc", "c"), ("x*", "-", "", "-"),
])
def test_replace(spark, pattern, replacement, text, want):
    assert values_of(spark, [text], lambda c: replace_all(c, pattern, replacement)) == [want]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "(", "[", "a**b(", "\\"])
def test_bad_patterns(spark, pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def walk(rows, rule):
    out, buf, last = [], [], None
    for t, rid, line in rows:
        hit = bool(re.search(rule.start_pattern or rule.continue_pattern, line))
        flush = bool(buf) and (hit if rule.start_pattern else not hit)
        flush |= bool(rule.max_lines) and len(buf) >= rule.max_lines
        flush |= bool(rule.timeout) and last is not None and t - last >= rule.timeout * 1_000_000
        if flush:
            out.append(buf)
            buf = []
        buf = [*buf, (rid, line)]
        last = t
    return [(b[0][0], len(b), "\n".join(x for _, x in b)) for b in [*out, *([buf] if buf else [])]]


@pytest.mark.parametrize("limit", [None, 9])
@pytest.mark.parametrize("rule", [
    {"start_pattern": "^S"}, {"start_pattern": "^S", "max_lines": 2}, {"continue_pattern": "^ ", "timeout": 0.003},
    {"continue_pattern": "^ ", "max_lines": 3, "timeout": 0.002, "field": "text"},
])
def test_multiline(spark, rule, limit):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randrange(300) * 500, i, rng.choice(["S x", " y", "z", " w"])) for i in range(160)]
    df = spark.createDataFrame(rows, "source string, t long, id long, line string").withColumn("ts", F.timestamp_micros("t"))
    got = multiline.assemble_multiline(df, rule, rows_per_task=limit)
    spec = multiline.MultilineRule.parse(rule)
    want = []
    for source in "ab":
        mine = sorted((t, i, line) for s, t, i, line in rows if s == source)
        want += [(source, *r) for r in walk(mine, spec)]
    assert sorted((r["source"], r["id"], r["n_lines"], r[spec.field]) for r in got.collect()) == sorted(want)


def test_multiline_rules():
    for bad in ({}, {"start_pattern": "a", "continue_pattern": "b"}, {"start_pattern": "a", "max_lines": -1}, {"start_pattern": "("}):
        with pytest.raises(ValueError):
            multiline.MultilineRule.parse(bad)


# Pattern, a text, and what the linear-time dialect says of it.
DIALECT = [
    (r"\Qa$b\E", "xa$by", True), (r"\Qa$b\E", "a", False), (r"\Qa.b", "axb", False), (r"\Qa.b", "a.b", True), (r"\Q(\E+", "((", True), (r"\Q\\E", "\\", True),
    (r"(?m:^a$)\n", "b\na\nc", True), (r"(?m:^a$)$", "a\nb", False), ("(?m)^a$", "b\na", True), ("^a$", "b\na", False), (r"(?:(?m)a$)b", "ab", False), (r"((?m)a$)\nb$", "a\nb\nc", False),
    (r"((?m)a$)\nb$", "a\nb", True), (r"(?m)\n^\z", "a\n", True), (r"^\z", "", True), (r"(?m)a$", "a\r\n", False), ("(?-m:^b)", "a\nb", False), ("(?m)a(?-m:^b)", "a\nb", False),
    (r"[\s,]", "\x0b", False), (r"[\s,]", "\t", True), (r"[^\s]", "\x0b", True), (r"[\S]", "\x0b", True), (r"[a\S]", " ", False), (r"\s", "\x0b", False), (r"\v", "\x0b", True), (r"\v", "\n", False),
    (r"[[:space:]]", "\x0b", True), (r"[[:^digit:]x]", "5", False), (r"\p{^Greek}", "α", False), (r"\P{^Greek}", "α", True), ("a+?b", "aab", True), ("a{2,3}?b", "aab", True), ("a{b", "a{b", True), ("a{,2}", "a{,2}", True),
    (r"(?i)É", "é", True), ("(?s)a.b", "a\nb", True), ("a.b", "a\nb", False), ("a.b", "a\rb", True), ("[]a]", "]", True), ("[^]a]", "]", False), ("[a&&b]", "&", True), ("[[]", "[", True), ("[:alpha:]", "p", True), ("[:alpha:]", "x", False),
    (r"\x{1F642}", "🙂", True), (r"\.", "a", False), ("", "x", True),
]


def test_dialect(spark):
    for pattern, text, hit in DIALECT:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(search(F.col("t"), pattern)).first()[0] is hit, (pattern, text)


@pytest.mark.parametrize("pattern", ["a++", "a*+", "a?+", "a{2}+", "a**", "a+??", "a{2}{3}", r"\R", r"\h", r"\Z", r"\G", r"\X", "(?U)a", "(?x)a", "(?=a)", "(?<!a)", "(?>a)", r"(a)\1", r"\k", "a)", "(a", "[a", r"[\b]", "a\\", "[[:nope:]]"])
def test_dialect_refuses(spark, pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_replacement_in_quoted_patterns(spark):
    df = spark.createDataFrame([("a(b) a(c)",)], "t string")
    assert df.select(replace_all(F.col("t"), r"\Qa(\E(\w)\)", "$1!")).first()[0] == "b! c!"
    assert df.select(replace_all(F.col("t"), r"(?P<x>[[:alpha:]])\(", "${x}<")).first()[0] == "a<b) a<c)"
