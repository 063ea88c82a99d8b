"""Enrichment from lookup tables and address ranges."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field, let
from tidelog.plans.sizing import fits_broadcast, maybe_broadcast, staged
from tidelog.specs import Scoped, require

# Fixed names: what a rule does with a record whose key is not in the table.
ON_MISS = {"": "keep", "ignore": "keep", "keep": "keep", "drop": "drop"}


@dataclass(frozen=True, eq=False)
class LookupRule:
    """``table`` has the key column ``table_key`` (first column by default).

    ``dest`` renames the attribute of a table that has just one.
    """

    key_field: str
    table: DataFrame
    on_miss: str = "ignore"
    table_key: str = ""
    dest: str = ""

    def __post_init__(self):
        require(bool(self.key_field), "lookup: key_field must not be empty")
        require(self.on_miss in ON_MISS, "lookup: on_miss must be ignore, keep or drop")
        require(len(self.table.columns) > 1 or self.on_miss == "drop", "lookup: table must have attributes")
        require(not self.dest or len(self.table.columns) == 2, "lookup: dest needs a table of one attribute")

    def keyed(self) -> tuple[DataFrame, list[str]]:
        """The table as ``__key`` and attribute struct ``__attrs``; one row per key."""
        key = self.table_key or self.table.columns[0]
        names = [c for c in self.table.columns if c != key]
        attrs = F.struct(*[field(n).alias(self.dest or n) for n in names]) if names else F.struct(F.lit(1).alias("__in"))
        rows = self.table.filter(field(key).isNotNull()).groupBy(field(key).cast("string").alias("__key"))
        return rows.agg(F.min(attrs).alias("__attrs")), [self.dest or n for n in names]


def _apply(df: DataFrame, rule: LookupRule, governed: Column | None) -> DataFrame:
    table, names = rule.keyed()
    drop = ON_MISS[rule.on_miss] == "drop"
    # Left rows with a null key never match; hot keys of the left side are split
    # by adaptive execution when the table is too big to broadcast.
    hit = field(rule.key_field).cast("string") == F.col("__key")
    if rule.key_field not in df.columns:
        joined = df.withColumn("__attrs", F.lit(None).cast(table.schema["__attrs"].dataType))
    elif drop and governed is None:
        joined = df.join(maybe_broadcast(table), hit, "inner").drop("__key")
    else:
        joined = df.join(maybe_broadcast(table), hit if governed is None else hit & governed, "left").drop("__key")
    if drop and (governed is not None or rule.key_field not in df.columns):
        keep = F.col("__attrs").isNotNull()
        joined = joined.filter(keep if governed is None else keep | ~governed)
    columns = {}
    for name in names:
        value = F.col("__attrs").getField(name)
        if name in df.columns:
            value = F.coalesce(field(name), value.cast(df.schema[name].dataType))
        columns[name] = value
    return joined.withColumns(columns).drop("__attrs")


def lookup(df: DataFrame, rules) -> DataFrame:
    """Add table attributes where the record has none; rules run in order.

    ``rules``: a list of :class:`LookupRule`, or a :class:`Scoped` of lists.
    """
    scoped = Scoped.of(rules)
    require(bool(scoped.default) or bool(scoped.by_source), "lookup: at least one rule is required")
    own = F.coalesce(field(scoped.source).isin(list(scoped.by_source)), F.lit(False)) if scoped.by_source else None
    for rule in scoped.default or ():
        df = _apply(df, rule, None if own is None else ~own)
    for source, part in scoped.by_source.items():
        for rule in part:
            df = _apply(df, rule, F.coalesce(field(scoped.source) == source, F.lit(False)))
    return df


def lookup_misses(df: DataFrame, rule: LookupRule) -> DataFrame:
    """The rows ``on_miss="drop"`` would drop."""
    table, _ = rule.keyed()
    hit = field(rule.key_field).cast("string") == F.col("__key")
    return df.join(maybe_broadcast(table.select("__key")), hit, "left_anti")


def lookup_hits(df: DataFrame, rule: LookupRule) -> DataFrame:
    """Filter only: the rows whose key is in the table."""
    table, _ = rule.keyed()
    hit = field(rule.key_field).cast("string") == F.col("__key")
    return df.join(maybe_broadcast(table.select("__key")), hit, "left_semi")


# Fixed value: a dotted IPv4 address without leading zeros.
IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}\z"


def is_ipv4(ip: Column) -> Column:
    return F.rlike(ip, F.lit(IPV4))


def ipv4_number(ip: Column) -> Column:
    """A valid address as a number."""

    def total(parts: Column) -> Column:
        octets = [F.get(parts, i).try_cast("long") for i in range(4)]
        return ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]

    return let(F.split(ip, r"\."), total)


def ipv6_digits(ip: Column) -> Column:
    """A valid IPv6 address as 32 hexadecimal digits; null for any other text. The last 32 bits may be dotted."""
    groups = "^[0-9a-f]{1,4}\\z"

    def parts(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def digits(halves: Column) -> Column:
        left = parts(halves[0])
        right = F.when(F.size(halves) == 2, parts(F.get(halves, 1))).otherwise(F.array().cast("array<string>"))

        def joined(sides: Column) -> Column:
            left, right = sides["l"], sides["r"]
            given = F.size(left) + F.size(right)
            fits = F.when(F.size(halves) == 1, given == 8).otherwise((F.size(halves) == 2) & (given < 8))
            whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
            read = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
            return F.when(fits & F.forall(whole, lambda g: F.rlike(g, F.lit(groups))), read)

        return let(F.struct(left.alias("l"), right.alias("r")), joined)

    tail = F.regexp_extract(ip, r"^.*:([0-9.]+)\z", 1)
    number = F.lpad(F.lower(F.hex(ipv4_number(tail))), 8, "0")
    dotted = F.when(is_ipv4(tail), F.concat(F.regexp_extract(ip, r"^(.*:)[0-9.]+\z", 1), F.substring(number, 1, 4), F.lit(":"), F.substring(number, 5, 4)))
    text = F.when(F.contains(ip, F.lit(".")), dotted).otherwise(ip)
    return let(F.split(F.lower(text), "::", -1), digits)


# Fixed value: the first 96 bits of an IPv4 address written as IPv6.
MAPPED = "0" * 20 + "ffff"

# An IPv6 range makes a few hundred blocks, so a task gets about a million.
RANGES_PER_TASK = 2_000


def address_key(ip: Column) -> Column:
    """A valid address as its family and hexadecimal digits (``4`` and 8, ``6`` and 32), which sort like addresses; else null."""
    four = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0"))
    six = let(ipv6_digits(ip), lambda d: F.when(F.startswith(d, F.lit(MAPPED)), F.concat(F.lit("4"), F.substring(d, 25, 8))).otherwise(F.concat(F.lit("6"), d)))
    return F.when(is_ipv4(ip), four).when(F.contains(ip, F.lit(":")), six)


def _bound_key(ranges: DataFrame, name: str) -> Column:
    """A bound as :func:`address_key`: address text, or the number of an IPv4 address."""
    if isinstance(ranges.schema[name].dataType, T.StringType):
        return address_key(field(name))
    number = field(name).cast("long")
    return F.when(number.between(0, 2**32 - 1), F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 8, "0")))


def _halves(key: Column) -> tuple[Column, Column]:
    """A key's digits as two whole numbers of 64 bits."""
    digits = F.lpad(F.substring(key, 2, 32), 32, "0")
    return tuple(F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))


def _blocks(ranges: DataFrame, start: str, end: str, attrs: list[str]) -> DataFrame:
    """Each range as the largest blocks of addresses with a common prefix of digits that make it up.

    Along each bound, every digit leaves at most 15 blocks beside it; a range
    that is itself a block is one. A block of two ranges is the narrower one's.
    """
    low, high = _bound_key(ranges, start), _bound_key(ranges, end)
    (low_a, low_b), (high_a, high_b) = _halves(F.col("a")), _halves(F.col("b"))
    borrow = high_b < low_b
    size = F.struct((high_a - low_a - borrow.cast("int")).alias("x"), (high_b - low_b + F.when(borrow, F.lit(Decimal(2**64))).otherwise(F.lit(Decimal(0)))).alias("y"))
    rows = ranges.select(low.alias("a"), high.alias("b"), F.struct(*[field(x).alias(x) for x in attrs]).alias("attrs"))
    # Bounds of two families, or in the wrong order, hold no address.
    rows = rows.filter((F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") <= F.col("b")))
    tasks = -(-ranges.count() // RANGES_PER_TASK)
    rows = rows.repartition(tasks) if tasks > 1 else rows
    entry = F.struct(size.alias("size"), F.col("a").alias("start"), F.col("attrs").alias("attrs"))

    places = F.sequence(F.lit(1), F.length("a"))
    common = F.size(F.filter(places, lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    rows = rows.select(entry.alias("entry"), "a", "b", common.alias("common"))
    rows = rows.withColumns({"end_a": F.length(F.rtrim("a", F.lit("0"))), "end_b": F.length(F.rtrim("b", F.lit("f")))})
    digits = F.array(*[F.lit(d) for d in "0123456789abcdef"])

    def siblings(bound: str, ends: Column, beside) -> Column:
        """Blocks beside the bound, at each digit after the first that differs."""
        first = F.col("common") + 2

        def at(k: Column) -> Column:
            kept = F.filter(digits, lambda d: beside(d, F.substring(bound, k, F.lit(1))))
            return F.transform(kept, lambda d: F.concat(F.substring(bound, F.lit(1), k - 1), d))

        none = F.array().cast("array<array<string>>")
        return F.flatten(F.when(ends >= first, F.transform(F.sequence(first, ends), at)).otherwise(none))

    last_a, last_b = (F.greatest(F.col("common") + 1, F.col(c)) for c in ("end_a", "end_b"))
    next_a, next_b = (F.substring(c, F.col("common") + 1, F.lit(1)) for c in ("a", "b"))
    between = F.transform(F.filter(digits, lambda d: (d > next_a) & (d < next_b)), lambda d: F.concat(F.substring("a", F.lit(1), F.col("common")), d))
    several = F.concat(
        F.array(F.substring("a", F.lit(1), last_a), F.substring("b", F.lit(1), last_b)), between,
        siblings("a", last_a, lambda d, own: d > own), siblings("b", last_b, lambda d, own: d < own),
    )
    one = F.array(F.substring("a", F.lit(1), F.col("common")))
    picked = F.when((F.col("end_a") <= F.col("common")) & (F.col("end_b") <= F.col("common")), one).otherwise(several)
    return rows.select(F.explode(picked).alias("block"), "entry").groupBy("block").agg(F.min("entry").alias("entry"))


def geo_enrich(
    df: DataFrame, ranges: DataFrame, src: str, dst: str, *, start: str = "start", end: str = "end",
    on_miss: str = "skip",
) -> DataFrame:
    """Attributes of the narrowest range that holds the address, as map ``dst``.

    ``ranges`` has ``start`` and ``end`` (both included), IPv4 and IPv6 address
    texts or IPv4 numbers; its other columns are the attributes. A range whose
    bounds do not read, or are of two families, holds nothing. An IPv4 address
    written as IPv6 is that IPv4 address. Address texts are read and looked up
    once each: a distinct address meets a range through an equal prefix of
    digits, so no range is ever compared with an address outside its block.
    """
    require(bool(src) and bool(dst), "geo: src and dst must not be empty")
    require(on_miss in ("", "skip", "empty"), "geo: on_miss must be skip or empty")
    map_type = "map<string,string>"
    before = field(dst).cast(map_type) if dst in df.columns else F.lit(None).cast(map_type)
    if src not in df.columns or not isinstance(df.schema[src].dataType, T.StringType):
        return df.withColumn(dst, before)
    attrs = [c for c in ranges.columns if c not in (start, end)]
    blocks = staged(_blocks(ranges, start, end, attrs))

    texts = df.select(field(src).alias("__text")).filter("__text IS NOT NULL").distinct()
    texts = staged(texts.withColumn("__ip", address_key(F.col("__text"))).filter("__ip IS NOT NULL"))
    # The prefix lengths in use: 9 of IPv4 and 33 of IPv6 at most.
    used = blocks.groupBy(F.substring("block", 1, 1).alias("family"), F.length("block").alias("length")).count().collect()
    lengths = {f: F.array(*[F.lit(n) for n in sorted(r["length"] for r in used if r["family"] == f)]).cast("array<int>") for f in ("4", "6")}
    own = F.when(F.startswith("__ip", F.lit("4")), lengths["4"]).otherwise(lengths["6"])
    probes = texts.select("__ip").distinct().select("__ip", F.explode(own).alias("__n")).select("__ip", F.substring("__ip", F.lit(1), F.col("__n")).alias("block"))
    # Large blocks are met by many addresses; a broadcast block table avoids
    # that hot key, else adaptive execution splits it.
    found = probes.join(maybe_broadcast(blocks), "block").groupBy("__ip").agg(F.min("entry").alias("e"))
    geo = F.create_map(*[x for a in attrs for x in (F.lit(a), F.col("e.attrs").getField(a).cast("string"))])
    # With "empty", an address without a range has an answer too.
    named = texts.join(found.hint("merge"), "__ip", "left" if on_miss == "empty" else "inner")
    named = staged(named.select("__text", F.when(F.col("e").isNotNull(), geo).otherwise(F.create_map().cast(map_type)).alias("__geo")))

    answer = F.coalesce("__geo", before)
    if fits_broadcast(named):
        return df.join(F.broadcast(named), field(src) == F.col("__text"), "left").withColumn(dst, answer).drop("__text", "__geo")
    # Rows without a text have no part in the join, where they would share one key.
    hit = df.filter(field(src).isNotNull()).join(named.hint("merge"), field(src) == F.col("__text"), "left").withColumn(dst, answer).drop("__text", "__geo")
    return hit.unionByName(df.filter(field(src).isNull()).withColumn(dst, before))
