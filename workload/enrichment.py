"""Lookups, address ranges, pairing."""

from pyspark.sql import functions as F

from tidelog.operators import lookup, pairs
from workload import logs, query, table


def _customers(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        F.lit("x").alias("o_orderstatus"),
    ).filter(F.col("c_acctbal") > 0)


CUSTOMERS = "SELECT c_custkey, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_acctbal > 0"


@query(f"SELECT o_orderkey, o_orderstatus, segment, nation FROM orders LEFT JOIN ({CUSTOMERS}) ON o_custkey = c_custkey")
def lookup_keep(spark, sf):
    rule = lookup.LookupRule("o_custkey", _customers(spark, sf))
    return lookup.lookup(table(spark, sf, "orders"), [rule]).select("o_orderkey", "o_orderstatus", "segment", "nation")


@query(f"""
    SELECT o_orderkey, segment, nation, n_name AS nation_name
    FROM orders JOIN ({CUSTOMERS}) ON o_custkey = c_custkey LEFT JOIN nation ON nation = n_nationkey AND n_regionkey < 3
""")
def lookup_drop(spark, sf):
    """Two rules in order: the second looks up what the first wrote."""
    nations = table(spark, sf, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    rules = [
        lookup.LookupRule("o_custkey", _customers(spark, sf), on_miss="drop"),
        lookup.LookupRule("nation", nations, dest="nation_name"),
    ]
    return lookup.lookup(table(spark, sf, "orders"), rules).select("o_orderkey", "segment", "nation", "nation_name")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM ({CUSTOMERS}))")
def lookup_missing(spark, sf):
    rule = lookup.LookupRule("o_custkey", _customers(spark, sf))
    return lookup.lookup_misses(table(spark, sf, "orders"), rule).select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ({CUSTOMERS}))")
def lookup_present(spark, sf):
    rule = lookup.LookupRule("o_custkey", _customers(spark, sf))
    return lookup.lookup_hits(table(spark, sf, "orders"), rule).select("o_orderkey", "o_custkey")


BASE = 167772160  # 10.0.0.0

RANGES = f"""
    SELECT n_name, {BASE} + n_nationkey * 700000 AS lo, {BASE} + n_nationkey * 700000 + 900000 AS hi FROM nation
    UNION ALL
    SELECT s_name, {BASE} + s_suppkey * 90001 + 13, {BASE} + s_suppkey * 90001 + 13 + s_nationkey * 1000 FROM supplier
"""


@query(f"""
    WITH r AS ({RANGES}), p AS (SELECT o_orderkey, {BASE} + (o_custkey * 48271 + o_orderkey * 977) % 20000000 AS ip FROM orders)
    SELECT o_orderkey, arg_min(n_name, struct_pack(size := hi - lo, lo := lo)) AS net
    FROM p LEFT JOIN r ON ip BETWEEN lo AND hi GROUP BY o_orderkey
""")
def geo_ranges(spark, sf):
    """Overlapping address ranges of nations and suppliers; the narrowest one wins."""
    nations = table(spark, sf, "nation").select(
        F.col("n_name").alias("net"),
        (F.lit(BASE) + F.col("n_nationkey").cast("long") * 700000).alias("start"),
        (F.lit(BASE) + F.col("n_nationkey").cast("long") * 700000 + 900000).alias("end"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_name").alias("net"),
        (F.lit(BASE) + F.col("s_suppkey") * 90001 + 13).alias("start"),
        (F.lit(BASE) + F.col("s_suppkey") * 90001 + 13 + F.col("s_nationkey") * 1000).alias("end"),
    )
    ip = F.lit(BASE) + (F.col("o_custkey") * 48271 + F.col("o_orderkey") * 977) % 20000000
    octets = [F.shiftright(ip, n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)]
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(".", *octets).alias("ip"))
    found = lookup.geo_enrich(rows, nations.unionByName(suppliers), "ip", "geo")
    return found.select("o_orderkey", F.col("geo")["net"].alias("net"))


V6 = "(((a::HUGEINT * 65536 + b) * 65536 + c) * 65536 * 65536 * 65536 + d)"


def _v6(a, b, c, d):
    """An address of four groups, the rest fixed or zero."""
    part = lambda x: F.lower(F.hex(x.cast("long")))
    return F.concat(F.lit("2001:DB8:"), part(a), F.lit(":"), part(b), F.lit(":"), part(c), F.lit("::"), part(d))


@query(f"""
    WITH bounds AS (
        SELECT n_name AS net, n_nationkey AS a, 0 AS b, 0 AS c, 0 AS d, n_nationkey AS a2, 65535 AS b2, 65535 AS c2, 65535 AS d2, true AS whole FROM nation
        UNION ALL SELECT s_name, s_nationkey, s_suppkey, 5, 7, s_nationkey, s_suppkey + 3, 9, 1, false FROM supplier),
    r AS (SELECT net, {V6} AS lo, (((a2::HUGEINT * 65536 + b2) * 65536 + c2) * 65536 * 65536 * 65536 + CASE WHEN whole THEN 281474976710655 ELSE d2 END) AS hi FROM bounds),
    p AS (SELECT o_orderkey, {V6} AS ip FROM (SELECT o_orderkey, o_custkey % 30 AS a, o_orderkey % 200 AS b, o_custkey % 12 AS c, o_orderkey % 9 AS d FROM orders))
    SELECT o_orderkey, arg_min(net, struct_pack(size := hi - lo, lo := lo)) AS net, count(net) = 0 AS missed
    FROM p LEFT JOIN r ON ip BETWEEN lo AND hi GROUP BY o_orderkey
""")
def geo_ranges_v6(spark, sf):
    """Overlapping IPv6 ranges, aligned and not; the narrowest one wins, a miss is an empty map."""
    key = F.col("n_nationkey")
    nations = table(spark, sf, "nation").select(
        F.col("n_name").alias("net"), _v6(key, F.lit(0), F.lit(0), F.lit(0)).alias("start"),
        F.concat(F.lit("2001:db8:"), F.lower(F.hex(key.cast("long"))), F.lit(":ffff:ffff:ffff:255.255.255.255")).alias("end"),
    )
    first, number = F.col("s_nationkey"), F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_name").alias("net"), _v6(first, number, F.lit(5), F.lit(7)).alias("start"), _v6(first, number + 3, F.lit(9), F.lit(1)).alias("end"),
    )
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", _v6(customer % 30, order % 200, customer % 12, order % 9).alias("ip"))
    found = lookup.geo_enrich(rows, nations.unionByName(suppliers), "ip", "geo", on_miss="empty")
    return found.select("o_orderkey", F.col("geo")["net"].alias("net"), (F.size("geo") == 0).alias("missed"))


def _paired(hours):
    return f"""
    WITH e AS (SELECT *, lag(event_type) OVER w AS ptype, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid, lag(value) OVER w AS pvalue
               FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN event_type <> ptype AND ts - pts <= INTERVAL {hours} HOUR THEN 0 ELSE 1 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r)
    SELECT user_id, CASE WHEN event_type = 'click' THEN event_id ELSE pid END AS left_id,
           CASE WHEN event_type = 'click' THEN pid ELSE event_id END AS right_id,
           CASE WHEN event_type = 'click' THEN ts ELSE pts END AS left_ts,
           CASE WHEN event_type = 'click' THEN pts ELSE ts END AS right_ts,
           CASE WHEN event_type = 'click' THEN pvalue ELSE value END AS value
    FROM n WHERE k % 2 = 0"""


@query(_paired(24))
def pair_exact(spark, sf):
    rule = {"left_source": "click", "right_source": "purchase", "key_field": "user_id", "window": "24h"}
    return pairs.pair_join(logs(spark, sf), rule, fields=["value"])


@query("SELECT user_id, left_id, right_id, value AS right_value, lv AS value FROM (SELECT p.*, e.value AS lv FROM (" + _paired(1) + ") p JOIN events e ON e.event_id = left_id)")
def pair_nested(spark, sf):
    rule = {"left_source": "click", "right_source": "purchase", "key_field": "user_id", "window": "1h", "output_field": "right"}
    paired = pairs.pair_join(logs(spark, sf), rule, fields=["value"])
    return paired.select("user_id", "left_id", "right_id", "value", F.col("right.value").alias("right_value"))


@query("""
    WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    m AS (SELECT c.user_id, c.event_id AS left_id, c.ts AS left_ts, p.event_id AS right_id, p.ts AS right_ts,
                 row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(c.ts)), p.ts) AS k
          FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR)
    SELECT user_id, left_id, left_ts, right_id, right_ts FROM m WHERE k = 1
""")
def nearest_in_window(spark, sf):
    rows = logs(spark, sf)
    clicks, buys = rows.filter("source = 'click'"), rows.filter("source = 'purchase'")
    return pairs.nearest_join(clicks, buys, "user_id", "6h", keep_unmatched=True)
