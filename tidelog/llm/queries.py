"""The registered queries of this package, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, fill_middle, line_dedup, near_dups, quality, search, simhash, substrings, templates, token_store, url_filter, warc, whitening
from tidelog.llm.common import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of url_filter.RULES, longest last wins.
URL_SQL = """
WITH parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM (
    SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts),
outcome AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL),
h AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(good) AS n, coalesce(sum(good), 0) AS good FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
overall AS (SELECT (sum(good) + 1) / (sum(n) + 2)::DOUBLE AS mu FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(mu) AS mu FROM h, overall GROUP BY suffix),
sf AS (SELECT sum((good - n * mu) * (good - n * mu) / n) AS s, sum(mu * (1 - mu)) AS v, sum(mu * (1 - mu) * (n - 1)) AS w FROM s WHERE n > 0),
sk AS (SELECT CASE WHEN w > 0 THEN least(greatest((s - v) / w, 0.001), 0.5) ELSE 0.5 END::DOUBLE AS rho FROM sf),
s2 AS (SELECT suffix, (good + (1 - rho) / rho * mu) / (n + (1 - rho) / rho) AS mu FROM s, sk),
d AS (SELECT domain, sum(n) AS n, sum(good) AS good, any_value(mu) AS mu FROM h JOIN s2 USING (suffix) GROUP BY domain),
df AS (SELECT sum((good - n * mu) * (good - n * mu) / n) AS s, sum(mu * (1 - mu)) AS v, sum(mu * (1 - mu) * (n - 1)) AS w FROM d WHERE n > 0),
dk AS (SELECT CASE WHEN w > 0 THEN least(greatest((s - v) / w, 0.001), 0.5) ELSE 0.5 END::DOUBLE AS rho FROM df),
d2 AS (SELECT domain, (good + (1 - rho) / rho * mu) / (n + (1 - rho) / rho) AS mu FROM d, dk),
h1 AS (SELECT host, n, good, mu FROM h JOIN d2 USING (domain)),
hf AS (SELECT sum((good - n * mu) * (good - n * mu) / n) AS s, sum(mu * (1 - mu)) AS v, sum(mu * (1 - mu) * (n - 1)) AS w FROM h1 WHERE n > 0),
hk AS (SELECT CASE WHEN w > 0 THEN least(greatest((s - v) / w, 0.001), 0.5) ELSE 0.5 END::DOUBLE AS rho FROM hf),
h2 AS (SELECT host, n + (1 - rho) / rho AS weight, (good + (1 - rho) / rho * mu) / (n + (1 - rho) / rho) AS mu FROM h1, hk),
r AS (SELECT host, least(1.0, mu + 1.645 * sqrt(mu * (1 - mu) / (weight + 1))) AS bound FROM h2),
judged AS (
  SELECT page_id, host, path, round(bound, 6) AS host_bound, bound, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN r USING (host))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound < 0.6 THEN 'block' ELSE 'allow' END AS verdict, host_bound
FROM judged
"""


@query(URL_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rule, else by the reputation of its host."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    labels = read(spark, sf_dir, "labels").filter("quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), good.cast("int").alias("good"))
    return url_filter.judge(read(spark, sf_dir, "pages"), labels)


@query(
    """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p),
k AS (
  SELECT *, regexp_replace(lower(coalesce(url, '')), '^[^:/?#]*://', '') AS rest FROM f),
u AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM k),
o AS (
  SELECT *, row_number() OVER (
    ORDER BY array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, length(host) + 1), page_id) - 1 AS capture_order
  FROM u)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, capture_order
FROM o
"""
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back, with its place in the merged capture index."""
    return warc.archive(read(spark, sf_dir, "pages"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to compressed shards and read back."""
    return token_store.round_trip(read(spark, sf_dir, "documents"), tokenizer_file())


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by lexicon and merges."""
    return bpe.code_documents(read(spark, sf_dir, "documents"), tokenizer_file())


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of its language, and whether it is kept."""
    scored = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"), text=False)
    return scored.select("doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__keep").alias("keep"))


@query()
def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    classes = near_dups.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select(F.col("__id").alias("doc_id"), "class_id", "class_size")


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count of lines, of lines removed, and the digest of what is left."""
    kept = line_dedup.deduplicate_lines(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), digest.alias("kept_sha256"))


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    hits = templates.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select(F.col("__id").alias("doc_id"), "item_id", "windows", "reworded")


@query(
    """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
s AS (SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
f AS (SELECT r, i, CASE WHEN count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS again FROM s),
c AS (
  SELECT w.r, w.k, w.word, max(coalesce(again, 0)) OVER (PARTITION BY w.r ORDER BY w.k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN f ON w.r = f.r AND w.k = f.i),
t AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of its repeated passages."""
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query(
    """
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') IF x <> ''] AS ws FROM documents),
n AS (SELECT count(*) AS n, sum(len(ws))::DOUBLE / count(*) AS mean FROM d),
t AS (SELECT doc_id, word, count(*)::DOUBLE AS tf, any_value(dl)::DOUBLE AS dl FROM (SELECT doc_id, unnest(ws) AS word, len(ws) AS dl FROM d) GROUP BY doc_id, word),
f AS (SELECT word, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, n GROUP BY word),
p AS (SELECT doc_id, word, tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean)) AS w FROM t, n),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, sum(floor(idf * w * 65536 + 0.5))::BIGINT AS score
  FROM t q JOIN f USING (word) JOIN p USING (word) WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
)
def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 50, as a query."""
    docs = read(spark, sf_dir, "documents")
    return search.top_documents(docs, docs.filter("doc_id % 50 = 0"))


@query(
    """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
    WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, and what is restored from it."""
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(
        "doc_id", F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"), F.col("__middle_chars").alias("middle_chars"),
        digest(F.col("__output")).alias("output_sha256"), digest(fill_middle.restore(F.col("__output"), F.col("__form"))).alias("restored_sha256"),
    )


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least document that its links lead to."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
