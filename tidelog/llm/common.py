"""What several operators of this package share: sessions, staged tables, row keys, skew-safe lookups, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.sizing import fits_broadcast
from tidelog.session import configure, ensure_checkpoint_dir

# Rows of one Arrow batch: texts may be long, and a worker holds a few batches at a time.
BATCH_ROWS = 1_000

# Words as in Python's bytes.split(): runs of anything but these six ASCII characters.
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"

# Rounds of one node of each bucket against the rest, before what is left is compared pair by pair.
STAR_ROUNDS = 3

# A key with more than this share of all rows is hot; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 0.002


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: those of the library, and Arrow batches that hold long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, fully qualified path in the folder that all machines share."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The file system of a qualified path and the path within it, for tasks that write files of their own format."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A key of a row's id and text. Rows equal in both are one row to every operator here."""
    return F.xxhash64(F.col(id_column), F.col(text_column))


def split_words(text: Column) -> Column:
    """The words of a text; an empty list if it has none."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def lookup(facts: DataFrame, info: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``info`` (one row per key) to ``facts`` where one key may hold a third of the facts.

    Keys with more than ``HOT_SHARE`` of the facts are few by definition
    (at most 500), so their rows of ``info`` are broadcast; the rest meet in
    a shuffled join that has no hot key left.
    """
    total = facts.count()
    hot = [r[0] for r in facts.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > max(1_000, HOT_SHARE * total)).select(key).collect()]
    if not hot:
        return facts.join(info, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (
        facts.filter(is_hot)
        .join(F.broadcast(info.filter(F.col(key).isin(hot))), key, how)
        .unionByName(facts.filter(~is_hot).join(info.filter(~F.col(key).isin(hot)), key, how))
    )


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` and :func:`row_key` are in ``dropped`` (columns ``__id``, ``__key``).

    Broadcast if ``dropped`` is measured to be small, else shuffled.
    """
    dropped = dropped.select("__id", "__key").distinct()
    if fits_broadcast(dropped):
        dropped = F.broadcast(dropped)
    return docs.join(dropped, (row_key() == dropped["__key"]) & docs["doc_id"].eqNullSafe(dropped["__id"]), "left_anti")


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of undirected links (``a``, ``b``): one row per linked node, with the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each
    points nodes at the least neighbour. Both are a grouped minimum (combined
    before the shuffle) and one join; no neighbour list is ever gathered. Ends
    when a round changes nothing, and raises if it doesn't end.

    Returns ``node``, ``component``.
    """
    edges = table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for _ in range(max_rounds):
        # Large star: each node hands its larger neighbours its least neighbour.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours point at the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = table(small.filter("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        last = now
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def link(
    members: DataFrame, near: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Links among nodes that share a bucket, enough that their components equal those of all links.

    ``members`` has ``bucket``, ``node`` and a ``mark`` for ``near``, a cheap
    necessary condition of two marks. ``verify`` takes pairs (``a``, ``b``) and
    returns those that are links. ``compare`` takes what is open after the rounds
    (``bucket``, ``node``, ``part``) and returns links between all parts that
    have one in a bucket; without it all near pairs of different components are
    verified.

    Each round compares one node of each bucket, its centre, with the bucket's
    nodes of other components, and then leaves it out, for all its pairs are
    done. A bucket that is one component by now is done too: with a group of
    near copies, of any size, that is nearly always after the first round.
    After ``STAR_ROUNDS`` all that is left of a bucket is compared. So the pairs
    of a group that is tied together are never listed, and no link between
    components is lost.
    """
    links, round_ = None, 0
    open_ = table(members.select("bucket", "node", "mark", F.col("node").alias("part")), "members")
    while True:
        centre = F.min("node") if round_ == 0 else F.min_by("node", F.xxhash64("node", F.lit(round_)))
        centres = open_.groupBy("bucket").agg(centre.alias("node"), F.count("*").alias("n")).filter("n > 1").select("bucket", "node")
        full = open_.join(centres, ["bucket", "node"]).select("bucket", F.col("node").alias("a"), F.col("mark").alias("mark_a"), F.col("part").alias("part_a"))
        stars = open_.join(full, "bucket").filter((F.col("part") != F.col("part_a")) & near(F.col("mark"), F.col("mark_a"))).select("a", F.col("node").alias("b"))
        new = verify(table(stars.distinct(), "pairs"))
        links = table(new if links is None else links.union(new), "links")
        open_ = open_.join(centres, ["bucket", "node"], "left_anti").drop("part").join(components(links), "node", "left").select("bucket", "node", "mark", F.coalesce("component", "node").alias("part"))
        unsettled = open_.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("bucket")
        open_ = table(open_.join(unsettled, "bucket", "left_semi"), "members")
        if open_.isEmpty():
            return links
        round_ += 1
        if round_ == STAR_ROUNDS:
            if compare:
                return table(links.union(compare(open_.select("bucket", "node", "part"))), "links")
            x = open_.select("bucket", F.col("node").alias("a"), F.col("mark").alias("mark_a"), F.col("part").alias("part_a"))
            y = open_.select("bucket", F.col("node").alias("b"), F.col("mark").alias("mark_b"), F.col("part").alias("part_b"))
            rest = x.join(y, "bucket").filter((F.col("part_a") < F.col("part_b")) & near(F.col("mark_a"), F.col("mark_b"))).select("a", "b")
            return table(links.union(verify(table(rest.distinct(), "pairs"))), "links")
