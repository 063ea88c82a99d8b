"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised to lower-case words of letters (a line without letters to
its other words). Equal ones meet by hash. Similar ones by SimHash: a line's
fingerprint is the SimHash of each quarter of its words, so an edit changes the
block of its own quarter alone, and lines that differ in two quarters agree on
the other two (pigeonhole). A word more or less moves the quarters, so the two
outer pairs give way to halves counted from the line's start and end. Lines meet
on those and their edit similarity is verified. Of each connected group of lines
one occurrence stays, the first by document and place.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_GAP, components, link, lookup, row_key, table, text_or_empty
from tidelog.plans.sizing import maybe_broadcast

LIKE = 0.9  # edit similarity of normalised lines: 1 - distance / length of the longer

BLOCKS = 4

# Shorter pairs of lines are similar only if equal, or after one edit, which leaves all blocks but one.
FUZZY_LENGTH = 10
TWO_EDITS_LENGTH = 20

# Lines from the first have halves counted from both ends, those below the second pairs of their outer quarters.
HALVES_WORDS, QUARTERS_WORDS = 10, 12
STEP = 1.2  # sizes of halves grow by this; a line has those of two sizes, so that a tenth of the words may come or go

NOT_BLANK = "[^ \\t\\n\\x0B\\f\\r]"  # what WORD_GAP leaves

CELL_LINES, CELL_CHARS = 64, 200_000  # of one block, about; a cell compares two

LONG_WORDS = 500  # the distance of longer lines is counted in words: in letters it would cost the square of a long text

# Words of more letters than this on average are a script without spaces; so few words have no quarters. Letters stand for words there.
LETTERS_A_WORD = 12


def normalised(lines: DataFrame) -> DataFrame:
    """``lines`` with a word in column ``raw``, which ``norm`` replaces: lower-case words of letters, else the line's words, by single spaces."""
    # Asked of the raw line: a filter on ``norm`` is moved before the steps that make it, which then run once more for it.
    lines = lines.filter(F.col("raw").rlike(NOT_BLANK))
    letters = F.trim(F.regexp_replace(F.lower("raw"), "[^\\p{L}]+", " "))
    other = F.trim(F.regexp_replace(F.lower("raw"), WORD_GAP, " "))
    lines = lines.withColumn("letters", letters).withColumn("norm", F.when(F.col("letters") != "", F.col("letters")).otherwise(other))
    return lines.drop("letters", "raw")


def majority(lanes: list[int], step: int) -> str:
    """SQL for a SimHash of words with hashes ``q``: a bit is set if it is in over half of them. ``lanes`` are the bits looked at of every ``step``.

    Counters lie ``step`` bits apart, so one addition counts several bits. A
    constant then lifts each counter that is over half to its second-highest bit.
    """
    mask = sum(1 << (step * i) for i in range(64 // step))
    top = step - 2
    counted = "aggregate(q, 0L, (a, h) -> a + (shiftrightunsigned(h, {k}) & {mask}L))"
    lifted = "shiftleft(shiftrightunsigned({counted} + ({least}L - (size(q) div 2 + 1)) * {mask}L, {top}) & {mask}L, {k})"
    return " | ".join(lifted.format(counted=counted.format(k=k, mask=mask), least=1 << top, mask=mask, top=top, k=k) for k in lanes)


# 32 of 64 bits, four of each eight: counters of 8 bits hold quarters of fewer than 64 words, those of 32 bits any.
NARROW = majority([0, 1, 2, 3], 8)
WIDE = majority([k for k in range(32) if k % 8 < 4], 32)
SIMHASH = f"CASE size(q) WHEN 0 THEN 0L WHEN 1 THEN q[0] & {0x0F0F0F0F0F0F0F0F}L ELSE IF(size(q) < 64, {NARROW}, {WIDE}) END"


def fingerprint(lines: DataFrame) -> DataFrame:
    """``lines`` with ``blocks``, the SimHashes of the quarters of ``norm``, ``halves``, hashes of words from the start and the end, and ``n``, their number."""
    words = F.split("norm", " ")
    few = (F.size("words") < BLOCKS) | (F.length("norm") > (LETTERS_A_WORD + 1) * F.size("words"))
    lines = lines.withColumn("words", words).withColumn("words", F.when(few, F.regexp_extract_all("norm", F.lit("([^ ])"), F.lit(1))).otherwise(F.col("words")))
    lines = lines.withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
    quarters = ", ".join(f"slice(words, {k} * size(words) div {BLOCKS} + 1, {k + 1} * size(words) div {BLOCKS} - {k} * size(words) div {BLOCKS})" for k in range(BLOCKS))
    # The largest power of STEP, rounded down, that half the words hold, and the one below.
    power = f"cast(floor(log({STEP}, size(words) / 2.0 + 1e-9)) as int)"
    sizes = f"transform(array({power}, {power} - 1), p -> cast(floor(pow({STEP}, p) + 1e-9) as int))"
    halves = f"flatten(transform({sizes}, h -> array(xxhash64(40, slice(words, 1, h)), xxhash64(41, slice(words, -h, h)))))"
    lines = lines.withColumn("n", F.size("words")).withColumn("blocks", F.expr(f"transform(array({quarters}), q -> {SIMHASH})"))
    return lines.withColumn("halves", F.when(F.col("n") >= HALVES_WORDS, F.expr(halves)).otherwise(no_keys())).drop("words")


def no_keys() -> Column:
    return F.array().cast("array<bigint>")


def buckets(lines: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``mark`` (the length) for each set of two blocks, or of three for lines so short that one edit is all they may have.

    A pair whose longer line is under ``TWO_EDITS_LENGTH`` has its keys of three
    blocks in common; of longer ones both sides reach 0.9 of that and have keys of two.
    """

    def keys(chosen: list[tuple[int, ...]]) -> Column:
        return F.array(*[F.xxhash64(F.lit(int("".join(map(str, picked)))), *[F.col("blocks")[k] for k in picked]) for picked in chosen])

    pairs, outer = list(combinations(range(BLOCKS), 2)), [(0, 1), (2, 3)]
    three, two = F.col("length") < TWO_EDITS_LENGTH, F.col("length") >= LIKE * TWO_EDITS_LENGTH
    found = F.concat(
        F.when(three, keys(list(combinations(range(BLOCKS), 3)))).otherwise(no_keys()),
        F.when(two, keys([p for p in pairs if p not in outer])).otherwise(no_keys()),
        F.when(two & (F.col("n") < QUARTERS_WORDS), keys(outer)).otherwise(no_keys()),
        F.when(two, F.col("halves")).otherwise(no_keys()),
    )
    # Two sizes of halves may round to one.
    return lines.filter(F.col("length") >= LIKE * FUZZY_LENGTH).select(F.explode(F.array_distinct(found)).alias("bucket"), "node", F.col("length").alias("mark"))


def near(a: Column, b: Column) -> Column:
    """Whether lines of these lengths can be similar."""
    return F.abs(a - b) <= allowed(F.greatest(a, b))


def allowed(length: Column) -> Column:
    return F.floor(length * (1 - LIKE) + 1e-6).cast("int")


def spellings(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``norm``, ``n`` (words) and ``symbols`` of ``lines``, read from ``docs`` again.

    ``symbols`` has a character for each word, where a similar line may have over ``LONG_WORDS``.
    """
    wanted = lines.select("node", F.col("least.id").alias("__id"), F.col("least.key").alias("__key"), F.col("least.line").alias("__line"))
    rows = docs.select("doc_id", "text").join(maybe_broadcast(table(wanted, "wanted")), (row_key() == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    found = normalised(rows.select("node", F.get(F.split(text_or_empty(), "\n"), F.col("__line")).alias("raw")))
    found = found.withColumn("n", F.size(F.split("norm", " ")))
    symbol = F.transform(F.split("norm", " "), lambda w: F.hex(F.lit(0x4E00) + F.pmod(F.xxhash64(w), F.lit(20_000))))
    symbols = F.when(F.col("n") >= 0.8 * LONG_WORDS, F.decode(F.unhex(F.array_join(symbol, "")), "UTF-16BE"))
    return table(found.withColumn("symbols", symbols).dropDuplicates(["node"]), "norms")


def limit_sql(x: str, y: str) -> str:
    return f"cast(floor(greatest(length({x}), length({y})) * (1 - {LIKE}D) + 1e-6D) as int)"


def near_sql(x: str, y: str) -> str:
    return f"abs(length({x}) - length({y})) <= {limit_sql(x, y)}"


def alike(a: str, b: str) -> str:
    """SQL for whether two lines, structs with ``norm``, ``n`` and ``symbols``, are similar.

    If one has over ``LONG_WORDS`` words, edits are counted in words for both; a
    line without ``symbols`` is then too short to be similar.
    """
    long = f"greatest({a}.n, {b}.n) > {LONG_WORDS}"

    def within(x: str, y: str) -> str:
        # Within the bound the distance takes the bound times the length; past it, -1.
        return f"{near_sql(x, y)} AND levenshtein({x}, {y}, {limit_sql(x, y)}) >= 0"

    return f"CASE WHEN {long} THEN {within(f'{a}.symbols', f'{b}.symbols')} ELSE {within(f'{a}.norm', f'{b}.norm')} END"


def verified(pairs: DataFrame, norms: DataFrame) -> DataFrame:
    """Of ``pairs`` (``a``, ``b``: nodes), those whose normalised lines are similar."""
    sides = [norms.select(F.col("node").alias(f"node_{side}"), F.struct("norm", "n", "symbols").alias(side * 2)) for side in "ab"]
    both = pairs.join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b"))
    return both.filter(F.expr(alike("aa", "bb"))).select("a", "b")


def compared(open_: DataFrame, norms: DataFrame) -> DataFrame:
    """Links (``a``, ``b``: parts) between the parts of ``open_`` (``bucket``, ``node``, ``part``) that have similar lines in a bucket.

    A bucket's lines are dealt into blocks of bounded text, and each two blocks
    are a cell. A cell is one row, compared where it lies; of it come the pairs
    of parts that are tied, never its pairs of lines.
    """
    lines = table(open_.join(norms, "node"), "open")
    sizes = lines.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / CELL_LINES, F.sum(F.length("norm")) / CELL_CHARS)).alias("blocks"))
    dealt = lines.join(maybe_broadcast(table(sizes, "sizes")), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    held = dealt.groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("node", "part", "norm", "n", "symbols")).alias("held"))
    cells = table(held, "blocks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    rows = cells.select("bucket", *cell, (F.col("block") <= F.col("other")).alias("first"), "held")
    x = rows.filter("first").select("bucket", "low", "high", F.col("held").alias("xs"))
    # A block meets itself in one cell, as both sides of it.
    y = rows.filter("NOT first OR low = high").select("bucket", "low", "high", F.col("held").alias("ys"))
    met = f"filter(ys, y -> x.part <> y.part AND {near_sql('x.norm', 'y.norm')} AND ({alike('x', 'y')}))"
    tied = f"array_distinct(flatten(transform(xs, x -> transform({met}, y -> struct(greatest(x.part, y.part) AS a, least(x.part, y.part) AS b)))))"
    # So many tasks, whatever little data the cells are: their work is not in their bytes.
    tasks, key = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["bucket", "low", "high"]
    return x.repartition(tasks, *key).join(y.repartition(tasks, *key).hint("merge"), key).select(F.explode(F.expr(tied)).alias("t")).select("t.a", "t.b").distinct()


def similar_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the nodes of ``lines``, distinct lines with their first place, ``least``, in ``docs``."""
    keyed = buckets(lines)
    # Most keys are one line's own: they are left out once, before anything is kept or read again.
    shared = table(keyed.groupBy("bucket").count().filter("count > 1").select("bucket"), "shared")
    members = table(keyed.join(maybe_broadcast(shared), "bucket", "left_semi"), "keyed")
    norms = spellings(lines.join(maybe_broadcast(table(members.select("node").distinct(), "nodes")), "node", "left_semi"), docs)
    return link(members, near, lambda pairs: verified(pairs, norms), lambda open_: compared(open_, norms))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines to remove: ``__id``, ``__key`` of the row, ``__lines`` (places from 0) and how many."""
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "raw"))
    worded = normalised(lines).withColumn("length", F.length("norm")).withColumn("node", F.xxhash64("norm"))
    occurrences = table(fingerprint(worded).select("id", "key", "line", "node", "length", "n", "blocks", "halves"), "lines")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "line")
    distinct = occurrences.groupBy("node").agg(F.min(place).alias("least"), F.count("*").alias("copies"), F.first(F.struct("length", "n", "blocks", "halves")).alias("made"))
    distinct = table(distinct.select("node", "least", "copies", "made.*"), "distinct")
    placed = distinct.select("node", "least", "copies").join(components(similar_lines(distinct, docs)), "node", "left").withColumn("part", F.coalesce("component", "node"))
    groups = placed.filter("copies > 1 OR component IS NOT NULL")
    firsts = groups.groupBy("part").agg(F.min("least").alias("first"))
    verdicts = table(groups.join(firsts, "part").select("node", "first"), "verdicts")
    gone = lookup(occurrences.select("id", "key", "line", "node"), verdicts, "node", "inner").filter(~place.eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.sort_array(F.collect_set("line")).alias("__lines"))


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``; more columns stay) with the text less its repeated lines, ``__n_lines`` and ``__n_removed``.

    Blank lines are never removed. Rows equal in id and text count as one row:
    they lose the same lines. A null text stays null and has no lines; an empty
    one has one. Lines may be whole long texts: one of over ``LONG_WORDS`` words
    is compared word by word.
    """
    gone = maybe_broadcast(table(repeated_lines(docs), "removed"))
    joined = docs.join(gone, (row_key() == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lines")), lambda i: F.get(lines, i))
    return joined.select(
        *[F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("__n_lines"),
        F.coalesce(F.size("__lines"), F.lit(0)).alias("__n_removed"),
    )
