"""Quality by language model: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Counts, discounts and probabilities are tables keyed by language and n-gram,
made and looked up by shuffled joins, so that no machine holds the model. To
score, documents are dealt into chunks of bounded text, in the order they are
read; each chunk asks once for each n-gram it has, and the answers are grouped
by chunk where its documents are read again. Labelled documents are scored with the others, once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import filesystem, shared_path, table, text_or_empty
from tidelog.plans.sizing import maybe_broadcast

ORDER = 4
START = "\x02"  # stands before each text
CHUNK_CHARS = 12_000_000  # a longer text is a chunk of its own
LEVEL = 6  # zstandard's, of chunks
BLOCK_CHARS = 1_000_000  # n-grams of so much text are in a worker's memory at a time

HELD_OUT = 5  # every fifth trusted document, by hash, sets the thresholds; the others train the model
QUANTILE = 0.995  # of the held-out ones, where no labelled bad text says where to cut

WORST = 8  # letters: the least likely run of so many tells a few bad words in a long text
LAG, RUN = 64, 256  # an n-gram seen up to LAG places before is a repeat; the share of repeats is taken over RUN places
PLAIN = "^[\\p{L}\\s.,\\x02]*$"  # n-grams of words: numbers, addresses and keys in good text are as unlikely as bad words

# Discounts where counts of counts are missing (modified Kneser-Ney needs n1 to n4).
FALLBACK = {1: 0.5, 2: 1.0, 3: 1.5}

# What a document is judged by, each with a cut above which it goes. Cuts are set in this order, the mean last: it says least.
MEASURES = ("__repeats", "__worst", "__perplexity")


class Grams:
    """The n-grams of texts as whole numbers, by a dense code of the characters given."""

    def __init__(self, points: np.ndarray):
        present = np.unique(points)
        self.codes = np.zeros(0x110000, np.int64)
        self.codes[present] = np.arange(len(present))
        self.present = present
        self.bits = max(1, int(len(present)).bit_length())

    def keys(self, points: np.ndarray) -> np.ndarray:
        """A key for each place from ``ORDER - 1`` on: the character there and those before it."""
        codes = self.codes[points]
        if self.bits * ORDER <= 63:
            key = codes[: len(codes) - ORDER + 1].copy()
            for i in range(1, ORDER):
                key = (key << self.bits) | codes[i : len(codes) - ORDER + 1 + i]
            return key
        raise OverflowError  # over 2^15 different characters: callers use the n-grams' texts instead


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after its start marks, and which of them end an n-gram of a text."""
    pad = START * (ORDER - 1)
    points = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    real = np.ones(len(points), bool)
    for i in range(ORDER - 1):
        real[starts + i] = False
    return points, real


def gram_texts(points: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The n-grams that end at the given places, as strings."""
    rows = points[ends[:, None] + np.arange(1 - ORDER, 1)].astype("<u4")
    lengths = np.where(rows < 0x80, 1, np.where(rows < 0x800, 2, np.where(rows < 0x10000, 3, 4))).sum(axis=1)
    data = rows.tobytes().decode("utf-32-le", "replace").encode()
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32).tobytes()), pa.py_buffer(data))


def distinct_grams(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Distinct n-grams and their counts."""
    points, real = points_of(texts)
    ends = np.flatnonzero(real)
    if not len(ends):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    try:
        keys = Grams(points).keys(points)[ends - (ORDER - 1)]
        codes, _ = pd.factorize(keys)
    except OverflowError:
        codes, _ = pd.factorize(pd.Series(gram_texts(points, ends).to_pandas()))
    first = np.full(codes.max() + 1, -1)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return gram_texts(points, ends[first]), np.bincount(codes)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK_CHARS`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language, the distinct n-grams and their counts; the shuffle's combine adds them up."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for lang in pc.unique(rows["lang"]).to_pylist():
            texts = rows.filter(pc.equal(rows["lang"], lang))["text"].to_pylist()
            for a, b in blocks(texts):
                grams, counts = distinct_grams(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(grams)), grams, pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def dealer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows that follow each other, up to ``CHUNK_CHARS``, to a file of ``folder``; gives back the chunk's number and the file's name.

    Equal rows share no chunk for being equal, so a group of copies of any size is spread like other rows.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        chunk, size, open_, file = TaskContext.get().partitionId() << 32, 0, ExitStack(), ""
        writer = None

        def closed() -> pa.RecordBatch:
            open_.close()
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([file])], ["__chunk", "__file"])

        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            start = 0
            for i, length in enumerate(lengths):
                if size and size + length > CHUNK_CHARS:
                    if i > start:
                        writer.write_batch(batch.slice(start, i - start))
                    yield closed()
                    chunk, size, start, writer = chunk + 1, 0, i, None
                if writer is None:
                    file = f"{uuid.uuid4().hex}.arrow"
                    raw = open_.enter_context(fs.open_output_stream(f"{root}/{file}", compression=None))
                    packed = open_.enter_context(zstandard.ZstdCompressor(level=LEVEL).stream_writer(raw))
                    writer = open_.enter_context(pa.ipc.new_stream(packed, batch.schema))
                size += length
            if batch.num_rows > start:
                writer.write_batch(batch.slice(start))
        if writer is not None:
            yield closed()

    return deal


def unpack(folder: str, file: str) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk, a batch at a time."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/{file}", compression="zstd") as source, pa.ipc.open_stream(source) as rows:
        yield from rows


def languages(rows: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Each language of a batch, the numbers of its rows, and their texts."""
    langs = pc.fill_null(rows["lang"], "")
    for lang in pc.unique(langs).to_pylist():
        at = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
        yield lang, at, [t or "" for t in rows["text"].take(pa.array(at)).to_pylist()]


def asker(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct n-grams of each chunk and language."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, file in zip(batch.column("__chunk").to_pylist(), batch.column("__file").to_pylist()):
                asked: dict[str, pa.Array] = {}
                for rows in unpack(folder, file):
                    for lang, _, texts in languages(rows):
                        parts = [distinct_grams(texts[a:b])[0] for a, b in blocks(texts)]
                        asked[lang] = pc.unique(pa.concat_arrays([asked.get(lang, pa.array([], pa.string())), *parts]))
                for lang, grams in asked.items():
                    n = len(grams)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chunk, pa.int64()), n), pa.repeat(pa.scalar(lang, pa.string()), n), grams], ["__chunk", "lang", "gram"])

    return ask


def means(x: np.ndarray, width: int) -> np.ndarray:
    """Of each window of ``x``; of all of it if it is shorter than a window."""
    if len(x) <= width:
        return x.mean(keepdims=True)
    total = np.cumsum(np.concatenate([[0.0], x]))
    return (total[width:] - total[:-width]) / width


def repeats(at: np.ndarray) -> np.ndarray:
    """Which places hold an n-gram that one of the ``LAG`` places before holds too."""
    order = np.argsort(at, kind="stable")
    out = np.zeros(len(at))
    out[order[1:]] = (at[order[1:]] == at[order[:-1]]) & (order[1:] - order[:-1] <= LAG)
    return out


def perplexities(texts: list[str], grams: pa.Array, logs: np.ndarray) -> np.ndarray:
    """Of each text; NaN for an empty one."""
    return measures(texts, grams, logs)[2]


def measures(texts: list[str], grams: pa.Array, logs: np.ndarray) -> np.ndarray:
    """Rows as in ``MEASURES``: each text's largest share of repeats, the perplexity of its worst ``WORST`` letters, and of all; NaN for an empty text."""
    out = np.full((len(MEASURES), len(texts)), np.nan)
    plain = pc.match_substring_regex(grams, PLAIN).to_numpy(zero_copy_only=False)
    joined = "".join(grams.to_pylist())
    known = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    for a, b in blocks(texts):
        some = texts[a:b]
        points, real = points_of(some)
        ends = np.flatnonzero(real)
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        if not len(ends):
            continue
        try:
            coder = Grams(np.concatenate([known, points]))
            index = pd.Index(coder.keys(known)[::ORDER])
            at = index.get_indexer(coder.keys(points)[ends - (ORDER - 1)])
        except OverflowError:
            at = pd.Index(grams.to_pandas()).get_indexer(gram_texts(points, ends).to_pandas())
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        out[2, a + full] = np.exp(-np.add.reduceat(logs[at], starts) / lengths[full])
        for i, start in zip(full.tolist(), starts.tolist()):
            own = at[start : start + lengths[i]]
            words = own[plain[own]]
            out[1, a + i] = np.exp(-means(logs[words], WORST).min()) if len(words) else 0.0
            out[0, a + i] = means(repeats(own), RUN).max()
    return out


def scorer(folder: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A group: the log probabilities of a chunk's n-grams, and a row with its file. ``names`` are the columns to give back."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        file = group["__file"].drop_null()[0].as_py()
        answers = {lang: group.filter(pc.equal(group["lang"], lang)).select(["gram", "log"]).combine_chunks() for lang in pc.unique(group["lang"]).to_pylist() if lang is not None}
        del group
        for docs in unpack(folder, file):
            found = np.full((len(MEASURES), docs.num_rows), np.nan)
            for lang, rows, texts in languages(docs):
                if lang in answers:
                    own = answers[lang]
                    found[:, rows] = measures(texts, own["gram"].combine_chunks(), own["log"].to_numpy().astype(np.float64))
            some = pc.greater(pc.fill_null(pc.binary_length(docs["text"]), 0), 0)
            scores = [pa.array(np.round(values, 4), pa.float64(), from_pandas=True) for values in found]
            yield pa.RecordBatch.from_arrays([*docs.select(names).columns, some, *scores], [*names, "__some", *MEASURES])

    return score


def discounts(counts: DataFrame) -> DataFrame:
    """``d1``, ``d2``, ``d3`` of each language, from its counts of counts."""
    of = counts.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        return F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(i)))).otherwise(FALLBACK[i]).alias(f"d{i}")

    # F.when guards each division: nullif keeps the unused branch from failing in ANSI mode.
    of = of.select("lang", *[F.when(F.col(f"n{i}") > 0, F.col(f"n{i}")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    return of.select("lang", *[discount(i) for i in (1, 2, 3)])


def train(trusted: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """The model of each language of ``trusted`` (``text``, ``lang``).

    For each order, probabilities of the n-grams seen (``lang``, ``gram``,
    ``p``) and the weight that each context leaves to the next lower order
    (``lang``, ``context``, ``backoff``). Lower orders count how many
    different characters precede an n-gram. Order 0 has the share of an
    unknown character.
    """
    counts = {ORDER: table(gram_counts(trusted), "counts")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = table(counts[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "counts")
    # A row per language: the uniform share of each character seen, and of any other.
    sizes = table(counts[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")), "characters")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    lower = sizes
    for k in range(1, ORDER + 1):
        rows = counts[k].join(maybe_broadcast(table(discounts(counts[k]), "discounts")), "lang").withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = table(
            rows.groupBy("lang", "context").agg(
                F.sum("n").alias("total"),
                F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"), F.count(F.when(F.col("n") > 2, 1)).alias("n3"),
                F.first("d1").alias("d1"), F.first("d2").alias("d2"), F.first("d3").alias("d3"),
            ).select("lang", "context", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("backoff")),
            "contexts",
        )
        known = rows.withColumn("taken", taken).select("lang", "gram", "context", "n", "taken").join(contexts, ["lang", "context"])
        if k == 1:
            known = known.join(maybe_broadcast(lower), "lang")
        else:
            known = known.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower.withColumnRenamed("gram", "suffix"), ["lang", "suffix"])
        lower = table(known.select("lang", "gram", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("backoff") * F.col("p")).alias("p")), "model")
        model[k] = (lower, contexts.select("lang", "context", "backoff"))
    model[0] = (sizes, sizes)
    return model


def look_up(wanted: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``lang``, ``gram``, ``log`` for each of the distinct n-grams wanted, of languages that have a model."""
    parts = {ORDER: wanted}
    for k in range(ORDER - 1, 0, -1):
        parts[k] = wanted.select("lang", F.substring("gram", ORDER - k + 1, k).alias("gram")).distinct()
    base = model[1][1].join(model[0][0], "lang").select("lang", (F.col("backoff") * F.col("p")).alias("rest"))
    found = parts[1].join(model[1][0], ["lang", "gram"], "left").join(maybe_broadcast(table(base, "unknown")), "lang").select("lang", "gram", F.coalesce("p", "rest").alias("p"))
    for k in range(2, ORDER + 1):
        seen, contexts = model[k]
        below = found.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        found = (
            parts[k].withColumn("suffix", F.substring("gram", 2, k - 1)).withColumn("context", F.substring("gram", 1, k - 1))
            .join(seen, ["lang", "gram"], "left")
            .join(contexts, ["lang", "context"], "left")
            .join(below, ["lang", "suffix"])
            .select("lang", "gram", F.coalesce("p", F.coalesce("backoff", F.lit(1.0)) * F.col("lower")).alias("p"))
        )
    return found.select("lang", "gram", F.log("p").cast("float").alias("log"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` of all texts: counted in the tasks, added up by a shuffle."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def perplexity(docs: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], *, text: bool = True) -> DataFrame:
    """``docs`` with ``MEASURES``, null for empty texts and for languages without a model, and ``__some``: the text is not empty.

    The texts are dealt into chunks and written once, compressed, each chunk a
    file of the shared folder. Chunks ask for their n-grams, each distinct one
    is looked up once, and a chunk's answers are grouped where its file is read
    again. Without ``text`` the texts don't come back from there.
    """
    typed = docs.withColumn("text", F.col("text").cast("string"))
    folder = shared_path(docs.sparkSession, "chunks")
    dealt = table(typed.mapInArrow(dealer(folder), "__chunk long, __file string"), "dealt")
    asked = table(dealt.mapInArrow(asker(folder), "__chunk long, lang string, gram string"), "asked")
    logs = table(look_up(table(asked.select("lang", "gram").distinct(), "wanted"), model), "logs")
    files = dealt.select("__chunk", *[F.lit(None).cast(kind).alias(name) for name, kind in (("lang", "string"), ("gram", "string"), ("log", "float"))], "__file")
    answers = asked.join(logs, ["lang", "gram"]).select("__chunk", "lang", "gram", "log", F.lit(None).cast("string").alias("__file"))
    names = [c for c in docs.columns if text or c != "text"]
    schema = T.StructType([*typed.select(*[F.col(f"`{c}`") for c in names]).schema.fields, T.StructField("__some", T.BooleanType()), *[T.StructField(m, T.DoubleType()) for m in MEASURES]])
    chunks = max(1, dealt.count())
    return answers.union(files).repartition(chunks, "__chunk").groupBy("__chunk").applyInArrow(scorer(folder, names), schema)


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """Per language, the exact quantile of ``__perplexity`` (of values rounded to 0.01, so that few are distinct); null for a single document."""
    from pyspark.sql.window import Window

    values = scored.filter("__perplexity IS NOT NULL").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.round("__perplexity", 2).alias("v")).count()
    by = Window.partitionBy("lang")
    ranked = values.withColumn("below", F.sum("count").over(by.orderBy("v"))).withColumn("total", F.sum("count").over(by))
    found = ranked.filter(F.col("below") >= F.ceil(F.col("total") * quantile)).groupBy("lang").agg((F.min("v") + 0.005).alias("most"))
    # Few documents hardly reach their quantile: Student's t (Cornish and Fisher's expansion) bounds the next one of as many.
    z = NormalDist().inv_cdf(quantile)
    n, log = F.count("__perplexity"), F.log("__perplexity")
    free = F.greatest(n - 1, F.lit(1))
    t = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free * free)
    bound = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(n.alias("n"), F.exp(F.avg(log) + t * F.stddev_samp(log) * F.sqrt(1 + 1 / F.greatest(n, F.lit(1)))).alias("next"))
    few = F.col("n") < math.ceil(1 / (1 - quantile))
    return found.join(bound, "lang").select("lang", F.when(few, F.when(F.col("n") > 1, F.greatest("most", "next"))).otherwise(F.col("most")).alias("most"))


def cuts(judged: DataFrame, measure: str) -> DataFrame:
    """``lang``, ``cut``: with the fewest mistakes on labelled texts, halfway to the least value cut off.

    ``judged`` has ``lang``, ``bad`` (0 or 1), ``held`` and the measures. A
    held-out good text stands for the ``HELD_OUT`` it was drawn from; repeats
    owe nothing to training, so there each good text stands for itself. No row
    for a language where a cut mends nothing.
    """
    from pyspark.sql.window import Window

    weight = F.lit(1) if measure == "__repeats" else F.when(F.col("held"), HELD_OUT).otherwise(0)
    good = F.sum((1 - F.col("bad")) * weight)
    # Rounded to three digits, so that few values are distinct.
    digits = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(measure, F.lit(0.001)))) - 2)
    values = judged.filter(F.col(measure).isNotNull()).groupBy("lang", (F.round(F.col(measure) / digits) * digits).alias("v")).agg(F.sum("bad").alias("bad"), good.alias("good"))
    by = Window.partitionBy("lang")
    upto = by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.sum("good").over(by) - F.sum("good").over(upto)
    tried = values.select("lang", "v", F.lead("v").over(by.orderBy("v")).alias("next"), (F.sum("bad").over(upto) + lost).alias("mistakes"), F.sum("good").over(by).alias("all"))
    best = tried.filter("all > 0").groupBy("lang").agg(F.max_by(F.struct("v", "next"), F.struct(-F.col("mistakes"), F.col("v"))).alias("b"))
    return best.filter("b.next IS NOT NULL").select("lang", ((F.col("b.v") + F.col("b.next")) / 2).alias("cut"))


def limits_of(judged: DataFrame, quantile: float) -> DataFrame:
    """``lang`` and the cut of each measure (``..._most``), null if there is none.

    One cut at a time is set on what the others let through. The second round
    takes back what an early cut spent on texts that a later one finds.
    """
    judged = table(judged, "judged")
    limits = table(thresholds(judged.filter("bad = 0 AND held"), quantile).select("*", *[F.lit(None).cast("double").alias(f"{m}_most") for m in MEASURES]), "thresholds")
    for measure in MEASURES * 2:
        passed = judged.join(F.broadcast(limits), "lang")
        for other in MEASURES:
            if other != measure:
                passed = passed.filter(F.coalesce(F.col(other) <= F.col(f"{other}_most"), F.lit(True)))
        limits = table(limits.drop(f"{measure}_most").join(cuts(passed, measure), "lang", "left").withColumnRenamed("cut", f"{measure}_most"), "limits")
    # Where no bad text lies above the good ones, perplexity is cut at the good ones' quantile.
    return limits.withColumn("__perplexity_most", F.coalesce("__perplexity_most", "most")).drop("most")


def verdicts(labels: DataFrame) -> DataFrame:
    """A row per labelled document: ``__good`` if all its labels say quality 1 and not toxic, ``__bad`` if one says toxic or quality 0."""
    quality, toxic = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(((F.min(quality) == 1) & (F.max(toxic) == 0)).alias("__good"), F.max(bad).alias("__bad"))


def is_held() -> Column:
    """Whether a trusted document is held out from training."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose labels all say quality 1 and not toxic, with ``__held``."""
    good = verdicts(labels).filter("__good").select("doc_id")
    return docs.select("doc_id", "text", "lang").join(maybe_broadcast(good), "doc_id", "left_semi").withColumn("__held", is_held())


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, *, text: bool = True) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``lang``; more columns stay) with ``__perplexity`` and ``__keep``; without ``text`` if that is False.

    A document is kept if none of ``MEASURES`` under the model of its language
    is above its cut. The cuts of a language are set by labelled bad documents
    (quality 0 or toxic) and by trusted ones held out from training; if no bad
    one is above the trusted ones, perplexity is cut at their given quantile.
    Empty and null texts are not kept. A language without
    trusted text (or without held-out text) gives no evidence: its documents
    are kept. A null language is one of its own. Every input row gives one
    row; repeated rows fare alike. Texts of any length are scored whole; one
    longer than ``CHUNK_CHARS`` is a chunk, so a task holds the longest text.
    """
    model = train(trusted_rows(docs, labels).filter("NOT __held"))
    scored = table(perplexity(docs, model, text=text), "scored")
    labelled = table(verdicts(labels).filter("__good OR __bad"), "labelled").withColumnRenamed("doc_id", "__doc")
    # Broadcast only as far as it is measured to be small; one label per document either way.
    judged = scored.select("doc_id", "lang", *MEASURES).join(maybe_broadcast(labelled), F.col("doc_id") == F.col("__doc"))
    judged = judged.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("__bad").cast("int").alias("bad"), (F.col("__good") & is_held()).alias("held"), *MEASURES)
    limits = maybe_broadcast(limits_of(judged, quantile).withColumnRenamed("lang", "__lang"))
    most = [f"{m}_most" for m in MEASURES]
    fits = F.lit(True)
    for measure in MEASURES:
        fits = fits & F.coalesce(F.col(measure) <= F.col(f"{measure}_most"), F.lit(True))
    return (
        scored.join(limits, F.coalesce(scored["lang"], F.lit("")) == limits["__lang"], "left")
        .withColumn("__keep", F.col("__some") & fits)
        .drop("__lang", "__some", *most, *MEASURES[:-1])
    )
