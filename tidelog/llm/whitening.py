"""Embedding whitening with the components of an exact integer spectrum."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import spectrum
from tidelog.llm.common import table

COMPONENTS = 32

# Entries are counted in steps of 1 / SCALE.
SCALE = 64

# Whole numbers travel in limbs of this many bits, so that sums over any number of tasks stay exact.
LIMB = 32

# Factors of this many bits and so many rows at once keep dot products within a double's 53 bits.
DIGIT, EXACT_ROWS = 20, 4_096

# Primes reduced together in one task.
PRIMES = 16


def usable(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``width`` finite entries, and those as whole numbers ``floor(scale * entry)``."""
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float), nan=-1)
    kept = lengths == width
    values = column.filter(pa.array(kept)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        steps = np.floor(scale * values)
        fine = (np.abs(steps) < 2.0**62).all(axis=1)
    kept[np.flatnonzero(kept)[~fine]] = False
    return kept, steps[fine].astype(np.int64)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed whole numbers as doubles of :data:`DIGIT` bits, lowest first; the last has the sign."""
    found = []
    while len(y) and np.abs(y).max() >= 1 << DIGIT:
        found.append((y & ((1 << DIGIT) - 1)).astype(float))
        y = y >> DIGIT
    return [*found, y.astype(float)]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as limbs; the last has the sign."""
    at = 0
    while abs(value) >> LIMB:
        yield at, value & ((1 << LIMB) - 1)
        value, at = value >> LIMB, at + 1
    yield at, value


def scatter(width: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact count (-1, -1), sums (-1, j) and sums of products (i <= j) of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        held: dict[tuple[int, int], np.ndarray] = {}
        added = 0

        def settle():
            for (a, b), part in held.items():
                products[:] = products + (part.astype(object) << DIGIT * (a + b))
            held.clear()

        for batch in batches:
            _, y = usable(batch.column("vector"), width, scale)
            n += len(y)
            for start in range(0, len(y), EXACT_ROWS):
                parts = digits(y[start : start + EXACT_ROWS])
                for a, x in enumerate(parts):
                    sums = sums + (x.sum(axis=0).astype(np.int64).astype(object) << DIGIT * a)
                    for b, z in enumerate(parts):
                        held[a, b] = held.get((a, b), 0) + (x.T @ z).astype(np.int64)
                added += 1
                if added % 512 == 0:
                    settle()
        settle()
        rows = [(-1, -1, *limb) for limb in limbs(n)]
        rows += [(-1, j, *limb) for j in range(width) for limb in limbs(sums[j])]
        rows += [(i, j, *limb) for i in range(width) for j in range(i, width) for limb in limbs(products[i, j])]
        i, j, limb, part = zip(*rows) if n else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())], ["i", "j", "limb", "part"])

    return run


@dataclass(frozen=True)
class Model:
    """What a fit keeps: sizes of the dimension, not of the rows."""

    width: int
    scale: int
    n: int
    sums: list[int]
    values: list[float]  # eigenvalues of the covariance, falling
    explained: list[float]
    vectors: list[list[float]]  # unit vectors; those of no variance are left out
    largest: int  # no whole entry exceeds this

    @property
    def weights(self) -> np.ndarray:
        """Turns a centred vector into its whitened components."""
        kept = len(self.vectors)
        return (np.array(self.vectors, float).reshape(kept, self.width) / np.sqrt(np.array(self.values[:kept], float))[:, None]).T


def centred(y: np.ndarray, model: Model) -> np.ndarray:
    """``n * x - S``, exact: as longs if they hold it, else as Python's whole numbers."""
    if 2 * model.n * model.largest < 1 << 62:
        return model.n * y - np.array(model.sums, np.int64)
    return model.n * y.astype(object) - np.array(model.sums, object)


def deviations(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where a long can not hold one."""
    rough = (apart.astype(float) ** 2).sum(axis=1)
    if apart.dtype == object:
        exact = (apart**2).sum(axis=1)
    else:
        with np.errstate(over="ignore"):
            exact = (apart * apart).sum(axis=1)  # wraps, but comes back to what fits a long
    found = []
    for row, about, value in zip(apart, rough.tolist(), exact.tolist()):
        if abs(about - 2.0**63) < 2.0**50 or (apart.dtype != object and about >= 2.0**62):
            value = sum(int(v) ** 2 for v in row)
        found.append(value if value < 1 << 63 else None)
    return found


def project(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, y = usable(batch.column("vector"), model.width, model.scale)
            apart = centred(y, model)
            found = (apart / model.n).astype(float) @ weights
            ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(kept)), pa.array(deviations(apart), pa.int64()), lists], ["id", "deviation", "whitened"])

    return run


def moments(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's count, means and centred products of the whitened components."""
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1]
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, y = usable(batch.column("vector"), model.width, model.scale)
            if not len(y):
                continue
            found = (centred(y, model) / model.n).astype(float) @ weights
            own = found.mean(axis=0)
            found = found - own
            spread = spread + found.T @ found + np.outer(own - mean, own - mean) * (n * len(y) / (n + len(y)))
            mean = mean + (own - mean) * (len(y) / (n + len(y)))
            n += len(y)
        i, j = np.triu_indices(k) if n else (np.empty(0, int), np.empty(0, int))
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n)), pa.array(mean[i]), pa.array(mean[j]), pa.array(spread[i, j])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n", "mean_i", "mean_j", "spread"])

    return run


def _vectors(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return embeddings.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))


def characteristic(embeddings: DataFrame, matrix: np.ndarray) -> list[int]:
    """The exact characteristic polynomial; the primes are shared out over tasks."""
    spark = embeddings.sparkSession
    primes = spectrum.primes_for(matrix)
    packed = pickle.dumps(matrix)  # grows with the square of the dimension alone

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for batch in batches:
            some = batch.column("prime").to_pylist()
            for a in range(0, len(some), PRIMES):
                found = spectrum.polynomials(own, some[a : a + PRIMES]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("prime").slice(a, PRIMES), pa.array(list(found), pa.list_(pa.int64()))], ["prime", "residues"])

    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(-(-len(primes) // PRIMES))
    got = {r["prime"]: r["residues"] for r in rows.mapInArrow(reduce, "prime long, residues array<long>").collect()}
    return spectrum.combine(np.array([got[p] for p in primes]), primes, sum(matrix[i, i] for i in range(len(matrix))))


def components(embeddings: DataFrame, matrix: np.ndarray, wanted: int) -> list[tuple[Decimal, list[list[float]]]]:
    """The largest positive roots with their vectors, falling; each group of equal roots is a task's work."""
    polynomial = characteristic(embeddings, matrix)
    intervals = spectrum.isolate(polynomial, wanted)
    if not intervals:
        return []
    packed = pickle.dumps((matrix, polynomial, intervals))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, coefficients, found = pickle.loads(packed)
        for batch in batches:
            for at in batch.column("at").to_pylist():
                root = spectrum.refine(coefficients, found[at])
                vectors = spectrum.eigenvectors(own, root, found[at].count)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([str(root)]), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], ["at", "root", "vectors"])

    rows = embeddings.sparkSession.range(len(intervals)).withColumnRenamed("id", "at").repartition(len(intervals), "at")
    solved = rows.mapInArrow(solve, "at long, root string, vectors array<array<double>>").collect()
    return [(Decimal(r["root"]), r["vectors"]) for r in sorted(solved)]


def fit(embeddings: DataFrame, *, components_: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> Model | None:
    """The whitening of all usable vectors; None if there are none.

    The driver gets sums over all rows of the size of the dimension squared,
    residues and vectors; no rows.
    """
    rows = _vectors(embeddings, id_column, vector_column)
    fine = F.forall("vector", lambda c: c.isNotNull() & (F.abs(scale * c.cast("double")) < 2.0**62))
    lengths = rows.filter((F.size("vector") > 0) & fine).groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return None
    width = lengths["width"]
    parts = rows.mapInArrow(scatter(width, scale), "i int, j int, limb int, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))
    totals: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        totals[r["i"], r["j"]] = totals.get((r["i"], r["j"]), 0) + (r["part"] << LIMB * r["limb"])
    n = totals.get((-1, -1), 0)
    if n == 0:
        return None
    sums = [totals[-1, j] for j in range(width)]
    matrix = np.zeros((width, width), object)
    for i in range(width):
        for j in range(i, width):
            matrix[i, j] = matrix[j, i] = n * totals[i, j] - sums[i] * sums[j]
    trace = sum(matrix[i, i] for i in range(width))
    wanted = min(components_, width)
    values, explained, vectors = [], [], []
    if trace:
        with localcontext() as context:
            context.prec = spectrum.DIGITS
            for root, own in components(embeddings, matrix, wanted):
                for vector in own[: wanted - len(vectors)]:
                    values.append(float(root / (n * n)))
                    explained.append(float(root / trace))
                    vectors.append(vector)
    values += [0.0] * (wanted - len(values))
    explained += [0.0] * (wanted - len(explained))
    largest = max(math.isqrt(totals[j, j]) for j in range(width))
    return Model(width, scale, n, sums, values, explained, vectors, largest)


def identity_error(embeddings: DataFrame, model: Model, *, id_column: str = "vec_id", vector_column: str = "embedding") -> float | None:
    """The largest entry, in absolute value, of the whitened vectors' covariance minus the identity."""
    if not model.vectors:
        return None
    schema = "i int, j int, n long, mean_i double, mean_j double, spread double"
    parts = table(_vectors(embeddings, id_column, vector_column).mapInArrow(moments(model), schema), "moments")
    # One row per component.
    means = {r["i"]: r["mean"] for r in parts.filter("i = j").groupBy("i").agg((F.sum(F.col("n") * F.col("mean_i")) / model.n).alias("mean")).collect()}
    listed = F.array(*[F.lit(means[i]) for i in range(len(model.vectors))])
    apart = (F.col("mean_i") - F.get(listed, F.col("i"))) * (F.col("mean_j") - F.get(listed, F.col("j")))
    covariance = parts.groupBy("i", "j").agg((F.sum(F.col("spread") + F.col("n") * apart) / model.n).alias("c"))
    return covariance.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, *, components_: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per usable vector and component, by falling eigenvalue: the id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries count in whole steps of ``1 / scale`` (rounded down); a constant
    added to all of them, such as the contract's 1 000 000, leaves every result
    as it is. The scatter ``n * sum(x x') - S S'`` is exact; its characteristic
    polynomial comes from Hessenberg reductions modulo primes and Chinese
    remainders; its roots are isolated by exact sign changes and halved to 192
    bits; the vectors are found by inverse iteration with 100 digits.
    ``deviation`` is the exact sum of ``(n * x - S) ** 2``, null where that is
    no long (from about 5 * 10**7 vectors of length one on).

    Left out are null vectors and those with null, NaN or infinite entries, or
    with entries beyond 2**62 steps. Vectors whose length is not the commonest
    (the longer one of two equally common) are left out too, as are empty ones.
    Equal vectors and rows count as often as they come, null ids are kept.
    Components of equal eigenvalues are orthonormal but otherwise arbitrary.
    A component without variance (fewer vectors than dimensions, say) has
    ``whitened`` null, ``explained`` 0, and does not enter ``identity_error``,
    which is null if there is no other. No usable vector, no rows. Other columns
    are not looked at.

    Work on the driver and in the tasks between the passes grows with the
    dimension alone, about as its fifth power: seconds at 64, minutes at 256.
    """
    spark = embeddings.sparkSession
    id_type = embeddings.schema[id_column].dataType.simpleString()
    names = dict(id_column=id_column, vector_column=vector_column)
    model = fit(embeddings, components_=components_, scale=scale, **names)
    if model is None:
        return spark.createDataFrame([], f"`{id_column}` {id_type}, {RESULT}")
    error = identity_error(embeddings, model, **names)
    rows = _vectors(embeddings, id_column, vector_column).mapInArrow(project(model), f"id {id_type}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(e) for e in model.explained])
    numbered = rows.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(len(model.values)))))
    return numbered.select(
        F.col("id").alias(id_column), "component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"),
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
