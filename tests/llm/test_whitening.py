"""The exact spectrum on small matrices, whitening against numpy's on whole tables."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import spectrum, whitening
from tidelog.llm.queries import QUERIES, read


def determinant(rows):
    rows, sign, last = [list(r) for r in rows], 1, 1
    for k in range(len(rows) - 1):
        if rows[k][k] == 0:
            swap = next((i for i in range(k + 1, len(rows)) if rows[i][k]), None)
            if swap is None:
                return 0
            rows[k], rows[swap], sign = rows[swap], rows[k], -sign
        for i in range(k + 1, len(rows)):
            for j in range(k + 1, len(rows)):
                rows[i][j] = (rows[i][j] * rows[k][k] - rows[i][k] * rows[k][j]) // last
        last = rows[k][k]
    return sign * rows[-1][-1]


def polynomial(matrix):
    primes = spectrum.primes_for(matrix)
    return spectrum.combine(spectrum.polynomials(matrix, primes), primes, sum(matrix[i, i] for i in range(len(matrix))))


def gram(rows):
    x = np.array(rows, object)
    return x.T.dot(x)


vectors = st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-(10**9), 10**9) | st.integers(-2, 2), min_size=d, max_size=d), min_size=1, max_size=8))


@settings(max_examples=80, deadline=None)
@given(vectors)
def test_polynomial_is_exact(rows):
    matrix = gram(rows)
    d = len(matrix)
    found = polynomial(matrix)
    assert found[0] == 1 and len(found) == d + 1
    for x in range(-2, d + 1):
        shifted = [[x * (i == j) - int(matrix[i, j]) for j in range(d)] for i in range(d)]
        assert sum(c * x ** (d - i) for i, c in enumerate(found)) == determinant(shifted)


def test_check_prime_catches_a_wrong_residue():
    matrix = gram([[1, 2, 3], [4, 5, 7], [1, 0, 9]])
    primes = spectrum.primes_for(matrix)
    wrong = spectrum.polynomials(matrix, primes)
    wrong[0, 2] += 1
    with pytest.raises(ArithmeticError):
        spectrum.combine(wrong, primes, sum(matrix[i, i] for i in range(3)))


def test_primes():
    assert [n for n in range(60) if spectrum.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert spectrum.is_prime(2**31 - 1) and spectrum.is_prime(3215031749) and not spectrum.is_prime(2147483645) and not spectrum.is_prime(46337 * 46349)


def times(factors):
    out = [1]
    for root in factors:
        out = [a - root * b for a, b in zip([*out, 0], [0, *out])]
    return out


@pytest.mark.parametrize("roots", [[5], [9, 4, 1], [7, 7, 7, 2], [10**30 + 1, 10**30, 3, 0, 0], [6, 6, 5, 5, 0], [2**80, 2**40, 1, 1, 1]])
def test_roots_of_known_polynomials(roots):
    for wanted in range(len(roots) + 2):
        found = spectrum.isolate(times(roots), wanted)
        got = [r for i in found for r in [spectrum.refine(times(roots), i)] * i.count]
        assert [i.first for i in found] == list(np.cumsum([0, *[i.count for i in found]])[:-1])
        positive = [r for r in roots if r]
        assert len(got) >= min(wanted, len(positive))
        assert all(abs(Fraction(g) - r) <= Fraction(sum(roots), 2**190) for g, r in zip(got, positive))


def test_roots_closer_than_one():
    """Irrational roots of a matrix: x**2 - (a + b) x + ab - 1."""
    big = 10**12
    matrix = np.array([[big, 1], [1, big]], object)
    found = spectrum.isolate(polynomial(matrix), 2)
    assert [spectrum.refine(polynomial(matrix), i) for i in found] == [Decimal(big + 1), Decimal(big - 1)]
    golden = np.array([[2, 1], [1, 1]], object)
    with localcontext() as context:
        context.prec = 60
        want = [(3 + Decimal(5).sqrt()) / 2, (3 - Decimal(5).sqrt()) / 2]
        roots = [spectrum.refine(polynomial(golden), i) for i in spectrum.isolate(polynomial(golden), 2)]
        assert all(abs(a - b) < Decimal(10) ** -55 for a, b in zip(roots, want))


@pytest.mark.parametrize("values", [[9, 4, 1], [4, 4, 4, 1], [10**12 + 1, 10**12, 5]])
def test_eigenvectors(values):
    """Of a matrix with known values, turned by a whole-numbered reflection."""
    d = len(values)
    u = np.arange(1, d + 1)
    norm = int(u @ u)
    h = norm * np.eye(d, dtype=object).astype(int).astype(object) - 2 * np.outer(u, u).astype(object)
    matrix = h.dot(np.diag(np.array(values, object))).dot(h)  # norm**2 times the values
    for i in spectrum.isolate(polynomial(matrix), d):
        root = spectrum.refine(polynomial(matrix), i)
        found = np.array(spectrum.eigenvectors(matrix, root, i.count))
        assert np.abs(found @ found.T - np.eye(i.count)).max() < 1e-15
        for v in found:
            exact = [sum(Fraction(int(m)) * Fraction(x) for m, x in zip(row, v)) - Fraction(root) * Fraction(x) for row, x in zip(matrix, v)]
            assert max(map(abs, exact)) < Fraction(sum(values) * norm**2) / 10**14


@settings(max_examples=50, deadline=None)
@given(st.integers(-(2**200), 2**200))
def test_limbs(value):
    parts = list(whitening.limbs(value))
    assert sum(p << whitening.LIMB * at for at, p in parts) == value and all(abs(p) <= 1 << 33 for _, p in parts)


def usable(rows):
    return [(i, [float(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def check(got, rows, components=32, tolerance=1e-9):
    rows = usable(rows)
    n = len(rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    total = x.sum(axis=0)
    apart = n * x - total
    far = (apart**2).sum(axis=1)
    centred = apart.astype(float) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    assert len(got) == n * k
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and {r["n"] for r in got} == {n}
    assert sorted(by_row, key=repr) == sorted({(i, int(f)) for (i, _), f in zip(rows, far)}, key=repr)
    whitened = np.zeros((n, k))
    for at, ((i, _), f) in enumerate(zip(rows, far)):
        for r in by_row[i, int(f)]:
            whitened[at, r["component"] - 1] = np.nan if r["whitened"] is None else r["whitened"]
    explained = {r["component"]: r["explained"] for r in got}
    trace = np.trace(covariance)
    live = [c for c in range(k) if values[c] > 1e-9 * trace]
    assert np.isnan(whitened[:, [c for c in range(k) if c not in live]]).all()
    for c in live:
        assert abs(explained[c + 1] - values[c] / trace) < 1e-9
        others = np.delete(values, c)
        if np.abs(others - values[c]).min() > 1e-6 * values[0]:
            want = centred @ axes[:, c] / math.sqrt(values[c])
            sign = np.sign(want @ whitened[:, c])
            assert np.abs(sign * want - whitened[:, c]).max() < 1e-6
    if live:
        own = whitened[:, live] - whitened[:, live].mean(axis=0)
        assert np.abs(own.T @ own / n - np.eye(len(live))).max() < tolerance and errors.pop() < tolerance


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_numpy(spark, sf):
    got = QUERIES["op13_whitening"](spark, f"/root/testdata/{sf}").collect()
    rows = read(spark, f"/root/testdata/{sf}", "embeddings").collect()
    check(got, [(r["vec_id"], r["embedding"]) for r in rows])


def test_odd_rows(spark):
    """Nulls, non-finite, huge and missing entries, other lengths, ties, repeated rows, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(0, rows[0][1]), (7, rows[7][1]), (None, rng.normal(size=5).tolist()), (41, [0.0] * 5)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [1.0, float("nan"), 2.0, 3.0, 4.0]), (53, [float("inf")] + [0.0] * 4), (54, [-float("inf")] * 5)]
    odd = [(55, [1.0, 2.0]), (56, []), (57, [1e300] + [0.0] * 4)]
    df = spark.createDataFrame([(*r, "x", 1.5, 9) for r in rows + bad + odd], "vec_id long, embedding array<double>, component string, whitened double, id int")
    check(whitening.whiten(df).collect(), rows + bad)
    left = whitening.whiten(df.filter("vec_id >= 50"))
    assert [(r["vec_id"], r["n"]) for r in left.collect()] == [(55, 1)] * 2  # the only usable vector
    assert whitening.whiten(df.filter("vec_id BETWEEN 50 AND 54 OR vec_id = 56")).count() == 0


def test_one_vector_and_equal_vectors_have_no_variance(spark):
    for rows in ([(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(5)]):
        got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        assert len(got) == 2 * len(rows)
        assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got} == {(None, 0.0, None, 0)}


def test_fewer_vectors_than_dimensions_and_equal_roots(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(4)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
    cross = [(2 * i + s, [float((-1) ** s * 4 * (i == j)) for j in range(4)]) for i in range(4) for s in (0, 1)]
    check(whitening.whiten(spark.createDataFrame(cross, "vec_id long, embedding array<double>"), components_=3).collect(), cross, 3)


def test_large_entries_stay_exact(spark):
    """Whole entries beyond 20 and beyond 53 bits; deviations beyond a long are null."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-(2**34), 2**34, 3) / 64).tolist()) for i in range(50)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], object)
    assert model.sums == x.sum(axis=0).tolist()
    huge = [(i, [float(v) * 2.0**50 for v in rng.integers(-20, 20, 3)]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    y = np.array([[math.floor(64 * c) for c in v] for _, v in huge], object)
    far = ((30 * y - y.sum(axis=0)) ** 2).sum(axis=1)
    assert all(r["deviation"] == (int(far[r["vec_id"]]) if far[r["vec_id"]] < 2**63 else None) for r in got) and got[0]["identity_error"] < 1e-9
    big = np.array([[3_037_000_500, 0], [3_037_000_499, 0], [2**31, 2**31 - 5]], np.int64)
    assert whitening.deviations(big) == [None, 3_037_000_499**2, 2**62 + (2**31 - 5) ** 2]
