"""The spectrum of an integer scatter matrix, exactly: characteristic polynomial, real roots, null vectors.

The matrices are symmetric, whole-numbered and positive semi-definite, so all
roots are real and none is negative. Everything here grows with the dimension
alone, never with the rows behind the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np

U = np.uint64

# Roots are pinned down to the trace divided by two to this power; closer roots count as one.
ROOT_BITS = 192

# Decimal places of the vectors' arithmetic, well beyond those of the roots.
DIGITS = 100


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3 215 031 751."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1):
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes below 2**31 whose product exceeds twice every coefficient, and one more as a check.

    The coefficients are elementary symmetric functions of the roots, which
    Maclaurin's inequality bounds by the trace, as no root is negative.
    """
    d, trace = len(matrix), sum(matrix[i, i] for i in range(len(matrix)))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    while not is_prime(candidate):
        candidate -= 2
    return [*found, candidate]


def powers(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    result, exponent = np.ones_like(base), exponent.copy()
    while exponent.any():
        result = np.where(exponent & U(1), result * base % p, result)
        base, exponent = base * base % p, exponent >> U(1)
    return result


def polynomials(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """The characteristic polynomial modulo each prime, highest power first.

    Similarity steps bring the matrix to Hessenberg form, column by column,
    for all primes at once; its leading minors then follow one from another.
    """
    d, p = len(matrix), np.array(primes, U)
    a = np.stack([(matrix % q).astype(U) for q in primes]) if d else np.empty((len(p), 0, 0), U)
    every, column = np.arange(len(p)), p[:, None]
    for k in range(d - 2):
        below = a[:, k + 1 :, k] != 0
        pivot = k + 1 + below.argmax(axis=1)
        some = a[every, pivot].copy()
        a[every, pivot], a[:, k + 1] = a[:, k + 1], some
        some = a[every, :, pivot].copy()
        a[every, :, pivot], a[:, :, k + 1] = a[:, :, k + 1], some
        # A column that is zero below the diagonal needs no step: its factors are zero.
        inverse = powers(a[:, k + 1, k], p - U(2), p)
        factor = a[:, k + 2 :, k] * inverse[:, None] % column
        a[:, k + 2 :] = (a[:, k + 2 :] + (column - factor)[:, :, None] * a[:, None, k + 1] % column[:, :, None]) % column[:, :, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + (factor[:, None, :] * a[:, :, k + 2 :] % column[:, :, None]).sum(axis=2)) % column
    found = np.zeros((d + 1, len(p), d + 1), U)  # minor, prime, power
    found[0, :, 0] = 1
    for k in range(1, d + 1):
        found[k, :, 1:] = found[k - 1, :, :-1]
        product = np.ones(len(p), U)
        for i in range(k):
            if i:
                product = product * a[:, k - i, k - i - 1] % p
            factor = product * a[:, k - 1 - i, k - 1] % p
            found[k] = (found[k] + (p - factor)[:, None] * found[k - 1 - i] % column) % column
    return found[d][:, ::-1]


def combine(residues: np.ndarray, primes: list[int], trace: int) -> list[int]:
    """Signed whole coefficients from their residues (Chinese remainders); the last prime checks the result."""
    *used, check = primes
    product = 1
    for p in used:
        product *= p
    weights = [(product // p) * pow(product // p, -1, p) for p in used]
    found = []
    for i in range(residues.shape[1]):
        value = sum(int(r) * w for r, w in zip(residues[:, i], weights)) % product
        found.append(value - product if 2 * value > product else value)
        if found[-1] % check != int(residues[-1, i]):
            raise ArithmeticError("characteristic polynomial: the check prime disagrees")
    if len(found) > 1 and found[1] != -trace:
        raise ArithmeticError("characteristic polynomial: the trace disagrees")
    return found


@dataclass(frozen=True)
class Interval:
    """Roots ``first`` to ``first + count - 1``, by falling value, lie in (low, high] / 2**scale; ``above`` the interval are as many as ``first``."""

    first: int
    count: int
    low: int
    high: int
    scale: int


def roots_above(coefficients: list[int], at: int, scale: int) -> int:
    """How many roots exceed ``at / 2**scale``: sign changes after a Taylor shift, exact where all roots are real."""
    shifted = [c << scale * i for i, c in enumerate(coefficients)]
    for end in range(len(shifted), 1, -1):
        value = 0
        for i in range(end):
            value = shifted[i] = value * at + shifted[i] if i else shifted[i]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(coefficients: list[int], at: int, scale: int) -> int:
    value = 0
    for i, c in enumerate(coefficients):
        value = value * at + (c << scale * i)
    return (value > 0) - (value < 0)


def isolate(coefficients: list[int], wanted: int) -> list[Interval]:
    """The ``wanted`` largest positive roots in intervals of their own; roots closer than :data:`ROOT_BITS` tells share one."""
    while len(coefficients) > 1 and coefficients[-1] == 0:
        coefficients = coefficients[:-1]  # a root at zero
    degree = len(coefficients) - 1
    if degree == 0 or wanted <= 0:
        return []
    trace = -coefficients[1]
    finest = max(0, ROOT_BITS - trace.bit_length())
    found, open_ = [], [(0, trace, 0, degree, 0)]
    while open_:
        low, high, scale, over_low, over_high = open_.pop()
        count = over_low - over_high
        if count == 0 or over_high >= wanted:
            continue
        narrow = (high - low) << ROOT_BITS <= trace << scale
        if count == 1 or narrow or (high - low == 1 and scale >= finest):
            found.append(Interval(over_high, count, low, high, scale))
            continue
        if high - low == 1:
            low, high, scale = 2 * low, 2 * high, scale + 1
        middle = (low + high) // 2
        over = roots_above(coefficients, middle, scale)
        open_ += [(low, middle, scale, over_low, over), (middle, high, scale, over, over_high)]
    return sorted(found, key=lambda i: i.first)


def refine(coefficients: list[int], interval: Interval) -> Decimal:
    """The root of an interval, halved until it is known to the trace over 2**ROOT_BITS."""
    low, high, scale = interval.low, interval.high, interval.scale
    trace = -coefficients[1]
    if interval.count == 1:
        beyond = -1 if interval.first % 2 else 1  # the sign just above the root
        # Roots at zero change signs below, not above, any positive root.
        while (high - low) << ROOT_BITS > trace << scale:
            if high - low < 2:
                low, high, scale = 2 * low, 2 * high, scale + 1
            middle = (low + high) // 2
            sign = sign_at(coefficients, middle, scale)
            if sign == 0:
                low = high = middle
            elif sign == beyond:
                high = middle
            else:
                low = middle
    with localcontext() as context:
        context.prec = DIGITS
        return Decimal(low + high) / Decimal(1 << scale + 1)


def eigenvectors(matrix: np.ndarray, root: Decimal, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of ``matrix - root``, by inverse iteration in decimal arithmetic."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        tiny = (abs(root) + 1) * Decimal(10) ** (10 - DIGITS)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                order[k], order[best] = order[best], order[k]
            if a[k, k] == 0:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(v: np.ndarray) -> np.ndarray:
            x = v[order]
            for k in range(1, d):
                x[k] -= (a[k, :k] * x[:k]).sum()
            for k in range(d - 1, -1, -1):
                rest = (a[k, k + 1 :] * x[k + 1 :]).sum() if k + 1 < d else Decimal(0)
                x[k] = (x[k] - rest) / a[k, k]
            return x

        rng = np.random.default_rng(1)
        found = [np.array([Decimal(int(v)) for v in rng.integers(-1000, 1001, d)], object) for _ in range(count)]
        settled = Decimal(10) ** -40
        for _ in range(60):
            before, found_ = found, []
            for v in found:
                v = solve(v)
                v = v / (v * v).sum().sqrt()
                for _ in range(2):
                    for w in found_:
                        v = v - (v * w).sum() * w
                found_.append(v / (v * v).sum().sqrt())
            found = found_
            # Settled once the space no longer turns: each vector lies in the one before.
            left = max(1 - sum(((v * w).sum()) ** 2 for w in before) for v in found) if _ else Decimal(1)
            if left < settled:
                break
        else:
            raise ArithmeticError("eigenvectors: inverse iteration did not settle")
        out = []
        for v in found:
            largest = max(range(d), key=lambda i: abs(v[i]))
            out.append([float(x if v[largest] > 0 else -x) for x in v])
        return out
