"""Spectrum of a symmetric integer matrix without negative eigenvalues, from its exact characteristic polynomial.

Everything here is arithmetic on one matrix of a vector's dimension; `whitening.py` deals the
primes and the eigenvalues out to tasks.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb, isqrt

import numpy as np

LARGEST = (1 << 31) - 1  #: products of two residues fit in 62 bits
RESOLUTION = 256         #: bits to which an eigenvalue is known, relative to the largest
TOGETHER = 192           #: eigenvalues closer than this many bits form one eigenspace
PRECISION = 768          #: bits of the arithmetic of inverse iteration


def _is_prime(n: int) -> bool:
    """Exact for numbers below 2**32."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (1, n - 1) or base % n == 0:
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient is larger: sums of products of k eigenvalues are largest for equal ones."""
    size, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    return max(comb(size, k) * trace ** k // size ** k + 1 for k in range(size + 1))


def enough_primes(bound: int) -> list[int]:
    """Primes below 2**31, falling, whose product is larger than twice the bound."""
    primes, product, n = [], 1, LARGEST
    while product <= 2 * bound:
        if _is_prime(n):
            primes.append(n)
            product *= n
        n -= 2
    return primes


def polynomial_modulo(matrix: list[list[int]], prime: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime, constant first, by reduction to Hessenberg form."""
    size = len(matrix)
    h = np.array([[v % prime for v in row] for row in matrix], np.int64).reshape(size, size)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        times = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, prime) % prime
        h[k + 2:] = (h[k + 2:] - times[:, None] * h[k + 1] % prime) % prime
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * times % prime).sum(1)) % prime
    # polynomials of the leading minors, each from all before it
    minors = np.zeros((size + 1, size + 1), np.int64)
    minors[0, 0] = 1
    for k in range(size):
        weights, below = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * below % prime
            below = below * int(h[i, i - 1]) % prime if i else 0
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % prime).sum(0)) % prime
    return minors[size].tolist()


def combine(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Whole numbers of either sign from their residues."""
    values, product = [0] * len(residues[0]), 1
    for own, prime in zip(residues, primes):
        inverse = pow(product, -1, prime)
        values = [v + product * ((r - v) * inverse % prime) for v, r in zip(values, own)]
        product *= prime
    return [v - product if 2 * v > product else v for v in values]


def _shifted(poly: list[int], numerator: int, bits: int) -> list[int]:
    """Coefficients, up to a positive factor, of poly(x + numerator / 2**bits)."""
    if bits < 0:
        numerator, bits = numerator << -bits, 0
    size = len(poly) - 1
    out = [c << bits * (size - k) for k, c in enumerate(poly)]
    for i in range(size):
        for k in range(size - 1, i - 1, -1):
            out[k] += numerator * out[k + 1]
    return out


def roots_above(poly: list[int], numerator: int, bits: int) -> int:
    """Roots, counted as often as they occur, above numerator / 2**bits.

    The rule of signs is exact for a polynomial whose roots are all real.
    """
    signs = [c > 0 for c in _shifted(poly, numerator, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def positive_roots(poly: list[int]) -> int:
    return roots_above(poly, 0, 0)


def isolate(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """The largest positive roots as (numerator, bits, times): the root is in (numerator, numerator + 1] / 2**bits.

    Falling; intervals hold one root, or several that are within 2**-TOGETHER of the largest bound of all.
    """
    top = max(1, -poly[-2]).bit_length()  # all roots are at most their sum
    found, stack = [], [(0, -top, positive_roots(poly), 0)]  # interval (a, a + 1] * 2**top; roots above a, and above a + 1
    while stack:
        low, bits, above_low, above_high = stack.pop()
        times = above_low - above_high
        if times == 0 or above_high >= wanted:
            continue
        # single, and away from 0 so that its size is known as well
        if (times == 1 and low > 0) or (bits + top >= TOGETHER and low > 0):
            found.append((low, bits, times))
            continue
        middle = 2 * low + 1
        above_middle = roots_above(poly, middle, bits + 1)
        stack.append((low * 2, bits + 1, above_low, above_middle))
        stack.append((middle, bits + 1, above_middle, above_high))
    return sorted(found, key=lambda x: -Fraction(x[0]) / Fraction(2) ** x[1])


def _value(poly: list[int], numerator: int, bits: int) -> int:
    """Sign-true value at numerator / 2**bits."""
    if bits < 0:
        numerator, bits = numerator << -bits, 0
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * numerator + (c << scale)
        scale += bits
    return value


def refine(poly: list[int], low: int, bits: int, times: int, top: int) -> tuple[int, int]:
    """(numerator, bits) just below the root: within 2**-RESOLUTION of the largest root and of itself."""
    high_sign = None
    while bits + top < RESOLUTION or low.bit_length() < RESOLUTION // 2:
        middle = 2 * low + 1
        if times == 1:
            if high_sign is None:
                end = _value(poly, low + 1, bits)
                if end == 0:  # the root is the end itself; go on just below it
                    while bits + top < RESOLUTION or low.bit_length() < RESOLUTION // 2:
                        low, bits = 2 * low + 1, bits + 1
                    return low, bits
                high_sign = end > 0
            value = _value(poly, middle, bits + 1)
            upper = value != 0 and (value > 0) != high_sign
        else:
            upper = roots_above(poly, middle, bits + 1) > roots_above(poly, 2 * low + 2, bits + 1)
        if times == 1 and value == 0:
            low, bits, high_sign = 2 * low, bits + 1, None
        else:
            low, bits = (middle if upper else 2 * low), bits + 1
    return low, bits


def _factors(matrix: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Rows of L and U in fixed point, with the order of rows."""
    size, rows = len(matrix), [list(r) for r in matrix]
    order = list(range(size))
    for k in range(size):
        best = max(range(k, size), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        order[k], order[best] = order[best], order[k]
        if rows[k][k] == 0:
            rows[k][k] = 1  # the shift is an eigenvalue to the last bit
        pivot, upper = rows[k][k], rows[k][k + 1:]
        for i in range(k + 1, size):
            own = rows[i]
            if own[k]:
                own[k] = times = (own[k] << PRECISION) // pivot
                own[k + 1:] = [a - (times * b >> PRECISION) for a, b in zip(own[k + 1:], upper)]
    return rows, order


def _solve(rows: list[list[int]], order: list[int], right: list[int]) -> list[int]:
    size = len(rows)
    x = [right[i] for i in order]
    for i in range(size):
        x[i] -= sum(a * b for a, b in zip(rows[i][:i], x)) >> PRECISION
    for i in range(size - 1, -1, -1):
        x[i] -= sum(a * b for a, b in zip(rows[i][i + 1:], x[i + 1:])) >> PRECISION
        x[i] = (x[i] << PRECISION) // rows[i][i]
    return x


def _unit(x: list[int]) -> list[int]:
    length = isqrt(sum(v * v for v in x))
    return [(v << PRECISION) // length for v in x]


def eigenvectors(matrix: list[list[int]], numerator: int, bits: int, times: int) -> list[list[float]]:
    """Unit vectors that span the eigenspace of a root, by inverse iteration in long fixed point.

    The root is known far better than its distance to the others, so three steps leave nothing
    of other spaces; several vectors of one space are made orthogonal in each step. The entry of
    largest size is positive, of equal ones the first.
    """
    size = len(matrix)
    scale = sum(row[i] for i, row in enumerate(matrix)).bit_length()
    up = PRECISION - scale
    fixed = [[v << up if up >= 0 else v >> -up for v in row] for row in matrix]
    move = up - bits
    shift = numerator << move if move >= 0 else numerator >> -move
    for i in range(size):
        fixed[i][i] -= shift
    rows, order = _factors(fixed)
    found = []
    state = 1
    for _ in range(times):
        start = []
        for _ in range(size):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            start.append((state >> 1) - (1 << 62) << PRECISION - 64)
        found.append(_unit(start))
    for _ in range(3):
        found = [_unit(_solve(rows, order, x)) for x in found]
        for i, x in enumerate(found):
            for _ in range(2):
                for other in found[:i]:
                    both = sum(a * b for a, b in zip(x, other)) >> PRECISION
                    x = _unit([a - (both * b >> PRECISION) for a, b in zip(x, other)])
            found[i] = x
    out = []
    for x in found:
        largest = max(range(size), key=lambda i: (abs(x[i]) >> PRECISION - 40, -i))
        sign = -1 if x[largest] < 0 else 1
        out.append([sign * v / (1 << PRECISION) for v in x])
    return out
