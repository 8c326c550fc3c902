"""Tail probabilities for test statistics, for a handful of result rows."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_two_sided(t: float | None, dof: float | None) -> float | None:
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    return beta_cdf(dof / 2.0, 0.5, dof / (dof + t * t))


def f_tail(f: float | None, dof1: float, dof2: float) -> float | None:
    if f is None or dof2 <= 0 or math.isnan(f):
        return None
    if math.isinf(f):
        return 0.0
    return beta_cdf(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * f))


@lru_cache(maxsize=None)
def _partition_terms(parts: int) -> tuple[int, list[int]]:
    """1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^parts)) as N(q) / (1 - q^period)^(parts + 1)."""
    period = math.lcm(*range(1, parts + 1))
    terms = [1]
    for step in (1, *range(1, parts + 1)):
        longer = [0] * (len(terms) + period - step)
        for start in range(0, period, step):  # times (1 - q^period) / (1 - q^step)
            for i, value in enumerate(terms):
                longer[start + i] += value
        terms = longer
    return period, terms


def _partitions_up_to(most: int, parts: int) -> int:
    """Partitions of all numbers up to `most` into at most `parts` parts."""
    if most < 0:
        return 0
    period, terms = _partition_terms(parts)
    return sum(terms[j] * math.comb((most - j) // period + parts, parts) for j in range(most % period, min(len(terms), most + 1), period))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p without ties, for any size of the larger sample.

    The ways to a rank sum of at most t are the partitions of up to t into
    n1 parts of at most n2, whose generating function is a product of n1 factors
    (1 - q^(n2 + i)) over the one of partitions into n1 parts of any size.
    """
    small, large = sorted((n1, n2))
    top = int(min(u, n1 * n2 - u))
    factors = {0: 1}
    for i in range(1, small + 1):
        for power, sign in list(factors.items()):
            factors[power + large + i] = factors.get(power + large + i, 0) - sign
    ways = sum(sign * _partitions_up_to(top - power, small) for power, sign in factors.items() if power <= top)
    return min(1.0, 2 * ways / math.comb(n1 + n2, small))


def mann_whitney_normal(u: float, n1: int, n2: int, ties: float) -> float | None:
    """Normal approximation with tie and continuity correction, two-sided."""
    n = n1 + n2
    spread = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
    if spread <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(spread)
    return min(1.0, 2.0 * normal_tail(z))


def mann_whitney_p(u: float | None, n1: int, n2: int, ties: float) -> float | None:
    """Exact when one sample has at most 8 values and nothing is tied."""
    if u is None or n1 == 0 or n2 == 0:
        return None
    small = min(n1, n2)
    if ties == 0 and small <= 8:
        return mann_whitney_exact(u, n1, n2)
    return mann_whitney_normal(u, n1, n2, ties)


# --- normal scores ---------------------------------------------------------
# Blom scores m_i = z((i - 3/8) / (n + 1/4)). Sums over long index ranges use
# the closed integrals of z and z*z with the first midpoint correction, so a
# value repeated a billion times costs no more than one seen once.

_ENUMERATED = 2_000


def _share(i: float, n: int) -> float:
    return (i - 0.375) / (n + 0.25)


def _integral(lo: float, hi: float, n: int, power: int) -> float:
    zs = [_NORMAL.inv_cdf(_share(i, n)) for i in (lo - 0.5, hi + 0.5)]
    pdf = [_NORMAL.pdf(z) for z in zs]
    width = n + 0.25
    if power == 1:
        area = (pdf[0] - pdf[1]) * width
        slope = [1.0 / (p * width) for p in pdf]
    else:
        prim = [_share(i, n) - z * p for i, z, p in zip((lo - 0.5, hi + 0.5), zs, pdf)]
        area = (prim[1] - prim[0]) * width
        slope = [2.0 * z / (p * width) for z, p in zip(zs, pdf)]
    return area - (slope[1] - slope[0]) / 24.0


def score_sum(first: int, last: int, n: int, power: int = 1) -> float:
    """Sum of m_i ** power for first <= i <= last (1-based)."""
    if last - first + 1 <= 2 * _ENUMERATED:
        return math.fsum(
            _NORMAL.inv_cdf(_share(i, n)) ** power for i in range(first, last + 1)
        )
    head, tail = first + _ENUMERATED, last - _ENUMERATED
    return (
        score_sum(first, head - 1, n, power)
        + _integral(head, tail, n, power)
        + score_sum(tail + 1, last, n, power)
    )


# Royston (1995), coefficients in ascending powers.
_ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_ROYSTON_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_ROYSTON_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_ROYSTON_SMALL_SHIFT = (-2.273, 0.459)
_ROYSTON_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_ROYSTON_LARGE_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_weights(n: int) -> tuple[float, float, float]:
    """(weight of the largest, of the second largest, scale of all other m_i)."""
    total = score_sum(1, n, n, power=2)
    last, second = (_NORMAL.inv_cdf(_share(i, n)) for i in (n, n - 1))
    u, norm = 1.0 / math.sqrt(n), math.sqrt(total)
    if n == 3:
        return math.sqrt(0.5), 0.0, 0.0
    a_last = last / norm + _poly(_ROYSTON_LAST, u)
    if n <= 5:
        phi = (total - 2 * last**2) / (1 - 2 * a_last**2)
        return a_last, second / math.sqrt(phi), 1 / math.sqrt(phi)
    a_next = second / norm + _poly(_ROYSTON_NEXT, u)
    phi = (total - 2 * last**2 - 2 * second**2) / (1 - 2 * a_last**2 - 2 * a_next**2)
    return a_last, a_next, 1 / math.sqrt(phi)


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return 1.0
    y = math.log1p(-w)
    if n <= 11:
        shift = _poly(_ROYSTON_SMALL_SHIFT, n)
        if y >= shift:
            return 1e-99
        y = -math.log(shift - y)
        mean, sd = _poly(_ROYSTON_SMALL_MEAN, n), math.exp(_poly(_ROYSTON_SMALL_SD, n))
    else:
        u = math.log(n)
        mean, sd = _poly(_ROYSTON_LARGE_MEAN, u), math.exp(_poly(_ROYSTON_LARGE_SD, u))
    return normal_tail((y - mean) / sd)
