"""The upper tail of the chi-square distribution, in closed form for whole degrees of freedom."""

from __future__ import annotations

import math


def survival(x: float, freedom: int) -> float:
    """P(X > x) with so many degrees of freedom; each term follows from the one before, so many degrees stay stable."""
    if x <= 0:
        return 1.0
    half = x / 2
    if freedom % 2 == 0:
        log_term, total = -half, 0.0
        for i in range(freedom // 2):
            total += math.exp(log_term)
            log_term += math.log(half) - math.log(i + 1)
        return min(1.0, total)
    total, log_term = math.erfc(math.sqrt(half)), -half + 0.5 * math.log(half) - math.lgamma(1.5)
    for i in range(1, (freedom - 1) // 2 + 1):
        total += math.exp(log_term)
        log_term += math.log(half) - math.log(i + 0.5)
    return min(1.0, total)
