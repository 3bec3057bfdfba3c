"""Texts of half-open intervals, with as many digits as their edges need to differ."""

from __future__ import annotations

import math


def _rounded(x: float, digits: int) -> float:
    """Rounded to that many decimals; below one, to that many digits that count."""
    if not math.isfinite(x) or x == 0:
        return x
    fraction, whole = math.modf(x)
    return round(x, digits if whole else digits - 1 - math.floor(math.log10(abs(fraction))))


def interval_labels(edges: list[float], lowest: bool = False, digits: int = 3) -> list[str]:
    """(a, b] for each pair of neighbours; with lowest, the first is shown a little lower as it holds its own edge."""
    shown, n = [_rounded(float(e), digits) for e in edges], digits
    while len(set(shown)) < len(edges) and n < 19:
        n += 1
        shown = [_rounded(float(e), n) for e in edges]
    left = [shown[0] - 10**-n, *shown[1:]] if lowest else shown
    left[0] = _rounded(left[0], n) if lowest else left[0]
    return [f"({a}, {b}]" for a, b in zip(left, shown[1:], strict=False)]
