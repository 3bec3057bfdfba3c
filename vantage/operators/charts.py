"""Data of charts, and which charts a dashboard shows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, num
from ..table import Table
from .stats import CategorySummary, Comparison, Correlation, NumericSummary
from .timeline import Timeline

#: How many of each chart, and what they hold at most.
SCATTER_POINTS, SCATTER_LEAST, SCATTERS = 2000, 0.3, 3
LINES, BOXES, HEAT_COLUMNS, HISTOGRAMS, BARS, BAR_VALUES = 2, 2, 3, 6, 6, (2, 30)


@dataclass(frozen=True)
class Chart:
    kind: str
    columns: tuple[str, ...]
    data: dict[str, Any]
    sampled_from: int | None = None


def histogram(s: NumericSummary) -> Chart | None:
    return Chart("histogram", (s.name,), {"edges": list(s.histogram.edges), "counts": list(s.histogram.counts)}) if s.histogram else None


def bar(s: CategorySummary) -> Chart:
    shown = sum(n for _, n, _ in s.top)
    return Chart("bar", (s.name,), {"values": [v for v, _, _ in s.top], "counts": [n for _, n, _ in s.top], "other_count": s.count - shown})


def points(table: Table, left: str, right: str) -> DataFrame:
    """(x, y) of all finite pairs of two columns, beside the rows' hidden places."""
    x, y = (num(col(n), table.kind(n)) for n in (left, right))
    return table.frame.select(x.alias("x"), y.alias("y"), *table.hidden()).filter("x is not null and y is not null")


def scatter(table: Table, c: Correlation, seed: int = 0) -> Chart:
    """Finite pairs in row order; beyond the limit, as many drawn by a seeded hash of the row's place."""
    rows = points(table, c.left, c.right)
    if c.n > SCATTER_POINTS:
        place = F.concat_ws("/", F.element_at(F.split(F.col("__row.file"), "/"), -1), F.col("__row.at"))
        rows = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), place).cast("binary")), *table.ordering()).limit(SCATTER_POINTS)
    found = rows.orderBy(*table.ordering()).select("x", "y").collect()
    return Chart("scatter", (c.left, c.right), {"x": [r["x"] for r in found], "y": [r["y"] for r in found]}, c.n if c.n > SCATTER_POINTS else None)


def line(t: Timeline) -> Chart:
    return Chart("line", (t.time, t.measure), {"x": [p.isoformat() for p, _ in t.points], "y": [v for _, v in t.points], "rule": t.rule})


def box(c: Comparison) -> Chart:
    groups = [{"name": g.group, "low": g.low, "q1": g.q1, "median": g.median, "q3": g.q3, "high": g.high, "n": g.n} for g in c.groups]
    return Chart("box", (c.group_by, c.measure), {"groups": groups})


def heatmap(names: list[str], found: list[Correlation]) -> Chart | None:
    if len(names) < HEAT_COLUMNS:
        return None
    told = {(c.left, c.right): c.pearson for c in found}
    value = lambda a, b: 1.0 if a == b else told.get((a, b), told.get((b, a)))
    return Chart("heatmap", tuple(names), {"matrix": [[value(a, b) for b in names] for a in names]})


def select(table: Table, numeric: list[NumericSummary], categories: list[CategorySummary], pairs: list[Correlation], comparisons: list[Comparison], lines: list[Timeline]) -> list[Chart]:
    """Charts of relations first, then of single columns."""
    strong = [c for c in pairs if c.strength >= SCATTER_LEAST][:SCATTERS]
    charts = [scatter(table, c) for c in strong]
    charts += [line(t) for t in lines[:LINES]]
    charts += [box(c) for c in comparisons[:BOXES]]
    charts.append(heatmap([s.name for s in numeric], pairs))
    charts += [histogram(s) for s in numeric[:HISTOGRAMS]]
    charts += [bar(s) for s in categories[:BARS] if BAR_VALUES[0] <= s.unique <= BAR_VALUES[1]]
    return [c for c in charts if c is not None]
