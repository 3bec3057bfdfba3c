"""The first look at a table: everything that its profile leads to."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.provenance import Provenance
from ..scratch import Written
from ..table import BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, Table
from . import charts, insights, quality, stats
from .counts import Counts, count_values
from .profile import DatasetProfile, profile, understood
from .timeline import Timeline, timelines


@dataclass(frozen=True)
class Analysis:
    numeric: tuple[stats.NumericSummary, ...]
    categories: tuple[stats.CategorySummary, ...]
    correlations: tuple[stats.Correlation, ...]
    comparisons: tuple[stats.Comparison, ...]
    timelines: tuple[Timeline, ...]


@dataclass(frozen=True)
class Dashboard:
    profile: DatasetProfile
    analysis: Analysis
    quality: quality.Quality
    charts: tuple[charts.Chart, ...]
    insights: tuple[insights.Insight, ...]


def analyse(table: Table, told: DatasetProfile, counts: Counts | None = None) -> Analysis:
    """Statistics of every column that is no identifier, by what it means."""
    if counts is None:
        with Written(table.frame.sparkSession, "analysis") as kept:
            return analyse(table, told, count_values(table, kept))
    of = lambda *kinds: [c.name for c in told.columns if c.kind in kinds and not c.is_id]
    numeric = of(NUMERIC)
    categories = stats.frequencies(table, of(CATEGORICAL, BOOLEAN), counts)
    low, high = stats.GROUP_VALUES
    groups = [c.name for c in categories if low <= c.unique <= high]
    return Analysis(
        tuple(stats.describe(table, numeric, counts)), tuple(categories), tuple(stats.correlate(table, numeric, counts=counts)), tuple(stats.compare_all(table, groups, numeric)),
        tuple(timelines(table, of(DATETIME), numeric)),
    )


def in_columns(table: Table, kept: Written) -> Table:
    """The table itself where a read of some columns costs no more than these; else written once in columns."""
    files = table.frame.inputFiles()
    if files and all(f.endswith(".parquet") for f in files):
        return table
    return table.with_frame(kept.put("table", table.frame))


def look(table: Table, provenance: Provenance = Provenance()) -> Dashboard:
    """Profile, analysis, quality, charts and ranked findings. Each column's values are counted once; what looks at
    columns by themselves reads these counts, and only what relates columns reads the table again."""
    with Written(table.frame.sparkSession, "look") as kept:
        table = in_columns(table, kept)
        counts = count_values(table, kept)
        told = profile(table, counts)
        known = table if table.meanings else understood(table, told)
        known = known.with_frame(known.frame, meanings=told.meanings)
        found = analyse(known, told, counts)
        health = quality.assess(known, told, provenance, counts, list(found.numeric))
        drawn = charts.select(known, list(found.numeric), list(found.categories), list(found.correlations), list(found.comparisons), list(found.timelines))
        read = insights.generate(told, list(found.numeric), list(found.categories), list(found.correlations), list(found.comparisons), list(found.timelines), health, drawn, provenance)
    return Dashboard(told, found, health, tuple(drawn), tuple(read))
