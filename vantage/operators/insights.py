"""Findings worth reading, from the results of the analyses, ranked."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from ..plans.analyses import GROUPED_ROWS
from ..plans.provenance import Provenance
from .charts import Chart
from .profile import DatasetProfile
from .quality import Quality
from .stats import CategorySummary, Comparison, Correlation, NumericSummary
from .timeline import Timeline

#: When a finding is worth telling, how strong it is, and how findings are weighed.
CORRELATION, GROUP_EFFECT, GROUP_P, GROUP_FULL = 0.5, 0.06, 0.05, 0.14
TREND, TREND_FULL, SEASON, SUDDEN = 0.10, 1.0, 0.30, 0.50
OUTLIERS, OUTLIERS_FULL, SKEW, SKEW_FULL = 0.05, 0.20, 1.0, 3.0
DOMINANT, RARE, MISSING, MISSING_FULL = 0.70, 3, 0.10, 0.5
DOUBT, HALF_RELIABLE = 0.6, 50
WEIGHTS = {
    "group_difference": 1.0, "trend": 1.0, "correlation": 0.95, "sudden_change": 0.9, "seasonality": 0.85, "missing_data": 0.8, "outliers": 0.7, "dominant_category": 0.6,
    "skewed_distribution": 0.5, "rare_categories": 0.4,
}
SAME_STORY = (frozenset({"trend", "sudden_change"}), frozenset({"outliers", "skewed_distribution"}), frozenset({"dominant_category", "rare_categories"}))
PER_TYPE, TOTAL = 3, 15
NOT_CAUSE = "Moving together does not mean that one causes the other."
SPLIT = "Some groups are spelled in several ways, so they may be split."


@dataclass(frozen=True)
class Insight:
    id: str
    kind: str
    title: str
    text: str
    columns: tuple[str, ...]
    strength: float
    sample: int
    confidence: float = 1.0
    caveats: tuple[str, ...] = ()
    chart: int | None = None

    @property
    def reliability(self) -> float:
        return self.sample / (self.sample + HALF_RELIABLE)

    @property
    def importance(self) -> float:
        return self.strength * self.confidence * self.reliability * WEIGHTS[self.kind]


def number(x: float) -> str:
    """Whole numbers with separators, large ones with one decimal, others with two."""
    return f"{int(x):,}" if float(x).is_integer() else f"{x:,.1f}" if abs(x) >= 100 else f"{x:,.2f}"


def percent(x: float) -> str:
    return f"{x:.1%}"


def multiple(x: float) -> str:
    return f"{x:.1f}x"


def _correlation(c: Correlation, grouped: bool) -> Insight | None:
    if c.strength < CORRELATION:
        return None
    lead = c.pearson if abs(c.pearson) >= abs(c.spearman) else c.spearman
    way = "rise together" if lead > 0 else "move in opposite directions"
    return Insight(
        f"correlation:{c.left}:{c.right}", "correlation", f"{c.left} and {c.right} {way}", f"Over {number(c.n)} rows r is {c.pearson:.2f} (by ranks {c.spearman:.2f}).", (c.left, c.right),
        c.strength, c.n, DOUBT if grouped else 1.0, (NOT_CAUSE, *((GROUPED_ROWS,) if grouped else ())),
    )


def _difference(c: Comparison, split: set[str], grouped: bool) -> Insight | None:
    if c.effect is None or c.effect < GROUP_EFFECT or (c.p_value is not None and c.p_value > GROUP_P):
        return None
    times = f", {multiple(c.mean_ratio)} as much" if c.mean_ratio is not None else ""
    doubt = c.group_by in split
    caveats = ((SPLIT,) if doubt else ()) + ((GROUPED_ROWS,) if grouped else ())
    return Insight(
        f"group_difference:{c.group_by}:{c.measure}", "group_difference", f"{c.measure} differs by {c.group_by}",
        f"{c.highest.group} averages {number(c.highest.mean)}, {c.lowest.group} {number(c.lowest.mean)}{times}.", (c.group_by, c.measure), min(c.effect / GROUP_FULL, 1.0),
        sum(g.n for g in c.groups), DOUBT if doubt or grouped else 1.0, caveats,
    )


def _over_time(t: Timeline) -> list[Insight]:
    out, both = [], (t.time, t.measure)
    seen = [v for _, v in t.points if v is not None]
    if t.change_ratio is not None and abs(t.change_ratio) >= TREND:
        way = "rose" if t.change_ratio > 0 else "fell"
        out.append(Insight(f"trend:{t.measure}", "trend", f"{t.measure} {way} by {percent(abs(t.change_ratio))}", f"From the first to the last quarter of {len(seen)} periods.", both, min(abs(t.change_ratio) / TREND_FULL, 1.0), t.n))
    if t.season and t.season.strength >= SEASON:
        out.append(Insight(f"seasonality:{t.measure}", "seasonality", f"{t.measure} follows the {t.season.cycle}", f"It is highest on {t.season.strongest} and lowest on {t.season.weakest}.", both, t.season.strength, t.n))
    if t.largest and t.largest.ratio is not None and abs(t.largest.ratio) >= SUDDEN:
        way = "jumped" if t.largest.difference > 0 else "dropped"
        out.append(Insight(f"sudden_change:{t.measure}", "sudden_change", f"{t.measure} {way} by {percent(abs(t.largest.ratio))}", f"By {number(abs(t.largest.difference))} at {t.largest.after:%Y-%m-%d}.", both, min(abs(t.largest.ratio), 1.0), t.n))
    return out


def _numeric(s: NumericSummary) -> list[Insight]:
    out = []
    if s.count and s.outliers / s.count >= OUTLIERS:
        ratio = s.outliers / s.count
        out.append(Insight(f"outliers:{s.name}", "outliers", f"{s.name} has unusual values", f"{number(s.outliers)} of {number(s.count)} ({percent(ratio)}) are far outside the usual range.", (s.name,), min(ratio / OUTLIERS_FULL, 1.0), s.count))
    if s.skewness is not None and abs(s.skewness) >= SKEW:
        side = "high" if s.skewness > 0 else "low"
        out.append(Insight(f"skewed_distribution:{s.name}", "skewed_distribution", f"{s.name} has a long tail of {side} values", f"The mean is {number(s.mean)}, the median {number(s.median)}.", (s.name,), min(abs(s.skewness) / SKEW_FULL, 1.0), s.count))
    return out


def _category(s: CategorySummary) -> list[Insight]:
    out = []
    if s.unique >= 2 and s.top[0][2] >= DOMINANT:
        value, n, share = s.top[0]
        out.append(Insight(f"dominant_category:{s.name}", "dominant_category", f"{s.name} is mostly {value}", f"{percent(share)} of {number(s.count)} rows.", (s.name,), share, s.count))
    if s.rare >= RARE:
        out.append(Insight(f"rare_categories:{s.name}", "rare_categories", f"{s.name} has {number(s.rare)} rare values", f"Each is in less than one row of a hundred; there are {number(s.unique)} values.", (s.name,), s.rare / s.unique, s.count))
    return out


def findings(
    told: DatasetProfile, numeric: list[NumericSummary], categories: list[CategorySummary], pairs: list[Correlation], comparisons: list[Comparison], lines: list[Timeline], quality: Quality,
    provenance: Provenance = Provenance(),
) -> list[Insight]:
    """All findings, unranked."""
    split = {i.column for i in quality.issues if i.kind == "suspicious_categories"}
    found = [_correlation(c, provenance.rows_are_groups) for c in pairs] + [_difference(c, split, provenance.rows_are_groups) for c in comparisons]
    for t in lines:
        found += _over_time(t)
    for s in numeric:
        found += _numeric(s)
    for c in categories:
        found += _category(c)
    for c in told.columns:
        if c.missing_ratio >= MISSING:
            found.append(Insight(f"missing_data:{c.name}", "missing_data", f"{c.name} is often missing", f"{percent(c.missing_ratio)} of {number(told.n_rows)} rows have no value.", (c.name,), min(c.missing_ratio / MISSING_FULL, 1.0), told.n_rows))
    return [i for i in found if i is not None]


#: The chart that shows the columns of a finding.
SHOWN = {
    "correlation": "scatter", "group_difference": "box", "trend": "line", "seasonality": "line", "sudden_change": "line", "outliers": "histogram",
    "skewed_distribution": "histogram", "dominant_category": "bar", "rare_categories": "bar",
}


def generate(
    told: DatasetProfile, numeric: list[NumericSummary], categories: list[CategorySummary], pairs: list[Correlation], comparisons: list[Comparison], lines: list[Timeline], quality: Quality,
    charts: list[Chart], provenance: Provenance = Provenance(),
) -> list[Insight]:
    """The ranked choice of all findings, each linked to the chart that shows the same columns."""
    places = {(c.kind, c.columns): k for k, c in enumerate(charts)}
    found = findings(told, numeric, categories, pairs, comparisons, lines, quality, provenance)
    return [replace(i, chart=places.get((SHOWN.get(i.kind), i.columns))) for i in rank(found)]


def rank(found: list[Insight]) -> list[Insight]:
    """The most important first: at most PER_TYPE of a kind and TOTAL in all. The second of two kinds that tell the same
    story of the same columns is left out, and so is a correlation that brings no new column."""
    out: list[Insight] = []
    kinds: Counter[str] = Counter()
    told: set[tuple[frozenset[str], frozenset[str]]] = set()
    related: set[str] = set()
    for i in sorted(found, key=lambda i: (-i.importance, i.id)):
        columns = frozenset(i.columns)
        story = next(((pair, columns) for pair in SAME_STORY if i.kind in pair), None)
        if kinds[i.kind] == PER_TYPE or story in told or (i.kind == "correlation" and columns <= related):
            continue
        if i.kind == "correlation":
            related |= columns
        if story:
            told.add(story)
        kinds[i.kind] += 1
        out.append(i)
    return out[:TOTAL]
