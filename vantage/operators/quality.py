"""What is wrong with a table's data, and a score out of 100 with its reasons."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from dataclasses import dataclass

from ..plans.provenance import Provenance
from ..scratch import Written
from ..table import BOOLEAN, CATEGORICAL, EMPTY, NUMERIC, TEXT, Table
from .counts import Counts, count_values
from .profile import DatasetProfile
from .stats import NumericSummary, describe

#: Thresholds, tolerances and weights.
MISSING_SHOWN, MISSING_WARNING, MISSING_SERIOUS = 0.01, 0.1, 0.5
DUPLICATES_WARNING = 0.05
OUTLIERS_SHOWN, OUTLIERS_WARNING = 0.01, 0.05
MISTYPED_SHARE, MOST_SPELLINGS, SPELLINGS_SHOWN = 0.8, 500, 3
DIMENSIONS = {"completeness": (0.5, 0.30), "consistency": (0.5, 0.20), "type_consistency": (0.5, 0.20), "duplicates": (0.3, 0.15), "outliers": (0.2, 0.15)}
SEVERITIES = ("serious", "warning", "info")
SHAPED = "Gaps were filled or dropped by an earlier step, so completeness describes the result, not the file."
GROUPED = "The rows are groups made by an earlier step, so the score describes the groups."
REMOVED = "Rows were removed by an earlier step, so the score describes what is left."


@dataclass(frozen=True)
class Issue:
    kind: str
    severity: str
    column: str | None
    count: int
    ratio: float
    message: str
    examples: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    score: int | None  # none: does not apply
    weight: float
    observed: float
    tolerance: float
    issues: tuple[str, ...] = ()


@dataclass(frozen=True)
class Quality:
    score: int | None
    dimensions: tuple[Dimension, ...]
    issues: tuple[Issue, ...]
    caveats: tuple[str, ...]


def normal_form(text: str) -> str:
    """Without accents, extra spaces and case: what a reader takes for the same word."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.split()).casefold()


@dataclass
class _Facts:
    outliers: dict[str, tuple[int, int]]  # flagged, values
    textual: dict[str, tuple[int, int, int]]  # values, numbers, badly spaced
    spellings: dict[str, list[tuple[str, ...]]]


def _facts(told: DatasetProfile, counts: Counts, numeric: list[NumericSummary] | None) -> _Facts:
    """Everything the issues need beyond the profile, from counted values."""
    if numeric is None:
        numeric = describe(counts.table, [c.name for c in told.columns if c.kind == NUMERIC and not c.is_id], counts)
    textual = [c for c in told.columns if c.kind in (CATEGORICAL, TEXT, BOOLEAN)]
    texts = {c.name: (r["n"], r["numbers"], r["spaced"]) if (r := counts.sums.get(c.name)) else (0, 0, 0) for c in textual}
    few = [c.name for c in textual if 2 <= c.n_unique <= MOST_SPELLINGS]
    groups: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    if few:
        for r in sorted(counts.of(few).select("unit", "value").collect()):  # at most MOST_SPELLINGS values for each column
            if r["value"] is not None:
                groups[counts.names[r["unit"]]][normal_form(r["value"])].append(r["value"])
    spellings = {n: [tuple(v) for v in forms.values() if len(v) > 1] for n, forms in groups.items()}
    return _Facts({s.name: (s.outliers, s.count) for s in numeric}, texts, {n: v for n, v in spellings.items() if v})


def issues(told: DatasetProfile, facts: _Facts) -> list[Issue]:
    """In order of what was looked at, then by severity."""
    out: list[Issue] = []
    for c in told.columns:
        if c.kind == EMPTY:
            out.append(Issue("empty_column", "serious", c.name, c.n_missing, 1.0, f'"{c.name}" has no values.'))
        elif c.missing_ratio >= MISSING_SHOWN:
            severity = "serious" if c.missing_ratio >= MISSING_SERIOUS else "warning" if c.missing_ratio >= MISSING_WARNING else "info"
            out.append(Issue("missing_values", severity, c.name, c.n_missing, c.missing_ratio, f'"{c.name}" has no value in {c.n_missing:,} rows ({c.missing_ratio:.1%}).'))
    if told.duplicate_rows:
        ratio = told.duplicate_rows / told.n_rows
        out.append(Issue("duplicate_rows", "warning" if ratio >= DUPLICATES_WARNING else "info", None, told.duplicate_rows, ratio, f"{told.duplicate_rows:,} rows repeat an earlier one ({ratio:.1%})."))
    for name, (flagged, n) in facts.outliers.items():
        ratio = flagged / n if n else 0.0
        if ratio >= OUTLIERS_SHOWN:
            out.append(Issue("outliers", "warning" if ratio >= OUTLIERS_WARNING else "info", name, flagged, ratio, f'{flagged:,} values of "{name}" are far outside the usual range ({ratio:.1%}).'))
    for name, groups in facts.spellings.items():
        out.append(Issue("suspicious_categories", "warning", name, len(groups), 0.0, f'{len(groups)} values of "{name}" are spelled in several ways.', tuple(groups[:SPELLINGS_SHOWN])))
    for name, (n, _, spaces) in facts.textual.items():
        if spaces:
            out.append(Issue("inconsistent_formatting", "warning", name, spaces, spaces / n, f'{spaces:,} values of "{name}" have needless spaces.'))
    for c in told.columns:
        n, numbers, _ = facts.textual.get(c.name, (0, 0, 0))
        if c.kind in (CATEGORICAL, TEXT) and n and numbers / n >= MISTYPED_SHARE:
            out.append(Issue("mistyped_column", "warning", c.name, numbers, numbers / n, f'{numbers:,} of {n:,} values of "{c.name}" are numbers, but others are not.'))
    for c in told.columns:
        if c.is_constant and c.kind != EMPTY:
            out.append(Issue("constant_column", "info", c.name, c.n_unique, 1.0, f'"{c.name}" never changes.'))
        if c.is_id:
            out.append(Issue("identifier_column", "info", c.name, c.n_unique, 1.0, f'"{c.name}" tells rows apart and is left out of the analysis.'))
        elif c.is_wide:
            out.append(Issue("high_cardinality", "info", c.name, c.n_unique, c.n_unique / told.n_rows, f'"{c.name}" has {c.n_unique:,} distinct values.'))
    return sorted(out, key=lambda i: SEVERITIES.index(i.severity))


def dimension_score(observed: float, tolerance: float) -> int:
    return round(100 * (1 - min(observed / tolerance, 1)))


def score(told: DatasetProfile, facts: _Facts, found: list[Issue], provenance: Provenance = Provenance()) -> Quality:
    """Five dimensions, each from 0 at its tolerance to 100 at none; those that don't apply give their weight away."""
    textual = [c for c in told.columns if c.kind in (CATEGORICAL, TEXT, BOOLEAN)]
    affected = {i.column for i in found if i.kind in ("suspicious_categories", "inconsistent_formatting")}
    mistyped = sum(i.kind == "mistyped_column" for i in found)
    flagged, values = (sum(x) for x in zip(*facts.outliers.values(), strict=True)) if facts.outliers else (0, 0)
    observed = {
        "completeness": told.missing_ratio, "consistency": len(affected) / len(textual) if textual else None,
        "type_consistency": mistyped / told.n_columns if told.n_columns else None, "duplicates": told.duplicate_rows / told.n_rows if told.n_rows else None,
        "outliers": flagged / values if values else None,
    }
    behind = {
        "completeness": ("empty_column", "missing_values"), "consistency": ("suspicious_categories", "inconsistent_formatting"), "type_consistency": ("mistyped_column",),
        "duplicates": ("duplicate_rows",), "outliers": ("outliers",),
    }
    parts = []
    for name, (tolerance, weight) in DIMENSIONS.items():
        x = observed[name]
        names = tuple(f"{i.kind}:{i.column or ''}" for k in behind[name] for i in found if i.kind == k)
        parts.append(Dimension(name, None if x is None else dimension_score(x, tolerance), weight, x or 0.0, tolerance, names))
    total = sum(p.weight for p in parts if p.score is not None)
    overall = round(sum(p.score * p.weight / total for p in parts if p.score is not None)) if total else None
    caveats = ([SHAPED] if provenance.gaps_were_shaped else []) + ([GROUPED] if provenance.rows_are_groups else [REMOVED] if provenance.rows_were_removed else [])
    return Quality(overall, tuple(parts), tuple(found), tuple(caveats))


def assess(table: Table, told: DatasetProfile, provenance: Provenance = Provenance(), counts: Counts | None = None, numeric: list[NumericSummary] | None = None) -> Quality:
    """The quality of a table; its counted values and summaries of its numbers are read if they are given."""
    if counts is None:
        with Written(table.frame.sparkSession, "quality") as kept:
            return assess(table, told, provenance, count_values(table, kept), numeric)
    facts = _facts(told, counts, numeric)
    return score(told, facts, issues(told, facts), provenance)
