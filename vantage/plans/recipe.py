"""Recipes: parsed from JSON-like data, checked against projected columns, run as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from ..table import Table
from . import steps as S
from .analyses import ANALYSES, Analysis
from .reasons import REASONS, Refused


class Malformed(ValueError):
    """Not a recipe at all: an unknown step, field or value."""


@dataclass(frozen=True)
class Refusal:
    step_index: int
    op: str
    column: str | None
    reason: str


@dataclass(frozen=True)
class StepReport:
    op: str
    rows_in: int
    rows_out: int
    note: str | None = None


@dataclass
class Recipe:
    steps: list[S.Step] = field(default_factory=list)
    analyze: Analysis | None = None

    @property
    def groups_rows(self) -> bool:
        return any(isinstance(s, S.Aggregate) for s in self.steps)


@dataclass(frozen=True)
class Validation:
    columns: S.Meanings
    accepted: int
    refusal: Refusal | None


@dataclass
class Run:
    """What a recipe left: the table up to the first refusal, reports of the steps that ran, and the finding."""

    table: Table
    notes: list[str | None]
    refusal: Refusal | None
    analysis: Any = None
    _tables: list[Table] = field(default_factory=list, repr=False)
    _steps: list[S.Step] = field(default_factory=list, repr=False)

    def reports(self) -> list[StepReport]:
        """Row counts of each step, taken when asked for.

        Steps that judge each row by itself share a pass: their conditions stand beside the rows, and a row counts for
        each step up to the first it fails at. Only what needs to know other rows ends a pass, and a new one starts just
        where its count is not known from the one before and later steps remove rows."""
        steps, counts = self._steps, [None] * (len(self._steps) + 1)
        at = 0
        while at <= len(steps):
            end = at
            while end < len(steps) and steps[end].by_row:
                end += 1
            if counts[at] is None or any(s.removes_rows for s in steps[at:end]):
                counts[at : end + 1] = _counted(self._tables[at], steps[at:end])
            else:
                counts[at : end + 1] = [counts[at]] * (end + 1 - at)
            if end < len(steps):
                counts[end + 1] = steps[end].rows_left(counts[end])
            at = end + 1
        return [StepReport(s.op, *counts[k : k + 2], note) for k, (s, note) in enumerate(zip(steps, self.notes, strict=True))]


def _counted(table: Table, steps: list[S.Step]) -> list[int]:
    """The rows of the table and those that are left after each step, all by_row, in one pass."""
    stays, left = [], []
    for k, step in enumerate(steps):
        if step.removes_rows:
            mark = f"__stays{k}"
            stays.append(F.col(mark))
            table = table.with_frame(table.frame.withColumn(mark, F.coalesce(step.stays(table), F.lit(False))), meanings=step.project(table.meanings))
        else:
            table, _ = step.apply(table)
        left.append(len(stays))
    told = table.frame.agg(F.count(F.lit(1)).alias("n0"), *(F.count_if(S.all_of(stays[:k])).alias(f"n{k}") for k in range(1, len(stays) + 1))).first()
    return [told["n0"], *(told[f"n{k}"] for k in left)]


_ALLOWED = {
    "combine": ("and", "or"), "order": ("asc", "desc"), "how": ("any", "all"), "operator": (*S.OPERATORS, "add", "subtract", "multiply", "divide"),
    "function": S.FUNCTIONS, "part": S.PARTS, "to": None,
}


def _fill(kind: type, told: Mapping[str, Any], skip: tuple[str, ...] = ("op", "kind")) -> Any:
    values = {k: v for k, v in told.items() if k not in skip}
    unknown = set(values) - {f for f in kind.__dataclass_fields__ if f != "kind"}
    if unknown:
        raise Malformed(f"Unknown fields: {', '.join(sorted(unknown))}")
    for name, value in values.items():
        if isinstance(allowed := _ALLOWED.get(name), tuple) and value not in allowed:
            raise Malformed(f"{name} can't be {value!r}")
    try:
        return kind(**values)
    except TypeError as missing:
        raise Malformed(str(missing)) from None


def _side(told: Mapping[str, Any]) -> str | float:
    if told.get("kind") == "column":
        return str(told["name"])
    if told.get("kind") == "constant":
        return float(told["value"])
    raise Malformed("An operand is a column or a constant.")


def _expression(told: Mapping[str, Any]) -> Any:
    kinds = {"arithmetic": S.Arithmetic, "bin": S.Bin, "datetime_part": S.DatetimePart, "map_values": S.MapValues}
    kind = kinds.get(told.get("kind"))
    if kind is None:
        raise Malformed(f"Unknown expression {told.get('kind')!r}")
    if kind is S.Arithmetic:
        told = {**told, "left": _side(told["left"]), "right": _side(told["right"])}
    if kind is S.MapValues and len(told.get("mapping", {})) > S.MAX_MAPPING:
        raise Malformed(f"A mapping has at most {S.MAX_MAPPING} values.")
    return _fill(kind, {"mapping": {}, **told} if kind is S.MapValues else told)


def parse_step(told: Mapping[str, Any]) -> S.Step:
    kind = S.STEPS.get(told.get("op"))
    if kind is None:
        raise Malformed(f"Unknown step {told.get('op')!r}")
    values = dict(told)
    if kind is S.FilterRows:
        values["clauses"] = [_fill(S.Clause, c) for c in told.get("clauses", [])]
    elif kind is S.Aggregate:
        values["aggregations"] = [_fill(S.Aggregation, a) for a in told.get("aggregations", [])]
    elif kind is S.DeriveColumn:
        values["expression"] = _expression(told["expression"])
    step = _fill(kind, values, ("op",))
    for name in ("clauses", "aggregations"):
        if getattr(step, name, [1]) == []:
            raise Malformed(f"{name} is empty")
    if kind in (S.SelectColumns, S.SortRows, S.DropColumns) and not step.columns:
        raise Malformed("columns is empty")
    if kind is S.LimitRows and not (1 <= step.count <= S.MAX_ROWS and step.method in ("head", "sample")):
        raise Malformed(f"count is from 1 to {S.MAX_ROWS}, method head or sample")
    if kind is S.FillMissing and step.method not in ("median", "mean", "mode", "constant", "forward"):
        raise Malformed(f"method can't be {step.method!r}")
    if kind is S.CastColumn and step.to not in ("numeric", "datetime", "categorical", "text"):
        raise Malformed(f"to can't be {step.to!r}")
    return step


def parse(told: Mapping[str, Any]) -> Recipe:
    """A recipe from JSON-like data; anything outside the vocabulary is Malformed."""
    listed = told.get("steps", [])
    if len(listed) > S.MAX_STEPS:
        raise Malformed(f"A recipe has at most {S.MAX_STEPS} steps.")
    analyze = told.get("analyze")
    if analyze is not None:
        kind = ANALYSES.get(analyze.get("op"))
        if kind is None:
            raise Malformed(f"Unknown analysis {analyze.get('op')!r}")
        analyze = _fill(kind, analyze, ("op",))
    return Recipe([parse_step(s) for s in listed], analyze)


def _refusal(at: int, op: str, refused: Refused, columns: S.Meanings, began: S.Meanings) -> Refusal:
    gone = refused.column is not None and any(m.name == refused.column for m in began) and all(m.name != refused.column for m in columns)
    return Refusal(at, op, refused.column, refused.reason + (REASONS["removed"] if gone else ""))


def validate(columns: S.Meanings, recipe: Recipe) -> Validation:
    """Check every step against the columns that the ones before it leave; the first refusal ends it. Runs nothing."""
    began = columns
    for at, step in enumerate(recipe.steps):
        try:
            step.check(columns)
        except Refused as refused:
            return Validation(columns, at, _refusal(at, step.op, refused, columns, began))
        columns = step.project(columns)
    if recipe.analyze is not None:
        try:
            recipe.analyze.check(columns)
        except Refused as refused:
            return Validation(columns, len(recipe.steps), _refusal(len(recipe.steps), recipe.analyze.op, refused, columns, began))
    return Validation(columns, len(recipe.steps), None)


def run(table: Table, recipe: Recipe) -> Run:
    """Check and run step by step. Steps only add to the plan; a job runs at once just for what a step must know of the
    data: losses of a cast, quantile edges, fill values, and the notes."""
    began, tables, notes = table.meanings, [table], []
    out = Run(table, notes, None, None, tables, recipe.steps)
    for at, step in enumerate(recipe.steps):
        try:
            step.check(out.table.meanings)
            after, note = step.apply(out.table)
        except Refused as refused:
            out.refusal = _refusal(at, step.op, refused, out.table.meanings, began)
            out._steps = recipe.steps[:at]
            return out
        out.table = after
        tables.append(after)
        notes.append(note)
    if recipe.analyze is not None:
        try:
            recipe.analyze.check(out.table.meanings)
            out.analysis = recipe.analyze.run(out.table, recipe.groups_rows)
        except Refused as refused:
            out.refusal = _refusal(len(recipe.steps), recipe.analyze.op, refused, out.table.meanings, began)
    return out


def derive(table: Table, recipe: Recipe) -> Table:
    """The table a recipe makes, to be kept: refused if it changes nothing, ends in an analysis or leaves no rows."""
    if recipe.analyze is not None:
        raise Refused("apply_analysis")
    if not recipe.steps:
        raise Refused("apply_nothing")
    out = run(table, recipe)
    if out.refusal is not None:
        raise ValueError(out.refusal.reason)
    if out.table.frame.isEmpty():
        raise Refused("apply_rows")
    return replace(out.table)
