"""The four analyses that may end a recipe."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from ..operators import charts, stats
from ..operators.timeline import timeline
from ..table import DATETIME, EMPTY, GROUPABLE, NUMERIC, TEXT, Meaning, Table
from .reasons import KIND_NAMES, Refused

GROUPED_ROWS = "The rows are groups made by an earlier step, not the rows of the file."


def _named(columns: tuple[Meaning, ...], name: str) -> Meaning:
    found = next((m for m in columns if m.name == name), None)
    if found is None:
        raise Refused("unknown", name)
    return found


def _measure(columns: tuple[Meaning, ...], name: str, what: str) -> None:
    m = _named(columns, name)
    if m.kind != NUMERIC:
        raise Refused("measure", name, kind=KIND_NAMES[m.kind], what=what)


@dataclass(frozen=True)
class Finding:
    op: str
    result: Any
    chart: Any
    caveats: tuple[str, ...] = ()


class Analysis:
    op: ClassVar[str]

    def check(self, columns: tuple[Meaning, ...]) -> None: ...

    def run(self, table: Table, rows_are_groups: bool) -> Finding: ...


@dataclass
class Compare(Analysis):
    op = "compare"
    group_by: str
    measure: str

    def check(self, columns) -> None:
        m = _named(columns, self.group_by)
        if m.kind not in GROUPABLE:
            raise Refused("compare_kind", m.name, kind=KIND_NAMES[m.kind])
        if m.is_id:
            raise Refused("compare_id", m.name)
        if m.is_wide:
            raise Refused("compare_wide", m.name)
        _measure(columns, self.measure, "compare")

    def run(self, table, rows_are_groups) -> Finding:
        found = stats.compare(table, self.group_by, self.measure)
        if found is None:
            raise Refused("compare_data", self.group_by, n=stats.LEAST_GROUP)
        return Finding(self.op, found, charts.box(found), (GROUPED_ROWS,) if rows_are_groups else ())


@dataclass
class Relate(Analysis):
    op = "relate"
    left: str
    right: str

    def check(self, columns) -> None:
        if self.left == self.right:
            raise Refused("relate_self", self.left)
        _measure(columns, self.left, "relate")
        _measure(columns, self.right, "relate")

    def run(self, table, rows_are_groups) -> Finding:
        found = stats.correlate(table, [self.left, self.right])
        if not found:
            raise Refused("relate_data")
        return Finding(self.op, found[0], charts.scatter(table, found[0]), (GROUPED_ROWS,) if rows_are_groups else ())


@dataclass
class Trend(Analysis):
    op = "trend"
    time: str
    measure: str

    def check(self, columns) -> None:
        m = _named(columns, self.time)
        if m.kind != DATETIME:
            raise Refused("trend_kind", m.name, kind=KIND_NAMES[m.kind])
        _measure(columns, self.measure, "follow over time")

    def run(self, table, rows_are_groups) -> Finding:
        found = timeline(table, self.time, self.measure)
        if found is None:
            raise Refused("trend_data")
        return Finding(self.op, found, charts.line(found))


@dataclass
class Distribution(Analysis):
    op = "distribution"
    column: str

    def check(self, columns) -> None:
        m = _named(columns, self.column)
        if m.kind in (TEXT, EMPTY):
            raise Refused("spread_none", m.name, kind=KIND_NAMES[m.kind])
        if m.kind == DATETIME:
            raise Refused("spread_date", m.name)

    def run(self, table, rows_are_groups) -> Finding:
        if table.meaning(self.column).kind == NUMERIC:
            found = stats.describe(table, [self.column])[0]
            return Finding(self.op, found, charts.histogram(found))
        told = stats.frequencies(table, [self.column])[0]
        return Finding(self.op, told, charts.bar(told))


ANALYSES: dict[str, type[Analysis]] = {a.op: a for a in (Compare, Relate, Trend, Distribution)}
