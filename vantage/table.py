"""A table with what Spark doesn't carry: what each column means, and the order of the rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "__row"
NUMERIC, CATEGORICAL, BOOLEAN, DATETIME, TEXT, EMPTY = "numeric", "categorical", "boolean", "datetime", "text", "empty"
GROUPABLE = (CATEGORICAL, BOOLEAN, DATETIME)
TEXTUAL = (CATEGORICAL, BOOLEAN, TEXT)
ORDERED = (NUMERIC, DATETIME)


@dataclass(frozen=True)
class Meaning:
    """A column as it is or will be: its semantic type and the two flags that keep it from being grouped on."""

    name: str
    kind: str
    is_id: bool = False
    is_wide: bool = False  # too many distinct values


@dataclass(frozen=True)
class Table:
    """Rows with a hidden place (ROW) and further hidden sort keys before it; meanings tells the visible columns."""

    frame: DataFrame
    meanings: tuple[Meaning, ...] = ()
    order: tuple[tuple[str, bool], ...] = ((ROW, True),)
    declared: dict[str, str] = field(default_factory=dict)  # semantic types set by a cast
    raw: dict[str, str] = field(default_factory=dict)  # hidden columns with the numbers as they are stored, NaN included

    @property
    def names(self) -> list[str]:
        return [c for c in self.frame.columns if not c.startswith("__")]

    def kind(self, name: str):
        return self.frame.schema[name].dataType

    def meaning(self, name: str) -> Meaning | None:
        return next((m for m in self.meanings if m.name == name), None)

    def ordering(self) -> list[Column]:
        """Sort keys of the current row order; gaps go last."""
        return [F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last() for name, up in self.order]

    def hidden(self) -> list[str]:
        return [c for c in self.frame.columns if c.startswith("__")]

    def visible(self) -> DataFrame:
        """The visible columns in no particular order of rows."""
        return self.frame.drop(*self.hidden())

    def ordered(self) -> DataFrame:
        """The visible columns, rows in their order."""
        return self.frame.orderBy(*self.ordering()).drop(*self.hidden())

    def changed(self, name: str, frame: DataFrame, **changes) -> Table:
        """with_frame() after the values of a column have changed: its stored numbers say nothing any more."""
        return self.with_frame(frame, raw={n: k for n, k in self.raw.items() if n != name}, **changes)

    def with_frame(self, frame: DataFrame, **changes) -> Table:
        return replace(self, frame=frame, **changes)
