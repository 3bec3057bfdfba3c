"""Every distinct value of a table's columns with its number of rows: counted once, written, and read by profile,
frequencies, summaries, ranks and quality alike."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import BOOLEAN_TOKENS, col, label, num
from ..scratch import Written
from ..table import Table
from .selection import is_small

#: Fixed value: blanks that a careful writer would not leave.
BAD_SPACES = r"^\s|\s$|\s{2,}"


def _keys(table: Table, names: list[str]) -> dict[str, dict[int, Column]]:
    """Whole numbers, doubles and everything else, as text, are told apart in columns of their own: for each of these the
    places of the columns that it holds and their values. Moments are counted before they are written as texts."""
    out: dict[str, dict[int, Column]] = {"k": {}, "x": {}, "moment": {}, "text": {}}
    for i, name in enumerate(names):
        c, kind = col(name), table.kind(name)
        if isinstance(kind, T.IntegralType):
            out["k"][i] = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out["x"][i] = c.cast("double")
        elif isinstance(kind, T.TimestampNTZType):
            out["moment"][i] = c
        else:
            out["text"][i] = label(c, kind)
    return out


@dataclass(frozen=True)
class Counts:
    """values: (unit, k, x, text, n), written; unit is a column's place in names, and all of k, x and text are null for
    its gaps. sums: what one pass over the values tells of each column."""

    table: Table
    names: tuple[str, ...]
    values: DataFrame
    kept: Written
    sums: dict[str, Row]

    def units(self, names: list[str]) -> list[int]:
        return [self.names.index(n) for n in names]

    def of(self, names: list[str]) -> DataFrame:
        """(unit, value, number, n) of the columns' values that are no gaps. Doubles have no value as text."""
        rows = self.values.filter(F.col("unit").isin(self.units(names)) & there())
        return rows.select("unit", text().alias("value"), number().alias("number"), "n")


def there() -> Column:
    return F.coalesce("k", "x").isNotNull() | F.col("text").isNotNull()


def text() -> Column:
    return F.coalesce("text", F.col("k").cast("string"))


def number() -> Column:
    """The finite number of a value of a numeric column, decimals included."""
    x = F.coalesce("x", F.col("k").cast("double"), num(F.col("text"), T.StringType()))
    return F.when(F.abs(x) != float("inf"), x)


#: The columns of values.
KINDS = {"k": "bigint", "x": "double", "text": "string"}


def _counted_at_once(table: Table, keys: dict[str, dict[int, Column]]) -> DataFrame:
    """The counts of the columns of a small table, of all kinds in one shuffle."""
    text = {i: label(c, T.TimestampNTZType()) for i, c in keys["moment"].items()} | keys["text"]
    cells = [{"unit": F.lit(i), key: c} for key, own in (("k", keys["k"]), ("x", keys["x"]), ("text", text)) for i, c in own.items()]
    parts = F.array(*(F.struct(cell["unit"].alias("unit"), *(cell.get(k, F.lit(None).cast(kind)).alias(k) for k, kind in KINDS.items())) for cell in cells))
    return table.frame.select(F.explode(parts).alias("c")).groupBy("c.unit", *(f"c.{k}" for k in KINDS)).agg(F.count("*").alias("n"))


def _counted(frame: DataFrame, key: str, own: dict[int, Column]) -> DataFrame:
    """The counts of columns whose values are of one kind."""
    cells = F.array(*(F.struct(F.lit(i).alias("unit"), c.alias("v")) for i, c in own.items()))
    rows = frame.select(F.explode(cells).alias("c")).groupBy("c.unit", "c.v").agg(F.count("*").alias("n"))
    as_text = label(F.col("v"), rows.schema["v"].dataType) if key == "moment" else F.col("v")
    value = {key if key in KINDS else "text": as_text}
    return rows.select("unit", *(value.get(k, F.lit(None).cast(kind)).alias(k) for k, kind in KINDS.items()), "n")


def count_values(table: Table, kept: Written, names: list[str] | None = None) -> Counts:
    """Counts of all columns, or of some: partial sums before the shuffle. In large tables columns
    of one kind are counted together, by keys of one kind."""
    names = table.names if names is None else names
    if not names:
        return Counts(table, (), table.frame.sparkSession.createDataFrame([], "unit int, k bigint, x double, text string, n bigint"), kept, {})
    keys = _keys(table, names)
    if is_small(table.frame):
        values = _counted_at_once(table, keys)
    else:
        values = reduce(DataFrame.unionByName, [_counted(table.frame, key, own) for key, own in keys.items() if own])
    values = kept.put("values", values)
    is_there, own, n = there(), text(), F.col("n")
    sums = values.withColumns({"own": own, "number": number()}).groupBy("unit").agg(
        F.coalesce(F.sum(F.when(is_there, n)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~is_there, n)), F.lit(0)).alias("gaps"), F.count_if(is_there).alias("unique"),
        (F.sum(F.length("own") * n) / F.sum(F.when(F.col("own").isNotNull(), n))).alias("length"), F.every(F.lower(F.trim("own")).isin(*BOOLEAN_TOKENS)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("text").rlike(BAD_SPACES), n)), F.lit(0)).alias("spaced"), F.coalesce(F.sum(F.when(F.col("number").isNotNull(), n)), F.lit(0)).alias("numbers"),
        F.count("number").alias("distinct_numbers"), F.sum(F.col("number") * n).alias("sum"), F.min("number").alias("min"), F.max("number").alias("max"),
    )
    return Counts(table, tuple(names), values, kept, {names[r["unit"]]: r for r in sums.collect()})
