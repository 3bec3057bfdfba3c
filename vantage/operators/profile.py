"""What each column of a table means, and how complete, distinct and repeated its values are."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, label, moment, num
from ..scratch import Written
from ..table import BOOLEAN, CATEGORICAL, DATETIME, EMPTY, NUMERIC, ROW, TEXT, Meaning, Table
from .counts import Counts, count_values

#: The rules' thresholds.
TEXT_LENGTH, MANY_VALUES, TEXT_SHARE = 40, 50, 0.5
MOMENT_SAMPLE, MOMENT_SHARE = 200, 0.9
ID_SHARE, SAMPLES = 0.99, 3
ID_NAME = re.compile(r"(^|[_\s])id$|^id$|_?(uuid|guid)$", re.IGNORECASE)


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: str
    kind: str
    n_missing: int
    missing_ratio: float
    n_unique: int
    is_id: bool
    is_constant: bool
    is_wide: bool
    samples: tuple[str, ...]

    @property
    def meaning(self) -> Meaning:
        return Meaning(self.name, self.kind, self.is_id, self.is_wide)


@dataclass(frozen=True)
class DatasetProfile:
    n_rows: int
    n_columns: int
    type_counts: dict[str, int]
    n_missing: int
    missing_ratio: float
    duplicate_rows: int
    columns: tuple[ColumnProfile, ...]

    @property
    def meanings(self) -> tuple[Meaning, ...]:
        return tuple(c.meaning for c in self.columns)


def unpivoted(table: Table, names: list[str]) -> DataFrame:
    """(name, value, row) of every value that is no gap: all columns share one shuffle from here."""
    cells = F.array(*(F.struct(F.lit(n).alias("name"), label(col(n), table.kind(n)).alias("value")) for n in names))
    return table.frame.select(F.explode(cells).alias("x"), F.col(ROW).alias("row")).select("x.name", "x.value", "row").filter("value is not null")


def value_counts(table: Table, names: list[str]) -> DataFrame:
    """(name, value, n, row) of every distinct value, with its first row."""
    return unpivoted(table, names).groupBy("name", "value").agg(F.count("*").alias("n"), F.min("row").alias("row"))


def duplicate_rows(table: Table, kept: Written | None = None) -> int:
    """Rows that equal an earlier one; gaps are equal. Two hashes of a row stand for it, so that texts are not shuffled;
    only rows whose hashes occur again are compared themselves."""
    if kept is None:
        with Written(table.frame.sparkSession, "duplicates") as kept:
            return duplicate_rows(table, kept)
    if not table.names:
        return max(table.frame.count() - 1, 0)
    cells = [x for n in table.names for x in (col(n), col(n).isNull())]  # a hash passes gaps over
    marks = [F.xxhash64(F.lit(k), *cells).alias(f"__mark{k}") for k in (1, 2)]
    rows = table.frame.select(*(col(n) for n in table.names), *marks)
    again = rows.groupBy("__mark1", "__mark2").agg(F.count("*").alias("__n")).filter("__n > 1").select("__mark1", "__mark2")
    again = kept.put("again", again, n=F.count("*"))
    if not kept.told["again"]["n"]:
        return 0
    alike = rows.join(again, ["__mark1", "__mark2"], "left_semi")
    counted = alike.groupBy("__mark1", "__mark2", *(col(n) for n in table.names)).agg(F.count("*").alias("__n"))
    return counted.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]


@dataclass(frozen=True)
class _Head:
    """What a table's first rows tell of a column: its first distinct values, and of its first values how many there
    are, are moments and are numbers."""

    samples: tuple[str, ...]
    seen: int
    moments: int
    numbers: int


def _heads(table: Table, sums: dict[str, Row]) -> dict[str, _Head]:
    """From the first rows alone where these hold enough values; the other columns, with many gaps or few changes, are
    searched whole."""
    names = [n for n in table.names if n in sums and sums[n]["n"]]
    if not names:
        return {}
    texts = {n for n in names if isinstance(table.kind(n), T.StringType)}
    kind, gap = T.StringType(), F.lit(None).cast("boolean")
    flags = lambda n: (moment(col(n), kind).isNotNull(), num(col(n), kind).isNotNull()) if n in texts else (gap, gap)
    cells = [F.struct(label(col(n), table.kind(n)).alias("value"), *(f.alias(x) for f, x in zip(flags(n), ("moment", "number"), strict=True))).alias(f"c{i}") for i, n in enumerate(names)]
    rows = table.frame.orderBy(F.col(ROW)).limit(MOMENT_SAMPLE).select(*cells).collect()
    out, open_ = {}, []
    for i, n in enumerate(names):
        seen = [r[f"c{i}"] for r in rows if r[f"c{i}"]["value"] is not None]
        first = tuple(dict.fromkeys(c["value"] for c in seen))[:SAMPLES]
        if len(first) < min(SAMPLES, sums[n]["unique"]) or (n in texts and len(seen) < min(MOMENT_SAMPLE, sums[n]["n"])):
            open_.append(n)
        out[n] = _Head(first, len(seen), sum(bool(c["moment"]) for c in seen), sum(bool(c["number"]) for c in seen))
    if open_:
        by_row = Window.partitionBy("name").orderBy("row")
        first = value_counts(table, open_).withColumn("rank", F.row_number().over(by_row)).filter(F.col("rank") <= SAMPLES)
        samples = {r["name"]: r["s"] for r in first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s")).collect()}
        some = unpivoted(table, open_).withColumn("rank", F.row_number().over(by_row)).filter(F.col("rank") <= MOMENT_SAMPLE)
        shares = some.groupBy("name").agg(F.count("*").alias("n"), F.count(moment(F.col("value"), kind)).alias("moments"), F.count(num(F.col("value"), kind)).alias("numbers"))
        told = {r["name"]: r for r in shares.collect()}
        out |= {n: _Head(tuple(x["value"] for x in samples[n]), told[n]["n"], told[n]["moments"], told[n]["numbers"]) for n in open_}
    return out


def _kind(dtype: T.DataType, declared: str | None, n: int, unique: int, length: float, boolean: bool, moments: float) -> str:
    if not n:
        return EMPTY
    if declared in (CATEGORICAL, TEXT):
        return declared
    if isinstance(dtype, T.BooleanType) or boolean:
        return BOOLEAN
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) or moments >= MOMENT_SHARE:
        return DATETIME
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if (unique > MANY_VALUES and unique / n > TEXT_SHARE) or length > TEXT_LENGTH:
        return TEXT
    return CATEGORICAL


def profile(table: Table, counts: Counts | None = None) -> DatasetProfile:
    """The profile of all columns, from the table's counted values; exact, as thresholds decide on it."""
    if counts is None:
        with Written(table.frame.sparkSession, "profile") as kept:
            return profile(table, count_values(table, kept))
    sums, names = counts.sums, table.names
    n_rows = next((r["n"] + r["gaps"] for r in sums.values()), 0) if names else table.frame.count()
    heads = _heads(table, sums)
    columns = []
    for name in names:
        r, dtype, head = sums.get(name), table.kind(name), heads.get(name)
        n, unique = (r["n"], r["unique"]) if r else (0, 0)
        real = isinstance(dtype, (T.DoubleType, T.FloatType))
        boolean = bool(n) and unique <= 2 and not real and not isinstance(dtype, T.DecimalType) and r["tokens"]
        moments = head.moments / head.seen if head and head.numbers < head.seen and isinstance(dtype, T.StringType) else 0.0
        kind = _kind(dtype, table.declared.get(name), n, unique, (r["length"] or 0) if r else 0, boolean, moments)
        is_id = n_rows >= 2 and kind not in (BOOLEAN, EMPTY, DATETIME) and not real and unique / n_rows >= ID_SHARE and (bool(ID_NAME.search(name)) or kind == CATEGORICAL)
        wide = kind in (CATEGORICAL, TEXT) and unique > MANY_VALUES
        columns.append(ColumnProfile(name, dtype.simpleString(), kind, n_rows - n, (n_rows - n) / n_rows if n_rows else 0.0, unique, is_id, unique <= 1, wide, head.samples if head else ()))
    missing = sum(c.n_missing for c in columns)
    cells = n_rows * len(columns)
    repeated = duplicate_rows(table, counts.kept)
    return DatasetProfile(n_rows, len(columns), dict(Counter(c.kind for c in columns)), missing, missing / cells if cells else 0.0, repeated, tuple(columns))


def understood(table: Table, told: DatasetProfile | None = None) -> Table:
    """The table with its columns' meanings, of its profile if that is known; text columns that hold dates are read as
    moments once and for all."""
    told = told or profile(table)
    dates = [c.name for c in told.columns if c.kind == DATETIME and c.dtype == "string"]
    frame = reduce(lambda f, n: f.withColumn(n, moment(col(n), table.kind(n))), dates, table.frame)
    return table.with_frame(frame, meanings=told.meanings)


def profile_frame(table: Table) -> DataFrame:
    """The column profiles as a DataFrame."""
    told = profile(table)
    schema = "name string, dtype string, kind string, n_missing bigint, missing_ratio double, n_unique bigint, is_id boolean, is_constant boolean, is_wide boolean, samples array<string>"
    rows = [(c.name, c.dtype, c.kind, c.n_missing, c.missing_ratio, c.n_unique, c.is_id, c.is_constant, c.is_wide, list(c.samples)) for c in told.columns]
    return table.frame.sparkSession.createDataFrame(rows, schema)


def assumed(table: Table, **kinds: str) -> Table:
    """The table with meanings taken from its types (numbers, moments, booleans, else categories) instead of from a look at
    the data; `kinds` names exceptions. Nothing is run."""
    def of(name: str) -> str:
        dtype = table.kind(name)
        if isinstance(dtype, T.NumericType):
            return NUMERIC
        return DATETIME if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else BOOLEAN if isinstance(dtype, T.BooleanType) else CATEGORICAL

    return table.with_frame(table.frame, meanings=tuple(Meaning(n, kinds.get(n) or of(n)) for n in table.names))
