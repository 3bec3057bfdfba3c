"""Statistics of columns and pairs of columns: summaries, frequencies, correlations, group comparisons."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chi2 import survival
from ..functions.columns import col, label, num
from ..scratch import Written
from ..table import Table
from .counts import Counts, count_values
from .selection import RANGE_VALUES, before_range, dealt, is_small, placed, quantiles_of_ranges, select_quantiles

#: Bounds and thresholds of the analyses.
BINS, FENCE = 30, 1.5
TOP_VALUES, RARE_SHARE = 10, 0.01
MAX_PAIRS, LEAST_PAIRS = 50, 3
LEAST_GROUP, GROUP_VALUES = 5, (2, 10)


@dataclass(frozen=True)
class Histogram:
    edges: tuple[float, ...]
    counts: tuple[int, ...]


@dataclass(frozen=True)
class NumericSummary:
    name: str
    count: int
    missing: int
    mean: float | None
    median: float | None
    std: float | None
    min: float | None
    max: float | None
    q1: float | None
    q3: float | None
    skewness: float | None
    outliers: int
    histogram: Histogram | None


@dataclass(frozen=True)
class CategorySummary:
    name: str
    count: int
    missing: int
    unique: int
    top: tuple[tuple[str, int, float], ...]  # value, rows, share
    rare: int


@dataclass(frozen=True)
class Correlation:
    left: str
    right: str
    n: int
    pearson: float
    spearman: float

    @property
    def strength(self) -> float:
        return max(abs(self.pearson), abs(self.spearman))


@dataclass(frozen=True)
class GroupStats:
    group: str
    n: int
    mean: float
    median: float
    std: float
    min: float
    max: float
    q1: float
    q3: float
    low: float
    high: float


@dataclass(frozen=True)
class Comparison:
    group_by: str
    measure: str
    groups: tuple[GroupStats, ...]  # by mean, descending
    ignored: int
    statistic: float | None
    p_value: float | None
    effect: float | None

    @property
    def highest(self) -> GroupStats:
        return self.groups[0]

    @property
    def lowest(self) -> GroupStats:
        return self.groups[-1]

    @property
    def mean_ratio(self) -> float | None:
        return self.highest.mean / self.lowest.mean if self.lowest.mean > 0 else None

    @property
    def median_difference(self) -> float:
        return self.highest.median - self.lowest.median


@dataclass(frozen=True)
class Moments:
    name: str
    count: int
    missing: int
    mean: float | None
    median: float | None
    std: float | None
    min: float | None
    max: float | None
    q1: float | None
    q3: float | None
    skewness: float | None
    unique: int
    outliers: int
    bins: tuple[int, ...]


def adjusted_skewness(n: int, second: float, third: float) -> float | None:
    """Bias-adjusted skewness from sums of powers about the mean; 0 where all values are equal, none under three."""
    if n <= 2:
        return None
    return (third / n) / (second / n) ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2) if second else 0.0


def moments(counts: Counts, names: list[str]) -> list[Moments]:
    """What counted values tell of numeric columns: quartiles by selection, then outliers, bins and powers about the
    mean in one more pass over the values."""
    own = {n: counts.sums[n] for n in names if n in counts.sums}
    found = dict(zip(own, _quartiles_of(counts, list(own), [0.25, 0.5, 0.75]), strict=True))
    rows = _spread(counts, {n: (r, found[n]) for n, r in own.items() if r["numbers"]})
    out = []
    for name in names:
        r, q, spread = own.get(name), found.get(name), rows.get(name)
        if not spread:
            out.append(Moments(name, 0, r["gaps"] if r else 0, *[None] * 8, 0, 0, ()))
            continue
        n, flat = r["numbers"], r["min"] == r["max"]
        second, third = (0.0, 0.0) if flat else spread[1:3]
        std = math.sqrt(second / (n - 1)) if n > 1 else None
        mean = r["min"] if flat else r["sum"] / n
        out.append(Moments(name, n, r["gaps"], mean, q[1], std, r["min"], r["max"], q[0], q[2], adjusted_skewness(n, second, third), r["distinct_numbers"], spread[0], tuple(spread[3])))
    return out


def _quartiles_of(counts: Counts, names: list[str], shares: list[float]) -> list[list[float] | None]:
    units = counts.units(names)
    rows = counts.of(names).select("unit", "number", "n").filter("number is not null")
    return select_quantiles(rows, [F.when(F.col("unit") == u, F.col("number")) for u in units], [shares] * len(units), F.col("n"), [tuple(counts.sums[n][x] for x in ("numbers", "min", "max")) for n in names])


def _spread(counts: Counts, told: dict[str, tuple]) -> dict[str, list]:
    """(outliers, second and third power about the mean, rows of each bin) of columns with known ends and quartiles."""
    if not told:
        return {}
    x, n, unit = F.col("number"), F.col("n"), F.col("unit")
    bins, mean, outside = (F.lit(None).cast(k) for k in ("int", "double", "boolean"))
    for name, (r, q) in told.items():
        mine, fence = unit == counts.names.index(name), fences(q[0], q[2])
        bins = F.when(mine, bucket(x, bucket_edges(r["min"], r["max"], r["distinct_numbers"]))).otherwise(bins)
        mean = F.when(mine, r["sum"] / r["numbers"]).otherwise(mean)
        outside = F.when(mine, (x < fence[0]) | (x > fence[1]) if fence else F.lit(False)).otherwise(outside)
    rows = counts.of(list(told)).filter("number is not null").select("unit", n, bins.alias("bin"), (x - mean).alias("d"), outside.alias("out"))
    sums = rows.groupBy("unit", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("out"), n).otherwise(0)).alias("out"), F.sum(F.col("d") * F.col("d") * n).alias("s2"), F.sum(F.col("d") * F.col("d") * F.col("d") * n).alias("s3"))
    out = {name: [0, 0.0, 0.0, [0] * min(BINS, r["distinct_numbers"])] for name, (r, _) in told.items()}
    for r in sums.collect():
        mine = out[counts.names[r["unit"]]]
        mine[0] += r["out"]
        mine[1] += r["s2"]
        mine[2] += r["s3"]
        mine[3][r["bin"]] += r["n"]
    return out


def moments_frame(table: Table, names: list[str]) -> DataFrame:
    """(name, count, missing, mean, median, std, min, max, q1, q3, skewness, unique) of columns' finite values."""
    with Written(table.frame.sparkSession, "moments") as kept:
        rows = [(m.name, m.count, m.missing, m.mean, m.median, m.std, m.min, m.max, m.q1, m.q3, m.skewness, m.unique) for m in moments(count_values(table, kept, names), names)]
    measures = "mean double, median double, std double, min double, max double, q1 double, q3 double, skewness double"
    return table.frame.sparkSession.createDataFrame(rows, f"name string, count bigint, missing bigint, {measures}, unique bigint")


def fences(q1: float | None, q3: float | None) -> tuple[float, float] | None:
    if q1 is None or not math.isfinite(q3 - q1) or q3 - q1 == 0:
        return None
    return q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)


def bucket_edges(low: float, high: float, unique: int) -> list[float]:
    n = min(BINS, unique)
    if low == high:
        low, high = low - 0.5, high + 0.5
    return [low + (high - low) * k / n for k in range(n)] + [high]


def bucket(x: Column, edges: list[float]) -> Column:
    """The number of the equal-width bin, of a value; the last one holds its upper edge."""
    n = len(edges) - 1
    return F.when(x.isNotNull(), F.least(F.floor((x - edges[0]) / ((edges[-1] - edges[0]) / n)), F.lit(n - 1))).cast("int")


def describe(table: Table, names: list[str], counts: Counts | None = None) -> list[NumericSummary]:
    """Summaries of numeric columns, from the table's counted values."""
    if not names:
        return []
    if counts is None:
        with Written(table.frame.sparkSession, "describe") as kept:
            return describe(table, names, count_values(table, kept, names))
    out = []
    for m in moments(counts, names):
        shape = Histogram(tuple(bucket_edges(m.min, m.max, m.unique)), m.bins) if m.count else None
        out.append(NumericSummary(m.name, m.count, m.missing, m.mean, m.median, m.std, m.min, m.max, m.q1, m.q3, m.skewness, m.outliers, shape))
    return out


def frequencies(table: Table, names: list[str], counts: Counts | None = None) -> list[CategorySummary]:
    """Top values and rare ones of category columns, from the table's counted values; ties among the top go by value."""
    if not names:
        return []
    if counts is None:
        with Written(table.frame.sparkSession, "frequencies") as kept:
            return frequencies(table, names, count_values(table, kept, names))
    total = F.lit(None).cast("bigint")
    for n, u in zip(names, counts.units(names), strict=True):
        total = F.when(F.col("unit") == u, F.lit(counts.sums[n]["n"] if n in counts.sums else 0)).otherwise(total)
    values = counts.of(names).select("unit", _labelled(counts, names).alias("value"), "n", (F.col("n") / total < RARE_SHARE).alias("rare"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("n").desc(), "value"))
    top = values.withColumn("rank", rank).filter(F.col("rank") <= TOP_VALUES).select("unit", "rank", "value", "n")
    rare = values.groupBy("unit").agg(F.count_if("rare").alias("n")).select("unit", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("value"), "n")
    tops: dict[int, list] = {u: [] for u in counts.units(names)}
    scarce = dict.fromkeys(tops, 0)
    for r in sorted(top.unionByName(rare).collect(), key=lambda r: r["rank"]):
        if r["rank"]:
            tops[r["unit"]].append((r["value"], r["n"]))
        else:
            scarce[r["unit"]] = r["n"]
    out = []
    for n, u in zip(names, counts.units(names), strict=True):
        told = counts.sums.get(n)
        out.append(CategorySummary(n, told["n"], told["gaps"], told["unique"], tuple((v, k, k / told["n"]) for v, k in tops[u]), scarce[u]) if told else CategorySummary(n, 0, 0, 0, (), 0))
    return out


def _labelled(counts: Counts, names: list[str]) -> Column:
    """The values as texts, those of doubles too."""
    out = F.col("value")
    for n, u in zip(names, counts.units(names), strict=True):
        kind = counts.table.kind(n)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out = F.when(F.col("unit") == u, label(F.col("number").cast(kind), kind)).otherwise(out)
    return out


#: Of the rows of a column, the share above which a value's rank is broadcast and its rows are dealt out freely; and the
#: number of values up to which all ranks of a column are.
HEAVY_SHARE, GIVEN_VALUES = 2000, 200_000


def quantiles_of(table: Table, name: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles of a column's finite numbers; none if it has none."""
    return select_quantiles(table.frame, [num(col(name), table.kind(name))], [shares])[0]


def pair_sums(numbers: DataFrame, centres: list[float], weighed: bool = False) -> dict[tuple[int, int], tuple]:
    """For every two of the columns (doubles or null) over rows that have both: their number, and the sums of both
    values, squares and products about the centres. Each batch gives them as products of matrices, for all pairs in one
    read, and partial sums meet in Spark. If weighed, a column behind these tells how many rows a row stands for."""
    width = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width, width))
        for batch in batches:
            raw = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]], axis=1) if batch.num_rows else np.zeros((0, width))
            there = ~np.isnan(raw)
            x, m = np.where(there, raw - centres, 0.0), there.astype(float)
            n = batch.column(width).to_numpy()[:, None] if weighed else 1.0
            a, b, c = (m * n).T, (x * n).T, (x * x * n).T
            total += np.stack((a @ m, b @ m, a @ x, c @ m, a @ (x * x), b @ x))
        a, b = np.triu_indices(width, 1)
        if len(a) and total[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(t[a, b]) for t in total)], names=["a", "b", *PAIR_SUMS])

    schema = f"a bigint, b bigint, {', '.join(f'{x} double' for x in PAIR_SUMS)}"
    sums = numbers.mapInArrow(run, schema).groupBy("a", "b").agg(*(F.sum(x).alias(x) for x in PAIR_SUMS))
    return {(r["a"], r["b"]): tuple(r)[2:] for r in sums.collect()}


PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _pearson(n: float, x: float, y: float, xx: float, yy: float, xy: float) -> float | None:
    """None where a column does not vary, by what is left of its squares beside rounding."""
    vx, vy = xx - x * x / n, yy - y * y / n
    if vx <= 1e-12 * xx or vy <= 1e-12 * yy:
        return None
    return max(-1.0, min(1.0, (xy - x * y / n) / math.sqrt(vx * vy)))


def correlate(table: Table, names: list[str], most: int | None = MAX_PAIRS, counts: Counts | None = None) -> list[Correlation]:
    """Pearson and Spearman of every pair of numeric columns over rows that have both, strongest first.

    Rows with the same numbers are counted and written once. Pearson takes sums of products, of all pairs in one read.
    Only the strongest pairs are ranked: each column's values once, for all partners that take the same rows away. Rows
    meet the ranks of each column once, whatever the number of pairs."""
    if len(names) < 2:
        return []
    if counts is None:
        with Written(table.frame.sparkSession, "correlate") as kept:
            return correlate(table, names, most, count_values(table, kept, names))
    sums = [counts.sums.get(n) for n in names]
    sizes = [r["numbers"] if r else 0 for r in sums]
    kept = counts.kept
    numbers = table.frame.select(*(num(col(n), table.kind(n)).alias(f"c{i}") for i, n in enumerate(names)))
    small = is_small(numbers)
    numbers = numbers.withColumn("n", F.lit(1)) if small else kept.put("numbers", numbers.groupBy(*numbers.columns).agg(F.count("*").alias("n")))
    c = lambda i: F.col(f"c{i}")
    told: dict[tuple[int, int], tuple] = {}
    for pair, (n, *rest) in pair_sums(numbers, [r["sum"] / r["numbers"] if r and r["numbers"] else 0.0 for r in sums], weighed=True).items():
        if n >= LEAST_PAIRS and (r := _pearson(n, *rest)) is not None:
            told[pair] = (int(n), r)
    chosen = sorted(told, key=lambda p: (-abs(told[p][1]), p))[:most]
    if not chosen:
        kept.drop("numbers")
        return []
    # A column's ranks over all its values serve all partners that take none of its rows away.
    unit = lambda a, b: None if told[min(a, b), max(a, b)][0] == sizes[a] else b
    units: dict[int, list] = {}
    for a, b in [(x, y) for p in chosen for x, y in (p, p[::-1])]:
        if unit(a, b) not in units.setdefault(a, []):
            units[a].append(unit(a, b))
    most_units = range(max(map(len, units.values())))
    rows = lambda a, k: F.lit(0) if k >= len(units[a]) else F.col("n") if units[a][k] is None else F.when(c(units[a][k]).isNotNull(), F.col("n")).otherwise(0)
    parts = F.array(*(F.struct(F.lit(a).alias("col"), c(a).alias("v"), F.col("n").alias("__n"), *(rows(a, k).cast("bigint").alias(f"n{k}") for k in most_units)) for a in units))
    values = numbers.select(F.explode(parts).alias("u")).filter("u.v is not null").groupBy("u.col", "u.v").agg(*(F.sum(f"u.{x}").alias(x) for x in ("__n", *(f"n{k}" for k in most_units))))
    values = placed(values, ["col"], "v", kept, sum(sums[a]["distinct_numbers"] for a in units), [f"n{k}" for k in most_units], [f"r{k}" for k in most_units])
    ranks = values.select("col", "v", "__n", *((F.col(f"r{k}") + (F.col(f"n{k}") + 1) / 2.0).alias(f"r{k}") for k in most_units))
    if small:
        ranked = _with_few_ranks(numbers, ranks, {a: len(own) for a, own in units.items()})
    else:
        ranked, ranks = numbers, kept.put("ranks", ranks)
        for a in units:
            ranked = _with_ranks(ranked, ranks, a, len(units[a]), sums[a]["distinct_numbers"], max(max(sizes) // HEAVY_SHARE, 1))
    names_of = [(f"r{a}_{units[a].index(unit(a, b))}", f"r{b}_{units[b].index(unit(b, a))}", (told[a, b][0] + 1) / 2) for a, b in chosen]
    moments = rank_sums(ranked, names_of)
    kept.drop("ranks", "ranges", "counts", "numbers")
    return [Correlation(names[a], names[b], *told[a, b], xy / math.sqrt(xx * yy)) for (a, b), (xy, xx, yy) in zip(chosen, moments, strict=True)]


def rank_sums(rows: DataFrame, pairs: list[tuple[str, str, float]]) -> list[tuple[float, float, float]]:
    """For pairs of columns with their common mean: the sums of products and of both squares about it, over rows (each
    standing for n) that have both. Each batch gives the sums of all pairs."""
    columns = list(dict.fromkeys(x for *both, _ in pairs for x in both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(pairs)))
        for batch in batches:
            n, *values = (x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns)
            of = dict(zip(columns, values, strict=True))
            for i, (left, right, mean) in enumerate(pairs):
                x, y = of[left] - mean, of[right] - mean
                there = ~np.isnan(x + y)
                x, y, m = x[there], y[there], n[there]
                total[:, i] += (m * x) @ y, (m * x) @ x, (m * y) @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int64()), *map(pa.array, total)], names=["pair", "xy", "xx", "yy"])

    told = rows.select("n", *columns).mapInArrow(run, "pair bigint, xy double, xx double, yy double").groupBy("pair").agg(*(F.sum(x).alias(x) for x in ("xy", "xx", "yy")))
    return [tuple(r)[1:] for r in sorted(told.collect())]


def _with_few_ranks(rows: DataFrame, ranks: DataFrame, units: dict[int, int]) -> DataFrame:
    """(n, r{a}_0, r{a}_1, ..) of the rows of a small table: all columns meet their ranks in one join."""
    cells = F.array(*(F.struct(F.lit(a).alias("col"), F.col(f"c{a}").alias("v")) for a in units))
    met = rows.withColumn("__id", F.monotonically_increasing_id()).select("n", "__id", F.explode(cells).alias("u")).select("n", "__id", "u.*").filter("v is not null").join(F.broadcast(ranks.drop("__n")), ["col", "v"])
    return met.groupBy("__id").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("col") == a, F.col(f"r{k}"))).alias(f"r{a}_{k}") for a, many in units.items() for k in range(many)))


def _with_ranks(rows: DataFrame, ranks: DataFrame, a: int, units: int, distinct: int, share: int) -> DataFrame:
    """Adds the ranks r{a}_0, r{a}_1, .. of a column's values. Ranks of few values are broadcast; of many, those with more
    than `share` rows (HEAVY_SHARE values at most), so that their rows don't meet in one task, and neither do gaps."""
    value, names = f"c{a}", [f"r{a}_{k}" for k in range(units)]
    own = ranks.filter(F.col("col") == a).select(F.col("v").alias(value), "__n", *(F.col(f"r{k}").alias(n) for k, n in enumerate(names)))
    if distinct <= GIVEN_VALUES:
        return rows.join(F.broadcast(own.drop("__n")), value, "left").select(*rows.columns, *names)
    heavy = own.filter(F.col("__n") > share).select(value, *(F.col(n).alias(f"__{n}") for n in names))
    given = rows.join(F.broadcast(heavy), value, "left").select(*rows.columns, *(f"__{n}" for n in names))
    alone = F.col(value).isNull() | F.col(f"__{names[0]}").isNotNull()
    given = given.withColumn("__dealt", F.when(alone, -1 - F.pmod(F.hash(*rows.columns), F.lit(4096))).otherwise(0))
    light = own.filter(F.col("__n") <= share).select(F.lit(0).alias("__dealt"), value, *names)
    met = given.join(light, ["__dealt", value], "left")
    return met.select(*rows.columns, *(F.coalesce(f"__{n}", n).alias(n) for n in names))


@dataclass(frozen=True)
class GroupCounts:
    """counts: (unit, x, g0, g1, .., n), written: how many rows have a measure's value and these groups. A measure's place
    is its unit, and a pair is its unit and the place of its group. If there are not few, counts are dealt out in ranges
    of units and values (__range)."""

    counts: DataFrame
    pairs: tuple[tuple[int, int], ...]
    rows: int

    def few(self) -> bool:
        """Whether a task can hold all cells."""
        return self.rows * len({g for _, g in self.pairs}) <= RANGE_VALUES

    def cells(self, rows: DataFrame | None = None, own: dict[int, int] | None = None) -> DataFrame:
        """(pair, g, x, n) of all pairs, a value in several cells if it meets several other groups. Of rows of units that
        `own` names for the pairs instead, with their other columns."""
        rows, own = (self.counts, {i: u for i, (u, _) in enumerate(self.pairs)}) if rows is None else (rows, own)
        cells = F.array(*(F.when(F.col("unit") == u, F.struct(F.lit(i).alias("pair"), F.col(f"g{self.pairs[i][1]}").alias("g"))) for i, u in own.items()))
        rest = [c for c in rows.columns if c != "unit" and not re.fullmatch(r"g\d+", c)]
        return rows.select(F.explode(F.array_compact(cells)).alias("c"), *rest).select("c.pair", "c.g", *rest).filter("g is not null")


def group_counts(table: Table, pairs: list[tuple[str, str]], kept: Written) -> GroupCounts:
    """For each measure its values counted with all groups, from one read for all pairs. In large tables a number stands
    for the labels of a row while its values are counted, if there are not too many different rows of labels."""
    groups, measures = (list(dict.fromkeys(side)) for side in zip(*pairs, strict=True))
    labels = [f"g{i}" for i in range(len(groups))]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("unit"), F.col(f"x{k}").alias("x")) for k in range(len(measures))))).alias("c")
    named = table.frame.select(*(label(col(g), table.kind(g)).alias(a) for g, a in zip(groups, labels, strict=True)), *(num(col(m), table.kind(m)).alias(f"x{k}") for k, m in enumerate(measures)))
    known = None
    if not is_small(table.frame):
        known = kept.put("labels", named.groupBy(*labels).agg(F.monotonically_increasing_id().alias("id")), n=F.count("*"))
    if known is not None and kept.told["labels"]["n"] <= GIVEN_VALUES:
        other = known.select("id", *(F.col(a).alias(f"_{a}") for a in labels))
        same = reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(f"_{a}")) for a in labels))
        rows = named.join(F.broadcast(other), same).select("id", values).select("id", "c.*").filter("x is not null")
        counts = rows.groupBy("unit", "x", "id").agg(F.count("*").alias("n")).join(F.broadcast(known), "id").select("unit", "x", *labels, "n")
    else:
        rows = named.select(*labels, values).select("c.unit", "c.x", *labels).filter("x is not null")
        counts = rows.groupBy("unit", "x", *labels).agg(F.count("*").alias("n"))
    counts = kept.put("cells", counts, n=F.count("*"))
    kept.drop("labels")
    found = GroupCounts(counts, tuple((measures.index(m), groups.index(g)) for g, m in pairs), kept.told["cells"]["n"])
    if not found.few():
        found = replace(found, counts=dealt(counts, ["unit", "x"], found.rows, kept, "dealt"))
        kept.drop("cells")
    return found


def group_stats(found: GroupCounts, kept: Written) -> DataFrame:
    """(pair, g, n, mean, median, std, min, max, q1, q3, low, high, groups) of groups of at least LEAST_GROUP values; low
    and high are the furthest values within the fences, groups the number of all groups of the pair."""
    x, n, q, cells = F.col("x"), F.col("n"), F.col("q"), found.cells()
    shares, reach = [0.25, 0.5, 0.75], FENCE * (q[2] - q[0])
    inside = F.when((x >= q[0] - reach) & (x <= q[2] + reach), x)
    ends = F.min(inside).alias("low"), F.max(inside).alias("high"), F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares")
    if found.few():  # one shuffle for everything that looks at a group
        own = Window.partitionBy("pair", "g")
        middle = F.when(F.min("x").over(own) == F.max("x").over(own), F.min("x").over(own)).otherwise(F.sum(x * n).over(own) / F.sum("n").over(own))
        met = cells.withColumns({"q": F.percentile("x", F.array(*map(F.lit, shares)), n).over(own), "mean": middle})
        told = met.groupBy("pair", "g").agg(F.sum("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), *ends, F.first("q").alias("q"), F.first("mean").alias("mean"))
        told = told.withColumn("groups", F.count("*").over(Window.partitionBy("pair"))).filter(n >= LEAST_GROUP)
    else:
        cells = cells.withColumnRenamed("n", "__n")
        parts = kept.put("parts", cells.groupBy("__range", "pair", "g").agg(F.sum("__n").alias("__n"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum(x * F.col("__n")).alias("sum")))
        mean = F.when(F.min("min") == F.max("max"), F.min("min")).otherwise(F.sum("sum") / F.sum("__n"))
        told = parts.groupBy("pair", "g").agg(F.sum("__n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"))
        told = told.withColumn("groups", F.count("*").over(Window.partitionBy("pair"))).filter(n >= LEAST_GROUP)
        told = kept.put("groups", told.join(quantiles_of_ranges(cells, parts, ["pair", "g"], "x", shares), ["pair", "g"]))
        cells = cells.withColumnRenamed("__n", "n")
        told = told.join(cells.join(told.select("pair", "g", "mean", "q"), ["pair", "g"]).groupBy("pair", "g").agg(*ends), ["pair", "g"])
    std = F.sqrt(F.col("squares") / (n - 1)).alias("std")
    return told.select("pair", "g", "n", "mean", q[1].alias("median"), std, "min", "max", q[0].alias("q1"), q[2].alias("q3"), "low", "high", "groups")


def _ranked_cells(found: GroupCounts, pairs: list[int], kept_by: Callable[[int], Column]) -> DataFrame:
    """The cells of the pairs with rank and __n, the rows of their value."""
    mine = {i: (F.col("unit") == found.pairs[i][0]) & F.coalesce(kept_by(i), F.lit(False)) for i in pairs}
    lost = found.counts.agg(*(F.count_if((F.col("unit") == found.pairs[i][0]) & ~F.coalesce(kept_by(i), F.lit(False))).alias(f"p{i}") for i in pairs)).first()
    units = 1 + max((u for u, _ in found.pairs), default=0)
    own = {i: units + i if lost[f"p{i}"] else found.pairs[i][0] for i in pairs}
    # Each row in its measure's ranks where a pair takes all rows, and in those of the pairs that take some.
    rules = {u: F.lit(False) for u in own.values()}
    for i, u in own.items():
        rules[u] = rules[u] | mine[i]
    parts = F.array_compact(F.array(*(F.when(rule, F.lit(u)) for u, rule in rules.items())))
    rows = found.counts.withColumn("unit", F.explode(parts))
    sums = rows.groupBy("unit", "__range").agg(F.sum("n").alias("__sum"))
    by_value = Window.partitionBy("__range", "unit").orderBy("x")
    tie, upto = (F.sum("n").over(by_value.rangeBetween(a, 0)) for a in (0, Window.unboundedPreceding))
    met = rows.withColumns({"__n": tie, "__upto": upto}).join(sums.select("unit", "__range", before_range("__sum", ["unit"]).alias("__base")), ["unit", "__range"])
    return found.cells(met.withColumn("rank", F.col("__base") + F.col("__upto") - (F.col("__n") - 1) / 2.0).drop("__base", "__upto", "__range"), own)


def kruskal(found: GroupCounts, kept: Written, large: dict[int, list[str]] | None = None) -> dict[int, tuple[float, float, float | None]]:
    """For each pair H with tie correction, its p-value, and the effect (H - k + 1) / (n - k) within 0 and 1, over the
    groups in `large` if these are given; pairs whose values are all equal, or that have one group, are left out.

    Pairs whose groups take no row of a measure away share its ranks."""
    pairs = list(range(len(found.pairs)) if large is None else large)
    kept_by = lambda i: F.col(f"g{found.pairs[i][1]}").isNotNull() if large is None else F.col(f"g{found.pairs[i][1]}").isin(large[i])
    if not pairs:
        return {}
    if found.few():
        mine = reduce(lambda a, b: a | b, ((F.col("pair") == i) if large is None else (F.col("pair") == i) & F.col("g").isin(large[i]) for i in pairs))
        by_value = Window.partitionBy("pair").orderBy("x")
        tie, upto = (F.sum("n").over(by_value.rangeBetween(a, 0)) for a in (0, Window.unboundedPreceding))
        met = found.cells().filter(mine).withColumns({"__n": tie, "rank": upto - (tie - 1) / 2.0})
    else:
        met = _ranked_cells(found, pairs, kept_by)
    tied = F.col("n") * (F.col("__n").cast("double") * F.col("__n") - 1)  # adds up to t^3 - t over a value's groups
    groups = met.groupBy("pair", "g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("s"), F.sum(tied).alias("t"))
    sums = groups.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("s"), F.sum("t").alias("t")).collect()
    out = {}
    for r in sums:
        n, k = r["n"], r["k"]
        spread = 1 - r["t"] / (float(n) ** 3 - n) if n > 1 else 0
        if k >= 2 and spread > 0:
            h = (12 / (n * (n + 1)) * r["s"] - 3 * (n + 1)) / spread
            out[r["pair"]] = (h, survival(h, k - 1), min(1.0, max(0.0, (h - k + 1) / (n - k))) if n > k else None)
    return out


def compare_pairs(table: Table, pairs: list[tuple[str, str]]) -> list[Comparison]:
    """How numbers differ across groups; pairs with fewer than two groups of LEAST_GROUP values give none."""
    if not pairs:
        return []
    with Written(table.frame.sparkSession, "compare") as kept:
        counts = group_counts(table, pairs, kept)
        found: dict[int, list] = {}
        seen = {}
        for r in group_stats(counts, kept).collect():
            found.setdefault(r["pair"], []).append(GroupStats(*r[1:-1]))
            seen[r["pair"]] = r["groups"]
        found = {i: sorted(g, key=lambda s: (-s.mean, s.group)) for i, g in found.items() if len(g) > 1}
        if not found:
            return []
        effects = kruskal(counts, kept, {i: [s.group for s in g] for i, g in found.items()})
    return [Comparison(*pairs[i], tuple(found[i]), seen[i] - len(found[i]), *effects.get(i, (None, None, None))) for i in sorted(found)]


def compare(table: Table, group: str, measure: str) -> Comparison | None:
    return next(iter(compare_pairs(table, [(group, measure)])), None)


def compare_all(table: Table, groups: list[str], measures: list[str]) -> list[Comparison]:
    """Every group column against every measure, the largest effects first."""
    return sorted(compare_pairs(table, [(g, m) for g in groups for m in measures]), key=lambda c: -(c.effect or 0.0))
