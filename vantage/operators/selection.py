"""Exact quantiles by selection and average ranks by prefix sums: no task holds or sorts all values of a group."""

from __future__ import annotations

import bisect
import itertools
import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Written

#: Classes that a pass counts in all, and in one range at most.
PASS_CLASSES, CLASSES = 1 << 16, 4096
#: A range with no more rows than this is fetched instead of being split again.
FETCHED = 10_000
#: So many groups' quantiles are selected by digits at most; beyond, they are told by ranks.
SELECTED_GROUPS = 1000
#: One task ranks this many distinct values, and holds the values of one group up to this many.
RANGE_VALUES, GROUP_VALUES = 2_000_000, 200_000
#: Fewer rows than this are not dealt out in ranges, others in so many ranges for each core if these have rows enough.
UNDEALT, LEAST_RANGE, CORE_RANGES = 100_000, 20_000, 8
#: Rows that one task sorts in the end, rows of a sample, and characters of a text that a cut looks at.
AT_ONCE, SAMPLED, HEAD = 2_000_000, 20_000, 64
#: Scans whose estimated size is no larger hold no group with more distinct values than one task takes.
SMALL_SCAN = 32 << 20


def places(total: int, share: float) -> list[tuple[int, float]]:
    """The neighbours (from 0) whose weighted sum is the quantile of so many values."""
    at = share * (total - 1)
    low, high = math.floor(at), math.ceil(at)
    return [(low, 1.0)] if low == high else [(low, high - at), (high, at - low)]


def _bent(x: Column) -> Column:
    """A number that rises with x and spreads the powers of two evenly, negative ones, 0 and positive ones apart."""
    return F.coalesce(F.signum(x) * (F.log2(F.abs(x)) + 1080), F.lit(0.0))


def _bent_number(x: float) -> float:
    """_bent() of a number."""
    return math.copysign(math.log2(abs(x)) + 1080, x) if x else 0.0


def _is_even(low: float, high: float) -> bool:
    """Whether classes of equal width suit a range."""
    near = low * high > 0 and max(abs(low), abs(high)) <= 4 * min(abs(low), abs(high))
    return near or (low == 0 and high <= CLASSES)


def _class(x: Column, low: float, high: float, classes: int) -> Column:
    """The class of a value between low and high, never falling as it rises: of equal width where both have about one
    size, else of equal width in powers of two."""
    if _is_even(low, high):
        width = (high / 2 - low / 2) / classes
        place = (x / 2 - low / 2) / width if width else F.lit(0.0)
    else:
        a, b = _bent(F.lit(low)), _bent(F.lit(high))
        place = (_bent(x) - a) / ((b - a) / classes)
    return F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(classes - 1)).cast("int")


def select_quantiles(
    frame: DataFrame, columns: Sequence[Column], shares: Sequence[Sequence[float]], rows: Column | None = None, ends: Sequence[tuple] | None = None
) -> list[list[float] | None]:
    """The exact quantiles of each column's values (double or null), of none where it has none; rows tells how many rows
    a row stands for, ends each column's number of rows, least and largest value, if these are known.

    Selection by digits: a pass counts the values in classes between the range's ends, for all columns and shares at
    once, and the class that holds a wanted place is the next range. A range spans 64 bits at the most, which some six
    passes of 12 bits exhaust, and one with few rows is fetched. Nothing is shuffled but counts of classes."""
    n = F.lit(1) if rows is None else rows
    if ends is None:
        ends = frame.agg(*(F.struct(F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0)), F.min(x), F.max(x)) for x in columns)).first() if columns else ()
    wanted = {i: [places(ends[i][0], s) for s in own] for i, own in enumerate(shares) if ends[i][0]}
    found: dict[tuple[int, int], float] = {}
    # Where each wanted place is: in a range (column, low, high) with so many rows, at that place within it.
    open_: dict[tuple[int, int], tuple[tuple[int, float, float], int, int]] = {}
    for i, own in wanted.items():
        for k in {k for spots in own for k, _ in spots}:
            size, low, high = ends[i]
            open_[i, k] = ((i, low, high), size, k)
    while open_:
        for key, (span, _, _) in list(open_.items()):
            if span[1] == span[2]:
                found[key] = span[1]
                del open_[key]
        few = {span for span, size, _ in open_.values() if size <= FETCHED}
        ranges = sorted({span for span, _, _ in open_.values()})
        classes = max(2, min(CLASSES, PASS_CLASSES // max(1, len(ranges))))
        for at in range(0, len(ranges), 100):
            part = ranges[at : at + 100]
            counted = _counted_classes(frame, columns, n, part, few, classes)
            for key, (span, _, k) in list(open_.items()):
                if span in counted:
                    upto, spans = counted[span]
                    j = bisect.bisect_right(upto, k)
                    low, high = spans[j]
                    before = upto[j - 1] if j else 0
                    open_[key] = ((span[0], low, high), upto[j] - before, k - before)
    return [[sum(found[i, k] * w for k, w in spots) for spots in wanted[i]] if i in wanted else None for i in range(len(columns))]


def _counted_classes(frame: DataFrame, columns: Sequence[Column], n: Column, ranges: list[tuple[int, float, float]], few: set, classes: int) -> dict[tuple[int, float, float], tuple[list[int], list[tuple[float, float]]]]:
    """For each range the running numbers of rows of its classes and the values each class lies between; the classes of
    a range with few rows are its values."""
    cells = []
    for r, span in enumerate(ranges):
        x = columns[span[0]]
        c = F.lit(0) if span in few else _class(x, span[1], span[2], classes)
        own = F.struct(F.lit(r).alias("r"), c.alias("c"), (x if span in few else F.lit(None).cast("double")).alias("v"), x.alias("x"), n.alias("n"))
        cells.append(F.when((x >= span[1]) & (x <= span[2]), own))
    rows = frame.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).groupBy("s.r", "s.c", "s.v")
    told = rows.agg(F.sum("s.n").alias("n"), F.min("s.x").alias("a"), F.max("s.x").alias("b")).collect()
    out: dict = {}
    for r, group in itertools.groupby(sorted(told, key=lambda t: (t["r"], t["a"])), key=lambda t: t["r"]):
        own = list(group)
        out[ranges[r]] = (list(itertools.accumulate(t["n"] for t in own)), [(t["a"], t["b"]) for t in own])
    return out


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, __n) of the values that are no gaps."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))


def dealt(rows: DataFrame, by: list[str], size: int, kept: Written, key: str) -> DataFrame:
    """The rows (so many) with __range, written: ranges of the sort keys, rows of equal keys in one. No range has many
    more than RANGE_VALUES rows, and there are enough of them for all cores."""
    ranges = max(-(-size // RANGE_VALUES), min(rows.sparkSession.sparkContext.defaultParallelism * CORE_RANGES, -(-size // LEAST_RANGE)), 1)
    return kept.put(key, rows.repartitionByRange(ranges, *by).withColumn("__range", F.spark_partition_id()))  # the numbers must not change any more


def before_range(column: str, keys: list[str]) -> Column:
    """Of sums for each range: the sum of the ranges before it, of the same keys."""
    own = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(own), F.lit(0))


def placed(counts: DataFrame, keys: list[str], value: str, kept: Written | None = None, at_most: int | None = None, columns: Sequence[str] = ("__n",), names: Sequence[str] = ("__before",)) -> DataFrame:
    """The counts with __before: how many rows (__n) of the same keys have a smaller value; or several such sums at once,
    `names` of `columns`.

    Counts are sorted in as many ranges as their number asks for, of all keys and values, and a range's places start
    behind the sums of those before it. Where that number is small (at_most, if that is known), one range does."""
    kept, first = kept or Written(counts.sparkSession, "places"), counts
    if at_most is None or at_most > min(RANGE_VALUES, UNDEALT):
        first = kept.put("counts", counts, n=F.count("*"))
        at_most = kept.told["counts"]["n"]
    inside = lambda own: [F.coalesce(F.sum(c).over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in columns]
    if at_most <= min(RANGE_VALUES, UNDEALT):
        return first.withColumns(dict(zip(names, inside(Window.partitionBy(*keys)), strict=True)))
    rows = dealt(first, [*keys, value], at_most, kept, "ranges")
    kept.drop("counts")
    sums = rows.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__sum{i}") for i, c in enumerate(columns)))
    sums = sums.select(*keys, "__range", *(before_range(f"__sum{i}", keys).alias(f"__base{i}") for i in range(len(columns))))
    met = rows.withColumns(dict(zip(names, inside(Window.partitionBy("__range", *keys)), strict=True))).join(sums, [*keys, "__range"])
    return met.select(*counts.columns, *((F.col(f"__base{i}") + F.col(n)).alias(n) for i, n in enumerate(names)))


def ranked_values(counts: DataFrame, keys: list[str], value: str, kept: Written | None = None, at_most: int | None = None) -> DataFrame:
    """(keys, value, __n, rank): the average rank of each value within its keys."""
    return placed(counts, keys, value, kept, at_most).select(*keys, value, "__n", (F.col("__before") + (F.col("__n") + 1) / 2.0).alias("rank"))


def estimated_bytes(rows: DataFrame) -> int:
    """Catalyst's estimate; without statistics it is huge."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(rows: DataFrame) -> bool:
    """Whether Catalyst's estimate of the rows is small; without statistics it is huge."""
    return estimated_bytes(rows) <= SMALL_SCAN


Order = Sequence[tuple[str, bool]]


def _cut_keys(frame: DataFrame, order: Order, widest: Sequence[int | None]) -> list[tuple[Column, bool]]:
    """The sort keys as values that a literal can be compared with. A text counts by its head; where that doesn't tell
    all texts of the key, the keys behind it tell nothing either and are left out."""
    keys: list[tuple[Column, bool]] = []
    for (name, up), longest in zip(order, widest, strict=True):
        c, kind = F.col(name), frame.schema[name].dataType
        if isinstance(kind, T.StructType):
            keys += [(c[f], up) for f in kind.fieldNames()]
        elif isinstance(kind, T.StringType):
            keys.append((F.substring(c, 1, HEAD), up))
            if (longest or 0) > HEAD:
                break
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            keys.append((F.unix_micros(c.cast("timestamp_ltz")), up))
        else:
            keys.append((F.unix_date(c) if isinstance(kind, T.DateType) else c, up))
    return keys


def _upto(keys: list[tuple[Column, bool]], cut: Sequence[object]) -> Column:
    """Whether a row comes no later than the cut; gaps come last."""
    out = F.lit(True)
    for (key, up), at in reversed(list(zip(keys, cut, strict=True))):
        earlier = key.isNotNull() if at is None else F.coalesce(key < F.lit(at) if up else key > F.lit(at), F.lit(False))
        out = earlier | (key.eqNullSafe(F.lit(at)) & out)
    first, at = keys[0], cut[0]
    if at is None:
        return out
    return (first[0] <= F.lit(at) if first[1] else first[0] >= F.lit(at)) & out  # alone, so that the scan can use it


def nearly_first(frame: DataFrame, order: Order, count: int, at_once: int | None = None) -> DataFrame:
    """The rows up to a cut behind the first `count` rows in that order: all of these and not many more, so that sorting
    what is left brings no `count` rows of every task to a single one. Keys of the order tell all rows apart.

    Cuts come from a sample of the keys, and one counts only if a pass over all rows finds enough of them up to it. What
    is left is cut again until one task can sort it. Nothing is cut where it can do so anyhow."""
    tasks = -(-estimated_bytes(frame) // (128 << 20))
    most = AT_ONCE if at_once is None else at_once
    if tasks * count <= most:
        return frame
    texts = [n for n, _ in order if isinstance(frame.schema[n].dataType, T.StringType)]
    told = frame.agg(F.count(F.lit(1)).alias("n"), *(F.max(F.length(F.col(n))).alias(f"w{k}") for k, n in enumerate(texts))).first()
    keys = _cut_keys(frame, order, [told[f"w{texts.index(n)}"] if n in texts else None for n, _ in order])
    size = told["n"]
    while size > max(most, 2 * count):
        names = [f"k{i}" for i in range(len(keys))]
        drawn = frame.sample(min(1.0, SAMPLED / size), seed=size % 1_000_003).select(*(k.alias(n) for n, (k, _) in zip(names, keys, strict=True)))
        sample = drawn.orderBy(*(F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, (_, up) in zip(names, keys, strict=True))).collect()
        expected = count * len(sample) / size
        spots = sorted({s for k in range(4) if (s := int(expected + 3 * math.sqrt(expected) + 3) << k) < len(sample)})
        found = frame.agg(*(F.count_if(_upto(keys, sample[s])) for s in spots)).first() if spots else ()
        left, spot = next(((n, s) for n, s in zip(found, spots, strict=True) if n >= count), (size, 0))
        if left > size * 0.9:
            break  # most rows lie at one value of the keys
        frame, size = frame.filter(_upto(keys, sample[spot])), left
    return frame


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], *, small: bool | None = None) -> DataFrame:
    """(keys, q): exact quantiles of the values of each key.

    Rows that small scans give are gathered by key in one shuffle. Else values are counted first; if a key has too many
    distinct ones for one task, places are told apart by ranges, and only values at wanted places are gathered."""
    spots = F.array(*map(F.lit, shares))
    if is_small(rows) if small is None else small:
        return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), spots).alias("q"))
    kept = Written(rows.sparkSession, "quantiles")
    return quantiles_of_counts(kept.put("values", counted(rows, keys, value)), keys, value, shares, kept)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, shares: list[float], kept: Written) -> DataFrame:
    """quantiles() of written values, each with its number of rows __n; a value may stand in several rows."""
    spots = F.array(*map(F.lit, shares))
    size = counts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    if (size[0] or 0) <= GROUP_VALUES and (size[1] or 0) <= RANGE_VALUES:  # what a task holds of all keys together
        return counts.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), spots, F.col("__n")).alias("q"))
    if size[2] <= SELECTED_GROUPS and isinstance(counts.schema[value].dataType, T.DoubleType):
        return _selected(counts, keys, value, shares)
    ordered = placed(counts, keys, value, kept, size[1])
    met = ordered.join(counts_total(ordered, keys), keys)
    return _quantiles_at(met.select(*keys, F.col(value).alias("__x"), F.explode(_held(_wanted(shares))).alias("s")), keys)


def _wanted(shares: list[float]) -> Column:
    """Of a key with __total rows, the places (from 0) that make up its quantiles: the quantile's number, place, weight."""
    at = lambda share: F.lit(share) * (F.col("__total") - 1)
    return F.array(*(
        F.struct(F.lit(i).alias("i"), k.alias("k"), weight.alias("w"))
        for i, share in enumerate(shares)
        for k, weight in ((F.floor(at(share)), F.when(F.floor(at(share)) == F.ceil(at(share)), 1.0).otherwise(F.ceil(at(share)) - at(share))), (F.ceil(at(share)), at(share) - F.floor(at(share))))
    ))


def _held(spots: Column) -> Column:
    """Those of the places that are among the __n behind __before."""
    return F.filter(spots, lambda s: (s["k"] >= F.col("__before")) & (s["k"] < F.col("__before") + F.col("__n")))


def _quantiles_at(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q) of the values (__x) at the wanted places (s)."""
    sums = hits.groupBy(*keys, "s.i").agg(F.sum(F.col("__x") * F.col("s.w")).alias("x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))


def quantiles_of_ranges(rows: DataFrame, parts: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q) of rows that were dealt() by value, each standing for __n rows; parts holds their sums of __n by keys and
    range. The sums tell which ranges hold wanted places, and only rows of these are sorted."""
    spots = parts.select("__range", *keys, "__n", before_range("__n", keys).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"))
    spots = spots.select("__range", *keys, F.col("__before").alias("__base"), _held(_wanted(shares)).alias("__spots")).filter(F.size("__spots") > 0)
    own = Window.partitionBy("__range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(spots, ["__range", *keys]).withColumn("__before", F.col("__base") + F.coalesce(F.sum("__n").over(own), F.lit(0)))
    return _quantiles_at(near.select(*keys, F.col(value).alias("__x"), F.explode(_held(F.col("__spots"))).alias("s")), keys)


def _selected(counts: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q) by the selection of select_quantiles(), for few keys: a pass counts the classes of the open ranges of all
    keys at once, and a class with one value or few enough rows to be fetched is settled. Only counts are shuffled."""
    spark, x, n = counts.sparkSession, F.col(value), F.col("__n")
    groups = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"), F.min(value).alias("__low"), F.max(value).alias("__high")).collect()
    own = [tuple(r[k] for k in keys) for r in groups]
    wanted = [[places(r["__total"], s) for s in shares] for r in groups]
    found: dict[tuple[int, int], float] = {}
    open_ = {(i, k): ((i, r["__low"], r["__high"]), r["__total"], k) for i, r in enumerate(groups) for spots in wanted[i] for k, _ in spots}
    head = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    while open_:
        for key, (span, _, _) in list(open_.items()):
            if span[1] == span[2]:
                found[key] = span[1]
                del open_[key]
        ranges = sorted({(span, size) for span, size, _ in open_.values()})
        if not ranges:
            break
        classes = max(2, min(CLASSES, PASS_CLASSES // len(ranges)))
        rows = []
        for r, ((i, low, high), size) in enumerate(ranges):
            even = _is_even(low, high)
            a, b = (low / 2, high / 2) if even else (_bent_number(low), _bent_number(high))
            rows.append((*own[i], r, low, high, even, size <= classes, a, (b - a) / classes))
        spans = F.broadcast(spark.createDataFrame(rows, f"{head}, __r int, __low double, __high double, __even boolean, __few boolean, __a double, __width double"))
        place = (F.when(F.col("__even"), x / 2).otherwise(_bent(x)) - F.col("__a")) / F.when(F.col("__width") != 0, F.col("__width"))
        c = F.when(F.col("__few"), 0).otherwise(F.coalesce(F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(classes - 1)), F.lit(0)))
        met = counts.join(spans, keys).filter((x >= F.col("__low")) & (x <= F.col("__high")))
        told = met.groupBy("__r", c.alias("__c"), F.when(F.col("__few"), x).alias("__v")).agg(F.sum(n).alias("__n"), F.min(x).alias("a"), F.max(x).alias("b")).collect()
        upto: dict[int, tuple[list[int], list[tuple[float, float]]]] = {}
        for r, group in itertools.groupby(sorted(told, key=lambda t: (t["__r"], t["a"])), key=lambda t: t["__r"]):
            mine = list(group)
            upto[r] = (list(itertools.accumulate(t["__n"] for t in mine)), [(t["a"], t["b"]) for t in mine])
        number = {span: r for r, (span, _) in enumerate(ranges)}
        for key, (span, _, k) in list(open_.items()):
            sums, ends = upto[number[span]]
            j = bisect.bisect_right(sums, k)
            before = sums[j - 1] if j else 0
            open_[key] = ((span[0], *ends[j]), sums[j] - before, k - before)
    out = [(*own[i], [sum(found[i, k] * w for k, w in spots) for spots in wanted[i]]) for i in range(len(own))]
    return spark.createDataFrame(out, f"{head}, q array<double>")


def counts_total(ordered: DataFrame, keys: list[str]) -> DataFrame:
    return ordered.groupBy(*keys).agg(F.sum("__n").alias("__total"))
