"""A number over time: regular periods, trend, steadiness, largest change, seasons."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, moment, num
from ..scratch import Written
from ..table import Table
from .selection import is_small, quantiles

#: How periods are chosen and changes judged.
DAILY_DAYS, WEEKLY_DAYS = 400, 2800
DAY_GAP, WEEK_GAP = 1, 7
FLAT, LEAST_POINTS = 0.05, 3
SEASON_POINTS = {"D": 14, "W": 104, "MS": 24}
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
STEPS = {"D": "interval 1 day", "W": "interval 7 days", "MS": "interval 1 month"}


@dataclass(frozen=True)
class Change:
    before: dt.datetime
    after: dt.datetime
    difference: float
    ratio: float | None


@dataclass(frozen=True)
class Season:
    cycle: str
    strength: float
    strongest: str
    weakest: str


@dataclass(frozen=True)
class Timeline:
    time: str
    measure: str
    rule: str
    points: tuple[tuple[dt.datetime, float | None], ...]
    n: int
    direction: str
    change_ratio: float | None
    slope: float
    monotonicity: float | None
    largest: Change | None
    season: Season | None


def period(t: Column, rule: str) -> Column:
    """The day, the Sunday that ends the week, or the first of the month."""
    if rule == "W":
        return F.date_add(F.date_trunc("week", t), 6).cast("timestamp_ntz")
    return F.date_trunc({"D": "day", "MS": "month"}[rule], t).cast("timestamp_ntz")


def choose_rule(span_days: float, gap_days: float) -> str:
    rules = ("D", "W", "MS")
    by_span = 0 if span_days <= DAILY_DAYS else 1 if span_days <= WEEKLY_DAYS else 2
    by_gap = 0 if gap_days <= DAY_GAP else 1 if gap_days <= WEEK_GAP else 2
    return rules[max(by_span, by_gap)]


def typical_gaps(rows: DataFrame) -> DataFrame:
    """(measure, gap): the median difference in microseconds of neighbouring distinct moments. Moments are dealt out by
    month; between months only the first and last count, a row for each. Those of a small scan are gone through at once."""
    micros = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    if is_small(rows):
        gap = micros(F.col("t")) - micros(F.lag("t").over(Window.partitionBy("measure").orderBy("t")))
        return rows.select("measure", "t").distinct().select("measure", gap.alias("gap")).groupBy("measure").agg(F.percentile("gap", 0.5).alias("gap"))
    moments = rows.select("measure", "t").distinct().withColumn("month", F.date_trunc("month", "t"))
    inside = moments.select("measure", (micros(F.col("t")) - micros(F.lag("t").over(Window.partitionBy("measure", "month").orderBy("t")))).alias("gap"))
    ends = moments.groupBy("measure", "month").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    between = ends.select("measure", (micros(F.col("first")) - micros(F.lag("last").over(Window.partitionBy("measure").orderBy("month")))).alias("gap"))
    return quantiles(inside.unionByName(between), ["measure"], "gap", [0.5]).select("measure", F.col("q")[0].alias("gap"))


def resampled(rows: DataFrame, rule: str) -> DataFrame:
    """(period, value) for every period from the first to the last: means, null where nothing was measured."""
    means = rows.select(period(F.col("t"), rule).alias("period"), "x").groupBy("period").agg(F.avg("x").alias("value"))
    spine = means.agg(F.min("period").alias("a"), F.max("period").alias("b")).filter("a is not null").select(F.explode(F.expr(f"sequence(a, b, {STEPS[rule]})")).alias("period"))
    return spine.join(means, "period", "left")


def periods(first: dt.datetime, last: dt.datetime, rule: str) -> list[dt.datetime]:
    """Every period from the first to the last."""
    if rule == "MS":
        months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
        return [dt.datetime(m // 12, m % 12 + 1, 1) for m in months]
    step = dt.timedelta(days=7 if rule == "W" else 1)
    return [first + step * k for k in range((last - first) // step + 1)]


def time_rows(table: Table, time: str, measures: list[str]) -> DataFrame:
    """(measure, t, x) of all rows that have both, all measures from one read."""
    cells = F.array(*(F.struct(F.lit(m).alias("measure"), num(col(m), table.kind(m)).alias("x")) for m in measures))
    rows = table.frame.select(moment(col(time), table.kind(time)).alias("t"), F.explode(cells).alias("c"))
    return rows.select("c.measure", "t", "c.x").filter("t is not null and x is not null")


def _summed(table: Table, time: str, measures: list[str], kept: Written) -> DataFrame:
    """(measure, t, n, s): how many values each measure has at each moment, and their sum. The table is read once, a row
    is not multiplied by its measures, and moments of large tables are written for all that looks at them."""
    cells = [num(col(m), table.kind(m)).alias(f"x{i}") for i, m in enumerate(measures)]
    rows = table.frame.select(moment(col(time), table.kind(time)).alias("t"), *cells).filter("t is not null")
    sums = rows.groupBy("t").agg(*(x for i in range(len(measures)) for x in (F.count(f"x{i}").alias(f"n{i}"), F.sum(f"x{i}").alias(f"s{i}"))))
    sums = sums if is_small(sums) else kept.put("moments", sums)
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i, m in enumerate(measures)))
    return sums.select("t", F.explode(parts).alias("c")).select("c.measure", "t", "c.n", "c.s").filter("n > 0")


def _ranks(values: list[float]) -> list[float]:
    order = sorted(range(len(values)), key=values.__getitem__)
    out, k = [0.0] * len(values), 0
    while k < len(order):
        j = k
        while j + 1 < len(order) and values[order[j + 1]] == values[order[k]]:
            j += 1
        for i in range(k, j + 1):
            out[order[i]] = (k + j) / 2 + 1
        k = j + 1
    return out


def _pearson(a: list[float], b: list[float]) -> float | None:
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    top = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True))
    size = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    return top / size if size else None


def monotonicity(values: list[float]) -> float | None:
    """Rank correlation of values with their place; none under three or if all are equal."""
    return _pearson([float(k) for k in range(len(values))], _ranks(values)) if len(values) >= LEAST_POINTS else None


def largest_change(points: list[tuple[dt.datetime, float]]) -> Change | None:
    steps = [(b[1] - a[1], a, b) for a, b in zip(points, points[1:], strict=False)]
    if not steps:
        return None
    difference, a, b = max(steps, key=lambda s: abs(s[0]))
    return Change(a[0], b[0], difference, difference / abs(a[1]) if a[1] else None)


def season(points: list[tuple[dt.datetime, float]], rule: str) -> Season | None:
    """The share of the variance that weekdays (daily periods) or months explain."""
    if len(points) < SEASON_POINTS[rule]:
        return None
    name = (lambda t: DAYS[t.weekday()]) if rule == "D" else (lambda t: MONTHS[t.month - 1])
    groups: dict[str, list[float]] = {}
    for t, v in points:
        groups.setdefault(name(t), []).append(v)
    values = [v for _, v in points]
    mean = sum(values) / len(values)
    total = sum((v - mean) ** 2 for v in values)
    if not total or len(groups) < 2:
        return None
    means = {g: sum(v) / len(v) for g, v in groups.items()}
    between = sum(len(v) * (means[g] - mean) ** 2 for g, v in groups.items())
    ordered = sorted(means)
    return Season("day of the week" if rule == "D" else "month of the year", min(1.0, max(0.0, between / total)), max(ordered, key=means.__getitem__), min(ordered, key=means.__getitem__))


def trend(values: list[float]) -> tuple[str, float | None, float]:
    """Direction, change from the first to the last quarter as a share, and slope for each period."""
    n = len(values)
    width = max(1, n // 4)
    first, last = sum(values[:width]) / width, sum(values[-width:]) / width
    middle, mean = (n - 1) / 2, sum(values) / n
    slope = sum((k - middle) * (v - mean) for k, v in enumerate(values)) / sum((k - middle) ** 2 for k in range(n))
    ratio = (last - first) / abs(first) if first else None
    lead = slope if ratio is None else ratio
    if (ratio is not None and abs(ratio) < FLAT) or lead == 0:
        return "flat", ratio, slope
    return ("up" if lead > 0 else "down"), ratio, slope


def timeline(table: Table, time: str, measure: str) -> Timeline | None:
    return next(iter(_timelines(table, time, [measure])), None)


def _timelines(table: Table, time: str, measures: list[str]) -> list[Timeline]:
    with Written(table.frame.sparkSession, "timelines") as kept:
        return _followed(_summed(table, time, measures, kept), time)


def _followed(rows: DataFrame, time: str) -> list[Timeline]:
    """The regular series of each measure and what it shows; none under three values or three periods that have any. What
    comes to the driver is the periods: some hundred days or weeks, or the months of the whole span."""
    spans = rows.groupBy("measure").agg(F.sum("n").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    told = {r["measure"]: r for r in spans.join(typical_gaps(rows), "measure", "left").collect() if r["n"] >= LEAST_POINTS}
    rules = {m: choose_rule((r["b"] - r["a"]).total_seconds() / 86_400, (r["gap"] or 0) / 86_400_000_000) for m, r in told.items()}
    means: dict[str, dict] = {m: {} for m in rules}
    if rules:
        own = F.lit(None).cast("timestamp_ntz")
        for rule in set(rules.values()):
            own = F.when(F.col("measure").isin([m for m, r in rules.items() if r == rule]), period(F.col("t"), rule)).otherwise(own)
        for r in rows.withColumn("period", own).filter("period is not null").groupBy("measure", "period").agg((F.sum("s") / F.sum("n")).alias("value")).collect():
            means[r["measure"]][r["period"]] = r["value"]
    out = []
    for m, rule in rules.items():
        own = [(t, means[m].get(t)) for t in periods(min(means[m]), max(means[m]), rule)]
        seen = [p for p in own if p[1] is not None]
        if len(seen) >= LEAST_POINTS:
            values = [v for _, v in seen]
            direction, ratio, slope = trend(values)
            out.append(Timeline(time, m, rule, tuple(own), told[m]["n"], direction, ratio, slope, monotonicity(values), largest_change(seen), season(seen, rule)))
    return out


def timelines(table: Table, times: list[str], measures: list[str]) -> list[Timeline]:
    """All measures over the first moment column, the largest changes first."""
    made = _timelines(table, times[0], measures) if times and measures else []
    return sorted(made, key=lambda t: -abs(t.change_ratio or 0.0))
