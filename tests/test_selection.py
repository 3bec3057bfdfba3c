"""Quantiles by selection and ranks by prefix sums, against loops, in every way they can take."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vantage.operators import profile, selection, stats
from vantage.operators.counts import count_values
from vantage.operators.dashboard import look
from vantage.scratch import Written
from vantage.sources import readers

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def quantile(values, share):
    own = sorted(values)
    return sum(own[k] * w for k, w in selection.places(len(own), share))


def spread(seed, n):
    """Values of all sizes, signs and repetitions."""
    deal = random.Random(seed)
    kinds = [
        lambda: deal.choice([-1, 1]) * 2.0 ** deal.uniform(-1070, 1020), lambda: float(deal.randrange(50)), lambda: deal.gauss(0, 1), lambda: 1e9 + deal.randrange(10**6) * 1e-7,
        lambda: deal.choice([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]),
    ]
    return [kinds[seed % len(kinds)]() for _ in range(n)]


@pytest.mark.parametrize("fetched,classes", [(2000, 1 << 16), (0, 1 << 13)])
def test_selection_equals_sorting(spark, monkeypatch, fetched, classes):
    monkeypatch.setattr(selection, "FETCHED", fetched)
    monkeypatch.setattr(selection, "PASS_CLASSES", classes)
    columns = [spread(k, 700) for k in range(5)] + [[7.5] * 700, [None] * 700]
    rows = [tuple(None if c[i] is None or (i + k) % 11 == 0 else c[i] for k, c in enumerate(columns)) for i in range(700)]
    frame = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(len(columns))))
    got = selection.select_quantiles(frame, [F.col(c) for c in frame.columns], [SHARES] * len(columns))
    for k, own in enumerate(got):
        there = [r[k] for r in rows if r[k] is not None]
        assert own == (pytest.approx([quantile(there, s) for s in SHARES], rel=1e-12) if there else None)


def test_selection_of_weighted_values_and_of_nothing(spark):
    frame = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4), (None, 5)], "x double, n int")
    assert selection.select_quantiles(frame, [F.col("x")], [SHARES], F.col("n")) == [[quantile([1.0] * 3 + [2.0] + [9.0] * 4, s) for s in SHARES]]
    assert selection.select_quantiles(frame.limit(0), [F.col("x"), F.col("x")], [[0.5], []]) == [None, None]
    assert selection.select_quantiles(frame, [], []) == []


@pytest.mark.parametrize("group_values,range_values,small", [(200_000, 500_000, True), (200_000, 500_000, False), (5, 500_000, False), (5, 40, False)])
def test_quantiles_of_groups_equal_sorting(spark, monkeypatch, group_values, range_values, small):
    monkeypatch.setattr(selection, "GROUP_VALUES", group_values)
    monkeypatch.setattr(selection, "RANGE_VALUES", range_values)
    deal = random.Random(group_values + range_values)
    rows = [(deal.choice("aaaaab"), deal.randrange(3), deal.choice([None, float(deal.randrange(30)), deal.gauss(0, 9)])) for _ in range(900)] + [("z", 0, None), ("y", 0, 4.0)]
    frame = spark.createDataFrame(rows, "g string, h int, x double")
    groups = defaultdict(list)
    for g, h, x in rows:
        if x is not None:
            groups[g, h].append(x)
    got = {(r.g, r.h): r.q for r in selection.quantiles(frame, ["g", "h"], "x", SHARES, small=small).collect()}
    assert got == {k: pytest.approx([quantile(v, s) for s in SHARES]) for k, v in groups.items()}


@pytest.mark.parametrize("range_values", [17, 500_000])
def test_ranks_equal_sorting(spark, monkeypatch, range_values):
    monkeypatch.setattr(selection, "RANGE_VALUES", range_values)
    deal = random.Random(range_values)
    rows = [(deal.choice("ab"), float(deal.randrange(60))) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.x): r["rank"] for r in selection.ranked_values(selection.counted(frame, ["g"], "x"), ["g"], "x").collect()}
    for (g, x), rank in got.items():
        own = [v for k, v in rows if k == g]
        assert rank == sum(v < x for v in own) + (sum(v == x for v in own) + 1) / 2


def test_ten_million_distinct_values_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_VALUES", 300_000)
    shares = [0.25, 0.5, 0.99]
    for n in (10_000_000, 1_000_000):
        frame = spark.range(n).select(F.lit("one").alias("g"), ((F.col("id") * 7_368_787 % n) / 7).alias("x"))
        want = [math.fsum(k / 7 * w for k, w in selection.places(n, s)) for s in shares]
        assert selection.select_quantiles(frame, [F.col("x")], [shares])[0] == pytest.approx(want)
    assert selection.quantiles(frame, ["g"], "x", shares, small=False).first()["q"] == pytest.approx(want)  # four ranges


def test_small_scans_are_told_by_statistics(spark):
    assert selection.is_small(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_totalprice"))
    assert not selection.is_small(spark.range(10**9).select("id"))


def test_pair_sums_of_many_columns_in_one_read(spark):
    deal = random.Random(3)
    rows = [tuple(None if deal.random() < 0.1 else deal.gauss(k, 1 + k) + (deal.gauss(0, 1) if k % 3 else 0) for k in range(200)) for _ in range(300)]
    frame = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(200)))
    got = stats.pair_sums(frame, [float(k) for k in range(200)])
    assert len(got) == 200 * 199 // 2
    for a, b in [(0, 1), (5, 77), (198, 199), (3, 150)]:
        both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        n, ma, mb = len(both), sum(x for x, _ in both) / len(both), sum(y for _, y in both) / len(both)
        want = sum((x - ma) * (y - mb) for x, y in both) / math.sqrt(sum((x - ma) ** 2 for x, _ in both) * sum((y - mb) ** 2 for _, y in both))
        assert got[a, b][0] == n and stats._pearson(*got[a, b]) == pytest.approx(want)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1.0, "a")] * 3, [(float(k % 7), "xy"[k % 2]) for k in range(50)] + [(None, "x")] * 4])
def test_repeated_rows_by_hashes(spark, rows):
    table = readers.of_frame(spark.createDataFrame(rows, "v double, g string"))
    assert profile.duplicate_rows(table) == len(rows) - len(set(rows))


def test_repeated_rows_whose_hashes_are_all_equal(spark, monkeypatch):
    monkeypatch.setattr(profile.F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    rows = [(float(k % 5), None) for k in range(12)] + [(None, "x"), ("7", None)][:1]
    assert profile.duplicate_rows(readers.of_frame(spark.createDataFrame(rows, "v double, g string"))) == len(rows) - len(set(rows))


def test_counts_of_all_kinds_of_columns(spark):
    rows = [(2**60 + k % 2, k % 3 / 4, "ab "[k % 3], k % 2 == 0, None) for k in range(12)]
    table = readers.of_frame(spark.createDataFrame(rows, "whole bigint, real double, word string, truth boolean, blank string"))
    with Written(spark, "test") as kept:
        told = count_values(table, kept)
        assert {n: (r["n"], r["gaps"], r["unique"]) for n, r in told.sums.items()} == {"whole": (12, 0, 2), "real": (12, 0, 3), "word": (12, 0, 3), "truth": (12, 0, 2), "blank": (0, 12, 0)}
        values = {(told.names[r.unit], r.value, r.number, r.n) for r in told.of(["whole", "real", "truth"]).collect()}
    assert ("whole", str(2**60 + 1), float(2**60), 6) in values and ("real", None, 0.25, 4) in values and ("truth", "True", None, 6) in values


def test_a_look_takes_few_jobs_and_keeps_nothing(spark, tmp_path):
    table = readers.read_parquet(spark, "/root/testdata/sf0.001/orders.parquet")
    spark.sparkContext.setJobGroup("look", "a first look")
    try:
        assert look(table).quality.score == 100
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("look"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 40


@pytest.fixture(scope="module")
def shipped(spark, tmp_path_factory):
    """20,000 rows in several files: numbers with gaps, few and many texts, long texts with one beginning, moments."""
    where = str(tmp_path_factory.mktemp("shipped") / "t")
    k = F.col("id")
    mixed = F.xxhash64(k)
    spark.range(0, 20_000, 1, 8).select(
        k.cast("int").alias("k"), F.when(k % 5 > 0, F.pmod(mixed, F.lit(1000)) / 4).alias("x"), F.when(k % 3 > 0, F.lit("common")).otherwise(F.concat(F.lit("rare"), (k % 7).cast("string"))).alias("few"),
        F.md5(k.cast("string")).alias("many"), F.concat(F.repeat(F.lit("p"), F.lit(80)), F.md5(k.cast("string"))).alias("long"),
        F.timestamp_seconds(F.pmod(mixed, F.lit(10**9))).cast("timestamp_ntz").alias("t"), F.pmod(mixed, F.lit(400)).cast("decimal(9,2)").alias("d"), (k % 2 == 0).alias("b"),
    ).write.parquet(where)
    return profile.understood(readers.read_parquet(spark, where))


def first_of(table, steps, count, **limit):
    from vantage.plans import recipe

    out = recipe.run(table, recipe.parse({"steps": [*steps, {"op": "limit_rows", "count": count, **limit}]}))
    assert out.refusal is None
    return out.table, [r["k"] for r in out.table.ordered().collect()]


@pytest.mark.parametrize("columns,order", [([], "asc"), (["x"], "asc"), (["x"], "desc"), (["few"], "asc"), (["few"], "desc"), (["many"], "asc"), (["long"], "desc"), (["t"], "desc"), (["d", "x"], "asc"), (["b"], "desc")])
@pytest.mark.parametrize("count", [1, 300, 30_000])
def test_limit_by_a_cut(spark, shipped, monkeypatch, columns, order, count):
    """The first rows in every order, gaps and ties too, are those of a plain sort."""
    steps = [{"op": "sort_rows", "columns": columns, "order": order}] if columns else []
    _, plain = first_of(shipped, steps, count)
    monkeypatch.setattr(selection, "AT_ONCE", 0)
    monkeypatch.setattr(selection, "SAMPLED", 900)
    assert first_of(shipped, steps, count)[1] == plain and len(plain) == min(count, 20_000)


def test_sample_by_a_cut(spark, shipped, monkeypatch):
    _, plain = first_of(shipped, [], 250, method="sample", seed=3)
    monkeypatch.setattr(selection, "AT_ONCE", 500)
    assert first_of(shipped, [], 250, method="sample", seed=3)[1] == plain
    assert first_of(shipped, [], 600, method="sample", seed=3, key="many")[1] != plain


def test_cut_leaves_few_rows(spark, shipped, monkeypatch):
    """What is sorted in the end is near the wanted number, one value for a third of all rows or not."""
    for order in ([("k", False)], [("few", True), ("__row", True)], [("x", True), ("__row", True)], [("__row", True)]):
        near = selection.nearly_first(shipped.frame, order, 400, at_once=300)
        assert 400 <= near.count() <= 1600
    assert selection.nearly_first(shipped.frame, [("k", True)], 400) is shipped.frame


def test_cut_reaches_the_scan(spark, shipped):
    near = selection.nearly_first(shipped.frame, [("k", True)], 400, at_once=300)
    assert "LessThanOrEqual(k," in near._jdf.queryExecution().executedPlan().toString()
