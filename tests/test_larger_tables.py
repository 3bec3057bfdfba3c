"""Queries and operators on tables beyond the sizes that one chart, task or group holds."""

import tracemalloc

import numpy as np
import pytest
from oracle import assert_equal, tables
from pyspark.sql import functions as F

from vantage import look_queries, queries
from vantage.llm import collocations, language_id
from vantage.operators import profile, quality, selection, stats, timeline
from vantage.operators import counts as counting
from vantage.scratch import Written
from vantage.sources.readers import of_frame

TINY = "/root/testdata/sf0.001"


def test_scatter_gives_more_points_than_a_chart_holds(spark, tmp_path):
    one = spark.read.parquet(f"{TINY}/supplier.parquet")
    many = one.crossJoin(spark.range(2500).select(F.col("id").alias("i"))).withColumn("s_suppkey", F.col("s_suppkey") + F.col("i") * 100_000)
    many.drop("i").write.parquet(str(tmp_path / "supplier.parquet"))
    (tmp_path / "sql").mkdir()
    many.drop("i").toPandas().to_parquet(tmp_path / "sql" / "supplier.parquet")
    base = tables(str(tmp_path / "sql"))
    assert_equal(spark, base, queries.QUERIES["chart_scatter"], queries.ORACLE_SQL["chart_scatter"], str(tmp_path))


def grouped(spark):
    """Two groupings, one with gaps and a group of two rows, and two measures, one with gaps."""
    return of_frame(spark.range(6000).selectExpr(
        "if(id % 10 = 0, null, if(id in (1, 2), 'few', concat('a', id % 3))) as a", "concat('b', id % 4) as b", "cast(id * id % 311 as double) - 60 as x", "if(id % 7 = 0, null, id * 37 % 5003 / 8) as y"
    ))


@pytest.mark.parametrize("fetched", [1 << 16, 60])
def test_comparisons_of_many_cells_equal_those_of_few(spark, monkeypatch, fetched):
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    few = stats.compare_pairs(grouped(spark), pairs)
    for module in (selection, stats):
        monkeypatch.setattr(module, "RANGE_VALUES", 500)
    monkeypatch.setattr(selection, "PASS_CLASSES", fetched)
    many = stats.compare_pairs(grouped(spark), pairs)
    plain = lambda found: [(c.ignored, c.statistic, c.p_value, c.effect, *(v for g in c.groups for v in list(vars(g).values())[1:])) for c in found]
    names = lambda found: [(c.group_by, c.measure, [g.group for g in c.groups]) for c in found]
    assert names(few) == names(many)
    assert [len(c.groups) for c in few] == [3, 3, 4, 4] and few[0].ignored == 1
    for a, b in zip(plain(few), plain(many), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_groups_are_compared_by_counted_values(spark):
    """However many rows a group has, what follows the first count sees each of its values once."""
    table = of_frame(spark.range(50_000).selectExpr("concat('g', id % 2) as g", "cast(id % 9 as double) as x"))
    with Written(spark, "test") as kept:
        found = stats.group_counts(table, [("g", "x")], kept)
        assert found.rows == found.counts.count() == 18
        assert {r["g"]: r["n"] for r in stats.group_stats(found, kept).collect()} == {"g0": 25_000, "g1": 25_000}


@pytest.mark.parametrize("query", ["found_in", "assessed"])
def test_values_are_counted_once_for_all_that_reads_them(spark, monkeypatch, query):
    calls, real = [], counting.count_values
    for module in (counting, look_queries, quality, stats):
        monkeypatch.setattr(module, "count_values", lambda *a: calls.append(a) or real(*a), raising=False)
    assert getattr(look_queries, query)(spark, TINY)
    assert len(calls) == 1


@pytest.mark.parametrize("step", ["judge", "count"])
def test_a_worker_holds_little_while_it_reads_languages(spark, step):
    """What a batch of the default size takes beside its text, in arrays of the judging and of the counting worker."""
    docs = spark.createDataFrame([(k, "some plain words here" if k % 2 else "einige schlichte Worte da", "en" if k % 2 else "de") for k in range(200)], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    size = {"judge": language_id.JUDGED_BYTES, "count": language_id.COUNTED_BYTES}[step]
    texts = ["some plain words here and there " * 30] * (size // 960)
    language_id.classes_of("a")
    tracemalloc.start()
    try:
        if step == "judge":
            language_id.judge(texts, model, 1.0)
        else:
            language_id.np.unique(language_id.np.concatenate([language_id.codes_of(language_id.classes_of(x), 4) for x in texts]))
        assert tracemalloc.get_traced_memory()[1] < 45 << 20
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little_while_it_sketches_runs():
    """What the words of a batch take beside its text, and that batches of sketches are small ones."""
    texts = [b"Some plain words, here and there. " * 30] * 4000
    collocations.Words.of(texts[:1], np.zeros(1, np.int64))
    tracemalloc.start()
    try:
        found = collocations.Words.of(texts, np.zeros(len(texts), np.int64))
        assert tracemalloc.get_traced_memory()[1] < 20 * sum(map(len, texts))
    finally:
        tracemalloc.stop()
    assert len(found.number) == 4000 * 180 and found.piece[:7].tolist() == [0, 0, 0, 1, 1, 1, 2]
    assert collocations.SKETCHED_BYTES <= 1 << 20


def test_every_group_column_meets_every_measure(spark):
    """Four groupings and seven measures: more than three, five and fifteen; the last pair is the strongest."""
    groups, measures = [f"g{k}" for k in range(4)], [f"x{k}" for k in range(7)]
    made = [f"concat('v', id % {k + 2}) as g{k}" for k in range(4)] + [f"cast(id * {k * 2 + 3} % 101 + if(id % 5 = 0, {k * k}, 0) as double) as x{k}" for k in range(7)]
    found = stats.compare_all(of_frame(spark.range(600).selectExpr(*made)), groups, measures)
    assert {(c.group_by, c.measure) for c in found} == {(g, x) for g in groups for x in measures}
    assert (found[0].group_by, found[0].measure) == ("g3", "x6")


def test_every_measure_is_followed_over_time(spark):
    made = ["timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id) as t"] + [f"cast(id % {k + 5} as double) as x{k}" for k in range(7)]
    found = timeline.timelines(of_frame(spark.range(90).selectExpr(*made)), ["t"], [f"x{k}" for k in range(7)])
    assert {t.measure for t in found} == {f"x{k}" for k in range(7)}


@pytest.mark.parametrize("least", [1000, 10_000, 100_000])
def test_long_numbers_among_texts_are_no_years(spark, least):
    """Codes of four to six digits, a tenth of them a word: as large copies of a table with shifted keys hold."""
    table = of_frame(spark.range(400).selectExpr(f"if(id % 10 = 0, 'none', cast({least} + id * 7 as string)) as code", "date_format(date'2024-01-01' + cast(id as int), if(id % 10 = 0, 'yyyy-MM-dd', 'yyyyMMdd')) as day"))
    assert {c.name: c.kind for c in profile.profile(table).columns} == {"code": "text", "day": "datetime"}


def test_ranks_that_are_broadcast_or_shuffled_give_the_same(spark, monkeypatch):
    names = ["x", "y", "z"]
    table = of_frame(spark.range(3000).selectExpr("if(id % 7 = 0, null, cast(id * id % 311 as double)) as x", "cast(if(id % 4 = 0, 5, id * 37 % 1009) as double) as y", "if(id % 3 < 2, null, id / 8) as z"))
    few = stats.correlate(table, names)
    for name, value in {"GIVEN_VALUES": 10, "HEAVY_SHARE": 6, "RANGE_VALUES": 400, "is_small": lambda _: False}.items():
        for module in (selection, stats):
            monkeypatch.setattr(module, name, value, raising=False)
    many = stats.correlate(table, names)
    assert [(c.left, c.right, c.n) for c in few] == [(c.left, c.right, c.n) for c in many] and len(few) == 3
    for a, b in zip(few, many, strict=True):
        assert (a.pearson, a.spearman) == pytest.approx((b.pearson, b.spearman), rel=1e-9)


def test_labels_are_counted_by_number_with_gaps(spark, monkeypatch):
    """Rows of labels, gaps among them, that stand as numbers while values are counted."""
    pairs = [("a", "x"), ("b", "y")]
    with Written(spark, "plain") as kept:
        plain = stats.group_counts(grouped(spark), pairs, kept).counts.collect()
    monkeypatch.setattr(stats, "is_small", lambda _: False)
    with Written(spark, "numbered") as kept:
        found = stats.group_counts(grouped(spark), pairs, kept).counts.collect()
    assert sorted(map(tuple, plain), key=repr) == sorted(map(tuple, found), key=repr)


def test_moments_are_summed_once_for_all_measures(spark):
    """Rows that share a moment make one row for each measure, before anything looks at gaps or periods."""
    table = of_frame(spark.range(5000).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 40 as int)) as t", "cast(id as double) as x", "if(id % 2 = 0, null, cast(id as double)) as y"))
    with Written(spark, "test") as kept:
        rows = timeline._summed(table, "t", ["x", "y"], kept).collect()
    assert len(rows) == 60 and sum(r["n"] for r in rows if r["measure"] == "x") == 5000
    assert sum(r["s"] for r in rows if r["measure"] == "y") == sum(range(1, 5000, 2))


def test_counts_by_kind_equal_those_at_once(spark, monkeypatch):
    made = "id % 7 as whole", "if(id % 5 = 0, null, id % 3 / 4) as real", "if(id % 2 = 0, null, 'ab') as word", "id % 2 = 0 as truth", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 4 as int)) as moment"
    found = []
    for small in (True, False):
        monkeypatch.setattr(counting, "is_small", lambda _, small=small: small)
        with Written(spark, "test") as kept:
            found.append(sorted(map(tuple, counting.count_values(of_frame(spark.range(200).selectExpr(*made)), kept).values.collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 19
