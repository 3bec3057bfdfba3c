"""Recipes: every step's projection equals what it leaves, refusals say why, and values are right on small tables."""

import datetime as dt

import pytest

from vantage.operators.profile import assumed, profile, understood
from vantage.plans import recipe as R
from vantage.plans import steps
from vantage.plans.reasons import Refused
from vantage.plans.steps import forward_filled
from vantage.sources.readers import of_frame, read_parquet
from vantage.table import Meaning

@pytest.fixture(scope="module")
def parcels(spark):
    """36 parcels: half of them from Graz, one without a weight; fees grow with weights, and both with time."""
    first = dt.date(2023, 3, 2)
    rows = []
    for k in range(36):
        depot = "Graz" if k % 2 else "Lyon" if k % 4 else "Turin"
        weight = 2.5 + 0.75 * k if k != 5 else None
        rows.append((f"P-{7 * k + 11}", depot, weight, 9.2 + 0.4 * k, (first + dt.timedelta(days=5 * k)).isoformat(), ("yes", "no", "no")[k % 3], f"parcel {k}: to be handed over as agreed with its sender"))
    table = of_frame(spark.createDataFrame(rows, "parcel string, depot string, weight double, fee double, sent string, fragile string, remark string").coalesce(1))
    out = understood(table)
    out.frame.persist()
    return out


def make(**told):
    return R.parse({"steps": [told]})


def col(name):
    return {"kind": "column", "name": name}


def const(value):
    return {"kind": "constant", "value": value}


def derive(**expression):
    return {"op": "derive_column", "name": "made", "expression": expression}


def step(op, **fields):
    return {"op": op, **fields}


VARIANTS = [
    step("select_columns", columns=["fee", "depot", "sent"]),
    step("drop_columns", columns=["remark", "fragile"]),
    step("rename_column", column="sent", to=" day sent "),
    *(step("cast_column", column=c, to=kind) for c, kind in (("fee", "text"), ("weight", "categorical"), ("fragile", "text"), ("depot", "text"))),
    step("sort_rows", columns=["fragile", "fee"], order="desc"),
    step("limit_rows", count=34),
    step("limit_rows", count=34, method="sample", seed=11),
    step("drop_missing", columns=["weight"]),
    step("drop_missing", how="all"),
    step("drop_duplicates"),
    step("drop_duplicates", columns=["remark"]),
    *(step("fill_missing", column="weight", method=m) for m in ("median", "mean", "mode", "forward")),
    step("fill_missing", column="fragile", method="mode"),
    step("fill_missing", column="weight", method="constant", value=7.5),
    *(derive(kind="arithmetic", left=col("weight"), operator=o, right=r) for o, r in (("add", const(1)), ("multiply", col("fee")), ("divide", col("fee")))),
    derive(kind="bin", column="fee", quantiles=4),
    derive(kind="bin", column="weight", edges=[0, 8, 16, 30], labels=["hand", "cart", "lift"]),
    *(derive(kind="datetime_part", column="sent", part=p) for p in ("year", "week", "month", "date", "weekday", "year_week")),
    derive(kind="map_values", column="depot", mapping={"Graz": "east", "Lyon": "west"}),
    derive(kind="map_values", column="fragile", mapping={"yes": "care"}, default="none"),
    step("filter_rows", clauses=[{"column": "fee", "operator": "lte", "value": 21.5}, {"column": "depot", "operator": "ne", "value": "Turin"}]),
    step("aggregate", group_by=["depot", "fragile"], aggregations=[{"function": "mean", "column": "fee"}, {"function": "count"}]),
]


@pytest.mark.parametrize("told", VARIANTS, ids=lambda t: t["op"] + ":" + str(t.get("expression", t).get("part") or t.get("expression", t).get("method") or t.get("expression", t).get("kind") or ""))
def test_projection_equals_profile(parcels, told):
    out = R.run(parcels, make(**told))
    assert out.refusal is None
    seen = {c.name: c.kind for c in profile(out.table).columns}
    planned = {m.name: m.kind for m in out.table.meanings}
    assert list(planned) == out.table.names
    if told["op"] != "aggregate":  # few groups look like categories of numbers either way
        assert seen == planned


PLAN = (
    Meaning("parcel", "categorical", is_id=True), Meaning("depot", "categorical"), Meaning("route", "categorical", is_wide=True), Meaning("weight", "numeric"), Meaning("fee", "numeric"),
    Meaning("sent", "datetime"), Meaning("remark", "text", is_wide=True), Meaning("blank", "empty"), Meaning("flag", "boolean"),
)
AGG = lambda *keys, **a: {"op": "aggregate", "group_by": list(keys), "aggregations": [a or {"function": "count"}]}
WHERE = lambda c, o, v=None: {"op": "filter_rows", "clauses": [{"column": c, "operator": o, "value": v}]}


@pytest.mark.parametrize("told,part", [
    ({"op": "select_columns", "columns": ["nope"]}, "no column named"), ({"op": "select_columns", "columns": ["depot", "depot"]}, "named twice in the same selection"), ({"op": "drop_columns", "columns": [m.name for m in PLAN]}, "Removing every column"),
    (WHERE("blank", "eq", 1), "nothing to compare"), (WHERE("depot", "gt", "a"), "cannot be ordered"), (WHERE("weight", "contains", "1"), "no text to search"), (WHERE("depot", "in", []), "needs a list"), (WHERE("depot", "eq"), "single value"),
    (WHERE("weight", "eq", "many"), "cannot be read as a value of"), (WHERE("sent", "gt", 1000), "cannot be read as a value of"), (WHERE("flag", "eq", "maybe"), "cannot be read as a value of"),
    (derive(kind="arithmetic", left=col("weight"), operator="divide", right=const(0)), "Dividing by zero"), (derive(kind="arithmetic", left=const(0), operator="divide", right=col("fee")), "Dividing by zero"), (derive(kind="arithmetic", left=col("depot"), operator="add", right=const(1)), "cannot be used in arithmetic"),
    (derive(kind="bin", column="depot", quantiles=3), "only numbers can be binned"), (derive(kind="bin", column="weight", quantiles=3, edges=[1, 2]), "not both"), (derive(kind="bin", column="weight"), "need cut points"), (derive(kind="bin", column="weight", edges=[1]), "must be two"),
    (derive(kind="bin", column="weight", edges=[1, 1]), "have to increase"), (derive(kind="bin", column="weight", quantiles=21), "Between 2 and 20 buckets"), (derive(kind="bin", column="weight", quantiles=3, labels=["a"]), "3 bins but 1 labels"),
    (derive(kind="bin", column="weight", quantiles=2, labels=["a", "a"]), "both be called"), (derive(kind="datetime_part", column="depot", part="year"), "so it has no year to read"), (derive(kind="map_values", column="weight", mapping={"a": "b"}), "only categories can be remapped"),
    (derive(kind="map_values", column="depot", mapping={}), "needs at least one value"), ({"op": "derive_column", "name": " ", "expression": {"kind": "map_values", "column": "depot", "mapping": {"a": "b"}}}, "needs a name"),
    ({"op": "rename_column", "column": "depot", "to": "fee"}, "already a column named"), ({"op": "rename_column", "column": "depot", "to": " depot "}, "already called that"), ({"op": "cast_column", "column": "blank", "to": "text"}, "no values to convert"),
    (AGG("depot", "flag", "sent"), "more than 2 columns"), (AGG("weight"), "Bin it"), (AGG("remark"), "Map its values"), (AGG("parcel"), "row identifier"), (AGG("route"), "too many distinct values"), (AGG(function="sum"), "needs a column"),
    (AGG(function="sum", column="depot"), "there is no sum of it"), ({"op": "aggregate", "aggregations": [{"function": "count"}, {"function": "count"}]}, "Two results would both be called"), ({"op": "fill_missing", "column": "depot", "method": "mean"}, "has no mean"),
    ({"op": "fill_missing", "column": "blank", "method": "forward"}, "no value to carry"), ({"op": "fill_missing", "column": "depot", "method": "constant"}, "needs a value"),
])
def test_refusals(told, part):
    found = R.validate(PLAN, make(**told)).refusal
    assert found is not None and part in found.reason and found.op == told["op"]


@pytest.mark.parametrize("told,part", [
    ({"op": "compare", "group_by": "weight", "measure": "fee"}, "no groups to compare across"), ({"op": "compare", "group_by": "parcel", "measure": "fee"}, "every group would hold one row"), ({"op": "compare", "group_by": "route", "measure": "fee"}, "too many distinct values to compare"),
    ({"op": "compare", "group_by": "depot", "measure": "remark"}, "nothing to compare"), ({"op": "relate", "left": "fee", "right": "fee"}, "relates to itself"), ({"op": "relate", "left": "fee", "right": "depot"}, "nothing to relate"), ({"op": "trend", "time": "depot", "measure": "fee"}, "in order of time"),
    ({"op": "trend", "time": "sent", "measure": "depot"}, "nothing to follow over time"), ({"op": "distribution", "column": "remark"}, "no spread"), ({"op": "distribution", "column": "sent"}, "is a date column"),
])
def test_analysis_refusals(told, part):
    assert part in R.validate(PLAN, R.parse({"analyze": told})).refusal.reason


def test_removed_columns_are_told():
    told = R.parse({"steps": [{"op": "drop_columns", "columns": ["fee"]}, {"op": "sort_rows", "columns": ["fee"]}]})
    found = R.validate(PLAN, told)
    assert found.accepted == 1 and found.refusal.step_index == 1 and found.refusal.reason.endswith("An earlier step removed it.")


@pytest.mark.parametrize("told", [
    {"steps": [{"op": "join"}]}, {"steps": [{"op": "limit_rows", "count": 0}]}, {"steps": [{"op": "limit_rows", "count": 5}] * 21}, {"steps": [{"op": "sort_rows", "columns": ["a"], "order": "up"}]}, {"steps": [{"op": "filter_rows", "clauses": []}]},
    {"analyze": {"op": "predict"}}, {"steps": [{"op": "drop_missing", "extra": 1}]}, {"steps": [derive(kind="python", code="1")]}, {"steps": [{"op": "cast_column", "column": "a", "to": "json"}]},
])
def test_closed_vocabulary(told):
    with pytest.raises(R.Malformed):
        R.parse(told)


def values(run, name):
    return [r[name] for r in run.table.ordered().collect()]


def small(spark, rows, schema, **kinds):
    return understood(of_frame(spark.createDataFrame(rows, schema).coalesce(1)))


def test_cast_losses(spark):
    bad = R.run(small(spark, [(x,) for x in ("10", "20", "thirty", "forty", "fifty")], "v string"), make(op="cast_column", column="v", to="numeric"))
    assert "3 of 5 values" in bad.refusal.reason
    good = R.run(small(spark, [(str(x),) for x in range(20)] + [("nope",)], "v string"), make(op="cast_column", column="v", to="numeric"))
    assert good.refusal is None and good.notes == ["1 value could not be read as a number."] and values(good, "v")[-1] is None


def test_divide_by_zero_is_a_gap(spark):
    table = small(spark, [(100.0, 4.0), (200.0, 0.0), (300.0, 2.0)], "a double, b double")
    out = R.run(table, make(**derive(kind="arithmetic", left=col("a"), operator="divide", right=col("b"))))
    assert values(out, "made") == [25.0, None, 150.0] and out.notes == ["1 row had nothing to divide by."]
    both = R.run(table, make(**derive(kind="arithmetic", left=const(6), operator="divide", right=const(4))))
    assert values(both, "made") == [1.5] * 3


def test_infinities_and_gaps(spark):
    table = small(spark, [(1.0,), (2.0,), (float("inf"),), (None,), (float("nan"),)], "v double")
    assert values(R.run(table, make(**WHERE("v", "ne", 1))), "v") == [2.0, float("inf")]
    assert values(R.run(table, make(**WHERE("v", "is_missing"))), "v") == [None, None]
    told = R.run(table, make(op="aggregate", aggregations=[{"function": f, "column": "v"} for f in ("sum", "mean", "max", "count")]))
    assert told.table.visible().first()[:] == (3.0, 1.5, 2.0, 3)
    empty = R.run(small(spark, [(None, "x"), (None, "x"), (1.0, "y"), (None, "y")], "v double, g string"), make(op="aggregate", group_by=["g"], aggregations=[{"function": "sum", "column": "v"}]))
    assert values(empty, "sum_v") == [0.0, 1.0]


def test_order_is_kept(spark):
    rows = [(k, "b" if k % 2 else "a", None if k % 3 else k) for k in range(12)]
    table = small(spark, rows, "k int, g string, v int")
    told = R.parse({"steps": [{"op": "sort_rows", "columns": ["g"], "order": "desc"}, {"op": "drop_columns", "columns": ["g"]}, {"op": "limit_rows", "count": 8}]})
    assert values(R.run(table, told), "k") == [1, 3, 5, 7, 9, 11, 0, 2]
    gaps = R.run(table, make(op="sort_rows", columns=["v"], order="desc"))
    assert values(gaps, "v")[:4] == [9, 6, 3, 0] and values(gaps, "v")[4:] == [None] * 8
    first = R.parse({"steps": [{"op": "sort_rows", "columns": ["k"], "order": "desc"}, {"op": "drop_duplicates", "columns": ["g"]}]})
    assert values(R.run(table, first), "k") == [11, 10]


@pytest.mark.parametrize("sort", [None, "asc", "desc"])
def test_forward_fill_over_blocks(spark, sort, monkeypatch):
    monkeypatch.setattr(steps, "BLOCK_ROWS", 60)
    rows = [(k * 37 % 1009, None if k % 7 else k) for k in range(1009)]
    table = small(spark, rows, "k int, v int")
    if sort:
        table = R.run(table, make(op="sort_rows", columns=["k"], order=sort)).table
        rows = sorted(rows, reverse=sort == "desc")
    last, want = None, []
    for _, v in rows:
        last = v if v is not None else last
        want.append(last)
    out = table.with_frame(forward_filled(table, "v"))
    assert [r["v"] for r in out.ordered().collect()] == want


@pytest.mark.parametrize("stretch", [7, 1024])
def test_forward_fill_over_ten_thousand_blocks(spark, tmp_path, monkeypatch, stretch):
    """Some stretches and whole files hold no value; nothing is broadcast, and no window goes over all blocks."""
    monkeypatch.setattr(steps, "BLOCK_ROWS", 2)
    monkeypatch.setattr(steps, "STRETCH", stretch)
    rows = [(k, k if k % 997 == 5 or 3000 < k < 3100 else None) for k in range(20_000)]
    spark.createDataFrame(rows, "k int, v int").repartitionByRange(5, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "x"))
    table = assumed(read_parquet(spark, str(tmp_path / "x")))
    filled = table.with_frame(forward_filled(table, "v"))
    last, want = None, []
    for r in table.ordered().collect():
        last = r.v if r.v is not None else last
        want.append((r.k, last))
    assert [(r.k, r.v) for r in filled.ordered().collect()] == want
    plan = filled.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and plan.count("strategy=merge") == 1


def test_forward_fill_over_files_and_texts(spark, tmp_path, monkeypatch):
    """Blocks of several files in file order, and of texts with a common beginning, gaps last."""
    monkeypatch.setattr(steps, "BLOCK_ROWS", 20)
    rows = [(f"{'long beginning' if k % 3 else 'x'} {k * 37 % 211:03d}" if k % 10 else None, None if k % 4 else k) for k in range(211)]
    spark.createDataFrame(rows, "t string, v int").repartition(3).write.parquet(str(tmp_path / "x"))
    table = assumed(read_parquet(spark, str(tmp_path / "x")))
    for order in (None, "asc", "desc"):
        now = R.run(table, make(op="sort_rows", columns=["t"], order=order)).table if order else table
        last, want = None, []
        for r in now.ordered().collect():
            last = r.v if r.v is not None else last
            want.append(last)
        assert [r.v for r in now.with_frame(forward_filled(now, "v")).ordered().collect()] == want


def test_quantile_bins_and_labels(spark):
    table = small(spark, [(float(k),) for k in range(1, 9)], "v double")
    out = R.run(table, make(**derive(kind="bin", column="v", quantiles=2)))
    assert values(out, "made") == ["(0.999, 4.5]"] * 4 + ["(4.5, 8.0]"] * 4
    assert values(R.run(table, make(**derive(kind="bin", column="v", edges=[1, 3, 8]))), "made")[:4] == [None, "(1.0, 3.0]", "(1.0, 3.0]", "(3.0, 8.0]"]
    same = R.run(small(spark, [(5.0,)] * 4 + [(None,)], "v double"), make(**derive(kind="bin", column="v", quantiles=2)))
    assert "enough distinct values" in same.refusal.reason


def test_sample_is_exact_and_repeatable(parcels):
    draw = lambda seed: values(R.run(parcels, make(op="limit_rows", count=10, method="sample", seed=seed)), "parcel")
    assert len(set(draw(1))) == 10 and draw(1) == draw(1) != draw(2)


def test_contains_is_literal(spark):
    table = small(spark, [("a.b",), ("A.B",), ("axb",), (None,)], "t string")
    assert values(R.run(table, make(**WHERE("t", "contains", "a."))), "t") == ["a.b", "A.B"]


def test_filters_reach_the_scan(spark, tmp_path):
    """What the scan is given, and that rows with gaps, NaN and infinities are kept or dropped as without it."""
    nan, inf = float("nan"), float("inf")
    rows = [(k, x, t, dt.datetime(2024, 1, 1 + k)) for k, (x, t) in enumerate([(1.0, "a"), (2.5, "b"), (nan, "c"), (inf, None), (-inf, "a"), (None, "b"), (3.0, "a")])]
    spark.createDataFrame(rows, "k int, x double, t string, d timestamp_ntz").write.parquet(str(tmp_path / "x"))
    table = understood(read_parquet(spark, str(tmp_path / "x")))
    table = table.with_frame(table.frame, meanings=tuple(Meaning(m.name, {"k": "numeric", "x": "numeric", "t": "categorical", "d": "datetime"}[m.name]) for m in table.meanings))
    cases = [
        ("x", "gt", 1, "GreaterThan(x,1.0)", [1, 6]), ("x", "lt", 3, "LessThan(x,3.0)", [0, 1]), ("x", "in", [1, 3], "In(x, [1.0,3.0])", [0, 6]), ("x", "eq", 2.5, "EqualTo(x,2.5)", [1]),
        ("k", "gte", 4.5, "GreaterThanOrEqual(k,5)", [5, 6]), ("k", "lte", 0.5, "LessThanOrEqual(k,0)", [0]), ("k", "eq", 3, "EqualTo(k,3)", [3]), ("k", "eq", 3.5, None, []), ("t", "eq", "a", "EqualTo(t,a)", [0, 4, 6]),
        ("t", "in", ["b", "c"], "In(t, [b,c])", [1, 2, 5]), ("d", "gt", "2024-01-05", "GreaterThan(d,2024-01-05T00:00)", [5, 6]), ("x", "ne", 1, None, [1, 3, 4, 6]), ("t", "not_in", ["a"], None, [1, 2, 5]),
    ]
    for column, operator, value, pushed, want in cases:
        out = R.run(table, make(**WHERE(column, operator, value))).table
        assert sorted(r.k for r in out.visible().collect()) == want, (column, operator)
        assert pushed is None or pushed in out.visible()._jdf.queryExecution().executedPlan().toString(), (column, operator)
    either = R.run(table, make(op="filter_rows", clauses=[{"column": "x", "operator": "gt", "value": 2}, {"column": "k", "operator": "lt", "value": 1}], combine="or")).table
    assert sorted(r.k for r in either.visible().collect()) == [0, 1, 6] and "Or(" in either.visible()._jdf.queryExecution().executedPlan().toString()


def test_odd_names(spark):
    table = small(spark, [(1.0, "x"), (2.0, "y")], "`a.b` double, `it``s` string")
    out = R.run(table, R.parse({"steps": [WHERE("a.b", "gt", 1), {"op": "rename_column", "column": "it`s", "to": "c.d"}]}))
    assert out.table.names == ["a.b", "c.d"] and values(out, "c.d") == ["y"]


def test_reports_and_analysis(parcels):
    out = R.run(parcels, R.parse({"steps": [WHERE("depot", "eq", "Graz"), {"op": "sort_rows", "columns": ["fee"]}], "analyze": {"op": "trend", "time": "sent", "measure": "weight"}}))
    assert [(r.rows_in, r.rows_out) for r in out.reports()] == [(36, 18), (18, 18)] and out.analysis.result.direction == "up"
    told = R.run(parcels, R.parse({"analyze": {"op": "compare", "group_by": "depot", "measure": "weight"}}))
    assert [g.n for g in told.analysis.result.groups] and told.analysis.caveats == ()
    assert R.run(parcels, R.parse({"analyze": {"op": "relate", "left": "weight", "right": "fee"}})).analysis.result.pearson == pytest.approx(1)
    assert R.run(parcels, R.parse({"analyze": {"op": "distribution", "column": "depot"}})).analysis.result.top[0][:2] == ("Graz", 18)


def test_nothing_to_apply(parcels):
    for told, code in (({"steps": []}, "apply_nothing"), ({"steps": [WHERE("fee", "lt", 0)]}, "apply_rows"), ({"analyze": {"op": "distribution", "column": "depot"}}, "apply_analysis")):
        with pytest.raises(Refused) as refused:
            R.derive(parcels, R.parse(told))
        assert refused.value.code == code


LONG = [
    step("filter_rows", clauses=[{"column": "fee", "operator": "gt", "value": 10}, {"column": "weight", "operator": "is_missing"}], combine="or"),
    derive(kind="arithmetic", left=col("weight"), operator="multiply", right=const(2)),
    step("drop_missing", columns=["made"]),
    step("select_columns", columns=["depot", "fee", "made", "fragile"]),
    step("rename_column", column="fee", to="cost"),
    step("filter_rows", clauses=[{"column": "cost", "operator": "lt", "value": 20}, {"column": "made", "operator": "ne", "value": 20}]),
    step("fill_missing", column="made", method="constant", value=1),
]


def jobs_of(spark, act):
    """What an action gives and how many jobs it starts."""
    spark.sparkContext.setJobGroup(name := f"group-{id(act)}", name)
    out = act()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(ids)


@pytest.mark.parametrize("steps,most", [
    (LONG, 2),
    ([*LONG, step("limit_rows", count=5), step("sort_rows", columns=["cost"])], 2),
    ([step("limit_rows", count=30), *LONG], 4),
    ([*LONG, step("drop_duplicates", columns=["depot"]), step("filter_rows", clauses=[{"column": "depot", "operator": "eq", "value": "Graz"}])], 4),
    ([*LONG, step("fill_missing", column="made", method="median"), step("filter_rows", clauses=[{"column": "fragile", "operator": "eq", "value": "no"}])], 4),
    ([*LONG, step("aggregate", aggregations=[{"function": "count"}])], 2),
    ([*LONG, step("aggregate", group_by=["depot"], aggregations=[{"function": "count"}]), step("sort_rows", columns=["depot"])], 5),
    ([], 2),
])
def test_reports_share_a_pass(spark, parcels, steps, most):
    """Counts equal those of each table, and a run of steps that judge rows by themselves is counted once."""
    out = R.run(parcels, R.parse({"steps": steps}))
    told, jobs = jobs_of(spark, out.reports)
    counts = [t.frame.count() for t in out._tables]
    assert [(r.rows_in, r.rows_out) for r in told] == list(zip(counts, counts[1:], strict=False))
    assert jobs <= most


def test_reports_of_every_step(parcels):
    for told in VARIANTS:
        out = R.run(parcels, R.parse({"steps": [told]}))
        assert [(r.rows_in, r.rows_out) for r in out.reports()] == [(36, out.table.frame.count())]
