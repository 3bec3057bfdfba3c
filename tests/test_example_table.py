"""A table of 60 orders with known faults, looked at as a whole: 57 orders on three days of each month, three of them twice."""

import datetime as dt

import pytest

from vantage.operators.dashboard import look
from vantage.sources.readers import read_dataset

PLACES = ["North", "South", "East", "West"]
SPELLED = {5: "online", 20: " Online", 33: "Retail ", 48: "online"}
SLOW = {9: 19, 27: 23, 44: 29}


def orders():
    days = [dt.date(2024 + m // 12, m % 12 + 1, d) for m in range(19) for d in (8, 17, 25)]
    rows = []
    for k, day in enumerate(days):
        units, price = 7 + (5 * k) % 13, round(21.3 + 0.2 * k, 2)
        channel = SPELLED.get(k, ("Online", "Retail", "Partner")[k % 3])
        wait = "" if k % 9 == 4 and k < 57 else str(SLOW.get(k, 2 + k % 5))
        discount = "pending" if k in (3, 17, 30, 50) else str(5 * (k % 4))
        rows.append((f"ORD-{1001 + k}", day.isoformat(), channel, PLACES[k % 4], str(units), str(price), str(round(units * price, 2)), wait, discount))
    return rows + [rows[3], rows[22], rows[44]]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("example") / "orders.csv"
    head = "order_id;order_date;channel;region;units;unit_price;order_total;delivery_days;discount_pct"
    path.write_text("\n".join([head, *(";".join(r) for r in orders())]) + "\n")
    return look(read_dataset(spark, str(path)))


def test_profile(found):
    told = found.profile
    assert (told.n_rows, told.n_columns, told.duplicate_rows) == (60, 9, 3)
    assert {c.name: c.kind for c in told.columns} == {
        "order_id": "text", "order_date": "datetime", "channel": "categorical", "region": "categorical", "units": "numeric", "unit_price": "numeric", "order_total": "numeric",
        "delivery_days": "numeric", "discount_pct": "categorical",
    }
    assert told.n_missing == sum(r[7] == "" for r in orders()) and {c.name for c in told.columns if c.n_missing} == {"delivery_days"}
    assert next(c.n_unique for c in told.columns if c.name == "order_id") == 57


def test_issues_and_score(found):
    issues = {(i.kind, i.column): i for i in found.quality.issues}
    gaps, values = sum(r[7] == "" for r in orders()), sum(r[7] != "" for r in orders())
    assert issues["duplicate_rows", None].count == 3 and issues["duplicate_rows", None].severity == "warning"
    assert issues["missing_values", "delivery_days"].count == gaps
    assert issues["outliers", "delivery_days"].count == sum(r[7] in ("19", "23", "29") for r in orders())
    assert issues["suspicious_categories", "channel"].count == 2
    assert issues["inconsistent_formatting", "channel"].count == 2
    assert issues["mistyped_column", "discount_pct"].count == sum(r[8] != "pending" for r in orders())
    assert ("high_cardinality", "order_id") in issues
    slow = issues["outliers", "delivery_days"].count
    share = {"completeness": gaps / 540 / 0.5, "consistency": 1 / 4 / 0.5, "type_consistency": 1 / 9 / 0.5, "duplicates": 3 / 60 / 0.3, "outliers": slow / (180 + values) / 0.2}
    assert {d.name: d.score for d in found.quality.dimensions} == {n: round(100 * (1 - x)) for n, x in share.items()}


def test_timelines_and_findings(found):
    lines = {t.measure: t for t in found.analysis.timelines}
    assert {t.rule for t in lines.values()} == {"MS"} and all(len(t.points) == 19 for t in lines.values())
    assert lines["unit_price"].direction == "up" and lines["unit_price"].monotonicity == pytest.approx(1)
    kinds = {i.kind for i in found.insights}
    assert {"correlation", "trend"} <= kinds and len(kinds & {"outliers", "skewed_distribution"}) == 1 and found.insights == tuple(sorted(found.insights, key=lambda i: -i.importance))
    assert {c.kind for c in found.charts} >= {"line", "heatmap", "histogram", "bar"}
