"""Sources, profile, statistics, timelines, quality, findings and the store on small made tables."""

import csv
import datetime as dt
import io
import math
import random
import tracemalloc
import zipfile

import pytest

from vantage.functions.chi2 import survival
from vantage.functions.intervals import interval_labels
from vantage.operators import insights, quality, selection, stats, timeline
from vantage.operators.dashboard import look
from vantage.operators.profile import profile, understood
from vantage.plans.recipe import parse
from vantage.sources import readers
from vantage.store import Full, Missing, Store, size_of
from vantage.table import Table


def table(spark, rows, schema) -> Table:
    return understood(readers.of_frame(spark.createDataFrame(rows, schema).coalesce(1)))


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    lines = [["city", "n", "note"], ["Ankara", "1", ' "quoted" '.replace('"', "")], ["Izmir", "2", "x"]]
    out = readers.read_dataset(spark, write(tmp_path, "a.csv", "\n".join(sep.join(r) for r in lines)))
    assert out.names == ["city", "n", "note"] and [tuple(r) for r in out.ordered().collect()] == [("Ankara", 1, " quoted "), ("Izmir", 2, "x")]


@pytest.mark.parametrize("end,encoding", [("\n", "utf-8"), ("\r\n", "latin-1")])
def test_csv_with_line_breaks_in_quotes_is_split(spark, tmp_path, end, encoding):
    """Values with breaks, quotes and delimiters across many splits, one longer than a split, equal the written ones."""
    deal = random.Random(len(end))
    parts = ["a", "é", "\n", "\n\n", ",", '"', '""', " ", "x, y", "\n\"", "word " * 9]
    value = lambda: "v" + "".join(deal.choice(parts) for _ in range(deal.randrange(8))) + "w"
    rows = [(str(k), value(), deal.choice(["", "plain", value()])) for k in range(900)] + [("900", "long\n" * 3000 + "end", "z")]
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    path = write(tmp_path, "a.csv", end.join(["n,one,two", *(",".join(map(quote, r)) for r in rows), ""]).encode(encoding))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = readers.read_csv(spark, path)
        assert [tuple(r) for r in out.ordered().collect()] == [(int(a), b, c or None) for a, b, c in rows]
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 8
        stray = readers.read_csv(spark, write(tmp_path, "b.csv", 'n,one\n1,5" pipe\n2,"a\nb"\n3,6" pipe\n4,c\n'))
        assert [tuple(r) for r in stray.ordered().collect()] == [(1, '5" pipe'), (2, "a\nb"), (3, '6" pipe'), (4, "c")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_gaps_types_and_names(spark, tmp_path):
    out = readers.read_csv(spark, write(tmp_path, "a.csv", b"\xef\xbb\xbfa,a,,d,e\r\n1,NA,x,True,1.5\r\n2,3,y,False,inf\r\n"))
    assert out.names == ["a", "a.1", "Unnamed: 2", "d", "e"] and [tuple(r) for r in out.ordered().collect()] == [(1, None, "x", True, 1.5), (2, 3.0, "y", False, math.inf)]
    latin = readers.read_csv(spark, write(tmp_path, "b.csv", "name,n\nMünchen,1\n".encode("latin-1")))
    assert latin.ordered().first()["name"] == "München"
    quoted = readers.read_csv(spark, write(tmp_path, "c.csv", 'a,b\n"x, ""y""\nz",2\n'))
    assert quoted.ordered().first()["a"] == 'x, "y"\nz'


@pytest.mark.parametrize("name,content,part", [("a.txt", "x", "CSV and XLSX"), ("a.csv", "", "empty"), ("a.csv", "a,b\n", "no rows"), ("a.csv", ",".join(map(str, range(1100))) + "\n1\n", "more than 1000"), ("a.csv", "a,b\n1,2,3\n", "more fields"), ("a.xlsx", "no zip", "not an XLSX")])
def test_unreadable(spark, tmp_path, name, content, part):
    with pytest.raises(readers.Unreadable, match=part):
        readers.read_dataset(spark, write(tmp_path, name, content))


SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, strings=("South",)):
    """A workbook of one sheet; a cell is a pair of attributes and content, None none at all."""
    letters = "ABCDEFGHIJ"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {SPACE}><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {SPACE}>" + "".join(f"<si><t>{t}</t></si>" for t in strings) + "</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {SPACE}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f"<worksheet {SPACE}><sheetData>".encode())
            for n, row in enumerate(rows, 1):
                cells = "".join(f'<c r="{letters[k]}{n}"{c[0]}>{c[1]}</c>' for k, c in enumerate(row) if c)
                sheet.write(f'<row r="{n}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return str(path)


def said(text):
    return ' t="inlineStr"', f"<is><t>{text}</t></is>"


def number(value, style=""):
    return style, f"<v>{value}</v>"


DAY, SHARED, TRUTH = ' s="1"', ' t="s"', ' t="b"'


def test_workbook(spark, tmp_path):
    path = tmp_path / "b[1].xlsx"
    workbook(path, [
        [said("region"), number(2023), said("2023"), said("day")],
        [said("North"), number(1), number(2.5), number(45292, DAY)],
        [number(0, SHARED), number(3), number(4), number(45293.5, DAY)],
    ])
    out = readers.read_dataset(spark, str(path))
    assert out.names == ["region", "2023", "2023.1", "day"]
    assert [tuple(r) for r in out.ordered().collect()] == [("North", 1, 2.5, dt.datetime(2024, 1, 1)), ("South", 3, 4.0, dt.datetime(2024, 1, 2, 12))]
    with pytest.raises(readers.Unreadable, match="when unpacked"):
        readers.check_workbook(path.read_bytes(), 100)
    with pytest.raises(readers.Unreadable, match="larger than 0 MB"):
        readers.read_xlsx(spark, str(path), max_bytes=100)


def test_workbook_types_and_gaps(spark, tmp_path):
    """Gaps, mixed columns, booleans, texts that stand for no value, huge whole numbers, rows wider than the header."""
    head = [said(n) for n in ("gap", "mixed", "truth", "half", "none", "huge", "when")]
    path = workbook(tmp_path / "t.xlsx", [
        head,
        [number(1), number(1), number(1, TRUTH), number(1, TRUTH), said("NA"), number("1e300"), number(45292.25, DAY)],
        [None, said("x y"), number(0, TRUTH), None, None, number(10**20), None, said("beyond the header")],
        [number(7), number(0.1), number(1, TRUTH), number(0, TRUTH), None, number(2), number(45293, DAY)],
    ])
    out = readers.read_xlsx(spark, path)
    assert [f.dataType.simpleString() for f in out.visible().schema] == ["double", "string", "boolean", "string", "string", "double", "timestamp_ntz"]
    assert [tuple(r) for r in out.ordered().collect()] == [
        (1.0, "1", True, "True", None, 1e300, dt.datetime(2024, 1, 1, 6)),
        (None, "x y", False, None, None, 1e20, None),
        (7.0, "0.1", True, "False", None, 2.0, dt.datetime(2024, 1, 2)),
    ]


@pytest.mark.parametrize("rows,part", [([], "no columns"), ([[None]], "no columns"), ([[said("a")]], "no rows"), ([[said("a")], [number("x1")]], "no sheet"), ([[said("a")], [number(9, SHARED)]], "no sheet")])
def test_unreadable_workbook(spark, tmp_path, rows, part):
    with pytest.raises(readers.Unreadable, match=part):
        readers.read_dataset(spark, workbook(tmp_path / "u.xlsx", rows))


def test_large_workbook(spark, tmp_path):
    """60,000 rows in many batches keep their order, and what the reader holds does not grow with them."""
    n = 60_000
    rows = ([said("k"), said("name"), said("odd")], *([number(k), number(k % 3, SHARED), number(k / 4)] for k in range(n)))
    path = workbook(tmp_path / "l.xlsx", rows, ("a", "b", "c"))
    out = readers.read_xlsx(spark, path)
    told = out.ordered().toPandas()
    assert told["k"].tolist() == list(range(n)) and told["odd"].tolist() == [k / 4 for k in range(n)] and told["name"].tolist() == ["abc"[k % 3] for k in range(n)]
    content = (tmp_path / "l.xlsx").read_bytes()
    tracemalloc.start()
    for k, _ in enumerate(readers._sheet_rows(content)):
        if k == 1000:
            early = tracemalloc.get_traced_memory()[0]
            tracemalloc.reset_peak()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < early + (1 << 20)


def test_preview_and_export(spark, tmp_path):
    out = readers.of_frame(spark.createDataFrame([(1, 0.12345678901234, dt.datetime(2024, 1, 2)), (2, math.inf, None)], "a int, b double, t timestamp_ntz").coalesce(1))
    assert readers.preview(out, 0)["rows"] == [{"a": 1, "b": 0.123456789, "t": "2024-01-02T00:00:00"}] and readers.preview(out)["rows"][1] == {"a": 2, "b": None, "t": None}
    assert list(readers.csv_lines(out))[:2] == ["a,b,t\n", "1,0.12345678901234,2024-01-02 00:00:00\n"]
    readers.write_csv(out, str(tmp_path / "out"))
    assert readers.export_name("x/orders.csv", 2) == "orders (2 steps).csv"


def test_export_of_several_parts(spark, tmp_path):
    """Chunks from many tasks and part files, each in row order, are the table: quotes, breaks, blanks and gaps too."""
    rows = [(k, None if k % 7 == 0 else f' n "{k}", {"x" * (k % 5)}\n' + "\\" * (k % 3), k / 8, k % 2 == 0) for k in range(5000)]
    frame = spark.createDataFrame(rows, "k long, name string, x double, even boolean").repartition(7)
    mixed = Table(readers.of_frame(frame).frame, order=(("k", False),))
    want = [["" if x is None else str(x) for x in r] for r in reversed(rows)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = list(readers.csv_chunks(mixed))
        readers.write_csv(mixed, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(chunks) > 2 and list(csv.reader(io.StringIO("".join(sum(chunks, []))))) == [["k", "name", "x", "even"], *want]
    parts = [list(csv.reader(open(p, newline=""))) for p in sorted((tmp_path / "parts").glob("part-*.csv"))]
    assert len(parts) > 1 and all(p[0] == ["k", "name", "x", "even"] for p in parts)
    assert [r[:3] for p in parts for r in p[1:]] == [r[:3] for r in want]
    assert list(readers.csv_lines(Table(mixed.frame.limit(0), order=(("k", True),)))) == ["k,name,x,even\n"]


def test_kinds(spark):
    rows = [(f"id{k}", k % 2, "yes" if k % 3 else "No", f"2024-01-{k % 28 + 1:02d}", f"{k}", "a" * 50, f"v{k}", float(k % 2), None, "x") for k in range(80)]
    told = profile(readers.of_frame(spark.createDataFrame(rows, "id string, bit int, truth string, day string, digits string, long string, many string, real double, blank string, same string").coalesce(1)))
    kinds = {c.name: c.kind for c in told.columns}
    assert kinds == {"id": "text", "bit": "boolean", "truth": "boolean", "day": "datetime", "digits": "text", "long": "text", "many": "text", "real": "numeric", "blank": "empty", "same": "categorical"}
    by = {c.name: c for c in told.columns}
    assert by["id"].is_id and by["same"].is_constant and by["many"].is_wide and by["day"].samples == ("2024-01-01", "2024-01-02", "2024-01-03") and told.duplicate_rows == 0
    assert told.type_counts["text"] == 4 and told.n_missing == 80


@pytest.mark.parametrize("text,want", [("2024-01-08", (2024, 1, 8)), ("13/08/2024", (2024, 8, 13)), ("1/2/2024", (2024, 1, 2)), ("Jan 8, 2024", (2024, 1, 8)), ("2024-03", (2024, 3, 1)), ("20240108", (2024, 1, 8)), ("2024Q2", (2024, 4, 1)), ("10:30", None), ("2024-02-30", None), ("", None)])
def test_moments(spark, text, want):
    from pyspark.sql import types as T

    from vantage.functions.columns import col, moment

    got = spark.createDataFrame([(text,)], "t string").select(moment(col("t"), T.StringType())).first()[0]
    assert (got and (got.year, got.month, got.day)) == want


def test_labels_of_numbers(spark):
    from pyspark.sql import types as T

    from vantage.functions.columns import col, label

    values = [1.0, 0.1, 1e7, 123456789.25, 1e16, 1.5e-5, 1e-4, 0.00123, -2.5e20, 1e100, 5e-324]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(label(col("v"), T.DoubleType())).collect()
    assert [r[0] for r in got][:-1] == [repr(v) for v in values][:-1]


def test_numeric_summaries(spark):
    out = stats.describe(table(spark, [(float(k), 1.0) for k in range(1, 21)] + [(500.0, 1.0), (math.inf, 1.0), (None, None)], "v double, same double"), ["v", "same"])
    v, same = out
    assert (v.count, v.missing, v.outliers, v.min, v.max, v.median) == (21, 1, 1, 1.0, 500.0, 11.0) and sum(v.histogram.counts) == 21 and len(v.histogram.counts) == 21
    assert v.std == pytest.approx(107.0, abs=1) and v.skewness > 4 and (same.skewness, same.histogram.edges) == (0.0, (0.5, 1.5)) and same.outliers == 0
    few = stats.describe(table(spark, [(1.0,), (2.0,), (3.0,), (math.inf,), (-math.inf,)], "v double"), ["v"])[0]
    assert (few.count, few.mean) == (3, 2.0)


@pytest.mark.parametrize("range_values", [7, 500_000])
def test_correlations(spark, range_values, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_VALUES", range_values)
    rng = random.Random(1)
    rows = [(float(k), k * 2.0 + rng.random(), rng.random(), 7.0, float(k) if k < 2 else None) for k in range(60)]
    found = stats.correlate(table(spark, rows, "a double, b double, c double, same double, rare double"), ["a", "b", "c", "same", "rare"])
    assert [(f.left, f.right) for f in found][0] == ("a", "b") and found[0].spearman == pytest.approx(1) and len(found) == 3 and {f.n for f in found} == {60}
    ties = stats.correlate(table(spark, [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 9.0)], "a double, b double"), ["a", "b"])[0]
    assert ties.spearman == pytest.approx(0.8333333)


def test_groups(spark):
    rows = [("big", 200.0 + 80 * k / 29) for k in range(30)] + [("smb", 80.0 + 40 * k / 29) for k in range(30)] + [("tiny", 1.0), ("tiny", 2.0)]
    found = stats.compare(table(spark, rows, "g string, v double"), "g", "v")
    assert (found.highest.group, found.lowest.group, found.ignored) == ("big", "smb", 1) and found.mean_ratio == pytest.approx(2.4) and found.p_value < 1e-9 and 0.7 < found.effect <= 1
    assert stats.compare(table(spark, rows[:30] + rows[-2:], "g string, v double"), "g", "v") is None
    flat = stats.compare(table(spark, [(g, 1.0) for g in "ab" for _ in range(6)], "g string, v double"), "g", "v")
    assert flat.effect is None and flat.p_value is None


@pytest.mark.parametrize("x,k", [(3.841459, 1), (5.991465, 2), (7.814728, 3), (15.507313, 8), (16.918978, 9)])
def test_chi_square(x, k):
    assert survival(x, k) == pytest.approx(0.05, abs=1e-6) and survival(0, k) == 1


def series(spark, values, step=1, start=dt.datetime(2024, 1, 1)):
    rows = [(start + dt.timedelta(days=step * k), float(v)) for k, v in enumerate(values)]
    return table(spark, rows, "t timestamp_ntz, v double")


def test_step_in_a_daily_series(spark):
    found = timeline.timeline(series(spark, [100] * 45 + [300] * 45), "t", "v")
    assert (found.rule, found.direction, found.change_ratio) == ("D", "up", 2.0) and (found.largest.after, found.largest.difference) == (dt.datetime(2024, 2, 15), 200.0) and len(found.points) == 90


def test_rules_gaps_and_seasons(spark):
    assert timeline.timeline(series(spark, range(3000)), "t", "v").rule == "MS" and timeline.timeline(series(spark, range(100), 7), "t", "v").rule == "W"
    months = [(dt.datetime(2020 + k // 12, k % 12 + 1, 1), 100 + 50 * math.sin(2 * math.pi * k / 12)) for k in range(48)]
    found = timeline.timeline(table(spark, months, "t timestamp_ntz, v double"), "t", "v")
    assert found.rule == "MS" and (found.season.strongest, found.season.weakest) == ("April", "October")
    gappy = table(spark, [(dt.datetime(2024, 1, d), float(d)) for d in (1, 2, 10, 11)], "t timestamp_ntz, v double")
    assert len(timeline.timeline(gappy, "t", "v").points) == 11
    assert timeline.timeline(series(spark, [1, 2]), "t", "v") is None


def test_quality(spark):
    rows = [("İstanbul", " Ankara", 1.0, str(k) if k % 10 else "none") for k in range(10)] + [("istanbul", "Ankara", 1.0, "5") for _ in range(10)]
    found = look(table(spark, rows, "city string, town string, same double, digits string"))
    kinds = {(i.kind, i.column) for i in found.quality.issues}
    assert {("suspicious_categories", "city"), ("suspicious_categories", "town"), ("inconsistent_formatting", "town"), ("constant_column", "same"), ("mistyped_column", "digits"), ("duplicate_rows", None)} <= kinds
    assert 0 <= found.quality.score < 100 and quality.normal_form("  İSTANBUL  x ") == "istanbul x" and quality.dimension_score(0.25, 0.5) == 50


def test_findings(spark):
    rng = random.Random(3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=k), "west" if k % 2 else "north", 100.0 + (80 if k % 2 else 0) + rng.random() * 20, None if k % 6 == 0 else rng.random() ** 6) for k in range(240)]
    found = look(table(spark, rows, "day timestamp_ntz, region string, total double, odd double"))
    kinds = [i.kind for i in found.insights]
    assert kinds[0] == "group_difference" and "missing_data" in kinds and len(kinds) <= insights.TOTAL and [i.importance for i in found.insights] == sorted((i.importance for i in found.insights), reverse=True)
    top = found.insights[0]
    assert found.charts[top.chart].kind == "box" and found.charts[top.chart].columns == top.columns
    assert {c.kind for c in found.charts} >= {"line", "box", "histogram", "bar"}


def test_ranking_drops_the_same_story():
    make = lambda kind, columns, strength: insights.Insight(f"{kind}:{columns}", kind, "", "", columns, strength, 1000)
    kept = insights.rank([make("trend", ("t", "v"), 0.9), make("sudden_change", ("t", "v"), 0.8), make("correlation", ("a", "b"), 0.9), make("correlation", ("b", "c"), 0.8), make("correlation", ("a", "c"), 0.7), *(make("outliers", (f"x{k}",), 0.5) for k in range(5))])
    assert [(i.kind, i.columns) for i in kept] == [("trend", ("t", "v")), ("correlation", ("a", "b")), ("correlation", ("b", "c")), ("outliers", ("x0",)), ("outliers", ("x1",)), ("outliers", ("x2",))]


def test_number_forms():
    assert [insights.number(x) for x in (1234567.0, 123.456, 1.234)] == ["1,234,567", "123.5", "1.23"] and insights.percent(0.1234) == "12.3%" and insights.multiple(1.84) == "1.8x"
    assert interval_labels([0.5234, 0.9981]) == ["(0.523, 0.998]"] and interval_labels([1.0001, 1.0002, 1.0003]) == ["(1.0001, 1.0002]", "(1.0002, 1.0003]"]


def test_tiny_tables_have_no_findings(spark):
    for n in (1, 2, 5):
        assert look(table(spark, [(float(k), "a") for k in range(n)], "v double, g string")).insights == ()


def test_store_lets_kept_results_go_before_it_refuses(spark, tmp_path):
    spark.range(2000).selectExpr("id", "cast(id as double) as v").coalesce(1).write.parquet(str(tmp_path / "x"))
    source = readers.read_parquet(spark, str(tmp_path / "x"))
    one = size_of(source)
    keeps = lambda n: parse({"steps": [{"op": "filter_rows", "clauses": [{"column": "v", "operator": "gte", "value": n}]}]})
    kept = Store(budget=4 * one)
    top = kept.add("ann", "x", source)
    made = [kept.derive("ann", top.id, keeps(n)) for n in (10, 20, 30)]
    assert list(kept._tables) == [m.id for m in made]
    kept.table("ann", made[0].id)  # now the second is the oldest
    kept.add("bob", "y", source)
    assert list(kept._tables) == [made[2].id, made[0].id]
    kept.add("bob", "z", source)
    kept.add("bob", "w", source)
    assert not kept._tables and [kept.table("ann", m.id).frame.count() for m in made] == [1990, 1980, 1970]
    with pytest.raises(Full):
        kept.add("ann", "u", source)
    kept.remove("bob", next(e.id for e in kept._entries.values() if e.name == "z"))
    assert kept.table("ann", made[1].id).frame.count() == 1980 and list(kept._tables) == [made[1].id]


def test_store(spark):
    now = [0.0]
    kept = Store(seconds=10, per_owner=4, clock=lambda: now[0])
    top = kept.add("ann", "orders.csv", table(spark, [(float(k), "ab"[k % 2]) for k in range(20)], "v double, g string"))
    recipe = parse({"steps": [{"op": "filter_rows", "clauses": [{"column": "v", "operator": "gte", "value": 10}]}]})
    child = kept.derive("ann", top.id, recipe)
    deep = kept.derive("ann", child.id, parse({"steps": [{"op": "aggregate", "group_by": ["g"], "aggregations": [{"function": "sum", "column": "v"}]}]}))
    assert kept.table("ann", deep.id).frame.count() == 2 and kept.title("ann", deep.id) == "orders.csv (2 steps)" and [e.id for e in kept.lineage("ann", deep.id)] == [top.id, child.id, deep.id]
    assert kept.provenance("ann", deep.id).rows_are_groups and kept.provenance("ann", child.id).rows_were_removed
    with pytest.raises(Missing):
        kept.get("bob", top.id)
    kept._tables.clear()
    assert kept.table("ann", child.id).frame.count() == 10
    kept.add("ann", "x", table(spark, [(1.0,), (2.0,)], "v double"))
    with pytest.raises(Full):
        kept.derive("ann", top.id, recipe)
    kept.remove("ann", child.id)
    with pytest.raises(Missing):
        kept.get("ann", deep.id)
    now[0] = 11
    with pytest.raises(Missing):
        kept.table("ann", top.id)
