"""Operators that shuffle, against plain loops: substrings, lines, near-duplicates, neighbours, archives, chats, pipeline."""

import base64
import gzip
import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import ann, chat_format, line_dedup, minhash, shared, substring_dedup, warc
from vantage.llm.components import components
from vantage.llm.fm_index import FMIndex
from vantage.llm.shared import Written, join_classes

DOCS = "doc_id bigint, text string, lang string, runs int, spans string"
BLANKS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [(None, "a row without id " * 9, None, None, None), (100, None, "x", 1, "y"), (101, "", None, None, None), (102, " \t\n ", None, None, None), (103, "short one", None, 2, "q"), (104, "été naïve \x1c" * 9000, "fr", None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


def made_texts(seed, n, words=40, vocabulary=12):
    """Texts over few words with copied passages, so that all kinds of overlaps occur."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefghijkl") + str(rng.randrange(vocabulary)) for _ in range(words)) for _ in range(5)]
    out = []
    for k in range(n):
        parts = [" ".join(rng.choice("mnopq") + str(rng.randrange(400)) for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        out.append((k, rng.choice(["  ", "\n", " "]).join(parts)))
    return out + [(n, "x " * 90), (n + 1, "x " * 70 + "y"), (n + 2, passages[0])]


def repeated(rows, window):
    seen, out = {}, {}
    words = {d: BLANKS.findall(t or "") for d, t in rows if d is not None}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            seen.setdefault(tuple(words[d][i : i + window]), (d, i))
    for d, row in words.items():
        gone = set()
        for i in range(len(row) - window + 1):
            if seen[tuple(row[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(row) if i not in gone)
        out[d] = (len(row), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed,shard_bytes,mark_bytes", [(1, 4 << 20, 1 << 20), (2, 600, 1 << 20), (3, 600, 400)])
def test_substrings_equal_loops(spark, seed, shard_bytes, mark_bytes):
    rows = made_texts(seed, 60) + [r[:2] for r in ODD]
    got = substring_dedup.dedup_substrings(frame(spark, rows), shard_bytes=shard_bytes, mark_bytes=mark_bytes, batch_bytes=2000).collect()
    want = repeated(rows, 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got if r.doc_id is not None} == want
    assert sum(x[1] for x in want.values()) > 500
    assert [(r.n_words, r.n_removed) for r in got if r.doc_id is None] == [(36, 0)]
    for r in got:
        assert r.n_removed == sum(s.stop - s.start for s in r.spans)


def test_matching_statistics_equal_loops():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (40, 25, 60)])
    index = FMIndex(text.astype(np.int64), 4)
    ends = np.array([e for e in range(8, len(text)) if (text[e - 8 : e] > 0).all()])
    length, low, high = substring_dedup.matching_statistics(index, text, ends, 8)
    for e, n, a, b in zip(ends, length, low, high, strict=True):
        times = [sum((text[i : i + k] == text[e - k : e]).all() for i in range(len(text) - k + 1)) for k in range(1, 9)]
        assert n == sum(t > 1 for t in times) and b - a == (times[n - 1] if n else len(text))


def test_substrings_edges(spark):
    assert substring_dedup.dedup_substrings(frame(spark, ODD).limit(0)).count() == 0
    text = " ".join(map(str, range(30)))
    twice = substring_dedup.dedup_substrings(frame(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, 0), (1, 0), (2, 30)]
    other = " ".join(f"b{i}" for i in range(30))
    shared = substring_dedup.dedup_substrings(frame(spark, [(0, text), (1, text), (1, other), (1, None), (2, f"{other} x {text}")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in shared) == [(0, 30, 0), (1, 0, 0), (1, 30, 0), (1, 30, 30), (2, 61, 60)]


def lines_removed(rows, m=2, alone=50):
    """Each document's text without its later copies of runs, its lines, those removed, and the maximal runs, by comparing
    all places with each other."""
    lines = {d: t.split("\n") for d, t in rows if d is not None and t is not None}
    places = [(d, i) for d in sorted(lines) for i in range(len(lines[d]))]
    heads = defaultdict(list)
    out = {}
    for d, i in places:
        heads[lines[d][i]].append((d, i))
    for d, row in lines.items():
        longest = []
        for i in range(len(row)):
            best = 0
            for e, j in heads[row[i]]:
                if (e, j) < (d, i):
                    n = 0
                    while i + n < len(row) and j + n < len(lines[e]) and row[i + n] == lines[e][j + n]:
                        n += 1
                    best = max(best, n)
            longest.append(best)
        gone, runs = set(), []
        for i, n in enumerate(longest):
            words = sum(len(BLANKS.findall(x)) for x in row[i : i + n])
            full = sum(bool(BLANKS.findall(x)) for x in row[i : i + n])
            if n and (i == 0 or longest[i - 1] != n + 1) and (full >= m or words >= alone):
                gone.update(range(i, i + n))
                runs.append((i, n, words))
        out[d] = ("\n".join(x for i, x in enumerate(row) if i not in gone), len(row), len(gone), runs)
    return out


SOME_LINES = ["", "a", "b b", "c\tc c", "dd", "five words are in here", "a line of eight words, as told\u00a0so, here", "Ünï"]


@pytest.mark.parametrize("m,alone", [(1, 99), (2, 50), (3, 8)])
def test_lines_equal_loops(spark, m, alone):
    rng = random.Random(m + alone)
    rows = [(k, "\n".join(rng.choice([*SOME_LINES, f"own {k}"]) for _ in range(rng.randrange(1, 25)))) for k in range(40)]
    whole = "\n".join(f"line {i} of a long text" for i in range(13))
    rows += [(50, whole), (51, "x\n" + whole), (52, whole + "\ny\n" + whole[: len(whole) // 2]), (53, "x\n" * 70), (54, "x\n" * 33), (55, "p\nq\n" * 30 + "x\nx")]
    rows += [r[:2] for r in ODD if r[1] is not None]
    rules = {"min_lines": m, "alone_words": alone}
    want = lines_removed(rows, m, alone)
    got = line_dedup.dedup_lines(frame(spark, rows), **rules).collect()
    assert {r.doc_id: (r.text, r["__n_lines"], r["__n_removed"]) for r in got if r.doc_id is not None} == {d: x[:3] for d, x in want.items()}
    found = line_dedup.find_repeated_runs(frame(spark, rows), **rules).collect()
    runs = defaultdict(list)
    texts = dict(rows)
    for r in sorted(found, key=lambda r: (r.doc, r.pos)):
        runs[r.doc].append((r.pos, r.length, r.words))
        other = texts[r.first.doc].split("\n")[r.first.pos :]
        assert (r.first.doc, r.first.pos) < (r.doc, r.pos) and other[: r.length] == texts[r.doc].split("\n")[r.pos : r.pos + r.length]
    assert runs == {d: x[3] for d, x in want.items() if x[3]}


LINES = ["one two three four five", "six seven eight nine ten", "eleven twelve thirteen fourteen"]


def test_lines_edges(spark):
    a, b, c = LINES
    rows = [*ODD, (1, f"{a}\n{b}\n{c}", "en", 7, "s"), (2, f"x\n{a}\n{b}\ny", "en", 8, "t"), (3, f"{a}\n{b}", "de", 9, "u"), (4, "\nThanks.", "en", 1, "v"), (5, "\nThanks.", "en", 1, "v"), (6, "Best,\n\nAnn", "en", 1, "v"), (7, "own\nBest,\n\nAnn\n", "en", 1, "v")]
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert (got[2].text, got[2].runs, got[2].spans, got[3].text, got[1].text, got[5].text, got[7].text) == ("x\ny", 8, "t", "", rows[len(ODD)][1], "\nThanks.", "own\n")
    assert got[100].text is None and got[100]["__n_lines"] == 0 and got[101].text == "" and got[None].text == ODD[0][1]
    left = line_dedup.drop_repeated_lines(frame(spark, rows))
    assert left.columns == DOCS.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ") and {r.doc_id for r in left.collect()} == set(got) - {3}
    again = line_dedup.dedup_lines(frame(spark, [(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, f"{a}\n{b}")])).collect()
    assert sorted((r.doc_id, r.text) for r in again) == [(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, "")]
    shared = line_dedup.dedup_lines(frame(spark, [(1, f"{a}\n{b}"), (1, f"{a}\n{b}\nmore"), (2, f"{c}\n{a}\n{b}")])).collect()
    assert sorted(r.text for r in shared if r.doc_id == 1)[0] in ("", "more") and [r.text for r in shared if r.doc_id == 2] == [c]
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0
    assert line_dedup.find_repeated_runs(frame(spark, ODD)).count() == 0
    plan = line_dedup.dedup_lines(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_with_clashing_and_odd_names(spark):
    a, b, _ = LINES
    names = ["doc", "twin", "pos", "__n_lines", "__n_removed", "__spans", "__doc", "spans", "a.b", "rank"]
    rows = [(f"id {k}", f"{k}\n{a}\n{b}", *(f"{n}{k}" for n in names)) for k in range(3)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in ["key", "body.text", *names]))
    out = line_dedup.dedup_lines(docs, id_col="key", text_col="body.text")
    assert out.columns == [*docs.columns, "__n_lines_", "__n_removed_"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(*rows[0], 3, 0), *((r[0], str(k + 1), *r[2:], 3, 2) for k, r in enumerate(rows[1:]))]
    assert line_dedup.drop_repeated_lines(docs, id_col="key", text_col="body.text").columns == docs.columns


@pytest.mark.parametrize("share", [1, 10, 2000])
def test_hot_classes_are_joined_like_others(spark, tmp_path, monkeypatch, share):
    rng = random.Random(1)
    rows = [(k, rng.choice([1] * 50 + [2, 3, 4, 5, None]), rng.choice(["a", "b", None])) for k in range(3000)]
    spark.createDataFrame(rows, "id bigint, x bigint, y string").write.parquet(str(tmp_path / "rows"))
    frame_ = spark.read.parquet(str(tmp_path / "rows"))
    frame_.filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("x <> 4").write.parquet(str(tmp_path / "classes"))
    classes = spark.read.parquet(str(tmp_path / "classes"))
    sizes = classes.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most")).first().asDict()
    monkeypatch.setattr(shared, "HEAVY_SHARE", share)
    got = join_classes(frame_, classes, sizes, ["x", "y"], ["low", "n"], ["id"]).collect()
    size, low = defaultdict(int), {}
    for k, x, y in rows:
        size[x, y] += 1
        low.setdefault((x, y), k)
    known = lambda x, y: x is not None and y is not None and x != 4
    assert sorted((r.id, r.low, r.n) for r in got) == [(k, *((low[x, y], size[x, y]) if known(x, y) else (None, None))) for k, x, y in rows]


def test_pipeline_cuts_repeated_long_lines(spark):
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage), (4, "short\nline"), (5, "line")])
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, "").collect()}
    assert got == {1: f"a\n{passage}\nb", 2: "c\nd", 4: "short\nline", 5: "line"}


def near(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = BLANKS.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    low = {d: d for d in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_loops(spark, width):
    rng = random.Random(width)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 60, 120]))]
        for _ in range(rng.randrange(1, 16)):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 14)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.3 else " ".join(own)))
    rows += [r[:2] for r in ODD if r[0] is not None and r[0] < 104] if len(rows) < 100 else [(d + 1000, t) for d, t in [r[:2] for r in ODD if r[0] is not None]]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), width=width, batch_bytes=5000).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in near(rows, width).items()}
    assert len({c for _, c, _ in got.values()}) < len(rows)


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [*ODD, (1, text, "en", 1, "s"), (2, text, "en", 2, "t"), (3, text + " more", "de", 3, "u")]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (1, False) and got[None] == (None, True) and got[100] == (100, True) and got[101] == (101, True)
    left = minhash.drop_near_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns and {r.doc_id for r in left.collect()} == set(got) - {2, 3}
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    other = " ".join(f"b{i}" for i in range(50))
    shared = minhash.drop_near_duplicates(frame(spark, [(1, text), (5, text), (5, other), (5, None), (6, other), (6, text + " more")])).collect()
    assert sorted((r.doc_id, r.text or "") for r in shared) == [(1, text), (5, ""), (5, other)]
    assert sorted(r.kept for r in minhash.near_duplicates(frame(spark, [(1, text), (1, text)])).collect()) == [True, True]


def test_open_buckets_lose_no_link(spark):
    """A chain: each text is near the next, while the ends share little; and a group around a text that is no hub."""
    words = [f"c{i}" for i in range(100)]
    rows = [(k, " ".join([f"n{i}" for i in range(4 * k)] + words[4 * k :])) for k in range(20)]
    rng = random.Random(3)
    for k in range(60):
        own = list(words)
        for _ in range(rng.randrange(3, 9)):
            own[rng.randrange(100)] = f"s{rng.randrange(12)}"
        rows.append((100 + k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), width=2, hub_rounds=1).collect()}
    assert got == {d: c for d, (_, c) in near(rows, 2).items()}


def test_open_buckets_are_held_once_and_looked_at_while_components_change(spark, monkeypatch):
    """Groups whose members share many bands; their buckets stay open, and no round adds to what the first one linked."""
    seen = {}

    class Told(Written):
        def put(self, key, frame, **measures):
            out = super().put(key, frame, **measures)
            if re.match("wanted|open", key):
                seen[key] = [tuple(r) for r in out.collect()]
            return out

    monkeypatch.setattr(minhash, "Written", Told)
    rng = random.Random(5)
    rows = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(100)]
        for _ in range(25):
            own = list(words)
            for at in rng.sample(range(100), rng.choice([2, 12, 30])):
                own[at] = f"s{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), width=2).collect()}
    assert got == {d: c for d, (_, c) in near(rows, 2).items()}
    buckets = {}
    for id_, _, cells in seen.pop("wanted"):
        for cell in cells:
            buckets.setdefault(cell, set()).add(id_)
    assert len({frozenset(b) for b in buckets.values()}) == len(buckets) > 20
    assert "open1" in seen and seen["open1"]
    views = [{(r[0], r[1]): r[3:] for r in seen[k]} for k in sorted(seen)]
    assert all(a != b for a, b in zip(views, views[1:], strict=False))


def test_hub_outside_open_buckets_loses_no_link(spark, monkeypatch):
    """4 and 5 share 90 of 100 words and one bucket, whose hub 1 stands in a bucket of one component only."""
    told = lambda letter, n: [f"{letter}{i}" for i in range(n)]
    half, ten, forty = told("w", 50), told("x", 10), told("f", 40)
    texts = {1: half + ten + forty + ["one"], 2: half + forty, 3: half + forty + ["three"], 4: half + told("u", 40) + ten, 5: half + told("u", 40) + told("y", 10)}
    rows = [(d, " ".join(t)) for d, t in texts.items()]

    class Told:
        def __init__(self, bands, rows):
            pass

        def band_keys(self, shingles):
            return np.array({101: [2], 90: [1, 2]}.get(len(shingles), [1]), np.uint64)

    monkeypatch.setattr(minhash, "MinMax", Told)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), width=1).collect()}
    assert got == {d: c for d, (_, c) in near(rows, 1).items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_near_duplicates_with_text_ids_and_clashing_names(spark):
    """Ids are texts; the table has columns that the operator uses itself, and a bucket stays open for a round."""
    words = [f"c{i}" for i in range(100)]
    rows = [(f"id {k:02d}", " ".join([f"n{i}" for i in range(4 * k)] + words[4 * k :])) for k in range(12)]
    columns = ["n_shingles", "set_key", "bands", "component_id", "kept", "class_id", "id"]
    docs = spark.createDataFrame([(*r, *columns) for r in rows], ", ".join(f"{c} string" for c in ["key", "body", *columns]))
    options = {"id_col": "key", "text_col": "body", "width": 2}
    got = {r.key: r.component_id for r in minhash.near_duplicates(docs, hub_rounds=1, **options).collect()}
    assert got == {d: c for d, (_, c) in near(rows, 2).items()}
    left = minhash.drop_near_duplicates(docs, **options)
    assert left.columns == docs.columns and {r.key for r in left.collect()} == set(got.values())


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    low = {x: x for pair in links for x in pair}
    for _ in range(len(low)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), Written(spark, "test")).collect()
    assert {r.node: r.component for r in got} == {x: c for x, c in low.items() if any(a != b and x in (a, b) for a, b in links)}


def test_min_max_estimates():
    rng = np.random.default_rng(2)
    sketch = minhash.MinMax(48, 6)
    for share in (0.3, 0.8):
        base = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
        common = int(2000 * 2 * share / (1 + share))
        other = np.concatenate((base[:common], rng.integers(0, 1 << 64, 2000 - common, dtype=np.uint64)))
        agree = np.mean(sketch.signature(base) == sketch.signature(other))
        assert agree == pytest.approx(share, abs=0.12)


def brute(vectors, queries, k):
    out = {}
    for q, point in queries.items():
        far = sorted((float(np.sqrt(((np.array(v, dtype=np.float32).astype(float) - np.array(point, dtype=np.float32).astype(float)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = far[:k]
    return out


def test_neighbours_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.filter("vec_id % 10 = 0")
    got = ann.nearest(vectors, asked, shard_rows=120).collect()
    told = {r.vec_id: r.embedding for r in vectors.collect()}
    want = brute(told, {q: told[q] for q in told if q % 10 == 0}, 10)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((r.score, r.vec_id))
    assert np.mean([len({i for _, i in found[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    for q, rows in found.items():
        assert rows == sorted(rows) and len(rows) == 10 and q not in {i for _, i in rows}
        exact = dict((i, s) for s, i in brute(told, {q: told[q]}, 10_000)[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for s, i in rows)


def test_neighbours_recall_at_the_registered_setting(spark):
    """Three shards of about 4096 rows, a beam of 96, the query's defaults; normal vectors lie far from each other."""
    points = np.random.default_rng(5).normal(size=(10_000, 24)).astype(np.float32)
    vectors = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: set(np.argsort(((points.astype(float) - points[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, 10_000, 100)}
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9


def test_neighbours_of_several_dimensions_in_several_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=2 + k % 3).tolist(), k, "x", 0.5) for k in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, shard int, dim string, score double")
    got = defaultdict(list)
    for r in ann.nearest(vectors, vectors.filter("vec_id < 60"), shard_rows=40, block_rows=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    told = {r[0]: r[1] for r in rows}
    for q in range(60):
        far = sorted((float(np.sqrt(((np.array(v) - np.array(told[q])) ** 2).sum())), i) for i, v in told.items() if i != q and len(v) == len(told[q]))
        assert got[q] == [i for _, i in far[:10]]


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (8, [], 1)]
    rows += [(k, [1.0, 0.0], 2) for k in range(100, 160)] + [(0, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(vectors, vectors.filter("vec_id % 100 = 0 or vec_id in (2, 3, 7)")).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, k + 1, v, 0.0) for k, v in enumerate([1, *range(100, 109)])]
    assert [g[2] for g in got if g[0] == 100] == [0, 1, *range(101, 109)] and {g[0] for g in got} == {0, 100}
    assert ann.nearest(vectors.limit(0), vectors).count() == 0 and ann.nearest(vectors, vectors.limit(0)).count() == 0


PAGES = "page_id bigint, url string, html string, payload_digest string"


def test_archives_round_trip(spark, tmp_path):
    body = "<p>été</p>\r\n\r\n<b>x</b>\r\n\r\n"
    rows = [(5, "http://www.B.org/x?q=1", body, "c"), (3, "https://a.org:8080/Y#top", body, None), (1, "http://b.org/x", "", None), (2, None, None, None), (None, "no url at all", "lonely", None), (9, "http://a.org/", "z" * 300_000, None), (4, "bad\r\nurl", "\r\n\r\n", None)]
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=3)
    files = list(Path(tmp_path / "w").glob("*.gz"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and raw.endswith(b"\r\n\r\n")
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len((t or "").encode()), digest(t)) for i, _, t, _ in rows}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 1: ("response", None), 2: ("revisit", 1), None: ("response", None), 9: ("response", None), 4: ("response", None)}
    assert got[5].url_key == "org,b)/x?q=1" and got[3].url_key == "org,a)/y"
    again = warc.read_archives(spark, str(tmp_path / "w"))
    warc.write_archives(pages, str(tmp_path / "v"), min_bytes=1)
    assert {r.page_id for r in warc.read_archives(spark, str(tmp_path / "v")).filter("record_type = 'revisit'").collect()} == {5}
    index = warc.capture_index(again, rows_per_range=2).orderBy("range_id", "range_place").collect()
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in index]
    assert keys == sorted(keys) and len(keys) == len(rows)


@pytest.mark.parametrize("rows_per_range", [1, 7, 1000])
def test_capture_histories(spark, tmp_path, rows_per_range):
    """A URL with a third of all captures over many ranges; repeated rows, null ids and URLs."""
    rng = random.Random(8)
    urls = ["http://hot.org/"] * 20 + [f"http://b.org/{k}" for k in range(9)] * 4 + [None]
    rows = [(k, u, "same" if k % 3 else f"own {k}", None) for k, u in enumerate(rng.sample(urls, len(urls)))]
    rows += [rows[0], rows[0], (None, "http://hot.org/", "x", None)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), seconds=F.coalesce(F.col("page_id"), F.lit(0)) % 5)
    entries = warc.read_archives(spark, str(tmp_path / "w"))
    warc.capture_index(entries, rows_per_range=rows_per_range).write.parquet(str(tmp_path / "index"))
    got = warc.capture_histories(spark.read.parquet(str(tmp_path / "index"))).orderBy("place").collect()
    key = lambda r: (r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0)
    assert [r.place for r in got] == list(range(len(rows))) and list(map(key, got)) == sorted(map(key, got))
    seen = defaultdict(int)
    for r in got:
        seen[r.url_key] += 1
        assert r.capture_no == seen[r.url_key]
    assert all(r.record_type == "response" for r in got if r.page_id == rows[0][0]) == (rows[0][2] != "same" or rows[0][0] == min(i for i, _, t, _ in rows if t == "same" and i is not None))


ENDS = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n", "\n\r\n", "\r\r\n", "\r\n\r\n\r\n\r\n"]


@pytest.mark.parametrize("per_file", [1, 7, 1000])
def test_archives_of_payloads_with_line_ends(spark, tmp_path, per_file):
    """Payloads that end in, begin with or are line ends, around the reader's buffers of 64 KiB, first and last in a file."""
    rng = random.Random(per_file)
    texts = [a + body + b for a in ENDS[:7] for b in ENDS for body in ("", f"<p>{rng.randrange(99)}</p>", "".join(rng.choice(["\r", "\n", "\r\n", "x"]) for _ in range(40)))]
    texts += ["y" * (65_000 + 40 * k) + ENDS[k % len(ENDS)] for k in range(20)]
    rng.shuffle(texts)
    pages = spark.createDataFrame([(k, f"http://a.org/{k}", t, None) for k, t in enumerate(texts)], PAGES)
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=per_file)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {k: (len(t), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for k, t in enumerate(texts)}


def test_records_are_cut_by_their_length():
    made = [warc.record(k, "http://a.org/", end.encode(), len(end), "D", None, 0) for k, end in enumerate(ENDS)]
    assert list(warc.whole_records(b"".join(r + warc.END for r in made).split(warc.END))) == made
    with pytest.raises(ValueError):
        list(warc.whole_records((made[3][:-2] + warc.END + made[0] + warc.END).split(warc.END)))


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7, 12])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(30), j) for _ in range(rng.randrange(0, 20))) for j in range(k)]
    assert list(warc.loser_tree_merge(runs)) == sorted(x for r in runs for x in r)


def test_cut_off_archive_is_an_error():
    whole = warc.record(1, "http://a.org/", b"x\r\n\r\ny", 6, "D", None, 0)
    assert list(warc.whole_records(whole.split(warc.END))) == [whole]
    with pytest.raises(ValueError):
        list(warc.whole_records(whole[:-4].split(warc.END)[:-1]))


TURNS = "conv_id bigint, turn bigint, role string, text string, part string"


def test_preferences(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "hi", "z"), (1, 1, "assistant", "yes", None), (1, 2, "user", "more", None), (1, 3, "assistant", "Ünï", None), (2, 0, "user", "a", None), (3, 0, "user", "q", None), (3, 1, "assistant", "same", None), (4, 0, "user", "alone", None), (None, 0, "user", "x", None), (1, None, "user", "x", None), (1, 0, "user", "hi", "y")], TURNS)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", None), (1, 1, "assistant", "yes", None), (1, 2, "user", "less", None), (2, 0, None, "b", None), (2, 1, "assistant", None, None), (3, 0, "user", "q", None), (3, 1, "assistant", "same", None), (5, 0, "user", "alone", None)], TURNS)
    got = {r.pair_id: r for r in chat_format.format_preferences(chat_format.turns_of(chosen), chat_format.turns_of(rejected)).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (2, "<|user|>\nhi\n<|assistant|>\nyes\n")
    assert one.chosen == "<|user|>\nmore\n<|assistant|>\nÜnï\n" and one.rejected == "<|user|>\nless\n" and one.rejected_mask == ""
    start, stop = map(int, one.chosen_mask.split("-"))
    assert one.chosen[start:stop] == "Ünï"
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].rejected, got[2].rejected_mask) == (0, "", "<|unknown|>\nb\n<|assistant|>\n\n", "28-28")
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (2, "", "")
    assert chat_format.format_preferences(chat_format.turns_of(chosen.limit(0)), chat_format.turns_of(rejected)).count() == 0
    plan = chat_format.format_preferences(chat_format.turns_of(chosen), chat_format.turns_of(rejected))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_reply_makes_a_pair(spark):
    """Even and sparse ids, the only one of its id twice, null ids and turns, and conversations without a reply."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t}", None) for c in [2, 4, -8, 100, 10**12, *range(200, 400, 4)] for t in range(2 + c % 3)]
    rows += [(7, 0, "user", "no reply", None), (None, 1, "assistant", "x", None), (9, None, "assistant", "x", None), (2, 1, "assistant", "also", None)]
    replies = {}
    for c, t, role, _, _ in rows:
        if c is not None and t is not None and role == "assistant":
            replies[c] = max(t, replies.get(c, 0))
    order = sorted(replies)
    render = lambda c, t: "".join(f"<|{r}|>\n{x}\n" for r, x in sorted((r, x) for d, u, r, x, _ in rows if (d, u) == (c, t)))
    got = {r.pair_id: r for r in chat_format.format_preferences(*chat_format.next_replies(spark.createDataFrame(rows, TURNS))).collect()}
    assert set(got) == set(order)
    for k, c in enumerate(order):
        other = order[(k + 1) % len(order)]
        assert (got[c].prompt, got[c].chosen, got[c].rejected) == ("".join(render(c, t) for t in range(replies[c])), render(c, replies[c]), render(other, replies[other]))
    for few in (rows[:0], [(1, 0, "assistant", "alone", None)], rows[-4:-1]):
        assert chat_format.format_preferences(*chat_format.next_replies(spark.createDataFrame(few, TURNS))).count() == 0
    plan = chat_format.format_preferences(*chat_format.next_replies(spark.createDataFrame(rows, TURNS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{source}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = after
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    texts = lambda name: {r.doc_id: r.text for r in kept[name].collect()}
    raw, language, lines, single, clean = {r.doc_id: r.text for r in docs.collect()}, *(texts(n) for n in ("language", "lines", "near_duplicates", "decontamination"))
    assert set(language) <= set(raw) and len(language) > 0.95 * len(raw)
    want = {d: t for d, (t, n, gone, _) in lines_removed(list(language.items())).items() if not gone or gone < n}
    assert lines == want
    groups = near(list(lines.items()), 5)
    assert set(single) == {d for d, (_, c) in groups.items() if d == c}
    assert set(clean) <= set(single) and any(clean[d] != single[d] for d in clean)
    assert {r.doc_id for r in kept["packing"].select("doc_id").distinct().collect()} == set(clean)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == kept["packing"].agg(F.sum("length")).first()[0]


def test_pipeline_on_nothing_and_on_odd_rows(spark, tmp_path):
    """Every stage takes an empty table, null and empty texts, null ids, repeated rows and columns that stages use
    themselves; what it keeps has the columns it was given."""
    import corpus_pipeline

    names = ["lang", "source", "n_chars", "twin", "pos", "bands", "set_key", "spans", "__found_spans_", "rank", "sequence_id_"]
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)
    plain = "the quick brown fox jumps over the lazy dog and the cat sat down on the mat again"
    rows = [(1, plain), (1, plain), (2, None), (3, ""), (None, plain), (4, f"{plain}\n{plain} twice"), (5, "x " * 3000)]
    docs = spark.createDataFrame([(*r, "en", *["z"] * (len(names) - 1)) for r in rows], schema)
    spark.createDataFrame([(1, "nothing of the kind"), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        none, some = (stage(spark, d, str(tmp_path)) for d in (docs.limit(0), docs))
        assert none.count() == 0 and some.count() > 0
        if name != "packing":
            assert none.columns == some.columns == docs.columns
