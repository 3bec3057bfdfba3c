"""Collocations, SentencePiece ids and resampling, against plain loops and the library itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from vantage.llm import collocations as c
from vantage.llm import sentencepieces as sp
from vantage.llm.resampling import keep_drawn, resample

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, lang string, spans int, items string"


def best(rows, max_words, min_count, top, percent):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= min_count}
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2:
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [v for (other, *x), v in f.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * v >= percent * a for v in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("max_words,min_count,top,percent,cells", [(3, 3, 40, 50, 1 << 25), (5, 4, 1000, 80, 64), (2, 2, 7, 50, 1 << 12)])
def test_collocations_equal_loops(spark, max_words, min_count, top, percent, cells):
    """Also where almost all runs share their counters."""
    deal = random.Random(max_words)
    text = lambda: " ".join(deal.choice(["a", "B", "ç", "d.", "e", "f,g", "new", "York", "new York", "of the", "\t", "x\ny"]) for _ in range(deal.randrange(60)))
    rows = [(k, text(), deal.choice(["en", "de", None, "und", ""]), None, None) for k in range(120)] + [(1, None, "en", 1, "x"), (None, "", None, None, None)]
    rows += [(5, "new york of the a", "en", None, None)] * 5
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = c.collocations(docs, max_words=max_words, min_count=min_count, top=top, percent=percent, max_cells=cells, batch_bytes=700)
    assert {tuple(r) for r in got.collect()} == best([(r[2], r[1]) for r in rows], max_words, min_count, top, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, " .,; ", "en", None, None)], DOCS)
    assert c.collocations(docs).count() == 0 and c.collocations(docs.limit(0)).count() == 0


def test_sketches_never_say_too_little(spark):
    deal = np.random.default_rng(5)
    hashes = deal.choice(deal.integers(0, 1 << 63, 3000, dtype=np.uint64), 20_000)
    one, two = c.Sketch([256, 1024], 2), c.Sketch([256, 1024], 2)
    for part in np.array_split(hashes, 7):
        one.add(1, part)
    for part in np.array_split(hashes, 3):
        two.add(1, part)
    assert (one.cells == two.cells).all() and not one.cells[:512].any()
    known, counts = np.unique(hashes, return_counts=True)
    for least in (2, 8, 300):
        assert one.reaches(1, known[counts >= least], least).all()
    wide = c.Sketch([1, 1 << 16], 2)
    wide.add(1, hashes)
    assert wide.reaches(1, known[counts < 5], 12).mean() < 0.05
    assert (wide.cells.astype(int)[2:].sum()) == 2 * len(hashes)


def test_ranks_come_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(c, "LEVEL_ROWS", 10)
    deal = random.Random(2)
    rows = [(deal.choice("aaab"), f"p{i}", deal.randrange(9)) for i in range(900)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, score bigint")
    from pyspark.sql import functions as F

    got = c.first_in_each(frame, "lang", [F.desc("score"), F.asc("phrase")], 30, len(rows)).collect()
    for lang in "ab":
        want = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[2], r[1]))[:30]
        assert sorted((r.rank, r.phrase) for r in got if r.lang == lang) == [(i, r[1]) for i, r in enumerate(want, 1)]


ODD = [
    None, "", " ", "   ", "a", " a", "a ", "  two  blanks  ", "▁", "a▁b", "▁▁ ▁a", "line\nline\r\n\ttab", "<s> </s> <unk> <0x0A>", "Ａ ﬁ é é   　 x", "日本語 テキスト 🎉🎉 👩‍👩‍👧", "\x00 \x01\x7f", "1234567890 12 3", "x" * 3000,
    "word " * 5000, "٠١٢ हिन्दी ไทย", "  ﻿ � \U0010ffff",
]


def test_pieces_equal_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    deal = random.Random(3)
    made = ["".join(deal.choice([*"  ▁ab\n.,é日", "the", "ing ", " 12"]) for _ in range(deal.randrange(200))) for _ in range(300)]
    odd = spark.createDataFrame([(10_000 + k, x) for k, x in enumerate([*ODD, *made])] + [(None, "no id"), (1, "twice"), (1, "twice")], "doc_id bigint, text string")
    docs = docs.unionByName(odd)
    library = SentencePieceProcessor(model_file=MODEL)
    rows = docs.collect()
    ids = library.encode([r.text or "" for r in rows])
    want = Counter((r.doc_id, tuple(x), y) for r, x, y in zip(rows, ids, library.decode(ids), strict=True))
    for batch in (1000, 2 << 20):
        got = sp.decode(sp.encode(docs, MODEL, batch_bytes=batch), MODEL).collect()
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert sp.encode(docs.limit(0), MODEL).count() == 0


def test_pieces_are_cut_only_where_none_crosses(monkeypatch):
    pieces = sp.Pieces(MODEL)
    assert pieces.by_chunk
    texts = [x or "" for x in ODD]
    want = [pieces.processor.encode(x) for x in texts]
    monkeypatch.setattr(sp, "MOST_CHUNKS", 3)  # the table is begun anew in each batch
    assert all([x.tolist() for x in pieces.encode(texts)] == want for _ in range(3))
    assert not any(len(x) > sp.LONGEST for x in pieces.table)
    pieces.by_chunk = False
    assert [x.tolist() for x in pieces.encode(texts)] == want


def test_decode_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, [1, 2], "x"), (2, None, None), (3, [], "y"), (4, [450, 29871], "z")], "id int, ids array<int>, text string")
    got = {r.id: (r.text, r.decoded) for r in sp.decode(rows, MODEL).collect()}
    assert got == {1: ("x", ""), 2: (None, None), 3: ("y", ""), 4: ("z", SentencePieceProcessor(model_file=MODEL).decode([450, 29871]))}
    with pytest.raises(ValueError, match="already"):
        sp.decode(rows, MODEL, decoded_col="text")


def drawn(docs, target, orders, buckets, percent, min_words, seed):
    def runs(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    own = [(doc, text, *runs(text)) for doc, text in docs]
    s, t = Counter(b for r in own for b in r[3]), Counter(b for text in target for b in runs(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for doc, _, n_words, found in own:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((doc, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    top = able[: percent * len(able) // 100]
    return Counter((*r, None) for r in rows) - Counter((*r, None) for r in top) + Counter((*r, k) for k, r in enumerate(top, 1))


@pytest.mark.parametrize("orders,buckets,percent", [(1, 10_000, 10), (3, 97, 40), (2, 1, 100)])
def test_resampling_equals_loops(spark, orders, buckets, percent):
    docs, target = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    extra = [(900, None, "x", 1, "y"), (901, "", None, None, None), (None, "no id but words " * 9, None, None, None), (902, "One two", None, None, None), (5, "again and again " * 8, "x", None, None), (5, "again and again " * 8, "x", None, None)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOCS).select("doc_id", "text"))
    target = target.select("text").unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    got = resample(docs, target, orders=orders, buckets=buckets, percent=percent)
    assert Counter(tuple(r)[:6] for r in got.collect()) == drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], orders, buckets, percent, 20, 2024)


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9, "en", 2, "w"), (1, "a b c " * 9, "en", 3, "w"), (None, "d e f " * 9, None, None, None), (2, None, None, None, None)], DOCS)
    kept = keep_drawn(docs, docs.select("text"), percent=100)
    assert kept.columns == docs.columns and sorted(r.spans or 0 for r in kept.collect()) == [0, 2, 3]
    assert resample(docs.limit(0), docs).count() == 0
    assert [r.rank for r in resample(docs, docs.limit(0), percent=0).collect()] == [None] * 4
    with pytest.raises(ValueError, match="buckets"):
        resample(docs, docs, buckets=1 << 21)
