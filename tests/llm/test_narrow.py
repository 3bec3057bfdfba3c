"""Operators that need no shuffle, against plain loops: decontamination, licence scan, language, packing."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vantage.llm import language_id, license_scan, packing
from vantage.llm.decontaminate import contamination_digest, find_contamination, remove_contamination
from vantage.llm.fm_index import FMIndex
from vantage.llm.license_scan import evaluate, identifier_expression, postfix, scan_licenses

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, lang string, spans int, items string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("size,symbols", [(60, 3), (900, 4), (1200, 60)])
def test_fm_index_counts_and_locates(size, symbols):
    text = np.random.default_rng(size).integers(0, symbols, size)
    text[-1] = 0
    index = FMIndex(text.astype(np.int64), symbols)
    for width in (1, 2, 4):
        patterns = np.array([text[i : i + width] for i in range(size - width) if (text[i : i + width] > 0).all()]).reshape(-1, width)[:40]
        low, high = index.search(patterns)
        for pattern, a, b in zip(patterns, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(size - width + 1) if (text[i : i + width] == pattern).all()]


def contaminated(docs, items, window=10):
    found = defaultdict(set)
    for item, text in items:
        row = words(text)
        n = min(window, len(row))
        for i in range(len(row) - n + 1 if n else 0):
            found[tuple(row[i : i + n])].add(str(item))
    out = {}
    for doc, text in docs:
        row, hit, names = words(text), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(row) - n + 1):
                if (own := found.get(tuple(row[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= own
        out[doc] = (len(row), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 4000])
def test_decontamination_equals_loops(spark, block_bytes):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    extra = spark.createDataFrame([(901, "Die und"), (902, ""), (903, None), (None, "the of"), (904, "Die und")], "item_id bigint, text string")
    bench = bench.unionByName(extra)
    got = contamination_digest(find_contamination(docs, bench, shard_bytes=50_000, block_bytes=block_bytes)).collect()
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None])
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert sum(r.contaminated for r in got) > 5


def test_decontamination_edges(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"Before. {passage.upper()} after", "x", 1, "y"), (2, None, None, None, None), (3, "", None, 2, "z"), (4, passage, "x", 3, "y"), (None, "plain", None, None, None), (1, "again", "x", 1, "y"), (5, "été " * 40_000 + passage, "fr", 1, "q")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    found = {(r.doc_id, r.n_words): [tuple(x) for x in r.spans] for r in find_contamination(docs, bench).collect()}
    assert found == {(1, 14): [(1, 13)], (2, 0): [], (3, 0): [], (4, 12): [(0, 12)], (None, 1): [], (1, 1): [], (5, 40_012): [(40_000, 40_012)]}
    left = remove_contamination(docs, bench).collect()
    assert sorted((r.text or "")[:20] for r in left if r.doc_id != 5) == ["", "", "Before.  after", "again", "plain"]
    assert [len(r.text.split()) for r in left if r.doc_id == 5] == [40_000]
    assert left[0].asDict().keys() == set(docs.columns)
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_with_clashing_names(spark, block_bytes):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b", "found", "named")], "doc_id bigint, text string, __found_spans string, __Found_items string")
    bench = spark.createDataFrame([(7, passage), (8, passage + " more"), (9, "x " * 20)], "item_id bigint, text string")
    left = remove_contamination(docs, bench, block_bytes=block_bytes)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "a  b", "found", "named")]


def test_decontamination_is_the_same_in_many_blocks(spark):
    """Items that overlap each other in a document, repeated ids and null ids, in one block and in about one per item."""
    told = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(told[at : at + 15])) for k, at in enumerate(range(0, 25, 5))]
    rows = [(1, " ".join(told)), (1, "x " + " ".join(told[:20]) + " y"), (1, "none"), (None, " ".join(told[3:30]) + " z"), (None, "null id"), (2, "a " + " ".join([*told[:7], *told[20:35], *told[7:20]])), (3, None), (3, "")]
    docs = spark.createDataFrame([(*r, None, k, None) for k, r in enumerate(rows)], DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one, many = ({"block_bytes": b} for b in (1 << 20, 60))
    found = [sorted(map(repr, find_contamination(docs, bench, **b).collect())) for b in (one, many)]
    left = [sorted(map(repr, remove_contamination(docs, bench, **b).collect())) for b in (one, many)]
    assert found[0] == found[1] and len(found[1]) == len(rows)
    assert left[0] == left[1] and not any("w10 " in x and "w9 " in x for x in left[1])


def test_licenses_equal_loops(spark):
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    more = [(9001, "CC BY CC-BY cc by. General Public\nLicense! all  rights reserved", None, None, None), (9002, None, None, None, None), (9003, "ccby xcc by", None, None, None), (None, "", None, None, None)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for doc, text in docs.collect():
        row, r = words(text), got[doc]
        places = sorted((i, label) for p, label in base.items() for i in range(len(row)) if row[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.base_labels) == (len(row), len(places), ",".join(sorted({x[1] for x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    assert got[9001].n_base == 5


def test_license_expressions(spark):
    assert postfix("MIT OR Apache-2.0 AND ISC".split()) == ["MIT", "Apache-2.0", "ISC", "and", "or"]
    assert postfix("( MIT OR ISC ) AND Zlib".split()) == ["MIT", "ISC", "or", "Zlib", "and"]
    assert postfix(["MIT", "OR"]) is None and postfix(["(", "MIT"]) is None and postfix([")"]) is None and postfix([]) is None
    assert evaluate("GPL-3.0 OR MIT".split()) == (1, ["mit"]) and evaluate("MIT OR ISC".split()) == (1, ["mit"])
    assert evaluate("( GPL-3.0 OR Unlicense ) AND Apache-2.0".split()) == (1, ["apache", "unlicense"])
    assert evaluate("GPL-3.0 AND MIT".split()) == (2, ["gpl", "mit"])
    assert evaluate("GPL-2.0 WITH Classpath-exception-2.0".split()) == (1, ["gpl-with-exception"])
    assert evaluate("MIT WITH ( A OR B )".split()) is None
    assert identifier_expression(b"(MIT OR ISC) AND Zlib and more text") == ["(", "MIT", "OR", "ISC", ")", "AND", "Zlib", "and", "more"]
    rows = [(1, "// SPDX-License-Identifier: MIT OR GPL-2.0-only\nx", None, None, None), (2, "SPDX-License-Identifier: OR", None, None, None)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].labels, got[1].expressions, got[1].kind) == ("mit", ["MIT OR GPL-2.0-only"], "permissive")
    assert got[2].labels == "malformed-tag"


def licence(expression):
    """Burden and labels by recursive descent, without the scanner's parser; None where it can't be read."""
    tokens = re.findall(r"[()]|[A-Za-z0-9.+:-]+", expression)
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def operand():
        nonlocal at
        if peek() == "(":
            at += 1
            out = choice()
            if peek() != ")":
                raise SyntaxError
            at += 1
            return (*out[:2], False)
        if peek() in (None, ")", "or", "and", "with"):
            raise SyntaxError
        low = tokens[at].lower().rstrip(".:")
        at += 1
        fits = [x for x in license_scan.BURDEN if re.match(re.escape(x) + r"($|[-+v])", low)]
        name = max(fits, key=len) if fits else low
        return license_scan.BURDEN.get(name, 3), {name}, True

    def excepted():
        nonlocal at
        out = operand()
        while peek() == "with":
            at += 1
            other = operand()
            if not (out[2] and other[2]):
                raise SyntaxError
            out = (1 if out[0] == 2 else out[0]), {f"{x}-with-exception" for x in out[1]}, False
        return out

    def both():
        nonlocal at
        out = excepted()
        while peek() == "and":
            at += 1
            other = excepted()
            out = max(out[0], other[0]), out[1] | other[1], False
        return out

    def choice():
        nonlocal at
        out = both()
        while peek() == "or":
            at += 1
            other = both()
            out = (*(other if other[0] < out[0] else out)[:2], False)
        return out

    try:
        out = choice()
    except SyntaxError:
        return None
    return out if at == len(tokens) else None


def licensed(text):
    """labels, kind and score of a text whose tags end with their expression, by plain search."""
    row, found, labels, burden = words(text), set(), set(), -1
    n_base = 0
    for phrase, label in {**license_scan.NOTICES, **license_scan.BASE}.items():
        parts = phrase.split()
        n = sum(row[i : i + len(parts)] == parts for i in range(len(row)))
        if n:
            labels.add(label)
            burden = max(burden, license_scan.BURDEN[label])
        n_base += n if phrase in license_scan.BASE else 0
    for line in re.split("[\r\n]", text or ""):
        for tag in license_scan.TAGS:
            for rest in line.translate(LOWER).split(tag)[1:]:
                told = licence(line[len(line) - len(rest) :]) if rest.strip() else None
                if told is None:
                    labels.add("malformed-tag")
                else:
                    found.add(rest)
                    labels |= told[1]
                    burden = max(burden, told[0])
    kind = ("free", "permissive", "copyleft", "restricted")[burden] if burden >= 0 else None
    return ",".join(sorted(labels)), kind, 0.0 if not labels else min(1.0, 0.5 + 0.1 * n_base + (0.4 if found else 0.0))


def test_license_labels_equal_plain_search(spark):
    rng = random.Random(3)
    names = ["MIT", "GPL-3.0-only", "LGPL-2.1+", "Apache-2.0", "CC0-1.0", "Foo-1.0", "CC-BY-SA-4.0", "Unlicense"]

    def expression(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(names)
        if rng.random() < 0.2:
            return f"{rng.choice(names)} WITH Classpath-exception-2.0"
        left, right = expression(depth - 1), expression(depth - 1)
        return rng.choice([f"({left} OR {right})", f"{left} AND {right}", f"{left} or {right}", f"({left}) and ({right})"])

    notices = [*license_scan.NOTICES, *license_scan.BASE]
    pieces = lambda: [rng.choice(notices).upper(), rng.choice(notices).replace(" ", "-"), f"// SPDX-License-Identifier: {expression(3)}", f"License-Expression: {expression(2)}\r", "plain words", "SPDX-License-Identifier:", "été spdx license identifier MIT"]
    rows = [(k, "\n".join(rng.sample(pieces(), rng.randrange(0, 6)))) for k in range(150)] + [(None, "MIT License"), (7, "MIT License"), (900, None)]
    names_ = "doc_id bigint, text string, labels string, kind string, id string"
    got = scan_licenses(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], names_)).collect()
    assert sorted(map(repr, ((r.doc_id, r.labels, r.kind, round(r.score, 9)) for r in got))) == sorted(map(repr, ((d, *licensed(t)[:2], round(licensed(t)[2], 9)) for d, t in rows)))
    assert scan_licenses(spark.createDataFrame([], names_)).count() == 0


def test_license_scan_is_linear_in_hits():
    phrases, tags = license_scan.automaton(), license_scan.tag_automaton()
    n = 200_000
    started = time.perf_counter()
    out = license_scan.scan(b"cc by SPDX-License-Identifier: MIT\n" * n, phrases, tags)
    assert out[1] == n and (out[2], out[3]) == (0, 6 * (n - 1)) and time.perf_counter() - started < 60


@pytest.mark.parametrize("unit,label", [(b"SPDX-License-Identifier: MIT ", "mit"), (b"SPDX-License-Identifier: ( MIT OR ", "malformed-tag"), (b"SPDX-License-Identifier: MIT OR ", "mit"), (b"spdx-license-identifier:", "malformed-tag")])
def test_many_tags_on_one_line_are_read_once(unit, label):
    phrases, tags = license_scan.automaton(), license_scan.tag_automaton()
    started = time.perf_counter()
    out = license_scan.scan(unit * (10_000_000 // len(unit)), phrases, tags)
    assert label in out[5].split(",") and time.perf_counter() - started < 60


def test_one_expression_of_many_names_is_evaluated_once():
    phrases, tags = license_scan.automaton(), license_scan.tag_automaton()
    names = [f"own{i}" for i in range(60_000)]
    started = time.perf_counter()
    out = license_scan.scan(("SPDX-License-Identifier: " + " AND ".join(names)).encode(), phrases, tags)
    assert len(out[5].split(",")) == len(names) and time.perf_counter() - started < 20


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out()).collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02


def kneser_ney(texts, order):
    """Interpolated Kneser-Ney by plain loops over tuples of classes: a function of a gram."""
    grams = {n: defaultdict(int) for n in range(1, order + 1)}
    for text in texts:
        row = [0] * (order - 2) + language_id.classes_of(text).tolist()
        for i in range(order - 1, len(row)):
            grams[order][tuple(row[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for gram in grams[n + 1]:
            grams[n][gram[1:]] += 1

    def discount(n):
        ones, twos = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def prob(gram):
        n = len(gram)
        if not n:
            return 1 / language_id.CLASSES
        after = [c for g, c in grams[n].items() if g[:-1] == gram[:-1]]
        if not after:
            return prob(gram[1:])
        d = discount(n)
        return (max(grams[n].get(gram, 0) - d, 0) + d * len(after) * prob(gram[1:])) / sum(after)

    return prob


@pytest.mark.parametrize("order", [3, 4])
def test_language_model_equals_plain_loops(spark, order):
    texts = {"x": ["abcab cab dab", "abba", "ab ab abc", "", "12"], "y": ["zzz yz zy", "Ünï ünï", None]}
    docs = spark.createDataFrame([(k, t, lang, None, None) for k, (lang, t) in enumerate((lang, t) for lang, every in texts.items() for t in every)], DOCS)
    model = language_id.fit(docs, orders=(order,), held=1_000_000)
    assert model.langs == ["x", "y"] and model.slack == language_id.UNCALIBRATED
    asked = ["abcabd", "zyzz", "qq vv", "ünïa b"]
    codes = np.concatenate([language_id.codes_of(language_id.classes_of(t), order) for t in asked])
    got = model.log_probs(codes)
    for k, lang in enumerate(model.langs):
        prob = kneser_ney([t for t in texts[lang] if t], order)
        for code, own in zip(codes.tolist(), got[:, k], strict=True):
            gram = tuple(code >> (language_id.BITS * j) & (language_id.CLASSES - 1) for j in range(order - 1, -1, -1))
            assert own == pytest.approx(np.log(prob(gram)), abs=1e-4)
    for context in ("ab", "zz", "qv", "b "):
        head = language_id.codes_of(language_id.classes_of(context), order)[len(context) - 1] << language_id.BITS & language_id._mask(order)
        assert np.exp(model.log_probs(head + np.arange(language_id.CLASSES)).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-3)


def test_language_order_and_slack_come_from_rows_held_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    assert model.order in (3, 4) and len(model.langs) == 4
    told = language_id.predict(docs.filter(language_id.held_out()), model).collect()
    assert np.mean([r.rejected for r in told]) < 0.02 and all(r.rejected == (r.excess is None or r.excess > model.slack) for r in told)
    with pytest.raises(ValueError):
        language_id.fit(docs.withColumn("lang", docs.doc_id.cast("string")))


def test_language_edges(spark):
    train = spark.createDataFrame([(k, f"the cat sat on the mat {k}", "en", None, None) for k in range(30)] + [(k, f"die katze sitzt auf der matte {k}", "de", None, None) for k in range(30, 60)] + [(70, None, "en", None, None), (71, "ohne sprache", None, None, None)], DOCS)
    model = language_id.fit(train)
    rows = [(1, None, "en", None, None), (2, "", None, None, None), (3, "123 !!", None, None, None), (4, "THE CAT", None, None, None), (None, "die matte", None, None, None), (4, "THE CAT", None, None, None), (6, "xqjvxqjv zvqxj qqqxzv " * 50, None, None, None), (7, "the cat sat on the mat " * 20_000, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.lang_pred, r.rejected) for r in language_id.predict(docs, model).collect())
    assert got == [(0, "de", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (6, got[6][1], True), (7, "en", False)]
    assert sorted(r.doc_id or 0 for r in language_id.keep_known(docs, model).collect()) == [0, 4, 4, 7]
    none = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.keep_known(docs, none).count() == 5
    assert language_id.predict(docs.limit(0), model).count() == 0


def check_packed(pieces, texts, width, end_id=2):
    own = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = [*own.encode(text or "", add_special_tokens=False).ids, end_id], 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids) == (at, len(ids), part) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
    return sum(r.length for r in pieces) / (width * len(by_sequence))


def test_packing_is_exact_and_dense(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fill = check_packed(packing.pack(docs, TOKENIZER, width=256).collect(), texts, 256)
    assert fill > 0.85
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert check_packed(packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), TOKENIZER).collect(), texts, 4096) > 0.98


def test_packing_edges(spark):
    odd = "Ça va? ΟΔΥΣΣΕΥΣ İstanbul été <|endoftext|> it's 12 34 \x1c x y"
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, odd, None, None, None), (4, "word " * 9000, None, None, None), (5, "One. Two. Three!", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    check_packed(packing.pack(docs, TOKENIZER, width=64).collect(), {r[0]: r[1] for r in rows}, 64)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0
    assert packing.pack(docs.unionByName(docs), TOKENIZER).agg({"length": "sum"}).first()[0] == 2 * packing.pack(docs, TOKENIZER).agg({"length": "sum"}).first()[0]


def test_other_tokenizers_take_texts_whole(tmp_path):
    """Only a file that prepares text exactly as the given one does is read word by word."""
    assert packing.TokenIds(TOKENIZER).by_word
    text = "A  text, with  some WORDS it's 12"
    for change in ("blank", "token", "prefix"):
        told = json.loads(open(TOKENIZER).read())
        if change == "blank":
            told["normalizer"]["normalizers"][1]["content"] = "_"
        elif change == "token":
            told["added_tokens"].append({**told["added_tokens"][0], "id": 49408, "content": "words"})
        else:
            told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
        path = tmp_path / f"{change}.json"
        path.write_text(json.dumps(told))
        own = packing.TokenIds(str(path))
        assert not own.by_word and own.encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_packing_with_null_ids_and_clashing_names(spark):
    names = ["start", "length", "ids", "sequence_id", "offset", "doc_tokens"]
    rows = [(None, "no id"), (None, "none either"), (1, "one"), (1, "one")]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = packing.pack(docs, TOKENIZER, width=8).collect()
    assert sum(r.length for r in got) == sum(len(Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert {r.doc_id for r in got} == {None, 1}


def test_language_ties_and_clashing_names(spark):
    """Two languages taught by the same texts: the first by name; columns that the operator uses itself."""
    names = ["part", "code", "n", "apart", "score", "lang_pred", "id"]
    rows = [(k, "the same words in both", lang, *names) for k in range(40) for lang in ("b", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    told = language_id.predict(docs, language_id.fit(docs, held=3)).collect()
    assert {r.lang_pred for r in told} == {"a"} and all(0.4 < r.score < 0.6 for r in told) and len(told) == len(rows)


def test_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        width = rng.randint(2, 6)
        lengths = np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 4))])
        ends = np.array(sorted(rng.sample(range(1, lengths.sum() + 1), rng.randint(0, lengths.sum()))), dtype=np.int64)
        places, costs = packing.cut_points(lengths, ends, width, 1.5, 7.0)
        price = dict(zip(places.tolist(), costs.tolist(), strict=True))
        best = {0: 0.0}
        for p in sorted(price):
            best[p] = min((best[q] + width - (p - q) + price[p] for q in best if 0 < p - q <= width), default=float("inf"))
        cuts = packing.best_cuts(places, costs, width)
        told = sum(width - (b - a) + price[b] for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == lengths.sum() and told == pytest.approx(best[int(lengths.sum())])
