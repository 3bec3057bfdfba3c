"""Substring dedup: word windows that occurred before, found by backward search in an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import Written, named
from .words import by_bytes, grams, hashed_words, utf8

SPANS = "array<struct<start:bigint,stop:bigint>>"
GRAM = 5


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def marked_runs(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their smallest gram: (text, first window, windows, mark, occurrences of the mark).

    Equal windows have equal marks, so all copies of a window meet under its mark."""
    width = window - GRAM + 1
    each = grams(hashes, GRAM)
    if len(each) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    mark = sliding_min(each, width)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    owner = np.repeat(np.arange(len(counts)), counts)[: len(mark)]
    inside = np.arange(len(mark)) + window <= (first + counts)[owner]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (mark[at[1:]] != mark[at[:-1]]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(at)))
    start, value = at[head], mark[at[head]]
    span = n + width - 1
    steps = np.arange(int(span.sum())) - np.repeat(np.concatenate(([0], np.cumsum(span)[:-1])), span)
    same = each[np.repeat(start, span) + steps] == np.repeat(value, span)
    times = np.add.reduceat(same.astype(np.int64), np.concatenate(([0], np.cumsum(span)[:-1])))
    doc = owner[start]
    return doc, start - first[doc], n, value.view(np.int64), times


def _runs(docs: DataFrame, window: int, batch_bytes: int) -> DataFrame:
    """(mark, doc, start, windows, times) of all documents."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            hashes, counts, _, _ = hashed_words(utf8(batch.column("text")))
            doc, start, n, mark, times = marked_runs(hashes, counts, window)
            yield pa.RecordBatch.from_arrays([pa.array(mark), batch.column("doc").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.minimum(times, 2).astype(np.int8))], names=["mark", "doc", "start", "windows", "times"])

    return docs.mapInArrow(run, f"mark bigint, doc {kind}, start int, windows int, times tinyint")


def _segments(cut: DataFrame, window: int, batch_bytes: int) -> DataFrame:
    """(mark, words, doc, start): the words of each candidate run, from rows (doc, text, runs)."""
    kind = cut.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            marks, words, owners, starts = [], [], [], []
            for k, (text, runs) in enumerate(zip(utf8(batch.column("text")), batch.column("runs").to_pylist(), strict=True)):
                row = text.split()
                for r in runs:
                    marks.append(r["mark"])
                    starts.append(r["start"])
                    owners.append(k)
                    words.append(b" ".join(row[r["start"] : r["start"] + r["windows"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(words, pa.binary()), batch.column("doc").take(pa.array(owners, pa.int64())), pa.array(starts, pa.int32())], names=["mark", "words", "doc", "start"])

    return cut.select("doc", "text", "runs").mapInArrow(run, f"mark bigint, words binary, doc {kind}, start int")


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end in the text: how many symbols before it, `most` at the most, also stand elsewhere in the index, and
    the rows of the index that start with them. All ends are searched backwards together; one whose rows are down to its
    own has its statistic."""
    low, high = index.start(len(ends))
    length = np.zeros(len(ends), dtype=np.int64)
    live = np.arange(len(ends))
    for step in range(most):
        a, b = index.extend(text[ends[live] - 1 - step], low[live], high[live])
        more = b - a > 1
        live = live[more]
        if not len(live):
            break
        low[live], high[live] = a[more], b[more]
        length[live] += 1
    return length, low, high


def first_windows(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For segments in order: the windows of each that start nowhere earlier, as spans (rows of start and stop).

    One FM-index holds the shard, and the segments are streamed against it. Where a matching statistic reaches the
    window, its rows are located, and the smallest position among them is the first copy; the others are later ones."""
    table: dict[bytes, int] = {}
    rows = [[table.setdefault(w, len(table) + 1) for w in x.split()] for x in segments]
    lengths = np.array([len(x) for x in rows], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    flat = np.fromiter((s for x in rows for s in x), dtype=np.int64, count=int(lengths.sum()))
    text[np.arange(len(flat)) + np.repeat(np.arange(len(rows)), lengths)] = flat
    index = FMIndex(text, len(table) + 1)
    n = lengths - window + 1
    place = np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    length, low, high = matching_statistics(index, text, place + window, window)
    first = np.ones(len(place), dtype=bool)
    live = np.flatnonzero(length == window)
    if len(live):
        ranges, which = np.unique(low[live], return_inverse=True)
        ends = np.zeros(len(ranges), dtype=np.int64)
        ends[which] = high[live]
        size = ends - ranges
        offsets = np.concatenate(([0], np.cumsum(size)[:-1]))
        hits = index.locate(np.repeat(ranges - offsets, size) + np.arange(int(size.sum())))
        first[live] = np.minimum.reduceat(hits, offsets)[which] == place[live]
    out, at = [], 0
    for k in n.tolist():
        edge = np.diff(np.concatenate(([0], first[at : at + k].view(np.int8), [0])))
        out.append(np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1))
        at += k
    return out


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """The segments' windows as segments of their own, each under a mark that its own words make."""
    kind = segments.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                marks, words, owners, starts = [], [], [], []
                for k, (text, start) in enumerate(zip(batch.column("words").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                    hashes, _, _, _ = hashed_words([text])
                    row = text.split()
                    for at, mark in enumerate(grams(hashes, window).view(np.int64).tolist()):
                        marks.append(mark)
                        words.append(b" ".join(row[at : at + window]))
                        owners.append(k)
                        starts.append(start + at)
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(words, pa.binary()), batch.column("doc").take(pa.array(owners, pa.int64())), pa.array(starts, pa.int32())], names=["mark", "words", "doc", "start"])

    return segments.select("mark", "words", "doc", "start").mapInArrow(run, f"mark bigint, words binary, doc {kind}, start int")


def _distinct(segments: DataFrame) -> DataFrame:
    """Equal segments as one, with the first place of all."""
    return segments.groupBy("mark", "words").agg(F.min(F.struct("doc", "start")).alias("first")).select("mark", "words", "first.doc", "first.start")


def _firsts(distinct: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(doc, start, stop): spans of candidate windows that are first copies, from rows (mark, words, doc, start) that
    lie sorted by mark; a shard holds whole marks."""
    kind = distinct.schema["doc"].dataType.simpleString()

    def solve(batch: pa.Table) -> pa.RecordBatch:
        doc = batch.column("doc").combine_chunks()
        keys = pa.table({**{x: pa.compute.struct_field(doc, x) for x in ("id", "twin")}, "start": batch.column("start")})
        batch = batch.take(pa.compute.sort_indices(keys, sort_keys=[(x, "ascending") for x in keys.column_names])).combine_chunks()
        spans = first_windows(batch.column("words").to_pylist(), window)
        owner = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
        begin = batch.column("start").to_numpy().astype(np.int64)[owner]
        every = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
        docs = batch.column("doc").take(pa.array(owner, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([docs if isinstance(docs, pa.Array) else docs.chunk(0), pa.array(every[:, 0] + begin), pa.array(every[:, 1] + begin)], names=["doc", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column("mark").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(marks[1:] != marks[:-1]) + 1, [len(marks)]))
            sizes = np.concatenate(([0], np.cumsum(pa.compute.binary_length(batch.column("words")).to_numpy())))
            at = 0
            if held and held[-1].column("mark")[-1].as_py() != marks[0] and size >= shard_bytes:
                yield solve(pa.Table.from_batches(held))
                held, size = [], 0
            for edge in edges[1:-1].tolist():
                if size + sizes[edge] - sizes[at] >= shard_bytes:
                    held.append(batch.slice(at, edge - at))
                    yield solve(pa.Table.from_batches(held))
                    held, size, at = [], 0, edge
            held.append(batch.slice(at))
            size += int(sizes[-1] - sizes[at])
        if held:
            yield solve(pa.Table.from_batches(held))

    return distinct.select("mark", "words", "doc", "start").mapInArrow(run, f"doc {kind}, start bigint, stop bigint")


def repeated_spans(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20, shard_bytes: int = 4 << 20, mark_bytes: int = 1 << 20) -> DataFrame:
    """(doc, windows, firsts) of the documents that hold candidate windows: spans of window starts that may repeat,
    and spans of those among them that are the first copy. The other candidates start earlier somewhere. doc is the id
    with `twin`, a hash of the text, so that rows that share an id are documents of their own.

    A window's mark is its smallest hashed gram of five words; runs of neighbouring windows share one. Only runs whose
    mark occurs twice can repeat. Their words are grouped (equal runs become one, with the first place of each), dealt
    out by mark and searched in an FM-index per shard. A mark with more than mark_bytes of distinct words is dealt out
    by its windows instead, so that no shard holds it whole. Marks are joined and grouped with partial sums; words
    decide, not hashes. Rows without id or text take no part."""
    spark = docs.sparkSession
    kept = Written(spark, "substring")
    rows = _with_twins(docs, id_col, text_col).filter("doc.id is not null and text is not null")
    runs = kept.put("runs", _runs(rows, window, batch_bytes))
    twice = runs.groupBy("mark").agg(F.sum("times").alias("n")).filter("n > 1").select("mark")
    lists = runs.join(twice.hint("shuffle_hash"), "mark").groupBy("doc").agg(F.collect_list(F.struct("mark", "start", "windows")).alias("runs"))
    lists = kept.put("lists", lists)
    kept.drop("runs")
    segments = _segments(rows.join(lists.hint("shuffle_hash"), "doc"), window, batch_bytes)
    dealt = kept.put("distinct", _distinct(segments), n=F.count("*"))
    sizes = dealt.groupBy("mark").agg(F.sum(F.octet_length("words")).alias("size"))
    hot = kept.put("hot", sizes.filter(F.col("size") > mark_bytes).select("mark"), n=F.count("*"))
    if kept.told["hot"]["n"]:
        parted = kept.put("parted", _distinct(_windows(dealt.join(hot, "mark", "left_semi"), window)))
        dealt = dealt.join(hot, "mark", "left_anti").select("mark", "words", "doc", "start").unionByName(parted)
    firsts = kept.put("firsts", _firsts(dealt.repartition("mark").sortWithinPartitions("mark"), window, shard_bytes))
    kept.drop("distinct", "hot", "parted")
    by_doc = firsts.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("firsts"))
    out = lists.select("doc", F.transform("runs", lambda r: F.struct(r["start"].cast("bigint").alias("start"), (r["start"] + r["windows"]).cast("bigint").alias("stop"))).alias("windows"))
    return out.join(by_doc, "doc", "left").select("doc", "windows", F.coalesce("firsts", F.array().cast(SPANS)).alias("firsts"))


def _with_twins(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = named(text_col)
    return docs.select(F.struct(named(id_col).alias("id"), F.xxhash64(text).alias("twin")).alias("doc"), text.alias("text"))


def removed_words(n: int, window: int, windows: list | None, firsts: list | None) -> np.ndarray:
    """Which of n words are covered by a candidate window that is no first copy."""
    gone = np.zeros(n + 1, dtype=bool)
    for r in windows or ():
        gone[r["start"] : r["stop"]] = True
    for r in firsts or ():
        gone[r["start"] : r["stop"]] = False
    step = np.zeros(n + window + 1, dtype=np.int64)
    at = np.flatnonzero(gone)
    step[at] += 1
    np.add.at(step, at + window, -1)
    return np.cumsum(step)[:n] > 0


def dedup_substrings(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20, shard_bytes: int = 4 << 20, mark_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text, kept_sha256) of each document.

    Words are blank-separated and unchanged. A word goes if a window of `window` consecutive words of its document
    covers it whose words also start earlier: in a document of smaller id, or further up. Windows are judged on the
    input. spans are the removed words' spans; kept_text is the kept words joined by one blank.

    Null text: no words, and empty kept text. A row without id takes no part and keeps its words. Repeated rows
    (equal id and text) count as one document and get a row each. Rows that share an id and differ in text are documents
    of their own, in the order of a hash of their texts. Other columns are not looked at."""
    found = repeated_spans(docs, window=window, id_col=id_col, text_col=text_col, batch_bytes=batch_bytes, shard_bytes=shard_bytes, mark_bytes=mark_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _with_twins(docs, id_col, text_col).join(found.hint("shuffle_hash"), "doc", "left").select(F.col("doc.id").alias("doc"), "text", "windows", "firsts")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            n, lost, spans, texts, digests = [], [], [], [], []
            for text, windows, firsts in zip(utf8(batch.column("text")), batch.column("windows").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                words = (text or b"").split()
                gone = removed_words(len(words), window, windows, firsts) if windows else np.zeros(len(words), dtype=bool)
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                kept = b" ".join(words if not windows else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                n.append(len(words))
                lost.append(int(gone.sum()))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                texts.append(kept)
                digests.append(hashlib.sha256(kept).hexdigest())
            columns = [batch.column("doc"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, span), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_removed", "spans", "kept_text", "kept_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, spans {SPANS}, kept_text string, kept_sha256 string")
