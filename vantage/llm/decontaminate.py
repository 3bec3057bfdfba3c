"""Benchmark decontamination: find test passages in training text by an FM-index over each shard of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fm_index import FMIndex
from .shared import free_name
from .words import alnum_words, by_bytes, utf8, word_spans

SPANS = "array<struct<start:bigint,stop:bigint>>"


class Phrases:
    """The windows of a block of benchmark items, as symbols of the block's own vocabulary."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            if item is None or text is None:
                continue
            ids = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in alnum_words(text.encode("utf-8", "surrogatepass")))
            width = min(window, len(ids))
            for at in range(len(ids) - width + 1 if width else 0):
                found.setdefault(ids[at : at + width], set()).add(str(item))
        self.by_width: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for width in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == width]
            self.by_width[width] = (np.array(keys, dtype=np.int64).reshape(len(keys), width), [sorted(found[k]) for k in keys])

    @property
    def shortest(self) -> int:
        return min(self.by_width, default=0)


class _Zero(dict):
    """Words outside the benchmark's vocabulary are 0: they end any match."""

    def __missing__(self, key: bytes) -> int:
        return 0


def _symbols(texts: list[bytes | None], table: _Zero) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as symbols, one after another, and each text's number of words."""
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = alnum_words(text) if text else []
        counts[k] = len(words)
        parts.append(np.fromiter(map(table.__getitem__, words), dtype=np.int32, count=len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts


def _stretches(symbols: np.ndarray, counts: np.ndarray, shortest: int) -> np.ndarray:
    """Positions in runs of at least `shortest` known words within one text: a match lies in such a run."""
    known = symbols > 0
    owner = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(symbols)))
    return np.flatnonzero(known & np.repeat(lengths >= shortest, lengths))


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Each text's number of words, its merged spans of hit words (rows of start and stop) and its items."""
    symbols, counts = _symbols(texts, _Zero(phrases.symbols))
    first = np.concatenate(([0], np.cumsum(counts)))
    spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
    items: list[set[str]] = [set() for _ in texts]
    if not phrases.by_width or not len(symbols):
        return counts, spans, [sorted(x) for x in items]
    kept = _stretches(symbols, counts, phrases.shortest)
    if not len(kept):
        return counts, spans, [sorted(x) for x in items]
    gap = np.ones(len(kept), dtype=bool)
    owner = np.searchsorted(first, kept, side="right") - 1
    gap[1:] = (kept[1:] != kept[:-1] + 1) | (owner[1:] != owner[:-1])
    place = np.arange(len(kept)) + np.cumsum(gap)  # a 0 stands before each run
    text = np.zeros(place[-1] + 2, dtype=np.int64)
    text[place] = symbols[kept]
    back = np.zeros(len(text), dtype=np.int64)
    back[place] = kept
    index = FMIndex(text, len(phrases.symbols) + 1)
    mark = np.zeros(len(symbols) + 1, dtype=np.int64)
    for width, (patterns, owners) in phrases.by_width.items():
        low, high = index.search(patterns)
        n = high - low
        which = np.repeat(np.arange(len(patterns)), n)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        at = back[index.locate(rows)]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + width, -1)
        doc = np.searchsorted(first, at, side="right") - 1
        for pair in np.unique(doc * len(patterns) + which):
            items[pair // len(patterns)].update(owners[pair % len(patterns)])
    hit = np.cumsum(mark[:-1]) > 0
    doc_of_hit = np.searchsorted(first, np.flatnonzero(hit), side="right") - 1
    for doc in np.unique(doc_of_hit):
        edge = np.diff(np.concatenate(([0], hit[first[doc] : first[doc + 1]].view(np.int8), [0])))
        spans[doc] = np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1)
    return counts, spans, [sorted(x) for x in items]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple]]]:
    """The benchmark in blocks of about block_bytes of text, so that what is sent to the tasks stays bounded; each with
    whether it is the last."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1
    part = F.pmod(F.xxhash64(F.col(item_col).cast("string")), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark if blocks == 1 else benchmark.filter(part == k)
        yield k == blocks - 1, [tuple(r) for r in rows.select(item_col, text_col).collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 8 << 20, block_bytes: int = 8 << 20,
) -> DataFrame:
    """Words of documents that lie inside an occurrence of a window of a benchmark item.

    Returns a row for each row of docs: the id, n_words, spans (merged word spans, start and stop from 0) and
    items (distinct ids with an occurrence, as strings, sorted). Each task indexes its documents in shards of about
    shard_bytes of text and searches the windows in them; nothing is shuffled. A benchmark beyond block_bytes is
    searched block by block; each row takes its spans along from block to block.

    Null text and text without words: no words, no spans. A null id stays null. An item that is null, empty or has
    no id has no windows. Repeated items find the same spans; repeated documents give a row each. Other columns of
    either table are not looked at."""
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(batch: pa.RecordBatch, texts: list[bytes | None], counts: np.ndarray, spans: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), _span_lists(spans), pa.array(items, pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "items"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    return _searched(rows, blocks, window, "text", shard_bytes, listed, f"`{id_col}` {kind}, n_words bigint, spans {SPANS}, items array<string>")


def _searched(rows: DataFrame, blocks: Iterator[tuple[bool, list[tuple]]], window: int, text_col: str, shard_bytes: int, finish: Callable[..., pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """What finish(batch, texts, counts, spans, items) makes of the rows and the union of all blocks' spans. Every block
    is searched in the text as it was given; two columns of names that are free take along what was found before."""
    found, named_ = free_name(rows, "__found_spans"), free_name(rows, "__found_items")
    between = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{found}` {SPANS}, `{named_}` array<string>").fields])
    out = rows
    for last, items in blocks:
        shared = rows.sparkSession.sparkContext.broadcast(Phrases(items, window))  # bounded by block_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, text_col, shard_bytes):
                texts = utf8(batch.column(text_col))
                counts, spans, names = search_shard(texts, shared.value)
                if found in batch.schema.names:
                    spans = [_union(x, earlier) for x, earlier in zip(spans, batch.column(found).to_pylist(), strict=True)]
                    names = [sorted({*x, *earlier}) for x, earlier in zip(names, batch.column(named_).to_pylist(), strict=True)]
                    batch = batch.drop_columns([found, named_])
                if last:
                    yield finish(batch, texts, counts, spans, names)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, _span_lists(spans), pa.array(names, pa.list_(pa.string()))], names=[*batch.schema.names, found, named_])

        out = out.mapInArrow(run, schema if last else between)
    return out


def _span_lists(spans: list[np.ndarray]) -> pa.Array:
    return pa.array([[{"start": int(a), "stop": int(b)} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))


def _union(spans: np.ndarray, earlier: list[dict]) -> np.ndarray:
    """The union of spans, ascending; touching ones become one."""
    if not earlier:
        return spans
    out: list[list[int]] = []
    for start, stop in sorted([*spans.tolist(), *([x["start"], x["stop"]] for x in earlier)]):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return np.array(out, dtype=np.int64)


def cut_spans(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the words in the spans and what stands between them."""
    starts, stops = word_spans(text)
    out, at = [], 0
    for first, stop in spans:
        out.append(text[at : starts[first]])
        at = stops[stop - 1]
    return b"".join([*out, text[at:]])


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shard_bytes: int = 8 << 20, block_bytes: int = 8 << 20,
) -> DataFrame:
    """The documents with the hit spans cut out of their text; one of which no word is left goes.

    All columns stay as they are but the text, so n_chars or the like is not brought up to date here. Documents
    without a hit stay, empty and null ones included. Each block of a large benchmark is one more pass; all search the
    text as it was given, and the last cuts out what any has found."""

    def cut(batch: pa.RecordBatch, texts: list[bytes | None], counts: np.ndarray, spans: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
        keep = np.ones(len(texts), dtype=bool)
        for k, found in enumerate(spans):
            if len(found):
                keep[k] = (found[:, 1] - found[:, 0]).sum() < counts[k]
                texts[k] = cut_spans(texts[k], found)
        place = batch.schema.get_field_index(text_col)
        fresh = batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.schema.field(place).type))
        return fresh.filter(pa.array(keep))

    return _searched(docs, benchmark_blocks(benchmark, item_col, item_text_col, block_bytes), window, text_col, shard_bytes, cut, docs.schema)


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that the query returns, from find_contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["stop"] - x["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
