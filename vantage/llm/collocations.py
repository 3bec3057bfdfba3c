"""Phrase collocations: merged count-min sketches rule out rare word runs, the rest is counted exactly, scored, subsumed."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written
from .words import LOWER, by_bytes, grams, hashed_words, mix, utf8

#: Counters stop here, so a byte holds one; that an estimate reaches a smaller threshold is still known.
FULL = 255
BLOCK = 1 << 20
SKETCHES = "block int, cells binary, lang string, words bigint"
#: A batch of the first pass: sketches of small batches are the same, and a worker holds less beside the sketch.
SKETCHED_BYTES = 1 << 20
SKETCH_COLUMNS = [x.split()[0] for x in SKETCHES.split(", ")]
#: first_in_each(): groups are cut into this many parts a level, and a level ends where a task gets so many rows at most.
FANOUT, LEVEL_ROWS = 64, 128_000


def _kinds() -> np.ndarray:
    """Byte map: 0 part of a word, 1 between words, 2 between pieces (`[.,;:!?\\x0A-\\x0D]`)."""
    out = np.zeros(256, np.uint8)
    out[[0x20, 0x09]] = 1
    out[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return out


KINDS = _kinds()


@dataclass
class Words:
    """All words of some texts in order: their number among the distinct ones, the piece and the language they are in."""

    distinct: pa.BinaryArray
    number: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(texts: list[bytes | None], langs: np.ndarray) -> Words:
        """langs: each text's language as a number."""
        raw = np.frombuffer(b"\n".join(x or b"" for x in texts).translate(LOWER), dtype=np.uint8)
        kinds = KINDS[raw]
        edge = np.diff((kinds == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[kinds == 0])])
        coded = every.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own, _, _, _ = hashed_words([b" ".join(coded.dictionary.to_pylist())])
        stops = np.cumsum([len(x or b"") + 1 for x in texts])
        lang = langs[np.searchsorted(stops, starts, side="right")] if len(starts) else np.zeros(0, np.int64)
        return Words(coded.dictionary, number, np.searchsorted(np.flatnonzero(kinds == 2), starts), lang, own[number] if len(own) else own)

    def runs(self, width: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of `width` words start that lie in one piece, and a hash of each with its language."""
        n = max(len(self.number) - width + 1, 0)
        at = np.flatnonzero(self.piece[:n] == self.piece[len(self.piece) - n :])
        return at, mix(grams(self.hashes, width)[at] ^ seeds[self.lang[at]])


class Sketch:
    """Count-min sketches of one-byte counters, one for each length of runs; `width` counters (a power of two) a row."""

    def __init__(self, widths: list[int], depth: int, cells: np.ndarray | None = None):
        self.widths, self.depth = widths, depth
        self.cells = np.zeros(depth * sum(widths), np.uint8) if cells is None else cells

    def _places(self, order: int, hashes: np.ndarray) -> Iterator[np.ndarray]:
        base = self.depth * sum(self.widths[:order])
        step = mix(hashes + np.uint64(1)) | np.uint64(1)
        for row in range(self.depth):
            place = (hashes + np.uint64(row) * step) >> np.uint64(20)
            yield base + row * self.widths[order] + (place & np.uint64(self.widths[order] - 1)).astype(np.int64)

    def add(self, order: int, hashes: np.ndarray) -> None:
        for place in self._places(order, hashes):
            place.sort()
            head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
            own = place[head]
            n = np.diff(np.append(head, len(place)))
            self.cells[own] = np.minimum(self.cells[own] + n, FULL).astype(np.uint8)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(self.cells), BLOCK):
            own = self.cells[at : at + BLOCK]
            if own.any():
                yield at // BLOCK, own

    def reaches(self, order: int, hashes: np.ndarray, count: int) -> np.ndarray:
        """Whether the estimates, which are never too low, reach the count."""
        out = np.ones(len(hashes), bool)
        for place in self._places(order, hashes):
            out &= self.cells[place] >= min(count, FULL)
        return out


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = mix(np.array([zlib.crc32(x.encode()) + 1 + (len(x) << 32) for x in names], np.uint64))
    return names, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), seeds


def sketched(rows: DataFrame, widths: list[int], depth: int, tasks: int, batch_bytes: int) -> DataFrame:
    """(block, cells, lang, words): blocks of the sketches of few tasks (about one for each core, so that what is to be
    merged does not grow with the number of files), and each language's number of words, without a block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, words = Sketch(widths, depth), {}
        for batch in by_bytes(batches, "text", min(batch_bytes, SKETCHED_BYTES)):
            names, langs, seeds = _languages(batch)
            found = Words.of(utf8(batch.column("text")), langs)
            for name, n in zip(names, np.bincount(found.lang, minlength=len(names)).tolist(), strict=True):
                words[name] = words.get(name, 0) + n
            for order in range(len(widths)):
                sketch.add(order, found.runs(order + 1, seeds)[1])
        yield from _merged_rows(sketch.blocks(), words)

    return rows.coalesce(tasks).mapInArrow(build, SKETCHES)


def merged(parts: DataFrame) -> DataFrame:
    """The same rows with equal blocks added up, one block at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, words = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] is None:
                    words[row["lang"]] = words.get(row["lang"], 0) + row["words"]
                    continue
                own = np.frombuffer(row["cells"], np.uint8)
                if row["block"] == now:
                    cells = np.minimum(cells.astype(np.int16) + own, FULL).astype(np.uint8)
                    continue
                if now is not None:
                    yield from _merged_rows([(now, cells)], {})
                now, cells = row["block"], own
        yield from _merged_rows([(now, cells)] if now is not None else [], words)

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, SKETCHES)


def _merged_rows(blocks: Iterable[tuple[int, np.ndarray]], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for block, cells in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.tobytes()], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=SKETCH_COLUMNS)
    if words:
        n = len(words)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=SKETCH_COLUMNS)


def survivors(rows: DataFrame, shared: Broadcast, widths: list[int], depth: int, min_count: int, batch_bytes: int) -> DataFrame:
    """(lang, size, phrase, n): the runs of each batch that the sketches allow min_count of, as well as the runs within
    them, with their exact number of occurrences in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(widths, depth, np.frombuffer(shared.value, np.uint8))
        for batch in by_bytes(batches, "text", batch_bytes):
            names, langs, seeds = _languages(batch)
            found = Words.of(utf8(batch.column("text")), langs)
            alive, rank = np.ones(len(found.number) + 1, bool), found.lang
            for order in range(len(widths)):
                at, hashes = found.runs(order + 1, seeds)
                may = alive[at] & alive[at + min(order, 1)]
                at, hashes = at[may], hashes[may]
                at = at[sketch.reaches(order, hashes, min_count)]
                if not len(at):
                    break
                code = rank[at] * len(found.distinct) + found.number[at + order]  # exact: the run before its last word, and that word
                _, first, own, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
                alive, rank = np.zeros(len(found.number) + 1, bool), np.zeros(len(found.number), np.int64)
                alive[at], rank[at] = True, own
                spots = at[first]
                parts = [found.distinct.take(pa.array(found.number[spots + k])) for k in range(order + 1)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).cast(pa.string())
                lang = pa.array(names, pa.string()).take(pa.array(found.lang[spots]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(spots), order + 1, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "n"])

    return rows.mapInArrow(run, "lang string, size int, phrase string, n bigint")


def phrase_counts(
    docs: DataFrame, kept: Written, *, max_words: int, min_count: int, depth: int, max_cells: int, lang_col: str, text_col: str, batch_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all runs of up to max_words words that occur min_count times, exactly; (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max_cells, max(1 << 16, 1 << (size // 32).bit_length()))
    widths = [1 << (max(n // depth, 1).bit_length() - 1) for n in [cells // 4] + [cells] * (max_words - 1)]
    parts = sketched(rows, widths, depth, spark.sparkContext.defaultParallelism, batch_bytes)
    found = kept.put("sketch", merged(parts))
    whole = np.zeros(depth * sum(widths), np.uint8)
    for block, own in found.filter("block is not null").select("block", "cells").toLocalIterator():
        whole[block * BLOCK : block * BLOCK + len(own)] = np.frombuffer(own, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())
    part = survivors(rows, shared, widths, depth, min_count, batch_bytes)
    counts = part.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    counts = kept.put("counts", counts)
    shared.destroy()
    return counts, found.filter("block is null").groupBy("lang").agg(F.sum("words").alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words and more, by its lowest-scoring cut."""
    cuts = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    left, right = (counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(n)) for part, n in (("first", "l"), ("rest", "r")))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(a as decimal(19, 0)) * a * 1000000 div (cast(l as decimal(19, 0)) * r)")
    lowest = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the most frequent longer phrase that holds the phrase."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), s -> array_join(slice(split(phrase, ' '), s, w), ' '))))"
    )
    return counts.filter("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def first_in_each(rows: DataFrame, group: str, order: list[Column], count: int, n_rows: int) -> DataFrame:
    """The first `count` rows of each group with their rank, level by level: no task sorts a whole large group."""
    salt = lambda parts: F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    parts = 1
    while parts * LEVEL_ROWS < n_rows:
        parts *= FANOUT
    while parts > 1:
        own = Window.partitionBy(group, salt(parts)).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= count).drop("rank")
        parts //= FANOUT
    own = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(own).cast("bigint")).filter(F.col("rank") <= count)


def collocations(
    docs: DataFrame, *, max_words: int = 3, min_count: int = 10, top: int = 2000, percent: int = 50, depth: int = 2, max_cells: int = 1 << 25,
    lang_col: str = "lang", text_col: str = "text", batch_bytes: int = 4 << 20,
) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased, texts are split at `[.,;:!?\x0A-\x0D]`, pieces into words `[^\x20\x09]+`. n is a language's
    number of words, f a run's number of occurrences within pieces. Phrases of 2 to max_words words with a = f >=
    min_count count. A cut into l = f(first part) and r = f(rest) has the score floor(1000000 a a / (l r)), exactly (for
    a up to 10^16); the lowest counts, of equal ones the earliest. A phrase inside a longer one that occurs at least
    percent as often goes. The first `top` stay, by score, a (both descending) and phrase (in bytes).

    A first pass merges sketches whose counters never say too little; a second one counts exactly what they let through,
    so they can only save work. max_cells bytes for each length of two and more words bound what the driver and
    each worker hold; they rule out most rare runs up to some 32 bytes of text a counter, fewer beyond that.

    Null languages are `und` (with those so named), null and empty texts have no words, repeated rows count each; an
    empty table gives none. Other columns are not looked at. A phrase longer than a batch is counted like others."""
    kept = Written(docs.sparkSession, "collocations")
    counts, totals = phrase_counts(docs, kept, max_words=max_words, min_count=min_count, depth=depth, max_cells=max_cells, lang_col=lang_col, text_col=text_col, batch_bytes=batch_bytes)
    inside = F.coalesce(F.col("most") * 100 >= F.col("a") * percent, F.lit(False))
    left = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left").filter(~inside).drop("most")
    left = kept.put("scored", left, n=F.count("*"))
    best = first_in_each(left, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, kept.told["scored"]["n"])
    out = kept.put("best", best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    kept.only("best")
    return out
