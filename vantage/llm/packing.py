"""Packing: token streams cut into windows of one length at document or sentence ends, by dynamic programming."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import by_bytes

#: How the vocabulary file itself prepares text. Only then are its words found one by one; texts for any
#: other file go to the tokenizer whole.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_PIECE = regex.compile(_PATTERN)
#: Texts with anything else go to the tokenizer whole too: composition, case and blanks are plain only up to U+02FF.
_PLAIN = regex.compile("[^\\x09-\\x0d\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u02ff]")
SENTENCE_END = (".", "!", "?", "...", "!!", "?!", "??", '."', '!"', '?"')
CACHED_RUNS, CACHED_PIECES = 300_000, 150_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Recent(dict):
    """What a function gave for the keys met lately: when a generation is full, the one before it is forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class TokenIds:
    """Token ids of whole texts as little-endian 32-bit numbers, each distinct word merged once in a worker."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        normalizers, cuts = ((told.get(x) or {}).get(y, []) for x, y in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        marks = all(x["content"].startswith("<|") for x in told.get("added_tokens") or ())  # texts with these go whole
        self.by_word = normalizers == _NORMALIZERS and cuts == _CUTS and marks
        self.letters = _byte_letters()
        self.pieces = Recent(self._piece, CACHED_PIECES)
        self.runs = Recent(self._run, CACHED_RUNS)
        vocab = self.tokenizer.get_vocab()
        ends = sorted(i for x in SENTENCE_END for form in (x, f"{x}</w>") if (i := vocab.get(form)) is not None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[ends] = True

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _run(self, run: str) -> bytes:
        """What stands between two blanks: a plain word or several pieces."""
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(run)))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word or "<|" in text or _PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.frombuffer(b"".join(map(self.runs.__getitem__, text.lower().split())), dtype=np.uint32)


def cut_points(lengths: np.ndarray, sentence_ends: np.ndarray, width: int, sentence_cost: float, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut and what a cut there costs: document ends free, sentence ends sentence_cost,
    and hard_cost at further places wherever the next of those is more than a window away."""
    docs = np.cumsum(lengths)
    total = int(docs[-1]) if len(docs) else 0
    places = np.union1d(docs, sentence_ends)
    places = places[(places > 0) & (places <= total)]
    costs = np.where(np.isin(places, docs, assume_unique=False), 0.0, sentence_cost)
    before = np.concatenate(([0], places[:-1]))
    far = np.flatnonzero(places - before > width)
    if len(far):
        extra = np.concatenate([np.arange(before[k] + 1, places[k]) if places[k] - before[k] <= 2 * width else np.unique(np.concatenate((np.arange(before[k] + width, places[k], width), np.arange(max(before[k] + 1, places[k] - width), places[k]), np.arange(before[k] + 1, before[k] + width)))) for k in far])
        places = np.concatenate((places, extra))
        costs = np.concatenate((costs, np.full(len(extra), hard_cost)))
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places, costs


def best_cuts(places: np.ndarray, costs: np.ndarray, width: int) -> list[int]:
    """The cuts of least padding plus cut costs such that no window is longer than width. The queue holds the start
    candidates within reach, the cheapest first, so each place enters and leaves it once."""
    at = [0, *places.tolist()]
    cost = [0.0, *costs.tolist()]
    n = len(at)
    back = [0] * n
    value = [0.0] * n  # the least cost of cutting at this place, plus the place itself
    queue: deque[int] = deque([0])
    for k in range(1, n):
        here = at[k]
        while here - at[queue[0]] > width:
            queue.popleft()
        back[k] = queue[0]
        fresh = value[queue[0]] + width + cost[k]
        value[k] = fresh
        while queue and value[queue[-1]] >= fresh:
            queue.pop()
        queue.append(k)
    out, k = [], n - 1
    while k:
        out.append(at[k])
        k = back[k]
    return out[::-1]


def pack_block(ids: list[np.ndarray], ends: np.ndarray, width: int, sentence_cost: float, hard_cost: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one block of documents in order, and its number of
    sequences."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    if not lengths.sum():
        return [], 0
    stream = np.concatenate(ids)
    places, costs = cut_points(lengths, np.flatnonzero(ends[stream]) + 1, width, sentence_cost, hard_cost)
    cuts = np.array(best_cuts(places, costs, width), dtype=np.int64)
    stops = np.cumsum(lengths)
    edges = np.union1d(cuts, stops[lengths > 0])
    begins = np.concatenate(([0], edges[:-1]))
    doc = np.searchsorted(stops, begins, side="right")
    sequence = np.searchsorted(cuts, begins, side="right")
    opened = np.concatenate(([0], cuts))[sequence]
    rows = zip(doc.tolist(), (begins - (stops - lengths)[doc]).tolist(), (edges - begins).tolist(), sequence.tolist(), (begins - opened).tolist(), strict=True)
    return list(rows), len(cuts)


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


def pack(
    docs: DataFrame, tokenizer_path: str, *, width: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    sentence_cost: float = 2.0, hard_cost: float = 256.0, block_bytes: int = 4 << 20, with_ids: bool = True,
) -> DataFrame:
    """Sequences of at most width tokens over all documents in their order; a row for each piece of a document.

    A document is its token ids and end_id. Each task packs its rows in blocks of about block_bytes of text: within a
    block the cuts minimise padding plus cut costs (nothing at a document's end, sentence_cost at a sentence's,
    hard_cost inside a sentence that is longer than a window), exactly, by dynamic programming. Only a block's last
    sequence may be short, so padding shrinks with the block. Nothing is shuffled. sequence_id is the task's number
    times 2^32 plus a running number; it is unique, not gapless. start counts the document's ids before the piece,
    offset the sequence's.

    Null text counts as empty: the document is end_id alone. A null id stays null. Repeated rows are packed each.
    Without rows there are no pieces. Other columns are not looked at. tokenizer_path must be readable on the
    executors. ids (with_ids) holds the piece's token ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_path)
        last = np.array([end_id], dtype=np.uint32)
        opened = TaskContext.get().partitionId() << 32
        for batch in by_bytes(batches, "text", block_bytes):
            ids = [np.concatenate((tokens.encode(x or ""), last)) for x in batch.column("text").to_pylist()]
            pieces, n = pack_block(ids, tokens.ends, width, sentence_cost, hard_cost)
            doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            cut = [ids[d][s : s + k] for d, s, k, _, _ in pieces]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in cut]
            own = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(length))).astype(np.int32), pa.array(np.concatenate(cut).astype(np.int32))) if with_ids else pa.nulls(len(cut), pa.list_(pa.int32()))
            columns = [batch.column("id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(sequence + opened), pa.array(offset), own]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            opened += n

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


_loaded: dict[str, TokenIds] = {}


def _tokens(path: str) -> TokenIds:
    """A worker serves many tasks; the caches stay with it."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]
