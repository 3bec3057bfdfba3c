"""Words of UTF-8 text, cut on bytes: what separates words is always ASCII, so bytes cut faster than characters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _table() -> bytes:
    """Byte map: A-Z to a-z; a-z, 0-9 and every byte of a non-ASCII character stay; the rest becomes a blank."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        out[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c] = c + 32
    return bytes(out)


ALNUM = _table()
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.translate(ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged: exactly what bytes.split() cuts at."""
    return text.split()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, nulls kept."""
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of alnum_words(text)."""
    solid = np.frombuffer(text.translate(ALNUM), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join or split incoming batches into ones whose column holds about `limit` bytes; one long text may exceed it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= limit or at < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)
        held = []
    tidy()


def tidy() -> None:
    """Give memory that is no longer used back to the system: a worker stays between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each blank-separated word of all texts in order, each text's number of words, and each word's
    byte start and end in b'\\n'.join(texts). Sums of byte codes times powers give every word's hash at once."""
    joined = b"\n".join(x or b"" for x in texts)
    raw = np.frombuffer(joined, dtype=np.uint8)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(_powers[0]) < len(raw) + 1:
        for k, step in enumerate((_STEP, _UNSTEP)):
            row = np.full(len(raw) + 1, step, dtype=np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _powers[0][: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(x or b"") + 1 for x in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, stops))))
    return hashes, counts, starts, ends


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, at its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : k + n]
        out ^= out >> np.uint64(31)
    return mix(out)
