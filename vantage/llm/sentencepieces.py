"""SentencePiece ids and texts: each distinct marked word is segmented once, and ids are joined back by position."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named
from .words import by_bytes, tidy

MARK = "▁"
_CROSSES = re.compile(f"[^{MARK}]{MARK}")
_CHUNK = re.compile(" +[^ ]*")
#: Chunks that a worker's table holds at most, and the longest that stays there; a batch's own are held for that batch.
MOST_CHUNKS, LONGEST = 300_000, 64
#: Ids that are decoded in one call.
MOST_IDS = 1 << 20


class Pieces:
    """Ids of whole texts under one model.

    A chunk is a run of markers and what follows up to the next one. Where no piece of a byte-pair model has a marker
    behind another character, no merge ever joins two chunks, so the ids of a text are those of its chunks in order.
    That needs text as it is (no normalisation, one marker put before it, no blank taken away); texts for other models
    go to the library whole."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.processor = SentencePieceProcessor(model_file=model_path)
        told = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            told.ParseFromString(file.read())
        rule, training = told.normalizer_spec, told.trainer_spec
        plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and rule.escape_whitespaces
        byte_pairs = training.model_type == training.BPE and not training.treat_whitespace_as_suffix
        self.by_chunk = bool(plain and byte_pairs and not any(_CROSSES.search(x.piece) for x in told.pieces))
        one, two = self.processor.encode(["a", "a "], num_threads=1)
        self.table: dict[str, bytes] = {}
        self.lone_mark = np.array(two[len(one) :], np.int32).tobytes()

    def chunks(self, text: str) -> list[str]:
        """The chunks, each without its first marker (the text's own first one is put there by the model)."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in _CHUNK.findall(f" {text}")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.array(x, np.int32) for x in self.processor.encode(texts, num_threads=1)]
        cut = [self.chunks(x) for x in texts]
        distinct = set().union(*cut)
        if len(self.table) > MOST_CHUNKS:
            self.table = {}
        known = self.table
        fresh = [x for x in distinct if x not in known]
        known = known | {x: np.array(ids, np.int32).tobytes() for x, ids in zip(fresh, self.processor.encode(fresh, num_threads=1), strict=True)} | {"": self.lone_mark}
        self.table.update((x, known[x]) for x in fresh if len(x) <= LONGEST)
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in cut]


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """A worker serves many tasks; its table stays with it."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, ids) of every row: the ids that the library gives for the whole text, without begin or end, no sampling.

    Each batch of about batch_bytes has a table of its distinct chunks, of which a worker keeps MOST_CHUNKS; a table of
    the whole corpus's chunks would have to be broadcast without a bound or cost a shuffle of every word. Nothing is
    shuffled here. A null text counts as empty and has no ids; a null id stays null; repeated rows give a row each; an
    empty table gives none; other columns are not looked at. model_path must be readable on the executors."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in by_bytes(batches, "text", batch_bytes):
            ids = pieces.encode([x or "" for x in batch.column("text").to_pylist()])
            ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
            column = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), column], names=[id_col, "ids"])

    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The rows with the text that the library's decode() gives for their ids; null ids have a null text, no ids the
    empty one. All columns stay; decoded_col must not be one of them."""
    if decoded_col in rows.columns:
        raise ValueError(f"there is a column {decoded_col} already")
    place = rows.columns.index(ids_col)
    out = rows.withColumn(decoded_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _pieces(model_path).processor
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_IDS, side="right")))
                part = batch.slice(at, to - at)
                ids = part.column(place).to_pylist()
                told = processor.decode([x or [] for x in ids], num_threads=1)
                texts = pa.array([None if x is None else y for x, y in zip(ids, told, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, decoded_col])
                at = to
        tidy()

    return rows.mapInArrow(run, out)
