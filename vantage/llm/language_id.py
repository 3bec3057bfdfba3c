"""Language identification: an interpolated Kneser-Ney model over letters per language, kept in sorted hash arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import by_bytes

CLASSES = 64  # 0: all that is no letter; 1-26: a-z; the rest: other letters, by hash
BITS = 6
UNKNOWN = "und"
#: Text that a worker judges or counts at once: some 100 bytes of arrays a byte, in every worker of an executor.
JUDGED_BYTES, COUNTED_BYTES = 1 << 18, 1 << 20


def letter_classes() -> np.ndarray:
    """The class of every code point, lower-cased first."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            out[point] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (CLASSES - 27)
    return out


_classes: np.ndarray | None = None


def classes_of(text: str) -> np.ndarray:
    """The text's letters as classes, each run of other characters as one 0, and a 0 at both ends."""
    global _classes
    if _classes is None:
        _classes = letter_classes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.concatenate(([0], _classes[points], [0]))
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != 0) | (row[:-1] != 0)
    return row[keep]


def codes_of(row: np.ndarray, order: int) -> np.ndarray:
    """A code for each class but the first: itself and the order-1 before it (0 before the start)."""
    wide = np.concatenate((np.zeros(order - 2, dtype=np.int64), row.astype(np.int64)))
    n = len(row) - 1
    code = np.zeros(n, dtype=np.int64)
    for k in range(order):
        code = (code << BITS) | wide[k : k + n]
    return code


@dataclass
class SortedTable:
    """Values by hash key in a sorted array; absent keys have the default."""

    keys: np.ndarray
    values: np.ndarray
    default: float = 0.0

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.default)


def _summed(keys: np.ndarray, values: np.ndarray) -> SortedTable:
    unique, place = np.unique(keys, return_inverse=True)
    return SortedTable(unique, np.bincount(place, weights=values, minlength=len(unique)))


class KneserNey:
    """One language's model. Counts of the highest order are of occurrences; below, of distinct left neighbours."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.levels: list[tuple[SortedTable, SortedTable, SortedTable, float]] = []
        keys, values = codes, counts.astype(float)
        for n in range(order, 0, -1):
            ones, twos = float((values == 1).sum()), float((values == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = keys >> BITS
            grams = _summed(keys, values)
            self.levels.append((grams, _summed(context, values), _summed(context, np.ones(len(keys))), discount))
            lower = np.unique(keys) & _mask(n - 1)
            shorter = _summed(lower, np.ones(len(lower)))
            keys, values = shorter.keys, shorter.values

    def prob(self, codes: np.ndarray, n: int) -> np.ndarray:
        """The probability of each code's last class after the n - 1 before it."""
        prob = np.full(len(codes), 1.0 / CLASSES)
        for k in range(1, n + 1):
            grams, totals, _, discount = self.levels[self.order - k]
            short = codes & _mask(k)
            total = totals.get(short >> BITS)
            own = np.maximum(grams.get(short) - discount, 0.0)
            prob = own / np.where(total > 0, total, 1.0) + self.weight(short >> BITS, k) * prob
        return prob

    def weight(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """What is left for the shorter order after a context of n - 1 classes; all of it after one never seen."""
        _, totals, kinds, discount = self.levels[self.order - n]
        total = totals.get(contexts)
        return np.where(total > 0, discount * kinds.get(contexts) / np.where(total > 0, total, 1.0), 1.0)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        return np.log(self.prob(codes, self.order))


def _mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


@dataclass
class Rows:
    """A row of values, one for each language, by hash key in a sorted array."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass
class Model:
    """Log probabilities of all languages in sorted arrays: for each order the grams that any language has seen, and the
    weights of their contexts. cost and spread tell what the training text itself costs, slack what a text may cost
    more."""

    order: int
    langs: list[str]
    grams: list[Rows]  # from order 1 on
    weights: list[Rows]
    cost: np.ndarray
    spread: np.ndarray
    slack: float = 0.0

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code, a column for each language. A gram that no language has seen costs what its context
        leaves to shorter ones."""
        out = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            short = codes[left] & _mask(n)
            at, there = self.grams[n - 1].find(short)
            out[left[there]] += self.grams[n - 1].values[at[there]]
            left, short = left[~there], short[~there]
            if not len(left):
                return out
            at, there = self.weights[n - 1].find(short >> BITS)
            out[left[there]] += self.weights[n - 1].values[at[there]]
        out[left] -= np.float32(np.log(CLASSES))
        return out


def char_counts(docs: DataFrame, labels: list[str], lang_col: str, text_col: str, order: int, batch_bytes: int, apart: Column) -> DataFrame:
    """(part, code, n) over all rows that have language and text: part is twice the label's number, and one more where
    `apart` holds. Each batch sums its own before the shuffle."""
    numbers = {label: 2 * k for k, label in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            parts: dict[int, list[np.ndarray]] = {}
            for lang, held, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "apart", "text")), strict=True):
                parts.setdefault(numbers[lang] + held, []).append(codes_of(classes_of(text), order))
            for part, rows in parts.items():
                code, n = np.unique(np.concatenate(rows), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), part, np.int32)), pa.array(code), pa.array(n)], names=["part", "code", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(apart, F.lit(False)).alias("apart"), F.col(text_col).alias("text"))
    counts = rows.filter("lang is not null and text is not null").mapInArrow(run, "part int, code bigint, n bigint")
    return counts.groupBy("part", "code").agg(F.sum("n").alias("n")).filter(F.col("code").bitwiseAND(F.lit(_mask(2))) > 0)  # two blanks are no letter


def _shortened(codes: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last `order` classes of codes."""
    short = _summed(codes & _mask(order), counts)
    return short.keys, short.values


def _collected(counts: DataFrame, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of each part."""
    table = counts.toArrow()
    part, code, n = (table.column(c).to_numpy() for c in ("part", "code", "n"))
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    return [(code[order[a:b]], n[order[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]


def _settled(models: list[KneserNey], counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], order: int) -> Model:
    """The models in shared sorted arrays."""
    grams, weights = [], []
    for n in range(1, order + 1):
        seen = np.unique(np.concatenate([m.levels[order - n][0].keys for m in models])) if models else np.zeros(0, np.int64)
        contexts = np.unique(seen >> BITS)
        grams.append(Rows(seen, np.stack([np.log(m.prob(seen, n)) for m in models], axis=1).astype(np.float32) if models else np.zeros((0, 0), np.float32)))
        weights.append(Rows(contexts, np.stack([np.log(m.weight(contexts, n)) for m in models], axis=1).astype(np.float32) if models else np.zeros((0, 0), np.float32)))
    cost, spread = np.zeros(len(langs)), np.zeros(len(langs))
    for k, (model, (codes, n)) in enumerate(zip(models, counts, strict=True)):
        logs, share = model.log_prob(codes), n / n.sum()
        cost[k] = -(share * logs).sum()
        spread[k] = np.sqrt(max((share * logs**2).sum() - cost[k] ** 2, 0.0))
    return Model(order, langs, grams, weights, cost, spread)


#: A text may cost so many standard errors more than the training text, on top of the calibrated slack.
ERRORS = 4.0
#: What a text may cost more, in nats a letter, where there is nothing to calibrate with: mixed languages and short texts
#: cost up to so much more.
UNCALIBRATED = 1.2


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", orders: tuple[int, ...] = (3, 4), held: int = 10,
    false_rejections: float = 1e-4, most_langs: int = 200, batch_bytes: int = COUNTED_BYTES,
) -> Model:
    """A model for each language of the labelled rows, from the counts of all of them.

    One in `held` of the rows, by a hash of id and text, is counted apart. The order is the one of `orders` under which
    the models of the other rows give those the lowest cross-entropy. They also calibrate the rejection: of them a share
    of false_rejections would be rejected. As so small a share can't be told from few rows, a part of UNCALIBRATED is
    added while there are fewer than 1 / false_rejections. The models returned are then taught by all rows.

    What comes to the driver is bounded by the code space (64 to the highest order, times the languages), not by the
    rows; more than most_langs labels are an error, as such a column holds something else. Rows without text or
    language, and texts without letters, teach nothing."""
    labels = [r[0] for r in docs.select(F.col(lang_col).cast("string").alias("lang")).filter("lang is not null").distinct().limit(most_langs + 1).collect()]
    if len(labels) > most_langs:
        raise ValueError(f"{lang_col} has more than {most_langs} values")
    labels, most = sorted(labels), max(orders)
    apart = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(held)) == 0
    counts = _collected(char_counts(docs, labels, lang_col, text_col, most, batch_bytes, apart), 2 * len(labels))
    langs = [x for k, x in enumerate(labels) if len(counts[2 * k][0]) or len(counts[2 * k + 1][0])]
    place = {x: 2 * labels.index(x) for x in langs}
    part = lambda x, k, order: _shortened(*counts[place[x] + k], order)
    both = [x for x in langs if len(counts[place[x]][0]) and len(counts[place[x] + 1][0])]
    loss = {}
    for order in orders:
        loss[order] = 0.0
        for x in both:
            codes, n = part(x, 1, order)
            loss[order] -= (n * KneserNey(*part(x, 0, order), order).log_prob(codes)).sum() / n.sum()
    order = min(orders, key=loss.__getitem__) if both else most
    slack = UNCALIBRATED
    if both:
        trial = [part(x, 0, order) for x in both]
        small = _settled([KneserNey(*c, order) for c in trial], trial, both, order)
        asked = docs.filter(apart & F.col(lang_col).cast("string").isin(both)).select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
        excess, n = predict(asked, small, id_col="id").agg(F.percentile_approx("excess", 1 - false_rejections, 100_000), F.count("excess")).first()
        slack = max(float(excess or 0.0), 0.0) + UNCALIBRATED * max(0.0, 1 - n * false_rejections)
    whole = lambda x: (np.concatenate(c) for c in zip(part(x, 0, order), part(x, 1, order), strict=True))
    taught = [_shortened(*whole(x), order) for x in langs]
    return replace(_settled([KneserNey(*c, order) for c in taught], taught, langs, order), slack=slack)


def judge(texts: list[str | None], model: Model, sharpness: float) -> list[tuple[str, float, float | None, float | None, bool]]:
    """Language, score, cross-entropy in nats per letter, what it exceeds that of the training text by, and whether the
    text is rejected."""
    out: list[tuple] = [(UNKNOWN, 0.0, None, None, True)] * len(texts)
    rows = [classes_of(x) if x else np.zeros(0, np.uint8) for x in texts]
    real = [k for k, row in enumerate(rows) if row.any()]
    if not real or not model.langs:
        return out
    codes = [codes_of(rows[k], model.order) for k in real]
    sizes = np.array([len(x) for x in codes])
    sums = np.add.reduceat(model.log_probs(np.concatenate(codes)), np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.float64)
    costs = -sums / sizes[:, None]
    best = costs.argmin(axis=1)
    least = costs.min(axis=1)
    share = 1 / np.exp(-(costs - least[:, None]) * sharpness).sum(axis=1)
    excess = least - model.cost[best] - ERRORS * model.spread[best] / np.sqrt(sizes)
    for i, k in enumerate(real):
        out[k] = (model.langs[best[i]], float(share[i]), float(least[i]), float(excess[i]), bool(excess[i] > model.slack))
    return out


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 10.0, batch_bytes: int = JUDGED_BYTES) -> DataFrame:
    """Language of each whole text; a narrow pass, a row for each row of docs.

    lang_pred is the language whose model has the lowest length-normalised cross-entropy (ties: the first by name),
    `und` where the text is null or has no letter. score is the share of that language when the costs are weighed
    against each other. excess is what the text costs more than the training text of that language, in nats a letter,
    beyond some standard errors at its length; rejected marks texts whose excess is above the model's calibrated slack:
    no language fits. A null id stays null; repeated rows give a row each; other columns aren't looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the code space
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        for batch in by_bytes(batches, "text", batch_bytes):
            rows = judge(batch.column("text").to_pylist(), shared.value, sharpness)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_col, "lang_pred", "score", "cost", "excess", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, cost double, excess double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text", batch_bytes: int = JUDGED_BYTES) -> DataFrame:
    """The documents, all columns as they are, without those that predict() marks as rejected (null and letterless
    texts among them). Without any labelled text to learn from, all with a letter stay."""
    if not model.langs:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, batch_bytes):
            yield batch.filter(pa.array([not row[-1] for row in judge(batch.column(text_col).to_pylist(), shared.value, 1.0)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the rows that is kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
