"""Near-duplicate documents: min-max hashing with bands for candidates, full sets for confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Written, free_name, named
from .words import LOWER, by_bytes, grams, hashed_words, mix, utf8


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; the whole sequence where it has fewer words."""
    hashes, counts, _, _ = hashed_words([x and x.translate(LOWER) for x in texts])
    every = grams(hashes, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(every[at : at + n - width + 1]))
        else:
            out.append(grams(hashes[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


class MinMax:
    """Signatures that keep the smallest and the largest value under each multiplication, and their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        n = -(-bands * rows // 2)
        self.factors = np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.random.default_rng(seed + 1).integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factors), np.uint64(2**64 - 1))
        high = np.zeros(len(self.factors), dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            table = np.multiply.outer(self.factors, shingles[at : at + 1024])
            np.minimum(low, table.min(axis=1), out=low)
            np.maximum(high, table.max(axis=1), out=high)
        return np.concatenate((low, high))[: self.bands * self.rows] if len(shingles) else np.zeros(0, np.uint64)

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; equal where all its rows agree."""
        rows = mix(self.signature(shingles)).reshape(self.bands, self.rows)
        return mix((rows * self.powers).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, sketch: MinMax, batch_bytes: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, text_key) of each document; set_key tells equal sets, in 128 bits, and
    text_key texts that share an id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            sets = shingle_sets(utf8(batch.column("text")), width)
            keys = [b"" if not len(s) else np.array([mix(s * np.uint64(3)).sum(), np.bitwise_xor.reduce(mix(s + np.uint64(len(s))))], np.uint64).tobytes() for s in sets]
            bands = [sketch.band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column("text_key")],
                names=["doc_id", "n_shingles", "set_key", "bands", "text_key"],
            )

    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, bands array<bigint>, text_key bigint")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, batch_bytes: int) -> DataFrame:
    """(doc_id, shingles) of the wanted documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            sets = [s.view(np.int64) for s in shingle_sets(utf8(batch.column("text")), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(run, f"doc_id {kind}, shingles array<bigint>")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    """Sets further apart in size can't share enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the number of shingles that both full sets hold, and of either."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b") - shared).alias("either"))


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, hub_rounds: int = 3,
    id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20,
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles: (id, n_shingles, class_id, component_id, kept,
    text_key); text_key is xxhash64 of the text, which tells rows that share an id apart.

    Words are blank-separated, A-Z lower-cased; a document's set is its distinct runs of `width` words (the whole
    sequence where it has fewer). Two documents link if 100 * shared >= percent * either, counted on their full sets.
    class_id is the smallest id with the same set, component_id the smallest id that links reach, kept is true for
    that one. Texts that are null or without words have an empty set and link with nothing. Rows without an id take
    no part: class_id and component_id are null and kept is true. Repeated rows give a row each. Rows that
    share an id and differ in text are linked with what either of them links with. Ids may be of any type that has an
    order; an empty table gives an empty one; other columns are not looked at.

    Candidates: documents that agree in all rows of a band of their min-max signature; with 48 bands of 6 rows a
    pair at 0.8 is missed once in two million. Equal sets are one candidate. A bucket is not expanded into pairs: its
    members are compared with its smallest one, then with the smallest document of its largest component until
    nothing new links. Members of different components that are left are compared with each other, but for pairs
    that exact counts rule out, so no link is lost."""
    spark = docs.sparkSession
    kept = Written(spark, "minhash")
    sketch = MinMax(bands, rows)
    marks = kept.put("marks", signatures(docs, id_col, text_col, width, sketch, batch_bytes))
    classes = kept.put("classes", marks.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs")))
    heads = marks.join(classes, [marks.set_key == classes.set_key, marks.doc_id == classes.class_id], "left_semi").dropDuplicates(["set_key"])
    cells = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), F.explode("bands").alias("cell"))
    counted = cells.groupBy("cell").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("cell", "pivot")
    members = kept.put("members", cells.join(counted, "cell"))
    wanted = kept.put("wanted", _buckets_of(members))
    sets = kept.put("sets", _sets(docs, wanted.select(F.col("id").alias("doc_id")).distinct(), id_col, text_col, width, batch_bytes))

    near = lambda x: x.filter(F.col("shared") * 100 >= F.col("either") * percent)
    stars = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    tested = kept.put("tested", _confirm(stars, sets))
    labels, named = components(near(tested).select("a", "b"), kept, "round0"), "round0"
    docs_left = wanted
    for turn in range(1, hub_rounds + 1):
        open_cells = _open(docs_left, labels, kept, turn)
        pairs = open_cells.filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        fresh = kept.put(f"tested{turn}", _confirm(pairs.join(tested, ["a", "b"], "left_anti"), sets))
        tested = tested.unionByName(fresh)
        if near(fresh).isEmpty():
            break
        labels, named = components(near(tested).select("a", "b"), kept, f"round{turn}"), f"round{turn}"
        if open_cells.join(labels, open_cells.id == labels.node).filter("component <> label").isEmpty():
            break  # the same buckets stay open, with the same hubs
        docs_left = open_cells.groupBy("id", "size").agg(F.collect_set("cell").alias("cells"))  # a bucket of one component stays so
    else:
        open_cells = _open(docs_left, labels, kept, "last")
    counted = open_cells.select("id").union(open_cells.select("hub")).distinct()  # a hub need not be in an open bucket
    alone = kept.put("alone", _alone(counted, sets))
    fresh = kept.put("rest", near(_confirm(_rest(open_cells, tested, alone, percent), sets)).select("a", "b"))
    if not fresh.isEmpty():
        labels, named = components(near(tested).select("a", "b").unionByName(fresh), kept, "final"), "final"
    kept.only("marks", "classes", named)
    return _result(marks, classes, labels, id_col)


def _buckets_of(members: DataFrame) -> DataFrame:
    """(id, size, cells): each document's buckets, at most one for each band; of buckets with the same members, told by
    their pivot, number and sums of hashes, one."""
    own = F.xxhash64("id")
    sums = F.sum(own.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(own, 32)).alias("high")
    told = members.groupBy("cell", "pivot").agg(F.count("*").alias("n"), *sums)
    one = told.groupBy("pivot", "n", "low", "high").agg(F.min("cell").alias("cell"))
    return members.join(one.select("cell"), "cell", "left_semi").groupBy("id", "size").agg(F.collect_set("cell").alias("cells"))


def _open(docs: DataFrame, labels: DataFrame, kept: Written, turn: object) -> DataFrame:
    """Members of buckets that hold more than one component yet, with the bucket's hub: the smallest document of the
    component that most of its members belong to. Documents meet their component before their buckets are told apart."""
    placed = docs.join(labels, docs.id == labels.node, "left").select("id", "size", "cells", F.coalesce("component", "id").alias("label"))
    named = kept.put("named", placed.select(F.explode("cells").alias("cell"), "id", "size", "label"))
    shares = named.groupBy("cell", "label").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("cell").agg(F.count("*").alias("labels"), F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("top")).filter("labels > 1").select("cell", F.col("top.label").alias("hub"))
    return kept.put(f"open{turn}", named.join(mixed, "cell"))


def _alone(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, alone): how many of a document's shingles no other of the given documents holds."""
    own = sets.join(ids, sets.doc_id == ids.id, "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    single = own.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).filter("n = 1")
    return ids.join(single.groupBy("id").agg(F.count("*").alias("alone")), "id", "left").select("id", F.coalesce("alone", F.lit(0)).alias("alone"))


def _rest(open_cells: DataFrame, tested: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket across components that may still link, by what is known of each exactly.

    With p the bucket's hub, x and y share at most what y shares with p and what else of x is not in p and not in x
    alone (alone among the open documents and all hubs, so that nothing in p counts as alone); likewise with x and y exchanged. As distance is a metric, their distances to p differ by no more than a link
    spans. The join itself drops all other pairs, and a pair in all but its smallest common bucket. Members not yet compared with p keep all theirs."""
    known = tested.select("a", "b", "shared", (1 - F.col("shared") / F.col("either")).alias("far"))
    own = F.col("id") == F.col("hub")
    pair = open_cells.withColumns({"a": F.least("id", "hub"), "b": F.greatest("id", "hub")})
    placed = pair.join(known, ["a", "b"], "left").join(alone, "id").withColumns(
        {"with": F.when(own, F.col("size")).otherwise(F.col("shared")), "far": F.when(own, F.lit(0.0)).otherwise(F.col("far"))}
    )
    placed = placed.withColumn("extra", F.col("size") - F.col("alone") - F.col("with"))
    placed = placed.join(open_cells.groupBy("id").agg(F.collect_set("cell").alias("cells")), "id")  # at most one for each band
    columns = ("id", "size", "label", "far", "with", "extra", "alone", "cells")
    one, two = (placed.select(F.col("cell").alias(f"cell_{k}"), *(F.col(x).alias(f"{x}_{k}") for x in columns)) for k in (1, 2))
    x, y = (lambda c: F.col(f"{c}_1")), (lambda c: F.col(f"{c}_2"))
    both = x("size") + y("size")
    most = F.least(y("with") + x("extra"), x("with") + y("extra"), x("size") - x("alone"), y("size") - y("alone"))
    sure = lambda c: F.coalesce(c, F.lit(True))
    may = (
        (x("cell") == y("cell")) & (x("id") < y("id")) & (x("label") != y("label")) & _similar_sizes(x("size"), y("size"), percent)
        & sure(most * (100 + percent) >= both * percent) & sure(F.abs(x("far") - y("far")) <= (100 - percent) / 100 + 1e-9)
        & (x("cell") == F.array_min(F.array_intersect(x("cells"), y("cells"))))
    )
    pairs = one.join(two, may).select(x("id").alias("a"), y("id").alias("b")).distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _result(marks: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    placed = marks.select("doc_id", "n_shingles", "set_key", "text_key").join(classes.select("set_key", "class_id"), "set_key", "left")
    placed = placed.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    named = placed.join(labels, placed.class_id == labels.node, "left")
    component = F.coalesce("component", "class_id")
    return named.select(F.col("doc_id").alias(id_col), "n_shingles", "class_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns as they are, without those that near_duplicates() does not keep. Of rows that share an
    id only those with a text that is not kept go."""
    gone_id, gone_text = free_name(docs, "__gone_id"), free_name(docs, "__gone_text")
    told = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("not kept")
    gone = told.select(named(id_col).alias(gone_id), F.col("text_key").alias(gone_text)).distinct()
    met = (named(id_col) == F.col(gone_id)) & (F.xxhash64(named(text_col)) == F.col(gone_text))
    return docs.join(gone.hint("shuffle_hash"), met, "left_anti")
