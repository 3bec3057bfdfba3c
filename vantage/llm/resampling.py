"""Importance resampling towards a target text: word runs from a position table, hashed, counted and weighed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, free_name, named

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The table of gains is broadcast, so this bounds what each executor gets (16 MB).
MOST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), F.lit(WORD), F.lit(0))


def features(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """The rows (`row` tells them apart) with `words` exploded to `bucket`s: one for each run of 1 to `orders` words,
    null for a row without any. The words that follow come from the position table by lead() over each row's own."""
    others = [c for c in rows.columns if c != "words"]
    table = rows.select(*others, F.posexplode_outer("words").alias("pos", "word"))
    bucket = lambda run: F.crc32(run.cast("binary")) % buckets
    if orders == 1:  # no following words
        return table.select(*others, bucket(F.col("word")).alias("bucket"))
    own = Window.partitionBy("row").orderBy("pos")
    table = table.select(*others, "word", *(F.lead("word", k).over(own).alias(f"next{k}") for k in range(1, orders)))
    runs, run = [F.col("word")], F.col("word")
    for k in range(1, orders):
        run = F.concat(run, F.lit(" "), F.col(f"next{k}"))  # null beyond the last word
        runs.append(run)
    each = table.select(*others, F.explode_outer(F.array_compact(F.array(*runs))).alias("run"))
    return each.select(*others, bucket(F.col("run")).alias("bucket"))


def _table(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(words(named(text_col)).alias("words")).withColumn("row", F.monotonically_increasing_id())


def gains(kept: Written, docs: DataFrame, target: DataFrame, orders: int, buckets: int, text_col: str, target_text_col: str) -> DataFrame:
    """(bucket, gain) of every bucket: how much likelier its features are in the target than in the documents."""
    counts = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for name, rows, column in (("s", docs, text_col), ("t", target, target_text_col)):
        own = features(_table(rows, column), orders, buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
        counts = counts.join(own, "bucket", "left").fillna(0, [name])
    counts = kept.put("counts", counts, S=F.sum("s"), T=F.sum("t"))
    here, there = (float(kept.told["counts"][x] + buckets) for x in "ST")
    ratio = (F.col("t") + 1).cast("double") * F.lit(here) / ((F.col("s") + 1).cast("double") * F.lit(there))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def resample(
    docs: DataFrame, target: DataFrame, *, orders: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank, text_key) of every document: a draw of percent of those with
    min_words words, without replacement, by importance towards the target's texts.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased, features all runs of 1 to `orders` of them,
    hashed into buckets. A bucket's gain compares its smoothed shares of both sides, in thousandths of a nat, rounded
    down; weight sums a document's gains. score adds Gumbel noise from seed and id, so the highest scores are a draw in
    proportion to the weights; ties go to the smaller id (a null one last), then by text_key. rank counts from 1 within
    the draw and is null outside.

    Counts are sums over all rows; the gains, at most MOST_BUCKETS rows, are broadcast. Ranks come from a sort by ranges
    and the ranges' sizes. A null or empty text has no features and weight 0; a null id counts as empty in the noise;
    repeated rows take part each, with the same score; empty tables on either side are none but smoothed counts. docs
    must be read in the same order twice (a table is), as rows are told apart by their place."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
    kept = Written(docs.sparkSession, "resampling")
    gain = gains(kept, docs, target, orders, buckets, text_col, target_text_col)
    rows = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("text_key"), words(named(text_col)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint")).withColumn("row", F.monotonically_increasing_id())
    weighed = features(rows, orders, buckets).join(F.broadcast(gain), "bucket", "left").groupBy("row").agg(
        F.first("id").alias("id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
        F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"),
    )
    lot = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((lot + 0.5) / 4294967296)))
    able = F.col("n_words") >= min_words
    scores = kept.put("scores", weighed.select("id", "text_key", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), able=F.count(F.when(able, 1)))
    drawn = percent * kept.told["scores"]["able"] // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), F.asc("text_key")]
    placed = scores.withColumn("able", able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = kept.put("placed", placed)
    kept.drop("counts", "scores")
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect()):  # a row for each range
        offsets.append((part, before))
        before += n
    offset = docs.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    ranked = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offset), "part")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"), "text_key")


def keep_drawn(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents, all columns as they are; of repeated rows each one drawn stays once."""
    drawn = resample(docs, target, id_col=id_col, text_col=text_col, **options).filter("rank is not null")
    id_, key, n, k = (free_name(docs, x) for x in ("drawn_id", "drawn_text", "drawn_n", "drawn_k"))
    drawn = drawn.groupBy(F.col(id_col).alias(id_), F.col("text_key").alias(key)).agg(F.count("*").alias(n))
    own = Window.partitionBy(named(id_col), F.xxhash64(named(text_col))).orderBy(F.lit(0))
    met = docs.join(drawn, named(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(named(text_col)) == F.col(key)))
    return met.withColumn(k, F.row_number().over(own)).filter(F.col(k) <= F.col(n)).select(*(named(c) for c in docs.columns))
