"""Line dedup: suffix order of line sequences by distributed prefix doubling, intervals of common prefixes, maximal runs.

DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, free_name, join_classes, named

WORD = r"[^\x20\x09-\x0D]+"
#: What tells a line's place: the document's id, a hash of its text, the line's number.
PLACE = ["doc", "twin", "pos"]
#: What is added up along a run: its words, and its lines that have any.
SUMS = ["words", "full"]


def _added() -> list[Column]:
    """The sums of a run and of the one that follows it."""
    return [(F.col(x) + F.col(f"more_{x}")).alias(x) for x in SUMS]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, twin, pos, h1, h2, words, full) of each line; its identity is two 64-bit hashes, so texts stay out of the
    shuffles. twin tells texts that share an id apart; full is 1 for a line with words and 0 for a blank one."""
    rows = docs.select(named(id_col).alias("doc"), named(text_col).alias("text")).filter("doc is not null and text is not null")
    lines = rows.select("doc", F.xxhash64("text").alias("twin"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(WORD)).cast("bigint")
    return lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line", F.lit(3)).alias("h2"), words.alias("words"), (words > 0).cast("bigint").alias("full"))


def _ranked(keys: DataFrame, *order: str) -> DataFrame:
    """Ascending ranks in key order: ranges are sorted apart and numbered upwards, so no task sees all keys."""
    return keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())


def _classes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, first, rank): the classes of more than one row, with the first place of each."""
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"))
    return _ranked(grouped.filter("n > 1"), *keys)


def suffix_levels(lines: DataFrame, kept: Written) -> list[DataFrame]:
    """For k = 0, 1, ... the suffixes whose first 2^k lines occur more than once, until there are none: (doc, twin, pos,
    rank, first, words, full, deeper).

    Equal ranks are an interval of the suffix array: suffixes with a common prefix of 2^k lines; ranks ascend in suffix
    order, as each comes from the order of two ranks of half the length. first is the interval's first place, words
    and full count the words and the lines with words of the prefix, and deeper is true where the suffix is also in an interval of the next level
    without being the first of it."""
    repeated = kept.put_classes("repeated", _classes(lines, "h1", "h2"))
    found = join_classes(lines, repeated, kept.told["repeated"], ["h1", "h2"], ["rank", "first"], PLACE).filter("rank is not null")
    now = kept.put("level0", found.select(*PLACE, "rank", "first", *SUMS).dropDuplicates(PLACE), n=F.count("*"))
    left = kept.told["level0"]["n"]
    levels: list[DataFrame] = []
    while left:
        k = len(levels)
        ahead = Window.partitionBy("doc", "twin").orderBy("pos").rangeBetween(1 << k, 1 << k)
        paired = now.withColumns({"next": F.max("rank").over(ahead), **{f"more_{x}": F.max(x).over(ahead) for x in SUMS}})
        paired = paired.withColumnsRenamed({"rank": "half", "first": "half_first"})
        classes = kept.put_classes("classes", _classes(paired.filter("next is not null"), "half", "next"))
        joined = join_classes(paired, classes, kept.told["classes"], ["half", "next"], ["rank", "first"], PLACE)
        joined = kept.put(f"joined{k}", joined, n=F.count("rank"))
        left = kept.told[f"joined{k}"]["n"]
        deeper = F.coalesce(F.struct(*PLACE) != F.col("first"), F.lit(False))
        levels.append(joined.select(*PLACE, F.col("half").alias("rank"), F.col("half_first").alias("first"), *SUMS, deeper.alias("deeper")))
        now = joined.filter("rank is not null").select(*PLACE, "rank", "first", *_added())
    kept.drop("repeated", "level0", "classes")
    return levels


def longest_runs(levels: list[DataFrame], kept: Written) -> DataFrame | None:
    """(doc, twin, pos, length, words, full, first): for each suffix the longest run of lines from its start on that also
    starts earlier, and where it does; None if nothing repeats.

    A suffix that is not the first of its interval at 2^k lines, but of all it is in at 2^(k+1), has a run of at least
    2^k and fewer than 2^(k+1) lines. The first ones of the intervals below represent all others, so these
    representatives alone are told apart: halving what is unknown, those that agree with others in the next lines make
    an interval of their own, and the first of each stays to represent it. Each suffix but the first is in one
    interval at a time, so a step's rows grow with the repeated lines only."""
    state: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].filter("not deeper").select(*PLACE, F.col("first").alias("base"), F.lit(1 << k).alias("length"), *SUMS)
        state = own if state is None else state.unionByName(own)
        if k:
            state = kept.put(f"state{k % 2}", _halved(state, levels[k - 1], 1 << (k - 1), kept))
    return None if state is None else state.filter(F.struct(*PLACE) != F.col("base")).select(*PLACE, "length", *SUMS, F.col("base").alias("first"))


def _halved(state: DataFrame, level: DataFrame, half: int, kept: Written) -> DataFrame:
    """Intervals (base, length) of suffixes that share `length` lines, split by whether they share `half` lines more."""
    ahead = level.select("doc", "twin", F.col("pos").alias("at"), F.col("rank").alias("next"), *(F.col(x).alias(f"more_{x}") for x in SUMS))
    placed = state.withColumn("at", F.col("pos") + F.col("length"))
    # The first key of a class is a number, and places are structs: the rank of the lines ahead goes first.
    seen = placed.join(ahead, ["doc", "twin", "at"], "left").drop("at")
    inner = seen.filter("next is not null").groupBy("next", "base", "length").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("head"))
    inner = kept.put_classes("inner", inner)
    told = join_classes(seen, inner, kept.told["inner"], ["next", "base", "length"], ["head", "n"], PLACE)
    here = F.struct(*PLACE)
    rest = F.when(F.col("head").isNull() | (here == F.col("head")), F.struct("base", "length", *SUMS))
    longer = F.struct(F.col("head").alias("base"), (F.col("length") + half).alias("length"), *_added())
    inside = F.when(F.col("n") > 1, longer)
    return told.select(*PLACE, F.explode(F.filter(F.array(rest, inside), lambda x: x.isNotNull())).alias("x")).select(*PLACE, "x.base", "x.length", *(f"x.{s}" for s in SUMS))


def repeated_runs(lines: DataFrame, kept: Written) -> DataFrame | None:
    """(doc, twin, pos, length, words, full, first) of the maximal repeated runs: longest_runs() without those that are only
    the rest of a run that starts one line earlier."""
    runs = longest_runs(suffix_levels(lines, kept), kept)
    if runs is None:
        return None
    runs = kept.put("runs", runs)
    kept.only("runs")
    before = Window.partitionBy("doc", "twin").orderBy("pos")
    tail = (F.lag("pos").over(before) == F.col("pos") - 1) & (F.lag("length").over(before) == F.col("length") + 1)
    return runs.withColumn("tail", F.coalesce(tail, F.lit(False))).filter("not tail").drop("tail")


def _spans(runs: DataFrame) -> DataFrame:
    """(doc, twin, spans): the union of a document's runs as ascending spans of line numbers that don't touch."""
    order = Window.partitionBy("doc", "twin").orderBy("pos", "stop")
    placed = runs.select("doc", "twin", "pos", (F.col("pos") + F.col("length")).alias("stop"))
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = placed.withColumn("new", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1)))
    grouped = fresh.withColumn("span", F.sum("new").over(order)).groupBy("doc", "twin", "span").agg(F.min("pos").alias("start"), F.max("stop").alias("stop"))
    return grouped.groupBy("doc", "twin").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _kept_lines(lines: Column, spans: Column) -> Column:
    """The lines outside the spans: the stretch before each span and the one after the last."""
    starts = F.transform(spans, lambda s, i: F.struct(F.when(i > 0, F.try_element_at(spans, i)["stop"]).otherwise(F.lit(0)).alias("a"), s["start"].alias("b")))
    ends = F.array(F.struct(F.element_at(spans, -1)["stop"].alias("a"), F.size(lines).alias("b")))
    return F.flatten(F.transform(F.concat(starts, ends), lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"])))


def find_repeated_runs(docs: DataFrame, *, min_lines: int = 2, alone_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, twin, pos, length, words, full, first) of the maximal runs of lines that count and that also start earlier, in a
    document of smaller id or further up; first tells where such a copy starts.

    A run counts if it has min_lines lines with words or more (blank ones between them go along), or if it has
    alone_words words or more whatever its lines. Nothing is returned for null ids and texts."""
    kept = Written(docs.sparkSession, "lines")
    runs = repeated_runs(line_table(docs, id_col, text_col), kept)
    if runs is None:
        place = f"struct<doc:{docs.schema[id_col].dataType.simpleString()},twin:bigint,pos:int>"
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc {kind}, twin bigint, pos int, length int, words bigint, full bigint, first {place}")
    return runs.filter((F.col("full") >= min_lines) | (F.col("words") >= alone_words))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules: int) -> DataFrame:
    """The documents, all columns, with later copies of repeated line runs cut out of the text; two columns follow:
    __n_lines and __n_removed (bigint), with underscores behind the name where docs has such a column.

    Lines are what stands between line feeds. Those in a run of find_repeated_runs() go, to which `rules` are given.
    All is judged on the input, not on what is left, so a first copy always stays.

    Null text stays null with no lines; empty text has one empty line. Rows without an id take no part and stay as
    they are. Rows equal in id and text count as one document and don't delete each other; rows that share an id only
    are documents of their own. A document all of whose lines go has empty text. Other columns, whatever their names,
    stay."""
    spans = _spans(find_repeated_runs(docs, id_col=id_col, text_col=text_col, **rules))
    doc, twin, found = (free_name(docs, f"__{x}") for x in ("doc", "twin", "spans"))
    total, gone = (free_name(docs, f"__{x}") for x in ("n_lines", "n_removed"))
    spans = spans.select(F.col("doc").alias(doc), F.col("twin").alias(twin), F.col("spans").alias(found))
    joined = docs.join(spans, (named(id_col) == F.col(doc)) & (F.xxhash64(named(text_col)) == F.col(twin)), "left")
    lines = F.split(named(text_col), "\n", -1)
    text = F.when(F.col(found).isNull(), named(text_col)).otherwise(F.array_join(_kept_lines(lines, F.col(found)), "\n"))
    lost = F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    n = F.when(named(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint")
    columns = (text.alias(c) if c == text_col else named(c) for c in docs.columns)
    return joined.select(*columns, n.alias(total), F.coalesce(lost, F.lit(0).cast("bigint")).alias(gone))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents of dedup_lines() without those that had lines and lost all; the columns are those of docs."""
    total, gone = (free_name(docs, f"__{x}") for x in ("n_lines", "n_removed"))
    return dedup_lines(docs, **options).filter((F.col(gone) == 0) | (F.col(gone) < F.col(total))).drop(total, gone)
