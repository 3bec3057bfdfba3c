"""Preference formatting: the common first turns of two conversations as one prompt, the rest as masked completions.

DataFrame operations only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Written

SAID = "array<struct<role:string,text:string>>"


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, turn, said): what is said at each turn, equal rows once, in order of role and text. Rows without id or
    turn have no place and are left out."""
    rows = conversations.select(F.col(id_col).alias("pair_id"), F.col(turn_col).alias("turn"), F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("row"))
    return rows.filter("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(F.array_sort(F.collect_set("row")).alias("said"))


def split_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, part, said): every turn as part of the prompt, the chosen or the rejected completion.

    chosen and rejected are tables of turns_of(). The prompt is the longest run of first turns that both sides share;
    from the first turn on that differs or that one side lacks, each side keeps its own. Pairs that lack a side are
    left out. Turns are joined and counted one by one: no conversation is gathered in a task."""
    sides = chosen.select("pair_id", "turn", F.col("said").alias("c")).join(rejected.select("pair_id", "turn", F.col("said").alias("r")), ["pair_id", "turn"], "full")
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    split = sides.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("turn"))).alias("split"), F.count("c").alias("n_c"), F.count("r").alias("n_r")
    ).filter("n_c > 0 and n_r > 0").select("pair_id", "split")
    placed = sides.join(split, "pair_id")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    row = lambda part, said: F.struct(F.lit(part).alias("part"), F.col(said).alias("said"))
    parts = F.when(shared, F.array(row("prompt", "c"))).otherwise(F.filter(F.array(row("chosen", "c"), row("rejected", "r")), lambda x: x["said"].isNotNull()))
    return placed.select("pair_id", "turn", F.explode(parts).alias("x")).select("pair_id", "turn", "x.part", "x.said")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))


def _rendered(said: Column) -> Column:
    return F.array_join(F.transform(said, lambda x: F.concat(_head(x["role"]), F.coalesce(x["text"], F.lit("")), F.lit("\n"))), "")


def _mask(said: Column, learned: str) -> Column:
    """start-stop of each text of the learned role within the rendered turns, in characters, joined by commas."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(_head(x["role"]))
        stop = begin + F.length(F.coalesce(x["text"], F.lit("")))
        spans = F.when(x["role"] == learned, F.concat(acc["spans"], F.array(F.concat_ws("-", begin, stop)))).otherwise(acc["spans"])
        return F.struct((stop + 1).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(said, start, add, lambda acc: acc["spans"]), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, *, learned: str = "assistant") -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of each pair with both sides.

    chosen and rejected are tables of turns_of(). A turn is rendered as `<|role|>`, a line feed, its text and a line
    feed (no role: unknown; no text: empty). The masks tell the characters of each completion that are to be learned:
    texts of the learned role. Equal sides give empty completions; sides that differ at once an empty prompt.
    A rendered conversation is one value, so one conversation must fit into a row; split_turns() has no such bound."""
    parts = split_turns(chosen, rejected)
    pick = lambda part: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "said")))), lambda x: x["said"]))
    whole = parts.groupBy("pair_id").agg(
        F.count(F.when(F.col("part") == "prompt", 1)).alias("n_prompt_turns"), *(pick(x).alias(x) for x in ("prompt", "chosen", "rejected"))
    )
    return whole.select(
        "pair_id", "n_prompt_turns", *(_rendered(F.col(x)).alias(x) for x in ("prompt", "chosen", "rejected")), *(_mask(F.col(x), learned).alias(f"{x}_mask") for x in ("chosen", "rejected"))
    )


def next_replies(conversations: DataFrame, *, learned: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations (conv_id, turn, role, text): chosen is a conversation up to its last
    reply; rejected is the same with the last reply of the next conversation by conv_id that has one, whatever the ids
    between; the last one takes that of the first.

    Turns after a conversation's last reply are followed by nothing to learn and are in neither side. Conversations
    without a reply make no pair, and neither does a reply that is the only one in the table."""
    rows = conversations.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    last = rows.filter(F.col("role") == learned).groupBy("conv_id").agg(F.max("turn").alias("last"))
    ranks, n = _numbered(last)
    takes = ranks.select("conv_id", "last", F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank"))
    partner = takes.join(ranks.select(F.col("conv_id").alias("from"), F.col("last").alias("from_last"), "rank"), "rank").filter("conv_id <> from").select("conv_id", "last", "from", "from_last")
    ended = rows.join(partner.select("conv_id", "last"), "conv_id").filter("turn <= last")
    said = rows.filter(F.col("role") == learned).select(F.col("conv_id").alias("from"), F.col("turn").alias("from_last"), "role", "text")
    other = partner.join(said, ["from", "from_last"]).select("conv_id", F.col("last").alias("turn"), "role", "text")
    return turns_of(ended), turns_of(ended.filter("turn < last").select("conv_id", "turn", "role", "text").unionByName(other))


def _numbered(last: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their rank by conv_id from 0, and their number. Ranges are sorted and numbered apart; only the
    number of rows in each range reaches the driver."""
    placed = last.repartitionByRange("conv_id").sortWithinPartitions("conv_id").withColumn("at", F.monotonically_increasing_id())
    placed = Written(last.sparkSession, "chat").put("ranks", placed.withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("at"))
    sizes = sorted(tuple(r) for r in placed.groupBy("range").count().collect())
    starts = dict(zip((r for r, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    before = F.create_map(*(F.lit(x).cast("bigint") for pair in starts.items() for x in pair)) if starts else F.create_map().cast("map<bigint,bigint>")
    return placed.select("conv_id", "last", (F.element_at(before, F.col("range")) + F.col("place")).alias("rank")), sum(n for _, n in sizes)
