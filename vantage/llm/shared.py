"""Cutting lineage in the folder that all machines of a cluster share, and joins that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..scratch import new_folder, remove

#: A class is broadcast in join_classes() if it has more than one row in so many of all rows.
HEAVY_SHARE = 2000
#: What join_classes() must know of a table of classes.
SIZES = {"total": F.sum, "least": F.min, "most": F.max}


class Written(scratch.Written):
    """Tables in the shared folder, with what join_classes() must know of those that hold classes."""

    def put_classes(self, key: str, frame: DataFrame) -> DataFrame:
        return self.put(key, frame, **{n: f("n") for n, f in SIZES.items()})


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes to be no column of the frame."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """The column of exactly that name, dots and back ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def join_classes(rows: DataFrame, classes: DataFrame, sizes: dict[str, int], keys: list[str], values: list[str], spread: list[str]) -> DataFrame:
    """rows with the values of the class that their keys name, null where there is none.

    classes has one row for each combination of keys and n, its number of rows; sizes tells the sum, the least and the
    most of n; the first key is a bigint. Classes of more than one row in HEAVY_SHARE (at most twice that many, as their
    sizes add up to no more than all rows) are broadcast; their rows, and those with a null key, are dealt out by the
    columns `spread`, which tell rows apart. So no task gets more than that share of rows for one key."""
    share = max(int(sizes["total"]) // HEAVY_SHARE, 1)
    first, *others = keys
    gap = F.lit(False)
    for key in keys:
        gap = gap | F.col(key).isNull()
    heavy = classes.filter(F.col("n") > share).select(*keys, *(F.col(v).alias(f"__heavy_{v}") for v in values), F.lit(True).alias("__heavy"))
    some, all_ = sizes["most"] > share, sizes["least"] > share
    placed = rows.join(F.broadcast(heavy), keys, "left") if some else rows.withColumn("__heavy", F.lit(None).cast("boolean"))
    if all_:
        return placed.select(*rows.columns, *(F.col(f"__heavy_{v}").alias(v) for v in values))
    light = classes.filter(F.col("n") <= share).select(F.col(first).alias("__dealt"), *others, *(F.col(v).alias(f"__light_{v}") for v in values))
    placed = placed.withColumn("__dealt", F.when(F.col("__heavy").isNotNull() | gap, F.xxhash64(*spread)).otherwise(F.col(first)))
    placed = placed.join(light, ["__dealt", *others], "left")
    # A row that is dealt out elsewhere may meet a class of that number by chance; its own class goes first.
    near = lambda v: F.when(F.col("__heavy").isNull() & ~gap, F.col(f"__light_{v}"))
    own = lambda v: F.coalesce(F.when(F.col("__heavy").isNotNull(), F.col(f"__heavy_{v}")), near(v)) if some else near(v)
    return placed.select(*rows.columns, *(own(v).alias(v) for v in values))


__all__ = ["HEAVY_SHARE", "Written", "free_name", "join_classes", "named", "new_folder", "remove"]
