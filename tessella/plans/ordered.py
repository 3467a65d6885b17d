"""Order over a whole table, or over keys of any size, without a task that sees it all: range partitions and what stands before each.

Rows are dealt out by ranges of (keys, order) and sorted within. One row a range and key says what the ranges before it hold,
so numbers, running maxima and places of order statistics are the range's own with that added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Ranges of values that an order statistic is looked for in, per key and round.
FAN = 1 << 14


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ranges") -> DataFrame:
    """``df`` written in range partitions of (keys, order), with __part and __at, the place in the partition, which only grows."""
    by = [*map(F.col, keys), *order]
    placed = df.repartitionByRange(_ranges(df), *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__id", 33).cast("int")).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")
    return written(placed, name)  # a range is read once, so a retry can't number it otherwise


def before_range(placed: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """(keys, __part, __first, sums): of each key in each range its first place and the aggregates over the ranges before it, from one row a range and key, so few that the planner sees them small once they are counted.

    The window is over a key's ranges; a table without keys has as many rows here as ranges."""
    own = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), *[c.alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = {n: F.max(f"__{n}").over(earlier) if n.startswith("max") else F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)) for n in sums}
    return own.select(*keys, "__part", "__first", *[c.alias(n) for n, c in totals.items()])


def numbered(df: DataFrame, number: str, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``number``: the place of each row among those of its keys, from 1 in ``order``; null keys are keys. Rows equal in ``order`` follow each other in any order."""
    placed = in_ranges(df, keys, order)
    before = before_range(placed, keys, n=F.count("*"))
    renamed = before.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), "__first", "n")
    same = placed["__part"] == renamed["__p"]
    for k in keys:
        same &= placed[k].eqNullSafe(renamed[f"__k_{k}"])
    return placed.join(renamed, same).select(*df.columns, (F.col("n") + F.col("__at") - F.col("__first") + 1).alias(number))


def max_before(placed: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``placed``, of in_ranges(), with ``name``: the largest ``value`` of all earlier rows of its keys, null for the first one."""
    before = before_range(placed, keys, max=F.max(value))
    renamed = before.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), F.col("max").alias("__max"))
    same = placed["__part"] == renamed["__p"]
    for k in keys:
        same &= placed[k].eqNullSafe(renamed[f"__k_{k}"])
    here = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.max(value).over(here)
    return placed.withColumn("__own", own).join(renamed, same).select(*placed.columns, F.greatest("__own", "__max").alias(name))


def nth_value(values: DataFrame, key: str, value: str, place: Column, name: str) -> DataFrame:
    """(key, name): the value at a place of each key in ascending order; ``place`` counts from 0 and may use n, how many values the key has.

    ``value`` is a whole number; nulls take no part and a key without others has no row. Each round counts the values of a key in FAN equal ranges, partially where they lie, keeps the range that
    the place falls into, and goes on in it until a range is one value: two rounds for 28 bits, three for 42. Only one small row a range is shuffled, so
    a key with most of all values is spread over all tasks.
    """
    some = values.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).where("v IS NOT NULL")
    bounds = some.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = bounds.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0  # one number; it says how many rounds there are
    now = bounds.select("k", "lo", "hi", place.cast("long").alias("at"))
    while width > 0:
        # of a range of hi - lo + 1 values each step covers a FAN-th, one at least
        step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / FAN)).cast("long")
        held = some.join(now.withColumnsRenamed({"k": "__k"}), F.col("k").eqNullSafe(F.col("__k"))).where("v BETWEEN lo AND hi")
        counts = held.groupBy("k", "lo", "hi", "at", F.call_function("div", F.col("v") - F.col("lo"), step).alias("r")).agg(F.count("*").alias("c"))
        till = F.sum("c").over(Window.partitionBy("k").orderBy("r"))
        found = counts.withColumn("till", till).where((F.col("at") < F.col("till")) & (F.col("at") >= F.col("till") - F.col("c")))
        low = F.col("lo") + F.col("r") * step
        now = found.select("k", low.alias("lo"), F.least("hi", low + step - 1).alias("hi"), (F.col("at") - F.col("till") + F.col("c")).alias("at"))
        width = -(-(width + 1) // FAN) - 1
    return now.select(F.col("k").alias(key), F.col("lo").alias(name))
