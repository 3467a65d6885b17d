"""Mixing sources to target weights: rates from per-source totals, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, word_count, written

#: Sources in code point order, null last, take these weights in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated at most so often.
MOST_REPEATS = 3


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    All sizes are shared out by weight. A source takes ``most`` times its size at the utmost and what
    exceeds that goes to the others by weight, until none is above: ``least(most * size, level * weight)``. Each round finds the level
    that the sources below their cap share; it only rises, and with it the number of capped sources, until it stays.

    Sources are dealt by ranges of their code points and numbered within a range, each range from the count of those before it; so the
    weights are given and summed without a task that sees all sources. One row a range and one row a round reach the driver.
    """
    spark = per_source.sparkSession
    order = F.col("source").asc_nulls_last()
    ranged = written(per_source.select("source", "source_size").repartitionByRange(partitions(spark), order).withColumn("part", F.spark_partition_id()), "ranges")
    before, at = {}, 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):
        before[part], at = at, at + n
    starts = F.create_map(*[F.lit(x) for p in before.items() for x in p]) if before else F.create_map(F.lit(0), F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.element_at(starts, F.col("part"))
    ranked = written(ranged.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).alias("weight")), "weights")
    cap, level = F.col("source_size") * most, 0.0
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        free = cap > F.col("weight") * F.lit(level)
        left, weight = ranked.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        if not weight or (new := (total - (left or 0)) / weight) <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def allocate(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17, size: Column | None = None) -> DataFrame:
    """``docs`` and size, source_size, target and copies: how often the mix takes each row.

    copies is floor(rate) and one more with the probability of rate's fraction, drawn from a hash of
    ``key``, ``text`` and ``seed``, so that a rerun, a retry or another partitioning takes the same rows, and rows of a null or repeated
    key with different texts draw apart. rate is
    target / source_size, 0 where the source has no words. Null texts have size 0, a very long text counts whole and is taken or not as one, a null source is a source,
    rows equal in key and text draw alike, an empty table gives an empty table. Columns of ``docs`` with one of
    the new names are replaced. The per-source table is written first, so the planner broadcasts it only
    while its known size is under the session's threshold; otherwise it is a sort-merge join, whose
    skewed source AQE splits.
    """
    made = ("size", "source_size", "target", "copies")
    plain = docs.drop(*[c for c in docs.columns if c in made])
    size = word_count(F.col(text)) if size is None else size
    sized = plain.withColumn("size", size)
    per_source = written(targets(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))), "sources")
    dim = per_source.select(F.col("source").alias("__source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_REPEATS)))).otherwise(0.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(1 << 40)) / float(1 << 40)
    joined = sized.join(dim, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    return joined.withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as allocate() says, with its own columns, whatever their names."""
    whole = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(source).alias("__from"))
    dealt = allocate(whole, "__text", "__from", "__id", seed).where("copies > 0")
    return dealt.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document, a row for a row; nulls, repeated rows and empty tables as allocate() says."""
    dealt = allocate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The draw is Spark's xxhash64, which DuckDB lacks, so op2 has no SQL; tests/llm hold it against a brute-force version.
