"""What the two vector searches share: which rows take part, blocks of queries, and merging what the shards found."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, written

#: Rows of a shard, and bytes of the queries that a broadcast carries: a block. Every which id is a query.
SHARD_ROWS, BLOCK_BYTES, STEP = 16_384, 16 << 20, 20
FOUND = "row long, query_id long, vec_id long, score {}"


def usable(vector: Column, zero: bool) -> Column:
    """Not null or empty and without null or non-finite components; ``zero``: all-zero vectors are fine too."""
    fine = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(fine if zero else fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def gathered(rows: DataFrame, key: str, vector: Column, zero: bool) -> DataFrame:
    """(row, id, dim, v) of the rows that take part, numbered as they are written.

    Every such row is a candidate, whatever its id: rows that repeat an id are rows of their own, and one without an id is found
    as null, behind others of its score. Vectors are compared with those of their own length.
    """
    some = rows.select(F.col(key).cast("long").alias("id"), vector.alias("v")).where(usable(F.col("v"), zero))
    return written(some.select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("dim"), "v"), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def numbers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are null) of a column of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def shown(ids: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=none)


def blocks(queries: DataFrame, dim: int, n: int) -> Iterator[pa.Table]:
    """The queries as tables of some BLOCK_BYTES each; only one is on the driver at a time."""
    many = max(1, -(-n * dim * 8 // BLOCK_BYTES))
    if many == 1:
        yield queries.toArrow()
        return
    path = f"{scratch_dir(queries.sparkSession)}/queries-{uuid.uuid4().hex}"
    queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(many)).cast("int")).repartition(many, "block").write.partitionBy("block").parquet(path)
    for k in range(many):
        yield queries.sparkSession.read.schema(queries.schema).parquet(f"{path}/block={k}").toArrow()


def searched(index: DataFrame, queries: DataFrame, dim: int, n: int, schema: str, run: Callable, k: int) -> DataFrame:
    """``run(batches of index, block of queries)`` for every block: each is broadcast to the shards, so neither rows nor queries are shuffled.

    What is merged is the k best of each query and shard. With several blocks, the k best of a query are written block by block.
    """
    spark = index.sparkSession
    path, parts = f"{scratch_dir(spark)}/found-{uuid.uuid4().hex}", []
    for block in blocks(queries, dim, n):
        sent = spark.sparkContext.broadcast(block)
        found = best(index.mapInArrow(lambda batches, sent=sent: run(batches, sent.value), schema), k)
        if n * dim * 8 <= BLOCK_BYTES:
            return found
        found.write.mode("append").parquet(path)
        sent.destroy()
        parts = found.schema
    return spark.read.schema(parts).parquet(path)


def best(found: DataFrame, most: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the candidates of all shards; each task first keeps ``most`` a query."""
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
