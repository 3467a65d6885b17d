"""What the operators of this package share: word rules, shared scratch tables, graph components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch for the Python maps of this package: a batch of whole texts has to fit several times.
BATCH_ROWS = 1_000
_claims: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None]) -> None:
    """In a Python worker: ``owner`` remembers things from now on, and what other owners have remembered goes."""
    for other in [o for o in _claims if o != owner]:
        _claims.pop(other)()
    _claims[owner] = forget


def small_batches(spark: SparkSession) -> None:
    """Have texts reach Python in batches of BATCH_ROWS unless the session has asked for even fewer.

    The session keeps this setting, since plans are run after the operator has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_folders: set[str] = set()
_tables: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one of the cluster, ``spark.checkpoint.dir``.

    Only a session on a local master may leave that unset, as tests do; it gets a temporary folder. Elsewhere
    executors wouldn't see a folder of the driver's machine, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = spark.conf.get("tessella.scratch.dir", "")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.scratch.dir", found)
    own = f"{found.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove, spark, own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; without a running context it stays."""
    if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that written() of this process made and no later step reads; any other table stays, whatever its path."""
    for df in frames:
        for path in {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()} & _tables:
            _tables.discard(path)
            _remove(df.sparkSession, path)


def _plain(path: str) -> str:
    """One spelling of a path: Spark names a local file as file:/a where a caller may have written file:///a."""
    return re.sub(r"^file:/+", "/", path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back: the lineage ends there,
    the planner knows the table's size, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # once written, its shuffle files are of no more use
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _tables.add(_plain(path))
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, component), component the smallest node.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the
    longest chain. Each round is a written table; only one row of counts reaches the driver.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            down.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(least.select("a", F.col("low").alias("b")))
            .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        now = written(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
                now.groupBy("b").agg(F.min("b").alias("component")).withColumnRenamed("b", "node")
            )
        before = state
