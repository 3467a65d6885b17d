"""Tables in the folder that driver and executors share. They go when the driver ends, or earlier by dropped()."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that are removed at exit, and the tables made in them.
_folders: set[str] = set()
_tables: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``. Only on a local master may that be unset; the folder is a temporary one then. Elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("tessella.plans.dir", "")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.plans.dir", found)
    own = f"{found.rstrip('/')}/plans-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove, spark, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; without a running context it stays."""
    if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: what follows reads it instead of making it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _tables.add(_plain(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that written() of this process made and no later step reads; any other table stays."""
    for df in frames:
        for path in {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()} & _tables:
            _tables.discard(path)
            _remove(df.sparkSession, path)
