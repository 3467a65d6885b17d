"""The journal as a stream source of its own: each run is read from the place that its subscriber has reached, and a restart goes on from there.

``spark.readStream.format("run_journal").option("path", ...)`` reads a table that ``append_segments`` wrote. The offset of the stream is, of each run,
the number of its last entry delivered; Spark keeps it in the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.derive import derived
from ..plans.registry import ORACLE_SQL, QUERIES
from ..plans.scratch import scratch_path

SCHEMA = "run_id string, seq long, type string"


def append_segments(entries: DataFrame, path: str) -> None:
    """Append entries (run_id, seq, type) to a journal table, a folder a run, in the order of seq. Numbers of a run only grow from one append to the next."""
    entries.select("run_id", "seq", "type").repartition("run_id").sortWithinPartitions("run_id", "seq").write.mode("append").partitionBy("run_id").parquet(path)


class Stretch(InputPartition):
    """Entries of one run behind ``after``, up to ``til``."""

    def __init__(self, run: str, after: int, til: int):
        self.run, self.after, self.til = run, after, til


class JournalReader(DataSourceStreamReader):
    """Offsets are {run: last number}. Only footers of files that it hasn't seen are read to find the ends; files are never changed once they are there."""

    def __init__(self, options: dict):
        self.path, self.runs = options["path"], [r for r in options.get("runs", "").split(",") if r]
        self.start = json.loads(options.get("from", "{}"))
        self.ends: dict[str, tuple[str, int]] = {}

    def _dataset(self):
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        files, path = FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        return ds.dataset(path, filesystem=files, format="parquet", partitioning=ds.partitioning(pa.schema([("run_id", pa.string())]), flavor="hive"))

    def initialOffset(self) -> dict:
        """Where ``from``, a JSON map of runs to numbers, says; runs that it leaves out begin at their beginning."""
        return {r: int(n) for r, n in self.start.items()}

    def latestOffset(self) -> dict:
        import pyarrow.dataset as ds

        for piece in self._dataset().get_fragments():
            if piece.path not in self.ends:
                run = ds.get_partition_keys(piece.partition_expression)["run_id"]
                meta = piece.metadata
                at = meta.schema.names.index("seq")
                last = max((meta.row_group(i).column(at).statistics.max for i in range(meta.num_row_groups)), default=-1)
                self.ends[piece.path] = (run, last)
        out = self.initialOffset()
        for run, last in self.ends.values():
            if not self.runs or run in self.runs:
                out[run] = max(last, out.get(run, -1))
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(run, start.get(run, -1), til) for run, til in sorted(end.items()) if til > start.get(run, -1)] or [Stretch("", 0, 0)]

    def read(self, part: Stretch) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not part.run:
            return
        seq = pc.field("seq")
        found = self._dataset().scanner(columns=["run_id", "seq", "type"], filter=(pc.field("run_id") == part.run) & (seq > part.after) & (seq <= part.til))
        schema = pa.schema([("run_id", pa.string()), ("seq", pa.int64()), ("type", pa.string())])
        for batch in found.to_batches():
            if batch.num_rows:
                yield batch.cast(schema)


class RunJournal(DataSource):
    """Options: path; runs, names by commas, else all; from, a JSON map of runs to the last number already seen."""

    @classmethod
    def name(cls) -> str:
        return "run_journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(dict(self.options))


def subscribed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The journal table at ``path`` as a stream."""
    spark.dataSource.register(RunJournal)
    reader = spark.readStream.format("run_journal").option("path", path)
    for name, value in options.items():
        reader = reader.option(name.rstrip("_"), value)
    return reader.load()


def drain(df: DataFrame, path: str, mark: int) -> None:
    """Run a stream over what is there and append its rows, marked, below ``path``; the checkpoint there says where the next call goes on."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("drain", F.lit(mark)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all runs as a subscriber gets them that was stopped in between: first the older half of the entries, then over the same checkpoint what came since."""
    events = derived(spark, sf_dir, "events").selectExpr("concat('run', CAST(user_id % 20 AS STRING)) AS run_id", "event_id AS seq", "event_type AS type")
    half = (events.agg(F.max("seq")).first()[0] or 0) // 2
    path = scratch_path(spark, "subscribed")
    for drain_no, part in ((1, F.col("seq") < half), (2, F.col("seq") >= half)):
        append_segments(events.where(part), f"{path}/journal")
        drain(subscribed(spark, f"{path}/journal"), path, drain_no)
    return spark.read.schema(f"{SCHEMA}, drain int").parquet(f"{path}/rows/*")


QUERIES["ss01_subscribed"] = followed
ORACLE_SQL["ss01_subscribed"] = "SELECT concat('run', user_id % 20) AS run_id, event_id AS seq, event_type AS type, CASE WHEN event_id < (SELECT max(event_id) // 2 FROM events) THEN 1 ELSE 2 END::INT AS drain FROM events"
