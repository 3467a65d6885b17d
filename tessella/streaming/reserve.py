"""Sources reserved as their addresses arrive: each canonical address once a run, and so many a run as its cap lets in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import canonical_url
from ..operators.meters import rocks
from ..plans.derive import derived
from ..plans.ordered import numbered
from ..plans.registry import ORACLE_SQL, QUERIES
from ..plans.scratch import scratch_path
from .subscribe import append_segments, drain, subscribed

TAKEN = "run_id string, seq long, canonical string, number long"
CAP = 25
#: How long an address is remembered behind the newest one seen; a run is shorter.
MEMORY = "3650 days"


class Cap(StatefulProcessor):
    """Of each run how many sources it has; the next ones get the next numbers until the cap is reached."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        have = self.count.get()[0] if self.count.exists() else 0
        room = max(0, self.cap - have)
        if room:
            some = pd.concat([r.nsmallest(room, "seq") for r in rows]).nsmallest(room, "seq")[["run_id", "seq", "canonical"]]
            some["number"] = range(have + 1, have + 1 + len(some))
            self.count.update((have + len(some),))
            yield some

    def close(self) -> None:
        pass


def reserved(requests: DataFrame, cap: int = CAP) -> DataFrame:
    """(run_id, seq, canonical, number) of a table of requests (run_id, seq, url): the first request of each address, the first ``cap`` of a run, numbered."""
    first = requests.groupBy("run_id", canonical_url(F.col("url")).alias("canonical")).agg(F.min("seq").alias("seq"))
    return numbered(first, "number", [F.col("seq")], ["run_id"]).where(F.col("number") <= cap).select("run_id", "seq", "canonical", "number")


def reserved_stream(requests: DataFrame, at: Column, cap: int = CAP, memory: str = MEMORY) -> DataFrame:
    """reserved() of a stream of requests, at ``at`` by event time, after 1970: addresses that came before are dropped, and of each run the count is kept as state."""
    timed = requests.select("run_id", "seq", canonical_url(F.col("url")).alias("canonical"), at.alias("at")).withWatermark("at", memory)
    return timed.dropDuplicatesWithinWatermark(["run_id", "canonical"]).groupBy("run_id").transformWithStateInPandas(Cap(cap), TAKEN, "append", "none")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "events").selectExpr(
        "concat('run', CAST(user_id % 20 AS STRING)) AS run_id", "event_id AS seq",
        "concat('https://site', CAST(event_id * 7 % 31 AS STRING), '.org/doc/', CAST(event_id * 13 % 11 AS STRING), CASE WHEN event_id % 2 = 0 THEN '?utm_source=x#top' ELSE '' END) AS url",
    )


def streamed(requests: DataFrame, path: str, cap: int = CAP) -> DataFrame:
    """What a stream of ``requests`` reserves that is stopped when a third of them has come and goes on over the same checkpoint."""
    spark = requests.sparkSession
    third = (requests.agg(F.max("seq")).first()[0] or 0) // 3
    for mark, part in ((1, F.col("seq") < third), (2, F.col("seq") >= third)):
        append_segments(requests.where(part).withColumnRenamed("url", "type"), f"{path}/requests")
        with rocks(spark):
            drain(reserved_stream(subscribed(spark, f"{path}/requests").withColumnRenamed("type", "url"), F.timestamp_seconds(F.col("seq") + 1), cap), path, mark)
    return spark.read.schema(f"{TAKEN}, drain int").parquet(f"{path}/rows/*").drop("drain")


SQL = f"""SELECT run_id, seq, canonical, number FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS number FROM (SELECT concat('run', user_id % 20) AS run_id,
  concat('https://site', event_id * 7 % 31, '.org/doc/', event_id * 13 % 11) AS canonical, min(event_id) AS seq FROM events GROUP BY 1, 2)) WHERE number <= {CAP}"""
QUERIES["ss15_reserved"] = lambda spark, sf: reserved(_requests(spark, sf))
ORACLE_SQL["ss15_reserved"] = SQL
QUERIES["ss15_reserved_stream"] = lambda spark, sf: streamed(_requests(spark, sf), scratch_path(spark, "reserved"))
ORACLE_SQL["ss15_reserved_stream"] = SQL
