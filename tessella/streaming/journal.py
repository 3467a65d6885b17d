"""The event journal as a stream: replay from the start, live counters, the search trail, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import ORACLE_SQL, QUERIES, register
from ..plans.scratch import scratch_path


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A driver table as an append-only stream read from its beginning."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a streaming plan over all that is there and read back what it wrote: the rows of appends, or the last state of a complete result.

    Rows, state and offsets are in the shared folder; nothing of them passes through the driver. A batch that is run again replaces its own folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'state' if mode == 'complete' else f'batch={number}'}")

    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = f"{path}/rows/state" if mode == "complete" else f"{path}/rows/*"
    return spark.read.schema(df.schema).parquet(rows)


def counters(events: DataFrame) -> DataFrame:
    """Live counters by type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def trail(events: DataFrame) -> DataFrame:
    """The most results of each search so far."""
    return events.groupBy((F.col("user_id") % 40).alias("key")).agg(F.max(F.floor("value")).alias("results"))


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES["ss17_live_counters"] = lambda spark, sf: drained(counters(stream(spark, sf)), "complete")
ORACLE_SQL["ss17_live_counters"] = "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1"
QUERIES["ss08_trail_stream"] = lambda spark, sf: drained(trail(stream(spark, sf)), "complete")
ORACLE_SQL["ss08_trail_stream"] = "SELECT user_id % 40 AS key, max(floor(value))::BIGINT AS results FROM events GROUP BY 1"
QUERIES["ss01_replay"] = lambda spark, sf: drained(stream(spark, sf).where("event_type <> 'view'").select("event_id", "event_type"), "append")
ORACLE_SQL["ss01_replay"] = "SELECT event_id, event_type FROM events WHERE event_type <> 'view'"
QUERIES["ss_tumbling_windows"] = lambda spark, sf: drained(tumbling(stream(spark, sf)), "complete")
ORACLE_SQL["ss_tumbling_windows"] = "SELECT time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
register("ss_sessions", "events", lambda e: e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest")), "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS sessions, max(n) AS largest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1")
