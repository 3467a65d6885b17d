"""What subscribers of a run see: the whole history up to the run's end, server-sent events from a place on, and sources that tools add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url
from ..plans.registry import register
from ..sources.catalog import JOURNAL_SCHEMA

ENDS = ("run.completed", "run.error")


def until_end(events: DataFrame) -> DataFrame:
    """Events of each run up to its first terminal one; what comes after a run is closed or has failed is seen by nobody."""
    end = events.where(F.col("type").isin(*ENDS)).groupBy("run_id").agg(F.min("seq").alias("__end"))
    return events.join(end, "run_id", "left").where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))).drop("__end")


def delivered(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(subscriber, run_id, seq, type, place): each subscriber gets the whole history of its run in order, however late it comes,
    and of a run that failed the failure last. ``subscribers`` has (subscriber, run_id)."""
    place = F.row_number().over(Window.partitionBy("subscriber", "run_id").orderBy("seq"))
    return subscribers.join(until_end(events), "run_id").select("subscriber", "run_id", "seq", "type", place.alias("place"))


def numbered_events(events: DataFrame) -> DataFrame:
    """Events of a run by their place in its log, from 1."""
    return events.withColumn("id", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))


def sse(events: DataFrame, asked: DataFrame) -> DataFrame:
    """(client, run_id, id, frame): server-sent events behind the last id that a client has; one that is no number, or negative, is 0."""
    last = F.coalesce(F.col("last_event_id").try_cast("double"), F.lit(0.0))
    log = numbered_events(events).select("run_id", "id", F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\ndata: "), F.to_json(F.struct("type", "seq")), F.lit("\n\n")).alias("frame"))
    return asked.withColumn("last", F.when((last < 0) | F.isnan(last), 0.0).otherwise(last)).join(log, "run_id").where("id > last").select("client", "run_id", "id", "frame")


def ingested(sources: DataFrame, cap: Column | int, by: str = "run_id", order: str = "seq") -> DataFrame:
    """Sources that a user's tools add to a run: the first of each canonical address that has any content, as many as the cap lets in, numbered.

    An empty address or content adds nothing; one that is there already is found and not added again.
    """
    named = sources.where((F.trim("url") != "") & (F.trim("content") != "")).withColumn("canonical", canonical_url(F.trim("url")))
    first = F.row_number().over(Window.partitionBy(by, "canonical").orderBy(order)) == 1
    number = F.row_number().over(Window.partitionBy(by).orderBy(order))
    once = named.withColumn("__first", first).where("__first").withColumn("number", number).where(F.col("number") <= cap)
    return once.select(by, "canonical", F.concat(F.lit("source_"), "number").alias("source_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url")).alias("title"))


class MemoryStore:
    """A journal that lives as long as the session: a view of the entries of all runs, appended run by run."""

    def __init__(self, spark: SparkSession, name: str = "journal_memory"):
        self.spark, self.name = spark, name
        spark.createDataFrame([], JOURNAL_SCHEMA).createOrReplaceTempView(name)

    def append(self, entries: DataFrame) -> None:
        self.spark.table(self.name).unionByName(entries.select(*self.spark.table(self.name).columns)).createOrReplaceTempView(self.name)

    def read(self, run_id: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run_id") == run_id)

    def runs(self) -> DataFrame:
        return self.spark.table(self.name).select("run_id").distinct()


def _remembered(j: DataFrame) -> DataFrame:
    store = MemoryStore(j.sparkSession)
    store.append(j.where("seq % 2 = 0"))
    store.append(j.where("seq % 2 = 1"))
    return store.read("run7").select("seq", "kind").unionByName(store.runs().agg(F.count("*").alias("seq")).withColumn("kind", F.lit("runs")))


EVENTS = "(SELECT run_id, seq, type FROM journal WHERE kind IN ('event', 'meta', 'io'))"
OPEN = f"(SELECT e.* FROM {EVENTS} e LEFT JOIN (SELECT run_id, min(seq) AS last FROM {EVENTS} WHERE type IN ('run.completed', 'run.error') GROUP BY 1) x USING (run_id) WHERE last IS NULL OR seq <= last)"


def _events(j: DataFrame) -> DataFrame:
    return j.where("kind IN ('event', 'meta', 'io')").select("run_id", "seq", "type")


register("ss01_delivered", "journal", lambda j: delivered(_events(j), j.select("run_id", F.explode(F.array(F.lit("early"), F.lit("late"))).alias("subscriber")).distinct()), f"SELECT s AS subscriber, run_id, seq, type, (row_number() OVER (PARTITION BY s, run_id ORDER BY seq))::INT AS place FROM {OPEN}, (VALUES ('early'), ('late')) v(s)")
register("sc33_server_sent_events", "journal", lambda j: sse(_events(j), j.select("run_id").distinct().select("run_id", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("3"), F.lit("x"), F.lit("-1")))).alias("client", "last_event_id"))), f"SELECT client, run_id, id::INT AS id, 'id: ' || id || chr(10) || 'data: {{\"type\":\"' || type || '\",\"seq\":' || seq || '}}' || chr(10) || chr(10) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS id FROM {EVENTS}), (VALUES ('a', 3), ('b', 0), ('c', 0)) v(client, n) WHERE id > n")
register("ud03_added_sources", "hits", lambda h: ingested(h.select(F.col("provider").alias("run_id"), F.col("hit_id").alias("seq"), F.when(F.col("hit_id") % 17 == 0, " ").otherwise(F.concat("url", F.when(F.col("hit_id") % 2 == 0, "?utm_source=x#top").otherwise(""))).alias("url"), F.when(F.col("hit_id") % 3 == 0, F.col("title")).alias("title"), F.col("snippet").alias("content")), 20), "SELECT run_id, canonical, 'source_' || number AS source_id, title FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY hit_id) AS number FROM (SELECT provider AS run_id, hit_id, url AS canonical, CASE WHEN hit_id % 3 = 0 THEN title ELSE url || CASE WHEN hit_id % 2 = 0 THEN '?utm_source=x#top' ELSE '' END END AS title, row_number() OVER (PARTITION BY provider, url ORDER BY hit_id) AS r FROM hits WHERE hit_id % 17 <> 0 AND trim(snippet) <> '') WHERE r = 1) WHERE number <= 20")
register("sc04_memory_store", "journal", _remembered, "SELECT seq, kind FROM journal WHERE run_id = 'run7' UNION ALL SELECT count(DISTINCT run_id), 'runs' FROM journal")
