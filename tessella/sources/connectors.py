"""Connectors: scholarly feeds, captions, trace files and run stores, each from recorded responses; retry, fallback and politeness."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pages import captions, mapped
from ..functions.text import host
from ..plans.registry import register

ATOM = "id string, title string, summary string, published string, author array<struct<name: string>>"
PUBMED = "PMID string, Title string, Abstract array<struct<_Label: string, _VALUE: string>>, Author array<struct<Last: string>>"


def collapsed(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def atom_entries(feeds: DataFrame, text: str = "xml") -> DataFrame:
    """Entries of Atom feeds, one ``entry`` element a row, as search results."""
    entry = F.from_xml(F.col(text), ATOM)
    return feeds.select("*", entry.alias("e")).select(*[c for c in feeds.columns if c != text], collapsed("e.title").alias("title"), F.col("e.id").alias("url"), collapsed("e.summary").alias("snippet"), F.concat_ws(", ", F.transform("e.author", lambda a: a["name"])).alias("authors"))


def pubmed_articles(records: DataFrame, text: str = "xml", most_authors: int = 12) -> DataFrame:
    """Articles with labelled abstract parts joined and at most ``most_authors`` authors."""
    article = F.from_xml(F.col(text), PUBMED, {"rowTag": "Article"})
    parts = F.transform("a.Abstract", lambda p: F.when(p["_Label"].isNotNull(), F.concat_ws(": ", p["_Label"], p["_VALUE"])).otherwise(p["_VALUE"]))
    return records.select("*", article.alias("a")).select(*[c for c in records.columns if c != text], F.col("a.PMID").alias("pmid"), F.col("a.Title").alias("title"), F.concat_ws("\n", parts).alias("abstract"), F.concat_ws(", ", F.slice(F.transform("a.Author", lambda x: x["Last"]), 1, most_authors)).alias("authors"))


def video_id(url: str) -> str | None:
    """The id in the common forms of a video's address."""
    parts = urlsplit(url)
    name = (parts.hostname or "").removeprefix("www.").removeprefix("m.")
    if name == "youtu.be":
        found = parts.path[1:].split("/")[0]
    elif name in ("youtube.com", "youtube-nocookie.com"):
        found = parse_qs(parts.query).get("v", [""])[0] or (m[1] if (m := re.match(r"/(?:shorts|embed|live|v)/([^/]+)", parts.path)) else "")
    else:
        return None
    return found if re.fullmatch(r"[\w-]{11}", found) else None


def picked_track(tracks: list[dict], lang: str = "en") -> dict | None:
    """A written track of the language, else a generated one, else the first."""
    order = [t for t in tracks if t.get("lang", "").startswith(lang) and t.get("kind") != "asr"] + [t for t in tracks if t.get("lang", "").startswith(lang)] + tracks
    return order[0] if order else None


def trace_files(spark: SparkSession, path: str) -> DataFrame:
    """Digest files ``<commit>/<run>.digest.json`` below a folder with what their paths say."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.digest.json").schema("wall_ms long, cost_usd double").json(path)
    file = F.col("_metadata.file_path")
    return read.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("commit_sha"), F.regexp_extract(file, r"([^/]+)\.digest\.json$", 1).alias("run_id"), "wall_ms", "cost_usd")


def migrated(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A legacy table with one wide row a run as runs and their blobs."""
    blobs = [c for c in results.columns if c.endswith("_json")]
    long = results.unpivot("run_id", blobs, "kind", "payload").where("payload IS NOT NULL").withColumn("kind", F.regexp_replace("kind", "_json$", ""))
    return results.drop(*blobs), long


@dataclass
class Politeness:
    """How a fetch connector treats hosts: attempts, a doubling delay and what ends the attempts."""

    attempts: int = 5
    base_s: float = 0.0
    transient: Callable[[Exception], bool] = field(default=lambda e: isinstance(e, (TimeoutError, ConnectionError)))

    def call(self, what: Callable[[], object]) -> object:
        for k in range(self.attempts):
            try:
                return what()
            except Exception as e:
                if k + 1 == self.attempts or not self.transient(e):
                    raise
                time.sleep(self.base_s * 2**k)
        raise AssertionError


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], schema: str = "url string, status int, body string", parts: int = 16) -> DataFrame:
    """Bodies of URLs: those of one host follow each other in one task, so a host sees one request at a time."""
    dealt = urls.withColumn("__host", host(F.col("url"))).repartition(parts, "__host").sortWithinPartitions("__host", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(u, *Politeness().call(lambda u=u: fetch(u))) for u in batch.url], columns=["url", "status", "body"])

    return dealt.select("url").mapInPandas(run, schema)


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in the place of those of their keys; new keys are added."""
    return rows.unionByName(table.join(rows.select(key), key, "left_anti"))


def attempts_by_host(attempts: DataFrame) -> DataFrame:
    """Of each URL's attempts the first good one, else the one with the best score, attempts in order."""
    order = Window.partitionBy("url").orderBy(F.desc("good"), F.when(F.col("good"), F.col("ord")), F.desc("score"), "ord")
    return attempts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _feed(b: DataFrame) -> DataFrame:
    clean = F.regexp_replace("text", "[^A-Za-z .]", "")
    return b.select("item_id", F.concat(F.lit("<entry><id>http://x/"), "item_id", F.lit("</id><title> "), clean, F.lit("\n</title><summary>"), F.reverse(clean), F.lit("</summary><author><name>A B</name></author><author><name>C</name></author></entry>")).alias("xml"))


register("sc24_atom", "benchmark", lambda b: atom_entries(_feed(b)).select("item_id", "url", "title", "authors"), "SELECT item_id, 'http://x/' || item_id AS url, trim(regexp_replace(regexp_replace(text, '[^A-Za-z .]', '', 'g'), '\\s+', ' ', 'g')) AS title, 'A B, C' AS authors FROM benchmark")
register("sc25_pubmed", "benchmark", lambda b: pubmed_articles(b.select("item_id", F.concat(F.lit("<Article><PMID>"), "item_id", F.lit("</PMID><Title>t</Title><Abstract Label=\"AIM\">one</Abstract><Abstract>two</Abstract><Author><Last>X</Last></Author><Author><Last>Y</Last></Author></Article>")).alias("xml"))), "SELECT item_id, item_id::VARCHAR AS pmid, 't' AS title, 'AIM: one' || chr(10) || 'two' AS abstract, 'X, Y' AS authors FROM benchmark")
register("sc30_video_ids", "pages", lambda p: mapped(p.select("page_id"), "page_id long, video string", lambda i: (i, video_id((f"https://www.youtube.com/watch?v=abcdefghij{i % 10}", f"https://youtu.be/abcdefghij{i % 10}?t=3", f"https://m.youtube.com/shorts/abcdefghij{i % 10}", "https://example.com/watch?v=abcdefghijk")[i % 4]))), "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'abcdefghij' || (page_id % 10) END AS video FROM pages")
register("xs13_caption_attempt", "documents", lambda d: mapped(d.select("doc_id", F.col("text").alias("t")), "doc_id long, ok boolean", lambda i, t: (i, len(captions(json.dumps({"events": [{"segs": [{"utf8": t}]}]}))) >= 40)), "SELECT doc_id, length(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) >= 40 AS ok FROM documents")
register("sc09_table_upsert", "runs", lambda r: upserted(r.select("run_id", "status", "created_at"), r.where("dirty = 1").select(F.when(F.col("created_at") % 3 == 0, F.concat(F.lit("new"), "run_id")).otherwise(F.col("run_id")).alias("run_id"), F.lit("regraded").alias("status"), (F.col("created_at") + 1).alias("created_at")), "run_id"), "SELECT run_id, status, created_at FROM runs WHERE NOT (dirty = 1 AND created_at % 3 <> 0) UNION ALL SELECT CASE WHEN created_at % 3 = 0 THEN 'new' || run_id ELSE run_id END, 'regraded', created_at + 1 FROM runs WHERE dirty = 1")
register("sc13_migration", "runs", lambda r: migrated(r.select("run_id", F.col("status").alias("score_json"), F.col("model").alias("usage_json")))[1], "SELECT run_id, 'score' AS kind, status AS payload FROM runs UNION ALL SELECT run_id, 'usage', model FROM runs WHERE model IS NOT NULL")
register("st13_best_text", "hits", lambda h: h.withColumn("k", F.row_number().over(Window.partitionBy("query_no").orderBy("hit_id"))).where("k <= 3").groupBy("query_no").agg(F.max(F.struct(F.length("snippet"), -F.col("hit_id"), "url")).alias("m")).select("query_no", F.col("m.url").alias("url")), "SELECT query_no, arg_max(url, (length(snippet), -hit_id)) AS url FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY hit_id) AS k FROM hits) WHERE k <= 3 GROUP BY 1")
register("sc18_fetch_by_host", "pages", lambda p: fetched(p.select("url"), lambda u: (200, u[::-1])).select("url", "status", F.reverse("body").alias("body")), "SELECT url, 200::INT AS status, url AS body FROM pages")
