"""Cards of source documents, what a search over them answers, and how a document was extracted: JSON with keys that are left out where there is nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import EXTRACTIONS, NO_QUERY, RAW_ACCESS
from ..functions.text import CHUNK, occurrences, query_terms
from ..plans.registry import register, rounded
from ..plans.scratch import written
from .retrieval import SQL_TERMS, SQL_WINDOWS, K1, B, windows

#: Characters of a card's preview, without and with passages; from how many a document has passages, and how many; links of a listing.
PREVIEW, HEAD, LEAST_CHARS, PASSAGES, LISTED = 700, 300, 3_000, 2, 20


def passages(docs: DataFrame, query: str, most: int, pool: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(pool, key, start, stop, score, rank): the ``most`` best windows of the documents of each pool, by BM25 over that pool's windows.

    Windows are counted where the texts lie; numbers alone are written and joined with the sums of their pool, one small row. A query without terms finds nothing.
    """
    terms = docs.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    ids = list(dict.fromkeys((pool, key)))
    plain = docs.select(*ids, text)
    if not terms:
        return windows(plain, key, text).where("false").select(*[F.lit(None).cast("string").alias(c) for c in ids], "start", F.col("start").alias("stop"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    named = plain.select(F.struct(*ids).alias("id"), text)
    cut = windows(named, "id", text).select("id", "start", "words", F.length("passage").alias("chars"), *[occurrences(F.col("passage"), F.lit(t)).alias(f"f{i}") for i, t in enumerate(terms)])
    counted = written(cut.select("id.*", "start", "words", "chars", *[f"f{i}" for i in range(len(terms))]), "pool-windows")
    stats = counted.groupBy(pool).agg(F.count("*").alias("total"), F.avg("words").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    some = counted.where(F.greatest(*[F.col(f"f{i}") for i in range(len(terms))], F.lit(0)) > 0).join(stats.withColumnRenamed(pool, "__pool"), F.col(pool).eqNullSafe(F.col("__pool")))
    size = F.greatest(F.col("words"), F.lit(1)) / F.coalesce(F.nullif(F.col("mean"), F.lit(0.0)), F.lit(1.0))

    def part(i: int) -> Column:
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        return F.log(1 + (F.col("total") - n + 0.5) / (n + 0.5)) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * size))

    score = rounded(reduce(lambda a, b: a + b, map(part, range(len(terms)))), 6)
    best = Window.partitionBy(pool).orderBy(F.desc("score"), key, "start")
    return some.select(*ids, "start", (F.col("start") + F.col("chars")).alias("stop"), score.alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def extraction(method: Column, chars: Column, tool: Column | None = None, notes: Column | None = None, **known: Column) -> Column:
    """How a document came about, as a structure whose null fields are left out of its JSON: method, its lead note, notes, and what is known beside.

    ``known`` has any of contentType, finalUrl, attempts, qualityWarnings, discoveredLinks and a page's metadata; empty arrays and texts count as unknown.
    """
    lead = F.when(method == "custom_tool", F.concat(F.lit('Added by the "'), F.coalesce(tool, F.lit("")) if tool is not None else F.lit(""), F.lit('" custom tool.')))
    for name, note in EXTRACTIONS.items():
        lead = lead.when(method == name, note)
    listed = {"attempts", "qualityWarnings", "discoveredLinks"}
    given = [(F.when(F.size(c) > 0, c) if n in listed else F.nullif(c, F.lit("")) if n != "jsonLd" else c).alias(n) for n, c in known.items()]
    every = F.array(lead) if notes is None else F.concat(F.array(lead), F.coalesce(notes, F.array().cast("array<string>")))
    return F.struct(chars.alias("markdownChars"), method.alias("method"), *given, every.alias("extractionNotes"))


def cards(docs: DataFrame, goal: str = "", preview: int = PREVIEW) -> DataFrame:
    """(doc_id, card) of documents (doc_id, url, title, markdown, warnings, links): what a reader gets to see of a source before reading it.

    A document of more than LEAST_CHARS characters has its best passages for the goal and a shorter preview. One that its warnings call a listing has its links.
    """
    long = docs.where(F.length("markdown") > LEAST_CHARS)
    found = passages(long.select("doc_id", F.col("markdown").alias("text")), goal, PASSAGES, "doc_id").withColumnRenamed("doc_id", "__doc")
    by_doc = found.groupBy("__doc").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "stop"))).alias("spots"))  # PASSAGES at most
    text, n, own = F.col("markdown"), F.length("markdown"), F.coalesce(F.col("warnings"), F.array().cast("array<string>"))
    spots = F.transform("spots", lambda p: F.struct(F.call_function("div", p["start"], F.lit(CHUNK)).alias("chunk_index"), p["start"].alias("start"), p["stop"].alias("end"), F.trim(F.substring(text, p["start"] + 1, p["stop"] - p["start"])).alias("snippet")))
    shown = F.substring(text, F.lit(1), F.least(F.lit(preview), F.when(F.size("spots") > 0, F.lit(HEAD)).otherwise(F.lit(preview))))
    warned = F.when(F.size(own) > 0, own)
    made = F.struct(F.col("method"), warned.alias("quality_warnings"), F.array(F.element_at(F.create_map(*[F.lit(x) for p in EXTRACTIONS.items() for x in p]), F.col("method"))).alias("notes"))
    card = F.struct(
        F.concat(F.lit("source_"), F.col("doc_id")).alias("source_id"), F.col("title"), F.col("url"), F.col("url").alias("canonical_url"), F.when(F.size(own) > 0, F.struct(own.alias("warnings"))).alias("source_quality"), F.when(F.col("method").isNotNull(), made).alias("extraction"),
        F.when(F.exists(own, lambda w: F.startswith(w, F.lit("search_listing_page"))), F.struct(F.lit("discovery_page").alias("source_kind"), F.slice("links", 1, LISTED).alias("links"))).alias("discovery"),
        n.alias("source_length_chars"), n.alias("stored_chars"), n.alias("original_chars"), F.lit(False).alias("truncated"), F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("int").alias("chunk_count"), F.lit(CHUNK).alias("chunk_chars"),
        F.nullif(shown, F.lit("")).alias("preview"), F.when(F.size("spots") > 0, spots).alias("relevant_passages"), F.lit(RAW_ACCESS).alias("raw_access"),
    )
    return docs.join(by_doc, F.col("doc_id") == F.col("__doc"), "left").select("doc_id", F.to_json(card).alias("card"))


def envelopes(docs: DataFrame, query: str, most: int, pool: str) -> DataFrame:
    """(pool, reply): what a search over the documents of each pool answers, matches best first; an error for a query without terms, no matches where nothing is found."""
    pools = docs.select(pool).distinct()
    if not docs.sparkSession.range(1).select(F.size(query_terms(F.lit(query))).alias("n")).first()["n"]:
        return pools.select(pool, F.lit(NO_QUERY).alias("reply"))
    top = written(passages(docs, query, most, pool), "top-passages").withColumnsRenamed({pool: "__pool", "doc_id": "__doc"})
    texts = top.join(docs.select("doc_id", "title", "url", "text"), F.col("doc_id") == F.col("__doc"))
    match = F.struct(
        F.col("rank"), F.concat(F.lit("source_"), F.col("doc_id")).alias("source_id"), "title", "url", F.col("url").alias("canonical_url"), F.call_function("div", F.col("start"), F.lit(CHUNK)).alias("chunk_index"),
        "start", F.col("stop").alias("end"), rounded(F.col("score"), 3).alias("score"), F.trim(F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))).alias("snippet"),
    )
    by_pool = texts.groupBy("__pool").agg(F.array_sort(F.collect_list(match)).alias("m"))  # ``most`` at most
    matches = F.coalesce(F.transform("m", lambda x: x.dropFields("rank")), F.from_json(F.lit("[]"), "array<struct<source_id string, title string, url string, canonical_url string, chunk_index bigint, start int, end int, score double, snippet string>>"))
    joined = pools.join(by_pool, F.col(pool).eqNullSafe(F.col("__pool")), "left")
    return joined.select(pool, F.to_json(F.struct(F.lit(query).alias("query"), F.size(matches).alias("result_count"), matches.alias("matches"))).alias("reply"))


QUERY = 'the "of the" tion'
DOCS = "SELECT doc_id, source, 'https://h.example/' || doc_id AS url, 'title ' || doc_id AS title, text FROM documents"
BEST = f"""WITH d AS ({DOCS}), w AS MATERIALIZED (SELECT {{pool}} AS pool, doc_id, start, passage, greatest(1, len(regexp_extract_all(passage, '[\\p{{{{L}}}}\\p{{{{N}}}}]+'))) AS dl, len(regexp_extract_all(passage, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')) AS words FROM {SQL_WINDOWS} JOIN d USING (doc_id) WHERE {{where}}),
f AS (SELECT pool, doc_id, start, dl, length(passage) AS chars, t, (length(passage) - length(replace(passage, t, ''))) / length(t) AS f FROM w, (SELECT unnest({SQL_TERMS}) AS t)),
s AS (SELECT pool, count(*) AS total, avg(words) AS mean FROM w GROUP BY 1), n AS (SELECT pool, t, count(*) FILTER (f > 0) AS n FROM f GROUP BY 1, 2),
c AS (SELECT f.pool, f.doc_id, start, start + chars AS stop, floor(sum(ln(1 + (total - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))) * 1e6 + 0.5) / 1e6 AS score FROM f JOIN n ON n.pool = f.pool AND n.t = f.t JOIN s ON s.pool = f.pool WHERE f > 0 GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, doc_id, start) AS rank FROM c QUALIFY rank <= {{most}})"""
TRIMMED = "trim(text[start + 1 : stop])"
CARDS = BEST.replace("{{", "{").replace("}}", "}").replace("{pool}", "doc_id").replace("{where}", f"length(text) > {LEAST_CHARS}").replace("{most}", str(PASSAGES)) + f""",
p AS (SELECT doc_id, string_agg('{{"chunk_index":' || (start // {CHUNK}) || ',"start":' || start || ',"end":' || stop || ',"snippet":' || to_json({TRIMMED})::VARCHAR || '}}', ',' ORDER BY rank) AS p FROM b JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, md5('{{"source_id":"source_' || doc_id || '","title":"' || title || '","url":"' || url || '","canonical_url":"' || url || '",' ||
  CASE doc_id % 5 WHEN 0 THEN '"source_quality":{{"warnings":["thin_content: few"]}},"extraction":{{"method":"html_direct","quality_warnings":["thin_content: few"],"notes":["{EXTRACTIONS["html_direct"]}"]}},'
    WHEN 1 THEN '"source_quality":{{"warnings":["search_listing_page"]}},"extraction":{{"method":"html_direct","quality_warnings":["search_listing_page"],"notes":["{EXTRACTIONS["html_direct"]}"]}},"discovery":{{"source_kind":"discovery_page","links":["' || url || '"]}},'
    ELSE '"extraction":{{"method":"html_direct","notes":["{EXTRACTIONS["html_direct"]}"]}},' END ||
  '"source_length_chars":' || length(text) || ',"stored_chars":' || length(text) || ',"original_chars":' || length(text) || ',"truncated":false,"chunk_count":' || greatest(1, ceil(length(text) / {CHUNK}))::INT || ',"chunk_chars":{CHUNK}' ||
  CASE WHEN text = '' THEN '' ELSE ',"preview":' || to_json(text[1 : CASE WHEN p IS NULL THEN {PREVIEW} ELSE {HEAD} END])::VARCHAR END || coalesce(',"relevant_passages":[' || p || ']', '') || ',"raw_access":"{RAW_ACCESS}"}}') AS digest FROM d LEFT JOIN p USING (doc_id)"""
REPLIES = BEST.replace("{{", "{").replace("}}", "}").replace("{pool}", "source").replace("{where}", "true").replace("{most}", "8") + f""",
m AS (SELECT pool, count(*) AS n, string_agg('{{"source_id":"source_' || doc_id || '","title":"' || title || '","url":"' || url || '","canonical_url":"' || url || '","chunk_index":' || (start // {CHUNK}) || ',"start":' || start || ',"end":' || stop || ',"score":' || (floor(score * 1000 + 0.5) / 1000) || ',"snippet":' || to_json({TRIMMED})::VARCHAR || '}}', ',' ORDER BY rank) AS m FROM b JOIN d USING (doc_id) GROUP BY 1)
SELECT source, md5('{{"query":"the \\"of the\\" tion","result_count":' || coalesce(n, 0) || ',"matches":[' || coalesce(m, '') || ']}}') AS digest FROM (SELECT DISTINCT source FROM documents) LEFT JOIN m ON pool = source"""


def _documents(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    warnings = F.when(i % 5 == 0, F.array(F.lit("thin_content: few"))).when(i % 5 == 1, F.array(F.lit("search_listing_page")))
    url = F.concat(F.lit("https://h.example/"), i)
    return d.select("doc_id", "source", url.alias("url"), F.concat(F.lit("title "), i).alias("title"), "text", F.col("text").alias("markdown"), warnings.alias("warnings"), F.array(url).alias("links"), F.lit("html_direct").alias("method"))


def _extracted(p: DataFrame) -> DataFrame:
    i = F.col("page_id")
    methods = [*EXTRACTIONS, "custom_tool"]
    method = F.element_at(F.array(*map(F.lit, methods)), (i % len(methods) + 1).cast("int"))
    known = {"contentType": F.when(i % 2 == 0, "text/html"), "finalUrl": F.when(i % 3 == 0, F.col("url")).otherwise(""), "qualityWarnings": F.when(i % 4 == 0, F.array(F.lit("thin_content"))).otherwise(F.array().cast("array<string>")), "author": F.when(i % 5 == 0, "A. U.")}
    return p.select("page_id", F.to_json(extraction(method, F.length("html"), F.lit("my_tool"), F.when(i % 7 == 0, F.array(F.lit("again"))), **known)).alias("meta"))


EXTRACTED = f"""SELECT page_id, '{{"markdownChars":' || length(html) || ',"method":"' || m || '"' || CASE WHEN page_id % 2 = 0 THEN ',"contentType":"text/html"' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN ',"finalUrl":' || to_json(url)::VARCHAR ELSE '' END ||
  CASE WHEN page_id % 4 = 0 THEN ',"qualityWarnings":["thin_content"]' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN ',"author":"A. U."' ELSE '' END || ',"extractionNotes":["' || CASE WHEN m = 'custom_tool' THEN 'Added by the \\"my_tool\\" custom tool.' ELSE {list(EXTRACTIONS.values())}[page_id % {len(EXTRACTIONS) + 1} + 1] END || '"' || CASE WHEN page_id % 7 = 0 THEN ',"again"' ELSE '' END || ']}}' AS meta
  FROM (SELECT *, {[*EXTRACTIONS, "custom_tool"]}[page_id % {len(EXTRACTIONS) + 1} + 1] AS m FROM pages)"""

register("pf25_source_cards", "documents", lambda d: cards(_documents(d), QUERY).select("doc_id", F.md5("card").alias("digest")), CARDS)
register("xs17_search_envelope", "documents", lambda d: envelopes(_documents(d), QUERY, 8, "source").select("source", F.md5("reply").alias("digest")), REPLIES)
register("xs16_extraction_metadata", "pages", _extracted, EXTRACTED)
