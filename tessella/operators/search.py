"""Search fusion: reciprocal-rank merging by canonical URL, authority, dedupe, candidate sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FILINGS, ascii_edges
from ..functions.text import bare_host, canonical_query, canonical_url, host, trail_key
from ..plans.registry import register, rounded

RRF_K = 60
# Hosts by authority.
TIER_A, TIER_B = 1.3, 1.12
TIER_A_HOSTS = r"((^|\.)(gov|mil|int)(\.[a-z]{2})?$)|(\.edu$)|(\.ac\.uk$)|(^|\.)(europa\.eu|who\.int|w3\.org)$|ncbi\.nlm\.nih\.gov$|^(doi\.org|arxiv\.org|iso\.org|ietf\.org|rfc-editor\.org)$"
TIER_B_HOSTS = r"^(docs|developer)\.|\.org$"


def authority(url: Column) -> Column:
    h = host(url)
    return F.when(h.rlike(TIER_A_HOSTS), TIER_A).when(h.rlike(TIER_B_HOSTS), TIER_B).otherwise(1.0)


def fused(hits: DataFrame, by: str = "query_no") -> DataFrame:
    """One row for each query and canonical URL: summed 1 / (60 + position), providers in order of arrival, title and URL of the
    best position, the first of equals, and of the snippets that came with an improvement the last that isn't empty."""
    some = hits.withColumn("key", canonical_url(F.col("url"))).withColumn("arrival", F.struct("list_no", "position", "hit_id"))
    best = F.min("position").over(Window.partitionBy(by, "key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("improves", best.isNull() | (F.col("position") < best))
    lead = F.struct("position", "arrival")
    firsts = F.array_sort(F.collect_list(F.struct("arrival", "provider")))
    return some.groupBy(by, "key").agg(
        F.sum(1 / (RRF_K + F.col("position"))).alias("raw"), F.min("position").alias("best"), F.min_by("title", lead).alias("title"), F.min_by("url", lead).alias("url"),
        F.max_by("snippet", F.when(F.col("improves") & (F.col("snippet") != ""), F.col("arrival"))).alias("snippet"),
        F.array_join(F.array_distinct(F.transform(firsts, lambda x: x["provider"])), ",").alias("providers"),
    ).withColumn("score", rounded(F.col("raw"), 8)).drop("raw")


def ranked(merged: DataFrame, limit: int = 20, by: str = "query_no") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "best", "key")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def across_queries(merged: DataFrame, by: str = "query_no") -> DataFrame:
    """Scores of all queries added; the title of the first query that had the URL stays."""
    return merged.groupBy("key").agg(rounded(F.sum("score"), 6).alias("score"), F.min_by("title", by).alias("title"), F.count("*").alias("queries"))


def allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Hosts by suffix: an excluded one loses, an empty include list allows all, a URL without host is out."""
    h = bare_host(url)
    under = lambda names: F.exists(F.array(*map(F.lit, names)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))) if names else F.lit(False)
    return F.coalesce(h.isNotNull() & ~under(exclude) & (under(include) if include else F.lit(True)), F.lit(False))


def unfetched(surfaced: DataFrame, fetched: DataFrame, dead: DataFrame, cap: int) -> DataFrame:
    """What searches surfaced and nobody fetched or found dead, newest first."""
    left = surfaced.join(fetched, "key", "left_anti").join(dead, "key", "left_anti")
    return left.orderBy(F.desc("at"), "key").limit(cap)


A = "regexp_matches(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '(^|\\.)(gov|mil|int)(\\.[a-z]{2})?$|\\.edu$|\\.ac\\.uk$|(^|\\.)(europa\\.eu|who\\.int|w3\\.org)$|ncbi\\.nlm\\.nih\\.gov$|^(doi\\.org|arxiv\\.org|iso\\.org|ietf\\.org|rfc-editor\\.org)$')"
AUTH = f"CASE WHEN {A} THEN 1.3 WHEN regexp_matches(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^(docs|developer)\\.|\\.org$') THEN 1.12 ELSE 1.0 END"
FUSED = """(SELECT query_no, url AS key, min(position) AS best, arg_min(title, (position, list_no, hit_id)) AS title, arg_min(url, (position, list_no, hit_id)) AS url,
  arg_max(snippet, (list_no, position, hit_id)) FILTER (improves AND snippet <> '') AS snippet,
  array_to_string(list_transform(list_sort(list_transform(map_entries(map_from_entries(list_distinct(list(struct_pack(k := provider, v := list_no))))), lambda x: struct_pack(v := x.value, k := x.key))), lambda x: x.k), ',') AS providers,
  floor(sum(1 / (60 + position)) * 1e8 + 0.5) / 1e8 AS score
  FROM (SELECT *, coalesce(position < min(position) OVER (PARTITION BY query_no, url ORDER BY list_no, position, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improves FROM hits) GROUP BY query_no, url)"""
HOST = "regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)"
KEPT = "list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|msclkid)(=|$)'))"
CANON = f"regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len({KEPT}) > 0 THEN '?' || array_to_string(list_sort({KEPT}), '&') ELSE '' END"

def fanned_out(lists: dict[str, DataFrame | None], key: str) -> DataFrame:
    """The results of all providers; one that failed, given as None, is an empty list and a warning of its own."""
    found, failed = [df.withColumn("warning", F.lit(None).cast("string")) for df in lists.values() if df is not None], [p for p, df in lists.items() if df is None]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    notes = out.sparkSession.createDataFrame([(p, f"{p} failed") for p in failed], "provider string, warning string")
    return out.unionByName(notes, allowMissingColumns=True)


def with_filings(hits: DataFrame) -> DataFrame:
    """Results, and for each query that names a filing the address of the full-text search for it as one more."""
    asked = hits.where(F.trim("query").rlike("(?i)" + ascii_edges(FILINGS)))
    address = F.concat(F.lit("https://efts.sec.gov/LATEST/search-index?q="), F.replace(F.url_encode(F.trim("query")), F.lit("+"), F.lit("%20")))
    return hits.select("hit_id", "url").union(asked.select("hit_id", address))


register("st01_rrf_merge", "hits", fused, f"SELECT * FROM {FUSED}")
register("so01_rrf_order", "hits", lambda h: ranked(fused(h)).select("query_no", "rank", "key", "score"), f"SELECT * FROM (SELECT query_no, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, best, key)::INT AS rank, key, score FROM {FUSED}) WHERE rank <= 20")
register("st02_cross_query", "hits", lambda h: across_queries(fused(h)), f"SELECT key, floor(sum(score) * 1e6 + 0.5) / 1e6 AS score, arg_min(title, query_no) AS title, count(*) AS queries FROM {FUSED} GROUP BY key")
register("so02_authority_rank", "hits", lambda h: across_queries(fused(h)).withColumn("weighed", rounded(F.col("score") * authority(F.col("key")), 6)).orderBy(F.desc("weighed"), "key").limit(15).select("key", "weighed"), f"SELECT url AS key, floor(score * ({AUTH}) * 1e6 + 0.5) / 1e6 AS weighed FROM (SELECT key AS url, floor(sum(score) * 1e6 + 0.5) / 1e6 AS score FROM {FUSED} GROUP BY key) ORDER BY weighed DESC, key LIMIT 15")
register("fn03_authority", "hits", lambda h: h.select("hit_id", authority(F.col("url")).alias("weight")), f"SELECT hit_id, ({AUTH})::DOUBLE AS weight FROM hits")
register("fn01_canonical_url", "pages", lambda p: p.select("page_id", canonical_url(F.col("url")).alias("key")), f"SELECT page_id, {CANON} AS key FROM pages")
register("fn02_host", "pages", lambda p: p.select("page_id", bare_host(F.col("url")).alias("host")), f"SELECT page_id, regexp_replace(lower({HOST}), '^www\\.', '') AS host FROM pages")
register("pf01_domain_filter", "pages", lambda p: p.where(allowed(F.col("url"), ["example.com", "example.org"], ["spam-farm.example.org"])).select("page_id"), f"SELECT page_id FROM pages WHERE regexp_matches({HOST}, '(^|\\.)example\\.(com|org)$') AND NOT regexp_matches({HOST}, '(^|\\.)spam-farm\\.example\\.org$')")
register("pf02_scheme", "pages", lambda p: p.where(F.col("url").rlike("(?i)^https://")).select("page_id"), "SELECT page_id FROM pages WHERE lower(url[1:8]) = 'https://'")
register("pf03_assets", "pages", lambda p: p.where(~F.col("url").rlike(r"(?i)\.(pdf|png|jpe?g|gif|zip|html)(?:[?#]|$)")).select("page_id"), "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '(?i)\\.(pdf|png|jpe?g|gif|zip|html)([?#]|$)')")
register("pf21_unfetched", "hits", lambda h: unfetched(h.groupBy(F.col("url").alias("key")).agg(F.max("hit_id").alias("at")), h.where("hit_id % 6 = 0").select(F.col("url").alias("key")), h.where("hit_id % 7 = 3").select(F.col("url").alias("key")), 40), "SELECT url AS key, max(hit_id) AS at FROM hits WHERE url NOT IN (SELECT url FROM hits WHERE hit_id % 6 = 0 OR hit_id % 7 = 3) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
register("pf28_sec_intent", "hits", lambda h: with_filings(h.select("hit_id", "url", F.concat_ws(" ", "title", F.element_at(F.array(*map(F.lit, ["10-K", "10 q", "an 8K form", "sec  filing", "see www.sec.gov/x", "12-K", "s1x", "Edgar", "DEF 14A"])), (F.col("hit_id") % 9 + 1).cast("int"))).alias("query"))), "SELECT hit_id, url FROM hits UNION ALL SELECT hit_id, 'https://efts.sec.gov/LATEST/search-index?q=' || replace(title || ' ' || q, ' ', '%20') FROM (SELECT *, ['10-K', '10 q', 'an 8K form', 'sec  filing', 'see www.sec.gov/x', '12-K', 's1x', 'Edgar', 'DEF 14A'][hit_id % 9 + 1] AS q FROM hits) WHERE hit_id % 9 NOT IN (4, 5, 6) UNION ALL SELECT hit_id, 'https://efts.sec.gov/LATEST/search-index?q=' || replace(title, ' ', '%20') || '%20see%20www.sec.gov%2Fx' FROM hits WHERE hit_id % 9 = 4")
register("st03_exact_dedupe", "hits", lambda h: h.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("hit_id"))).where("r = 1").select("url", "hit_id"), "SELECT url, min(hit_id) AS hit_id FROM hits GROUP BY 1")
register("st08_query_key", "benchmark", lambda b: b.select("item_id", canonical_query(F.col("text")).alias("key")), "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))), ' ') AS key FROM benchmark")
register("st09_trail_key", "benchmark", lambda b: b.select("item_id", trail_key(F.concat("text", F.lit(" 2024 1999"))).alias("key")), "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text || ' 2024 1999'), '[\\p{L}\\p{N}]+'), lambda t: NOT regexp_full_match(t, '(19|20)[0-9]{2}')))), ' ') AS key FROM benchmark")
register("st12_url_extract", "hits", lambda h: h.select("hit_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.concat(F.lit("see "), "url", F.lit("), or ("), "url", F.lit("/x.")), F.lit(r"https?://[^\s)\]]+"), 0), lambda u: F.regexp_replace(u, r"[.,;:)]+$", "")))).alias("found")), "SELECT hit_id, url AS found FROM hits UNION ALL SELECT hit_id, url || '/x' FROM hits")
register("ss16_search_cache", "benchmark", lambda b: b.groupBy(F.md5(canonical_query(F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("again again "), F.lower("text"))))).alias("key")).agg(F.count("*").alias("asked"), (F.count("*") - 1).alias("from_cache")), "SELECT md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(CASE WHEN item_id % 3 = 0 THEN text ELSE 'again again ' || lower(text) END), '[\\p{L}\\p{N}]+'))), ' ')) AS key, count(*) AS asked, count(*) - 1 AS from_cache FROM benchmark GROUP BY 1")
register("xs04_fan_out", "hits", lambda h: fanned_out({p: h.where(F.col("provider") == p) for p in ("p0", "p1", "p2")} | {"p3": None}, "hit_id").groupBy("provider", "warning").agg(F.count("hit_id").alias("n")), "SELECT provider, NULL AS warning, count(*) AS n FROM hits GROUP BY 1 UNION ALL SELECT 'p3', 'p3 failed', 0")
register("ss15_reservation", "hits", lambda h: h.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("hit_id"))).where("r = 1").orderBy("hit_id").limit(50).select("url", "hit_id"), "SELECT url, min(hit_id) AS hit_id FROM hits GROUP BY 1 ORDER BY 2 LIMIT 50")
register("so11_bounded_list", "hits", lambda h: h.withColumn("r", F.row_number().over(Window.partitionBy("query_no").orderBy("hit_id"))).groupBy("query_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("hit_id")))), lambda x: x.cast("string")), ",").alias("shown"), F.count_if(F.col("r") > 5).alias("more")), "SELECT query_no, string_agg(hit_id::VARCHAR, ',' ORDER BY hit_id) FILTER (r <= 5) AS shown, count(*) FILTER (r > 5) AS more FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY hit_id) AS r FROM hits) GROUP BY 1")
register("sc19_fallback_chain", "hits", lambda h: h.withColumn("good", F.col("snippet") != "").withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("good"), F.desc("position"), "hit_id"))).where("r = 1").select("url", "hit_id", "good"), "SELECT url, hit_id, snippet <> '' AS good FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY (snippet <> '') DESC, position DESC, hit_id) AS r FROM hits) WHERE r = 1")
