"""Small scalar functions: answers, identifiers, retries, envelopes, budget plans."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.registry import register, rounded
from .fixed import ARTICLES, FINAL_ANSWERS, LARGE_MODEL, SMALL_MODEL, STOPWORDS, TRANSIENT, ascii_edges

# Run envelopes by effort.
EFFORTS = {"fast": (0.5, 15, 200_000, 30, 600), "balanced": (2.5, 40, 1_000_000, 60, 1_200), "deep": (10.0, 100, 4_000_000, 100, 2_400), "max": (40.0, 250, 16_000_000, 150, 3_600)}


def _plain_letters() -> tuple[str, str, list[tuple[str, str]]]:
    """From the compatibility decomposition: characters and the one they come to without marks, marks (which go), and those that come to several."""
    one, several = {}, []
    for c in map(chr, range(0x80, 0x10000)):
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if to != c and len(to) == 1:
            one[c] = to
        elif 1 < len(to) <= 3 and to.isascii() and to.isalpha() and c <= "\ufb06":
            several.append((c, to))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(one) + marks, "".join(one.values()), several


FROM, TO, SEVERAL = _plain_letters()


def unaccented(text: Column) -> Column:
    """Lower case of the compatibility decomposition without its marks, of the characters that come to up to three ASCII letters."""
    out = F.translate(text, FROM, TO)
    for c, to in SEVERAL:
        if "\ufb00" <= c:  # ligatures; the rest are signs that hardly any answer has
            out = F.replace(out, F.lit(c), F.lit(to))
    return F.lower(out)


def normalized_answer(text: Column) -> Column:
    bare = F.regexp_replace(unaccented(text), ascii_edges(ARTICLES), " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def final_answer(text: Column) -> Column:
    """The first line that names the final, then the exact, then an answer."""
    found = [F.nullif(F.trim(F.regexp_extract(text, f"(?im){p}", 1)), F.lit("")) for p in FINAL_ANSWERS]
    return F.coalesce(*found)


def judged_field(text: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, f"(?im)^{name}:[ \\t]*(.*)$", 1)), F.lit(""))


def message_code(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "(?i)^([a-z_]+):", 1), F.lit("")), F.lit("unknown"))


def query_tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[\"']", " "), "(?i)" + ascii_edges(STOPWORDS), " ")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(bare, "[^a-z0-9 ]", " "), r"\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def title_of_id(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


def stop_reason(finished: Column, budget: Column, tokens: Column, timeout: Column) -> Column:
    return F.when(finished, "finished").when(budget, "budget").when(tokens, "tokens").when(timeout, "timeout").otherwise("completed")


def backoff_ms(attempt: Column, base: int = 500, cap: int = 30_000) -> Column:
    """Doubling delay up to a cap, before jitter."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt))


def trail_caps(sources: Column, fraction: Column) -> list[Column]:
    searches = F.greatest(F.lit(30), F.ceil(sources * fraction))
    return [searches.alias("max_searches"), F.greatest(F.lit(15), F.ceil(searches / 2)).alias("max_dead_ends")]


def budget_plan(budget: Column, max_tokens: Column, in_rate: Column, out_rate: Column, report: Column, single: Column) -> list[Column]:
    """What is left for gathering once planning and the draft are paid, and whether that is enough."""
    per_token = (0.85 * in_rate + 0.15 * out_rate) / 1_000_000
    effective = F.when(per_token > 0, F.least(max_tokens.cast("double"), F.floor(budget / per_token).cast("double"))).otherwise(max_tokens.cast("double"))
    draft = F.when(single, 8_000 + F.least(report, F.lit(2_000))).otherwise(48_000 + report)
    left = F.greatest(F.lit(0.0), effective - 2_000 - draft)
    return [draft.cast("long").alias("draft_reserve"), left.cast("long").alias("gather_ceiling"), (left >= F.when(single, 24_000).otherwise(60_000)).alias("feasible")]


def strong_anchors(text: Column) -> Column:
    """Figures worth checking: amounts, grouped numbers, decimals and percentages of three digits or more."""
    found = F.regexp_extract_all(text, F.lit(r"\$\s?\d[\d,]*(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+%?|\d[\d,]*%"), 0)
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"[\s$%]", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.length(F.regexp_replace(x, "[,.]", "")) >= 3))


def model_window(model: Column) -> list[Column]:
    """Tokens of a model's context by what its name says, and whether it is a small one."""
    small = F.coalesce(model.rlike(f"(?i){SMALL_MODEL}"), F.lit(False))
    return [F.when(small, 200_000).when(model.rlike(f"(?i){LARGE_MODEL}"), 1_000_000).otherwise(200_000).alias("window"), small.alias("small")]


register("fn09_quarantine", "benchmark", lambda b: b.select("item_id", F.md5(F.concat(F.lit("<<<page\n"), F.replace("text", F.lit("<<<"), F.lit("« ")), F.lit("\n>>>"))).alias("digest")), "SELECT item_id, md5('<<<page' || chr(10) || replace(text, '<<<', '« ') || chr(10) || '>>>') AS digest FROM benchmark")
register("fn11_anchors", "part", lambda p: p.select("p_partkey", F.array_join(strong_anchors(F.concat(F.lit("Cost $"), F.col("p_partkey"), F.lit(",000 at "), F.col("p_size"), F.lit("% or 12.5% of 1,234,567"))), "|").alias("anchors")), "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey >= 0 THEN p_partkey || ',000' END, CASE WHEN p_size >= 100 THEN p_size::VARCHAR END, '12.5', '1,234,567'], lambda x: x IS NOT NULL AND length(replace(replace(x, ',', ''), '.', '')) >= 3), '|') AS anchors FROM part")
register("fn15_normalized_answer", "benchmark", lambda b: b.select("item_id", normalized_answer(F.concat(F.lit("The Étude, an Ősi ﬁn ğş "), "text")).alias("answer")), "SELECT item_id, trim(regexp_replace(regexp_replace(strip_accents(lower('The Étude, an Ősi fin ğş ' || text)), '\\b(a|an|the)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS answer FROM benchmark")
register("fn16_final_answer", "benchmark", lambda b: b.select("item_id", final_answer(F.concat("text", F.lit("\n"), F.when(F.col("item_id") % 3 == 0, "**Final answer**: ").when(F.col("item_id") % 3 == 1, "## Answer: ").otherwise("says: "), F.translate("text", "\n", " "))).alias("answer")), "SELECT item_id, CASE WHEN item_id % 3 < 2 THEN trim(replace(text, chr(10), ' '), ' ') END AS answer FROM benchmark")
register("fn17_confidence", "benchmark", lambda b: b.select("item_id", F.regexp_extract(judged_field(F.concat(F.lit("correct: yes\nConfidence: about "), F.col("item_id") * 1.5, F.lit("%")), "confidence"), r"\d+(?:\.\d+)?", 0).cast("double").alias("confidence")), "SELECT item_id, item_id * 1.5::DOUBLE AS confidence FROM benchmark")
register("fn18_message_code", "events", lambda e: e.select("event_id", message_code(F.concat(F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(": "))).otherwise(F.lit("? ")), F.col("props"))).alias("code")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS code FROM events")
register("fn19_query_jaccard", "benchmark", lambda b: b.select("item_id", rounded(jaccard(query_tokens(F.col("text")), query_tokens(F.concat(F.lit("What of the plan "), F.reverse("text"), F.lit(" "), "text")))).alias("similarity")), r"SELECT item_id, floor(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) * 10000 + 0.5) / 10000 AS similarity FROM (SELECT item_id, list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\b(or|and|the|of|in|on|for|to|a|an|site)\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS a, list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower('What of the plan ' || reverse(text) || ' ' || text), '\b(or|and|the|of|in|on|for|to|a|an|site)\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS b FROM benchmark)")
def title_of_url(url: Column) -> Column:
    """The last part of a URL's path, decoded, else its host, else the URL."""
    last = F.try_element_at(F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda x: x != ""), F.lit(-1))
    name = F.try_url_decode(F.regexp_replace(last, r"\+", "%2B"))
    return F.coalesce(F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), F.coalesce(F.when(last.isNotNull() & name.isNull(), url), name, F.try_parse_url(url, F.lit("HOST")))), url)


register("fn20_url_titles", "pages", lambda p: p.select("page_id", title_of_url(F.col("url")).alias("title")), "SELECT page_id, coalesce(nullif(url_decode(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[^:]+://[^/]+/(?:.*/)?([^/]+)/*$', 1)), ''), regexp_extract(url, '^[^:]+://([^/?#]+)', 1)) AS title FROM pages")
register("fn20_titles", "grades", lambda g: g.select("section_id").distinct().select("section_id", title_of_id(F.col("section_id")).alias("title")), "SELECT DISTINCT section_id, array_to_string(list_transform(string_split(section_id, '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM grades")
register("fn24_call_key", "journal", lambda j: j.select("seq", F.left(F.sha2(F.regexp_replace("data", r"\s+", " "), 256), F.lit(40)).alias("key")), "SELECT seq, sha256(regexp_replace(data, '\\s+', ' ', 'g'))[1:40] AS key FROM journal")
register("fn25_stable_hash", "documents", lambda d: d.select("doc_id", F.sha2("text", 256).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")
register("fn26_transient", "events", lambda e: e.select("event_id", F.concat(F.when(F.col("event_id") % 4 == 0, "Rate limit hit ").when(F.col("event_id") % 4 == 1, "HTTP 503 ").otherwise("x5030 "), "event_type").rlike("(?i)" + ascii_edges(TRANSIENT)).alias("transient")), "SELECT event_id, event_id % 4 < 2 AS transient FROM events")
register("fn27_backoff", "events", lambda e: e.select("event_id", backoff_ms(F.col("event_id") % 9).alias("delay_ms")), "SELECT event_id, least(30000.0::DOUBLE, 500 * pow(2, event_id % 9)) AS delay_ms FROM events")
register("fn29_stop_reason", "events", lambda e: e.select("event_id", stop_reason(F.col("event_id") % 5 == 0, F.col("event_id") % 4 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0).alias("reason")), "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'finished' WHEN event_id % 4 = 0 THEN 'budget' WHEN event_id % 3 = 0 THEN 'tokens' WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'completed' END AS reason FROM events")
register("fn30_budget_plan", "events", lambda e: e.select("event_id", *budget_plan(F.col("value") / 20, 100_000 + F.col("event_id") * 37 % 900_000, F.lit(3.0), F.lit(15.0), 1_000 + F.col("event_id") % 9_000, F.col("event_id") % 3 == 0)), "SELECT event_id, draft AS draft_reserve, greatest(0, eff - 2000 - draft)::BIGINT AS gather_ceiling, greatest(0, eff - 2000 - draft) >= CASE WHEN single THEN 24000 ELSE 60000 END AS feasible FROM (SELECT event_id, event_id % 3 = 0 AS single, CASE WHEN event_id % 3 = 0 THEN 8000 + least(1000 + event_id % 9000, 2000) ELSE 48000 + 1000 + event_id % 9000 END::BIGINT AS draft, least((100000 + event_id * 37 % 900000)::DOUBLE, floor(value / 20 / ((0.85::DOUBLE * 3 + 0.15::DOUBLE * 15) / 1000000))) AS eff FROM events)")
register("fn31_efforts", "events", lambda e: e.select("event_id", F.element_at(F.array(*map(F.lit, EFFORTS)), (F.col("event_id") % 4 + 1).cast("int")).alias("effort")).join(F.broadcast(e.sparkSession.createDataFrame([(k, *v) for k, v in EFFORTS.items()], "effort string, usd double, sources int, tokens int, turns int, seconds int")), "effort").select("event_id", "effort", F.when(F.col("event_id") % 10 == 0, 5.0).otherwise(F.col("usd")).alias("usd"), "sources"), "SELECT event_id, e AS effort, CASE WHEN event_id % 10 = 0 THEN 5.0 ELSE u END::DOUBLE AS usd, s::INT AS sources FROM events JOIN (VALUES (0, 'fast', 0.5, 15), (1, 'balanced', 2.5, 40), (2, 'deep', 10, 100), (3, 'max', 40, 250)) t(i, e, u, s) ON event_id % 4 = i")
register("fn32_model_window", "usage", lambda u: u.select("id", *model_window(F.when(F.col("id") % 3 == 0, F.concat(F.lit("any-Opus-"), "model_id")).otherwise(F.col("model_id")))), "SELECT id, CASE WHEN regexp_matches(model_id, '(?i)mini|nano') THEN 200000 WHEN id % 3 = 0 AND model_id IS NOT NULL THEN 1000000 ELSE 200000 END::INT AS window, coalesce(regexp_matches(model_id, '(?i)mini|nano'), FALSE) AS small FROM usage")
register("fn33_trail_caps", "events", lambda e: e.select("event_id", *trail_caps(F.col("event_id") % 400, F.lit(0.5))), "SELECT event_id, greatest(30, ceil(event_id % 400 * 0.5))::BIGINT AS max_searches, greatest(15, ceil(greatest(30, ceil(event_id % 400 * 0.5)) / 2))::BIGINT AS max_dead_ends FROM events")
register("fn35_collapse", "benchmark", lambda b: b.select("item_id", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("digest"), F.greatest(F.lit(1), F.least(F.lit(25), F.col("item_id"))).alias("limit_")), "SELECT item_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest, greatest(1, least(25, item_id)) AS limit_ FROM benchmark")
register("fn37_json_or_null", "events", lambda e: e.select("event_id", F.try_variant_get(F.try_parse_json(F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))), "$.k", "bigint").alias("k")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
register("xs07_clamps", "events", lambda e: e.select("event_id", F.greatest(F.lit(1), F.least(F.lit(20), F.floor("value"))).alias("n")), "SELECT event_id, greatest(1, least(20, floor(value)))::BIGINT AS n FROM events")
register("xs38_timeout_clamp", "events", lambda e: e.select("event_id", F.least(F.lit(10_000), F.greatest(F.lit(1), F.col("event_id"))).alias("ms")), "SELECT event_id, least(10000, greatest(1, event_id)) AS ms FROM events")
register("xs41_revision", "pages", lambda p: p.select("page_id", F.regexp_extract("url", r"/(\w\w)/(\d+)", 2).alias("revision")), "SELECT page_id, regexp_extract(url, '/(\\w\\w)/(\\d+)', 2) AS revision FROM pages")
