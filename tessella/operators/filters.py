"""Page and transcript predicates: blocked pages, quality flags, address guards, event projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ERROR_TITLE, LISTING_TITLE, TRACE_EVENTS, ascii_edges
from ..functions.text import host
from ..plans.registry import register

# What challenge pages say, looked for in the first 4,000 characters.
BLOCK_MARKERS = ("just a moment", "verifying you are human", "checking your browser", "enable javascript and cookies", "access denied", "captcha", "pardon our interruption", "unusual traffic from your computer network")
BLOCK_HEAD, BLOCK_EXEMPT, FATAL_CHARS, THIN_CHARS = 4_000, 2_000, 20, 300


def looks_blocked(text: Column, markers: tuple[str, ...] = BLOCK_MARKERS) -> Column:
    """Short pages that say what challenge pages say."""
    head = F.substring(F.lower(text), 1, BLOCK_HEAD)
    return (F.length(text) < BLOCK_EXEMPT) & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(head, m))


def quality_flags(text: Column, title: Column, http_error: Column, markers: tuple[str, ...] = BLOCK_MARKERS) -> Column:
    n = F.length(F.trim(text))
    flag = lambda name, when: F.when(when, name)
    fatal = n < FATAL_CHARS
    return F.array_compact(F.array(
        flag("blocked_or_challenge", looks_blocked(F.concat_ws("\n", title, F.trim(text)), markers)), flag("fatal", fatal),
        flag("error_page", ~fatal & title.rlike("(?i)" + ascii_edges(ERROR_TITLE)) & ((n < 500) | http_error)), flag("thin_content", ~fatal & (n < THIN_CHARS)), flag("search_listing_page", ~fatal & title.rlike("(?i)" + ascii_edges(LISTING_TITLE))),
    ))


def blocked_or_thin(flags: Column) -> Column:
    """Pages that gave nothing: flagged as blocked, fatal or thin. A listing page isn't one of them."""
    return F.exists(flags, lambda f: f.isin("blocked_or_challenge", "fatal", "thin_content"))


def private_v4(address: Column) -> Column:
    """Dotted addresses that aren't public: this network, private, shared, loopback, link-local, test nets, multicast and beyond."""
    a, b, c = (F.try_element_at(F.split(address, r"\."), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    part = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    # sorted, so that equal characters are one run: what a character adds is known when its run ends
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (a["sum"] + part(a["run"])).alias("sum")))
    n = F.size(letters).cast("double")
    return F.when(n > 0, F.aggregate(letters, start, step, lambda a: F.log2(n) - (a["sum"] + part(a["run"])) / n)).otherwise(0.0)


def suspicious_query(urls: DataFrame, key: str, url: str, least: int = 64, bits: float = 4.6) -> DataFrame:
    """URLs that are the first of their host and carry a long query of high entropy."""
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    first = F.row_number().over(Window.partitionBy(host(F.col(url))).orderBy(key)) == 1
    return urls.withColumn("first", first).where("first").withColumn("bits", entropy(query)).where((F.length(query) >= least) & (F.col("bits") >= bits))


def url_guard(url: Column) -> Column:
    h = host(url)
    return F.when(F.length(url) > 2048, "too-long").when(~url.rlike("(?i)^https?://"), "scheme").when(url.rlike(r"(?i)^https?://[^/?#]*@"), "credentials").when((h == "localhost") | h.rlike(r"\.(local|internal|localhost)$"), "local-name").when(h.rlike(r"^\d+\.\d+\.\d+\.\d+$") & private_v4(h), "ssrf").otherwise("ok")


def grep(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, match) of every occurrence, numbered within its document."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("n", "match"))


def keep_last(steps: DataFrame, k: int) -> DataFrame:
    """The text of each conversation's last k steps, a stub for the earlier ones."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return steps.withColumn("back", back).select("conv_id", "turn", F.when(F.col("back") > k, F.concat(F.lit("[cleared "), F.length("text").cast("string"), F.lit(" chars]"))).otherwise(F.md5("text")).alias("shown"))


def traced(events: DataFrame) -> DataFrame:
    """(run_id, seq, event, error): a run's events as its trace names them, and what failed; those without a name are left out."""
    names = F.create_map(*[F.lit(x) for pair in TRACE_EVENTS.items() if pair[1] for x in pair])
    some = events.withColumn("event", F.try_element_at(names, F.col("type"))).where("event IS NOT NULL")
    return some.select("run_id", "seq", "event", F.when(F.col("type").isin("source.failed", "run.error"), F.col("message")).alias("error"))


LIKE = ("the the", "ofthe", "tion the")
ADDRESS = "concat((page_id * 7 % 256)::VARCHAR, '.', (page_id * 11 % 256)::VARCHAR, '.', (page_id % 4)::VARCHAR, '.1')"
V4 = "(a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))"


def _address(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.concat_ws(".", F.col("page_id") * 7 % 256, F.col("page_id") * 11 % 256, F.col("page_id") % 4, F.lit("1")).alias("ip"))


register("pf05_private_v4", "pages", lambda p: _address(p).select("page_id", private_v4(F.col("ip")).alias("private")), f"SELECT page_id, {V4} AS private FROM (SELECT page_id, page_id * 7 % 256 AS a, page_id * 11 % 256 AS b, page_id % 4 AS c FROM pages)")
register("pf04_url_guard", "pages", lambda p: p.select("page_id", url_guard(F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("http://10.0.0."), F.col("page_id").cast("string"), F.lit("/x"))).when(F.col("page_id") % 11 == 0, F.lit("ftp://a/b")).when(F.col("page_id") % 13 == 0, F.lit("https://u:p@a.com/")).otherwise(F.col("url"))).alias("verdict")), "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'ssrf' WHEN page_id % 11 = 0 THEN 'scheme' WHEN page_id % 13 = 0 THEN 'credentials' ELSE 'ok' END AS verdict FROM pages")
register("pf06_entropy_guard", "pages", lambda p: suspicious_query(p.select("page_id", F.concat(F.lit("https://h"), F.col("page_id") % 50, F.lit(".com/?q="), F.when(F.col("page_id") % 2 == 0, F.base64(F.unhex(F.sha2("url", 384)))).otherwise(F.repeat(F.lit("ab"), 40))).alias("url")), "page_id", "url").select("page_id"), "SELECT min(page_id) AS page_id FROM pages WHERE page_id % 50 % 2 = 0 GROUP BY page_id % 50")
register("fn08_entropy", "benchmark", lambda b: b.select("item_id", (F.floor(entropy(F.col("text")) * 1e6 + 0.5) / 1e6).alias("bits")), "SELECT item_id, floor(-sum(n / t * log2(n / t)) * 1e6 + 0.5) / 1e6 AS bits FROM (SELECT item_id, c, count(*) AS n, any_value(t) AS t FROM (SELECT item_id, unnest(string_split(text, '')) AS c, length(text) AS t FROM benchmark) WHERE c <> '' GROUP BY 1, 2) GROUP BY 1")
register("pf07_blocked", "documents", lambda d: d.select("doc_id", looks_blocked(F.concat("text", F.element_at(F.array(*map(F.lit, ["", " Just a MOMENT...", " Access denied", " solve the CAPTCHA", " moment"])), (F.col("doc_id") % 5 + 1).cast("int")))).alias("blocked")), "SELECT doc_id, length(t) < 2000 AND (contains(lower(t)[1:4000], 'just a moment') OR contains(lower(t)[1:4000], 'access denied') OR contains(lower(t)[1:4000], 'captcha')) AS blocked FROM (SELECT doc_id, text || ['', ' Just a MOMENT...', ' Access denied', ' solve the CAPTCHA', ' moment'][doc_id % 5 + 1] AS t FROM documents)")
register("pf08_quality", "documents", lambda d: d.select("doc_id", F.array_join(quality_flags(F.col("text"), F.concat(F.substring("text", 1, 10), F.when(F.col("doc_id") % 9 == 0, " 404 page").when(F.col("doc_id") % 10 == 0, " Search results").otherwise("")), F.col("doc_id") % 2 == 0, LIKE), ",").alias("flags")), """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(title || chr(10) || t) < 2000 AND (contains(lower(title || chr(10) || t), 'the the') OR contains(lower(title || chr(10) || t), 'ofthe') OR contains(lower(title || chr(10) || t), 'tion the')) THEN 'blocked_or_challenge' END,
  CASE WHEN length(t) < 20 THEN 'fatal' END, CASE WHEN length(t) >= 20 AND doc_id % 9 = 0 AND (length(t) < 500 OR doc_id % 2 = 0) THEN 'error_page' END, CASE WHEN length(t) >= 20 AND length(t) < 300 THEN 'thin_content' END, CASE WHEN length(t) >= 20 AND doc_id % 10 = 0 AND doc_id % 9 <> 0 THEN 'search_listing_page' END], lambda x: x IS NOT NULL), ',') AS flags
  FROM (SELECT doc_id, trim(text, ' ') AS t, text[1:10] || CASE WHEN doc_id % 9 = 0 THEN ' 404 page' WHEN doc_id % 10 = 0 THEN ' Search results' ELSE '' END AS title FROM documents)""")
register("pf10_blocked_or_thin", "documents", lambda d: d.where(blocked_or_thin(quality_flags(F.col("text"), F.when(F.col("doc_id") % 10 == 0, "Search results").when(F.col("doc_id") % 7 == 0, "Just a moment").otherwise(""), F.lit(False)))).select("doc_id"), "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) < 300 OR doc_id % 10 <> 0 AND doc_id % 7 = 0 AND length('Just a moment' || chr(10) || trim(text, ' ')) < 2000")
register("pf14_transcript_slice", "conversations", lambda c: c.where((F.col("role") == "user") & F.col("turn").between(0, 4) & F.col("text").rlike("(?i)the")).orderBy("conv_id", "turn").limit(40).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn BETWEEN 0 AND 4 AND regexp_matches(text, '(?i)the') ORDER BY conv_id, turn LIMIT 40")
register("pf15_trace_grep", "journal", lambda j: j.where(F.col("data").rlike('"k": 6[0-9]')).select("run_id", "seq"), "SELECT run_id, seq FROM journal WHERE regexp_matches(data, '\"k\": 6[0-9]')")
register("pf18_source_lookup", "documents", lambda d: d.where((F.col("doc_id") == 17) | (F.col("source") == "src3")).select("doc_id", "n_chars", (F.col("n_chars") < 500).alias("blocked")), "SELECT doc_id, n_chars, n_chars < 500 AS blocked FROM documents WHERE doc_id = 17 OR source = 'src3'")
register("pf19_event_projection", "journal", lambda j: traced(j.select("run_id", "seq", F.element_at(F.array(*map(F.lit, TRACE_EVENTS)), (F.col("seq") % len(TRACE_EVENTS) + 1).cast("int")).alias("type"), F.concat(F.lit("m"), F.col("seq") % 7).alias("message"))), f"SELECT run_id, seq, name AS event, CASE WHEN type IN ('source.failed', 'run.error') THEN 'm' || (seq % 7) END AS error FROM (SELECT run_id, seq, {list(TRACE_EVENTS)}[seq % {len(TRACE_EVENTS)} + 1] AS type FROM journal) JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in TRACE_EVENTS.items() if v)}) v(type, name) USING (type)")
register("pf20_progress", "journal", lambda j: j.where("kind = 'event'").select("run_id", "seq", F.format_string("%s #%d (%d c)", "type", "seq", "cents").alias("line")), "SELECT run_id, seq, printf('%s #%d (%d c)', type, seq, cents) AS line FROM journal WHERE kind = 'event'")
register("pf22_unjournaled", "journal", lambda j: j.where(~F.col("type").isin("report.delta", "report.reset")).groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM journal WHERE type NOT IN ('report.delta', 'report.reset') GROUP BY 1")
register("pf23_case_aliases", "journal", lambda j: j.select("seq", F.coalesce(F.nullif(F.trim(F.get_json_object("data", "$.question")), F.lit("")), F.get_json_object("data", "$.k"), F.lit("none")).alias("problem")), "SELECT seq, coalesce(nullif(trim(data->>'$.question'), ''), data->>'$.k', 'none') AS problem FROM journal")
register("pf26_source_records", "documents", lambda d: d.where("n_chars > 3000").select(F.concat(F.lit("source_"), "doc_id").alias("id"), F.col("n_chars").alias("chars"), "lang"), "SELECT 'source_' || doc_id AS id, n_chars AS chars, lang FROM documents WHERE n_chars > 3000")
register("wn06_call_ordinal", "journal", lambda j: j.where("call_key IS NOT NULL").select("run_id", "call_key", "seq", (F.row_number().over(Window.partitionBy("run_id", "call_key").orderBy("seq")) - 1).alias("k")), "SELECT run_id, call_key, seq, (row_number() OVER (PARTITION BY run_id, call_key ORDER BY seq) - 1)::INT AS k FROM journal WHERE call_key IS NOT NULL")
register("wn07_keep_last", "conversations", lambda c: keep_last(c, 4), "SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 4 THEN '[cleared ' || length(text) || ' chars]' ELSE md5(text) END AS shown FROM conversations")
register("ud05_grep", "documents", lambda d: grep(d, "[Tt]hat[a-z]*").select("doc_id", "n", "match"), "SELECT doc_id, (unnest(range(len(m))))::INT AS n, unnest(m) AS match FROM (SELECT doc_id, regexp_extract_all(text, '[Tt]hat[a-z]*') AS m FROM documents)")
register("xs08_query_explode", "journal", lambda j: j.select("seq", F.explode(F.concat(F.array(F.concat(F.lit("q"), F.get_json_object("data", "$.k"))), F.array("type"))).alias("query")), "SELECT seq, unnest(['q' || (data->>'$.k'), type]) AS query FROM journal")
register("xs12_attempt_status", "documents", lambda d: d.select("doc_id", F.when(F.length("text") < 100, "thin").when(looks_blocked(F.col("text"), LIKE), "blocked").otherwise("ok").alias("status")), "SELECT doc_id, CASE WHEN length(text) < 100 THEN 'thin' WHEN length(text) < 2000 AND (contains(lower(text)[1:4000], 'the the') OR contains(lower(text)[1:4000], 'ofthe') OR contains(lower(text)[1:4000], 'tion the')) THEN 'blocked' ELSE 'ok' END AS status FROM documents")
register("xs14_body_cap", "pages", lambda p: p.where(F.octet_length("html") <= 5_000).select("page_id", F.octet_length("html").cast("long").alias("bytes")), "SELECT page_id, strlen(html) AS bytes FROM pages WHERE strlen(html) <= 5000")
register("xs21_repeat_reads", "journal", lambda j: j.where("call_key IS NOT NULL").withColumn("reads", F.count("*").over(Window.partitionBy("call_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).where("reads >= 3").select("call_key", "seq", "reads"), "SELECT call_key, seq, reads FROM (SELECT *, count(*) OVER (PARTITION BY call_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS reads FROM journal WHERE call_key IS NOT NULL) WHERE reads >= 3")
