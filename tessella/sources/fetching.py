"""Fetching pages and searching the web: the rules, over whatever brings the answers.

What goes to the network is a function given by the caller, ``get(url) -> (status, headers, body)``; recorded answers serve where there
is none. URLs are dealt by host, so that a host sees one request at a time and its robots file once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import markdown
from ..functions.pages import is_private, mapped, robots_allowed
from ..functions.text import host
from ..operators.filters import looks_blocked
from ..plans.registry import register

Get = Callable[[str], tuple[int, dict[str, str], bytes]]
# Hops of redirection, bytes of a body by kind, results a provider gives at most.
HOPS, HTML_BYTES, PDF_BYTES = 5, 5 * 1024 * 1024, 25 * 1024 * 1024
MOST_RESULTS = {"tavily": 20, "exa": 100, "brave": 20}
DEFAULT_RESULTS, SNIPPET_CHARS = 8, 500
AGENT = "tessella"


def refused(url: str) -> str | None:
    """Why a URL is not fetched, if it isn't: its scheme, credentials, length or an address that isn't public."""
    try:
        parts = urlsplit(url)
        name = parts.hostname or ""
    except ValueError:
        return "invalid"
    if parts.scheme not in ("http", "https") or not name:
        return "scheme"
    if len(url) > 2048:
        return "too long"
    if parts.username or parts.password:
        return "credentials"
    if name == "localhost" or name.endswith((".localhost", ".local", ".internal")):
        return "local name"
    try:
        return "private address" if is_private(name) else None
    except ValueError:
        return None  # a name, not an address


class Fetcher:
    """Fetches of one task: robots files by host, redirects by hand, bodies within their bounds."""

    def __init__(self, get: Get, agent: str = AGENT):
        self.get, self.agent, self.robots = get, agent, {}

    def allowed(self, url: str) -> bool:
        parts = urlsplit(url)
        site = f"{parts.scheme}://{parts.netloc}"
        if site not in self.robots:
            try:
                status, _, body = self.get(f"{site}/robots.txt")
                self.robots[site] = body.decode("utf-8", "replace") if status == 200 else ""
            except OSError:
                self.robots[site] = ""
        return robots_allowed(self.robots[site], self.agent, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))

    def __call__(self, url: str) -> tuple[str, str, str | None]:
        """(last url, outcome, text): outcome is the kind of the body or a code of what went wrong."""
        if refused(url):
            return url, "blocked_url", None
        for hop in range(HOPS + 1):
            if not self.allowed(url):
                return url, "robots_disallowed", None
            try:
                status, headers, body = self.get(url)
            except OSError:
                return url, "network_error", None
            headers = {k.lower(): v for k, v in headers.items()}
            if not (300 <= status < 400 and headers.get("location")):
                return url, *self._body(status, headers, body, url)
            if hop == HOPS:
                break
            try:
                onward = urljoin(url, headers["location"])
                urlsplit(onward)
            except ValueError:
                return url, "bad_redirect", None
            if refused(onward):
                return url, "blocked_redirect", None
            url = onward
        return url, "too_many_redirects", None

    @staticmethod
    def _body(status: int, headers: dict[str, str], body: bytes, url: str) -> tuple[str, str | None]:
        if not 200 <= status < 300:
            return "http_error", None
        kind = headers.get("content-type", "").lower()
        pdf = urlsplit(url).path.lower().endswith(".pdf") or "pdf" in kind
        said = headers.get("content-length", "")
        if max(int(said) if said.isdigit() else 0, len(body)) > (PDF_BYTES if pdf else HTML_BYTES):
            return "too_large", None
        if body.startswith(b"%PDF-") or "pdf" in kind:
            return "pdf", None
        if "html" in kind:
            return "html", body.decode("utf-8", "replace")
        textual = any(x in kind for x in ("text/", "json", "xml")) or not kind and b"\0" not in body
        return ("text", body.decode("utf-8", "replace")) if textual else ("unsupported_content_type", None)


def fetched_pages(urls: DataFrame, get: Get, key: str = "page_id", url: str = "url", parts: int = 16) -> DataFrame:
    """(key, final_url, outcome, text) of each row of ``urls``; those of a host follow each other in one task. A null url is refused."""
    dealt = urls.select(key, F.coalesce(F.col(url), F.lit("")).alias("url")).withColumn("__host", host(F.col("url"))).repartition(parts, "__host").sortWithinPartitions("__host", "url", key)
    kind = dict(urls.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = Fetcher(get)
        for batch in batches:
            yield pd.DataFrame([(k, *fetcher(u)) for k, u in zip(batch[key], batch["url"], strict=True)], columns=[key, "final_url", "outcome", "text"])

    return dealt.select(key, "url").mapInPandas(run, f"{key} {kind}, final_url string, outcome string, text string")


def result_limit(provider: str, wanted: int | None) -> int:
    return min(max(1, int(DEFAULT_RESULTS if wanted is None else wanted)), MOST_RESULTS[provider])


def search_request(provider: str, query: Column, wanted: int | None = None) -> Column:
    """What is sent to a search provider, as a struct of method, url and body; keys of access are headers and not of it."""
    n = result_limit(provider, wanted)
    if provider == "tavily":
        return F.struct(F.lit("POST").alias("method"), F.lit("https://api.tavily.com/search").alias("url"), F.to_json(F.struct(query.alias("query"), F.lit(n).alias("max_results"))).alias("body"))
    if provider == "exa":
        contents = F.struct(F.struct(F.lit(3).alias("numSentences"), F.lit(2).alias("highlightsPerUrl")).alias("highlights"))
        return F.struct(F.lit("POST").alias("method"), F.lit("https://api.exa.ai/search").alias("url"), F.to_json(F.struct(query.alias("query"), F.lit(n).alias("numResults"), contents.alias("contents"))).alias("body"))
    url = F.concat(F.lit("https://api.search.brave.com/res/v1/web/search?q="), F.url_encode(query), F.lit(f"&count={n}&extra_snippets=true"))
    return F.struct(F.lit("GET").alias("method"), url.alias("url"), F.lit(None).cast("string").alias("body"))


ANSWERS = {
    "tavily": "struct<results: array<struct<url: string, title: string, content: string>>>",
    "exa": "struct<results: array<struct<url: string, title: string, text: string, highlights: array<string>>>>",
    "brave": "struct<web: struct<results: array<struct<url: string, title: string, description: string, extra_snippets: array<string>>>>>",
}


def search_results(answers: DataFrame, provider: str, key: str, body: str) -> DataFrame:
    """(key, position, url, title, snippet) from the JSON bodies that a provider answered; rows without a web address are left out and don't count."""
    read = F.from_json(body, ANSWERS[provider])
    rows = F.coalesce(read["web"]["results"] if provider == "brave" else read["results"], F.array().cast(f"array<{_row(provider)}>"))
    good = F.filter(rows, lambda r: F.coalesce(r["url"].rlike("(?i)^https?://"), F.lit(False)))
    some = answers.select(key, F.posexplode(good).alias("at", "r"))
    r, joined = F.col("r"), lambda x: F.coalesce(F.array_join(x, " … "), F.lit(""))
    cut = lambda x: F.coalesce(F.trim(F.substring(x, 1, SNIPPET_CHARS)), F.lit(""))
    snippet = {"tavily": lambda: cut(r["content"]), "exa": lambda: F.coalesce(F.nullif(F.trim(joined(r["highlights"])), F.lit("")), cut(r["text"])), "brave": lambda: F.trim(F.coalesce(F.nullif(r["description"], F.lit("")), joined(r["extra_snippets"])))}[provider]()
    title = F.coalesce(F.nullif(F.trim(r["title"]), F.lit("")), r["url"])
    return some.select(key, (F.col("at") + 1).alias("position"), r["url"].alias("url"), title.alias("title"), snippet.alias("snippet"))


def _row(provider: str) -> str:
    inner = ANSWERS[provider]
    return inner[inner.index("array<") + 6 : -3 if provider == "brave" else -2]


# Addresses and parameters of the searches by field; {q} is the query, {n} the number of results.
DOMAINS = {
    "arxiv": ("https://export.arxiv.org/api/query", {"search_query": "all:{q}", "start": "0", "max_results": "{n}", "sortBy": "relevance", "sortOrder": "descending"}),
    "openalex": ("https://api.openalex.org/works", {"search": "{q}", "per_page": "{n}"}),
    "edgar": ("https://efts.sec.gov/LATEST/search-index", {"q": "{q}"}),
    "clinicaltrials": ("https://clinicaltrials.gov/api/v2/studies", {"query.term": "{q}", "pageSize": "{n}", "format": "json"}),
    "semantic_scholar": ("https://api.semanticscholar.org/graph/v1/paper/search", {"query": "{q}", "limit": "{n}", "fields": "title,abstract,authors,year,venue,citationCount,tldr,externalIds,url"}),
    "wikipedia": ("https://en.wikipedia.org/w/api.php", {"action": "query", "generator": "search", "gsrsearch": "{q}", "gsrlimit": "{n}", "prop": "extracts", "exintro": "1", "explaintext": "1", "format": "json", "formatversion": "2"}),
}
SCRAPE_CHARS, CONTENTS_CHARS = 100, 200


def domain_request(source: str, query: Column, n: int = 5, **more: str) -> Column:
    """The address of a search by field; null for an empty query. ``more``: parameters beside the usual ones, such as a sort or a mail address."""
    base, params = DOMAINS[source]
    parts: list[Column] = []
    for k, (name, value) in enumerate([*params.items(), *more.items()]):
        before, _, after = value.partition("{q}")
        shown = F.concat(F.lit(before), F.trim(query), F.lit(after)) if "{q}" in value else F.lit(value.replace("{n}", str(n)))
        parts += [F.lit(f"{'&' if k else '?'}{name}="), F.url_encode(shown)]
    return F.when(F.trim(query) != "", F.concat(F.lit(base), *parts))


def scraped(answers: DataFrame, key: str, body: str, url: str) -> DataFrame:
    """(key, outcome, final_url, text) from the JSON bodies of a scraping service: the page's HTML as markdown if that has text enough and
    isn't a challenge, else the service's own markdown under the same conditions."""
    read = F.from_json(body, "struct<content: struct<html: string, markdown: string>, metadata: struct<statusCode: int, canonical: string>>")
    some = answers.select(key, F.coalesce(read["metadata"]["statusCode"], F.lit(0)).alias("status"), F.coalesce(F.nullif(read["metadata"]["canonical"], F.lit("")), F.col(url)).alias("final_url"), F.coalesce(read["content"]["html"], F.lit("")).alias("html"), F.coalesce(F.trim(read["content"]["markdown"]), F.lit("")).alias("own"))
    kind = dict(answers.dtypes)[key]
    texts = mapped(some.where("html <> '' AND status < 400").select(key, "html", "final_url"), f"{key} {kind}, made string", lambda k, h, u: (k, markdown(h, u)[0]))
    good = lambda t: (F.length(t) >= SCRAPE_CHARS) & ~looks_blocked(t)
    both = some.join(texts, key, "left")
    outcome = F.when(F.col("status") >= 400, "http_error").when(F.coalesce(good(F.col("made")) & ~looks_blocked(F.col("html")), F.lit(False)), "html").when(good(F.col("own")), "markdown").otherwise("no_content")
    return both.select(key, outcome.alias("outcome"), "final_url", F.when(outcome == "html", F.col("made")).when(outcome == "markdown", F.col("own")).alias("text"))


def contents(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, outcome, text) from the JSON bodies of a contents service: its first result, unless that is a challenge or too thin."""
    text = F.coalesce(F.trim(F.try_element_at(F.from_json(body, "struct<results: array<struct<title: string, text: string, url: string>>>")["results"], F.lit(1))["text"]), F.lit(""))
    outcome = F.when(F.col("status") >= 300, "http_error").when(looks_blocked(F.col("text")), "blocked_or_challenge").when(F.length("text") < CONTENTS_CHARS, "thin_content").otherwise("ok")
    return answers.select(key, "status", text.alias("text")).select(key, outcome.alias("outcome"), F.when(outcome == "ok", F.col("text")).alias("text"))


def providers_for(keys: dict[str, str | None], source: str = "web", own: dict[str, list[str]] | None = None) -> list[str]:
    """Which providers a search goes to: those of its source if it has any, else all whose key is there, else the model's own search."""
    if own and own.get(source):
        return own[source]
    return [p for p in MOST_RESULTS if keys.get(p)] or ["native"]


def recorded_web(url: str) -> tuple[int, dict[str, str], bytes]:
    """A small web for runs without a network: what a path says decides the answer."""
    path = urlsplit(url).path
    if path == "/robots.txt":
        return 200, {"Content-Type": "text/plain"}, b"User-agent: *\nDisallow: /private\n"
    name, _, rest = path.strip("/").partition("/")
    if name.startswith("r") and name[1:].isdigit():
        return 302, {"Location": f"/r{int(name[1:]) - 1}/{rest}" if name != "r0" else f"/page/{rest}"}, b""
    answers = {
        "page": (200, {"Content-Type": "text/html; charset=utf-8"}, f"<p>{rest}</p>".encode()), "data": (200, {"Content-Type": "application/json"}, b"{}"), "bare": (200, {}, b"just text"),
        "inward": (301, {"Location": "http://127.0.0.1/x"}, b""), "large": (200, {"Content-Type": "text/html", "Content-Length": str(HTML_BYTES + 1)}, b"x"), "image": (200, {"Content-Type": "image/png"}, b"\0"),
        "file.pdf": (200, {"Content-Type": "application/pdf", "Content-Length": str(HTML_BYTES + 1)}, b"%PDF-1"),
    }
    if name == "down":
        raise ConnectionError("down")
    return answers.get(name, (404, {}, b""))


PLACES = ["/page/x", "/r3/y", "/r9/z", "/private/a", "/inward", "/large", "/gone", "/image", "/file.pdf", "/data", "/bare", "/down"]
OUTCOMES = ["html", "html", "too_many_redirects", "robots_disallowed", "blocked_redirect", "too_large", "http_error", "unsupported_content_type", "pdf", "text", "text", "network_error"]


def _asked(p: DataFrame) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("page_id") % len(PLACES) + 1).cast("int"))
    at = F.when(F.col("page_id") % 25 == 24, F.lit("http://192.168.0.1/page/x")).otherwise(F.concat(F.lit("https://site"), F.col("page_id") % 7, F.lit(".example.com"), place))
    return p.select("page_id", at.alias("url"))


def _answers(h: DataFrame, provider: str) -> DataFrame:
    """What a provider would have answered to each query, from the table of hits."""
    url, title = F.when(F.col("hit_id") % 10 == 9, F.lit("ftp://x")).otherwise(F.col("url")).alias("url"), F.when(F.col("hit_id") % 6 == 5, F.lit(" ")).otherwise(F.col("title")).alias("title")
    text, none = F.nullif(F.col("snippet"), F.lit("")), F.array().cast("array<string>")
    more = {"tavily": [text.alias("content")], "exa": [F.concat(F.lit("text "), "title").alias("text"), F.when(text.isNotNull(), F.array(text, F.lit("more"))).otherwise(none).alias("highlights")], "brave": [text.alias("description"), F.array(F.lit("a"), F.lit("b")).alias("extra_snippets")]}[provider]
    rows = h.groupBy("query_no").agg(F.array_sort(F.collect_list(F.struct("hit_id", url, title, *more))).alias("results"))
    body = F.struct(F.struct("results").alias("web")) if provider == "brave" else F.struct("results")
    return rows.select("query_no", F.to_json(body).alias("body"))


def _all_results(h: DataFrame) -> DataFrame:
    parts = [search_results(_answers(h, p), p, "query_no", "body").withColumn("provider", F.lit(p)) for p in MOST_RESULTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SNIPPETS = {"tavily": "snippet", "exa": "CASE WHEN snippet <> '' THEN snippet || ' … more' ELSE 'text ' || title END", "brave": "CASE WHEN snippet <> '' THEN snippet ELSE 'a … b' END"}
RESULTS = " UNION ALL ".join(f"SELECT query_no, (row_number() OVER (PARTITION BY query_no ORDER BY hit_id))::INT AS position, url, CASE WHEN hit_id % 6 = 5 THEN url ELSE title END AS title, {s} AS snippet, '{p}' AS provider FROM hits WHERE hit_id % 10 <> 9" for p, s in SNIPPETS.items())

register("sc17_fetch_rules", "pages", lambda p: fetched_pages(_asked(p), recorded_web).select("page_id", "outcome"), f"SELECT page_id, CASE WHEN page_id % 25 = 24 THEN 'blocked_url' ELSE {OUTCOMES}[page_id % {len(PLACES)} + 1] END AS outcome FROM pages")
register("sc22_search_results", "hits", _all_results, RESULTS)
register("xs34_search_requests", "benchmark", lambda b: b.select("item_id", search_request("tavily", F.concat(F.lit("q"), "item_id"), 50)["body"].alias("tavily"), search_request("brave", F.concat(F.lit("a b&"), "item_id"))["url"].alias("brave")), "SELECT item_id, '{\"query\":\"q' || item_id || '\",\"max_results\":20}' AS tavily, 'https://api.search.brave.com/res/v1/web/search?q=a+b%26' || item_id || '&count=8&extra_snippets=true' AS brave FROM benchmark")
register("xs34_domain_requests", "benchmark", lambda b: b.select("item_id", *[domain_request(s, F.concat(F.lit(" a:b & "), F.col("item_id").cast("string"), F.lit(" "))).alias(s) for s in DOMAINS]), "SELECT item_id, " + ", ".join("'" + base + "?" + "&".join(f"{k}={quote_plus(v.replace('{n}', '5'), safe='*{}').replace('{q}', chr(39) + ' || q || ' + chr(39))}" for k, v in params.items()) + f"' AS {name}" for name, (base, params) in DOMAINS.items()) + " FROM (SELECT item_id, 'a%3Ab+%26+' || item_id AS q FROM benchmark)")
register("sc20_scraped", "documents", lambda d: scraped(d.select("doc_id", F.lit("https://h.example/x").alias("url"), F.to_json(F.struct(F.struct(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<p>"), F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("word "), 30)).otherwise("few"), F.lit("</p>"))).alias("html"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.when(F.col("doc_id") % 7 == 0, "Access denied ").otherwise(""), F.repeat(F.lit("own "), 40))).alias("markdown")).alias("content"), F.struct(F.when(F.col("doc_id") % 11 == 0, 404).alias("statusCode"), F.when(F.col("doc_id") % 4 == 0, "https://c.example/").alias("canonical")).alias("metadata"))).alias("body")), "doc_id", "body", "url").select("doc_id", "outcome", "final_url"), "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'http_error' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'html' WHEN doc_id % 5 > 0 AND doc_id % 7 > 0 THEN 'markdown' ELSE 'no_content' END AS outcome, CASE WHEN doc_id % 4 = 0 THEN 'https://c.example/' ELSE 'https://h.example/x' END AS final_url FROM documents")
register("sc21_contents", "documents", lambda d: contents(d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, 500).otherwise(200).alias("status"), F.to_json(F.struct(F.when(F.col("doc_id") % 4 > 0, F.array(F.struct(F.lit("t").alias("title"), F.concat(F.when(F.col("doc_id") % 5 == 0, "Just a moment ").otherwise(""), F.repeat(F.lit("text "), (F.col("doc_id") % 80).cast("int"))).alias("text")))).alias("results"))).alias("body")), "doc_id", "body").select("doc_id", "outcome"), "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'http_error' WHEN doc_id % 4 > 0 AND doc_id % 5 = 0 THEN 'blocked_or_challenge' WHEN doc_id % 4 = 0 OR length(trim(repeat('text ', (doc_id % 80)::INT), ' ')) < 200 THEN 'thin_content' ELSE 'ok' END AS outcome FROM documents")
