"""Operators on small literal inputs and on random ones against plain loops."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import markdown, pages, retries
from tessella.functions.scalars import final_answer, normalized_answer, strong_anchors
from tessella.functions.text import canonical_query, canonical_url, query_terms, trail_key, window_starts
from tessella.operators import evals, filters, ledger, metering, retrieval, runs, search, trace
from tessella.sources import catalog

SPAN = "id long, run_id string, kind string, site string, agent_id string, t0 long, t1 long, duration_ms long, wait_ms long, compute_ms long, retry_ms long, cost_cents long, tok_in long, tok_out long, tok_read long, tok_write long, status string, call_key string"


def spans(spark, some, kind="model", site="s"):
    return spark.createDataFrame([(i, r, kind, site, None, a, b, b - a, 0, None, 0, 0, 1, 1, 1, 1, "ok", None) for i, (r, a, b) in enumerate(some)], SPAN)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("some", "union", "peak"), [([(0, 100), (50, 150)], 150, 2), ([(0, 100), (100, 200)], 200, 1), ([(0, 90), (10, 80), (20, 70), (95, 99)], 94, 3), ([(5, 5)], None, None)])
def test_intervals(spark, some, union, peak):
    df = spans(spark, [("r", a, b) for a, b in some])
    assert [x["union_ms"] for x in trace.union_ms(df, "run_id").collect()] == ([union] if union else [])
    assert [x["peak"] for x in trace.peak_overlap(df, "run_id").collect()] == ([peak] if peak else [])


def test_intervals_at_random(spark):
    r = random.Random(1)
    some = [(f"r{i % 40}", a := r.randint(0, 60), a + r.randint(0, 25)) for i in range(400)]
    df = spans(spark, some)
    unions = {x["run_id"]: x["union_ms"] for x in trace.union_ms(df, "run_id").collect()}
    peaks = {x["run_id"]: x["peak"] for x in trace.peak_overlap(df, "run_id").collect()}
    covers = {x["run_id"]: (x["covered_ms"], x["idle_ms"]) for x in trace.cover(df).collect()}
    gained: dict[str, int] = {}
    for x in trace.critical_path(df).collect():
        gained[x["run_id"]] = gained.get(x["run_id"], 0) + x["gained_ms"]
    for run in {s[0] for s in some}:
        own = [(a, b) for n, a, b in some if n == run]
        points = {t for a, b in own for t in range(a, b)}
        assert unions.get(run, 0) == len(points) == gained.get(run, 0)
        assert peaks.get(run, 0) == max([0, *(sum(a <= t < b for a, b in own) for t in points)])
        assert covers[run] == (len(points), max(b for _, b in own) - min(a for a, _ in own) - len(points))


def test_percentile_place(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 3, 4)], "k string, v long")
    assert trace.nth_percent(df, "k", "v", 50).first()["p50"] == 3


def score(spark, rows):
    df = spark.createDataFrame([("c", 0, i, "s", w, v, None) for i, (w, v) in enumerate(rows)], "case_id string, run int, criterion int, section_id string, weight long, verdict string, judge_error string")
    return df.groupBy("case_id").agg(*evals.score_columns()).first()


@pytest.mark.parametrize(("rows", "raw", "normalized", "passed"), [([(10, "MET"), (10, "UNMET"), (-5, "UNMET")], 10, 0.5, 0.6667), ([(10, "MET"), (-20, "MET")], -10, 0.0, 0.5), ([(-5, "UNMET")], 0, 1.0, 1.0), ([(-5, "MET")], -5, 0.0, 0.0)])
def test_rubric(spark, rows, raw, normalized, passed):
    got = score(spark, rows)
    assert (got["raw_score"], got["normalized"], got["pass_rate"]) == (raw, normalized, passed)


def test_majority_tie_is_met(spark):
    df = spark.createDataFrame([("c", r, 1, "s", 3, v, None) for r, v in enumerate(["MET", "UNMET"])], "case_id string, run int, criterion int, section_id string, weight long, verdict string, judge_error string")
    got = evals.majority(df).first()
    assert (got["verdict"], got["met_votes"], got["errored"]) == ("MET", 1, False)


@pytest.mark.parametrize(("n", "most"), [(10, 1), (20, 2)])
def test_stratified(spark, n, most):
    df = spark.createDataFrame([(f"c{i}", f"d{i % 10}") for i in range(30)], "case_id string, domain string")
    got = [r["domain"] for r in evals.stratified(df, "s", n).collect()]
    assert len(got) == n and max(map(got.count, got)) == min(map(got.count, got)) == most


def test_rank_fusion(spark):
    rows = [(0, 1, "a", 0, 1, "http://x.com/1", "one", ""), (1, 1, "a", 0, 2, "http://x.com/2?utm_source=f", "two", "kept"), (2, 1, "b", 1, 1, "http://x.com/2", "better", ""), (3, 1, "b", 1, 2, "http://x.com/3", "three", "s")]
    df = spark.createDataFrame(rows, "hit_id long, query_no long, provider string, list_no long, position long, url string, title string, snippet string")
    got = search.ranked(search.fused(df)).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["http://x.com/2", "http://x.com/1", "http://x.com/3"]
    assert (got[0]["title"], got[0]["snippet"], got[0]["providers"]) == ("better", "kept", "a,b")
    assert abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-8


def test_queries(spark):
    assert one(spark, canonical_query(F.col("q")), q="AWS, Lambda! Lambda") == "aws lambda"
    assert one(spark, trail_key(F.col("q")), q="2024 2025") == "2024 2025"
    assert one(spark, trail_key(F.col("q")), q="Prices 2024") == "prices"
    assert one(spark, query_terms(F.col("q")), q='Find "Exact Phrase" in a-b x') == ["exact phrase", "find", "in", "a-b"]
    assert one(spark, canonical_url(F.col("u")), u="HTTPS://X.com/A?b=2&utm_source=z&a=1#f") == "https://x.com/A?a=1&b=2"


@pytest.mark.parametrize("n", [0, 1, 899, 900, 901, 1600, 1601, 5000])
def test_windows(spark, n):
    want, start = [], 0
    while start < n:
        want.append(start)
        if start + 900 >= n:
            break
        start += 700
    assert one(spark, window_starts(F.col("n")), n=n) == want


def test_answers(spark):
    assert one(spark, final_answer(F.col("t")), t="Exact answer: b\n# **Final Answer**: The Café!\n") == "The Café!"
    assert one(spark, normalized_answer(F.col("t")), t="The Café, an  Æon!") == "cafe on"
    assert one(spark, strong_anchors(F.col("t")), t="$1,200 and 5% and 12.5% of 100") == ["1,200", "12.5"]


def test_urls_in_full():
    assert pages.canonical("HTTP://Example.com:80/a b?z=1&a=2&fbclid=x#y") == "http://example.com/a%20b?a=2&z=1"
    assert pages.canonical("not a url") == "not a url"
    assert [pages.is_private(a) for a in ("127.0.0.1", "8.8.8.8", "::ffff:192.168.1.1", "2001:4860:4860::8888", "fc00::1")] == [True, False, True, False, True]


def test_robots():
    rules = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/ok$\n\nUser-agent: *\nDisallow: /"
    assert not pages.robots_allowed(rules, "A-bot", "/x/1") and pages.robots_allowed(rules, "b", "/x/ok") and not pages.robots_allowed(rules, "b", "/x/ok1")
    assert not pages.robots_allowed(rules, "other", "/any") and pages.robots_allowed("", "other", "/any")
    assert pages.robots_allowed("User-agent: *\nDisallow: /" + "*a" * 200 + "$", "x", "/" + "a" * 3000 + "b")


def md(html):
    return markdown.read_page(html, "https://example.com/docs/page")


def test_markdown_of_lists_quotes_and_tables():
    text = md("<html><body><main><ul><li><p>Revenue was $4.2M in 2024.</p></li><li>Simple item</li></ul><blockquote><p>Quoted insight.</p><p>More.</p></blockquote></main></body></html>")["markdown"]
    assert text == "- Revenue was $4.2M in 2024.\n- Simple item\n\n> Quoted insight.\n>\n> More."
    text = md("<table><caption>Annual revenue</caption><thead><tr><th>Year</th><th>Revenue</th></tr></thead><tbody><tr><td>2024</td><td>4|6</td></tr><tr><td><p>Alpha</p><p>Beta</p></td></tr></tbody></table>")["markdown"]
    assert text == "Annual revenue\n\n| Year | Revenue |\n| --- | --- |\n| 2024 | 4\\|6 |\n| Alpha Beta |  |"
    text = md("<body><ol><li>First</li><li>Second <ul><li>Nested A</li><li>Nested B</li></ul></li></ol><dl><dt>Latency</dt><dd>12ms</dd><div><dt>a<dt>b<dd>c<dd>d</div></dl></body>")["markdown"]
    assert text == "1. First\n2. Second\n   - Nested A\n   - Nested B\n\n- Latency: 12ms\n- a, b: c; d"


def test_markdown_of_code_and_links():
    text = md('<pre><code class="language-bash">npm install x\nnpm run ```build</code></pre><p>Call <code>fetch()</code> once, <kbd>a`b</kbd>.</p>')["markdown"]
    assert text == "````bash\nnpm install x\nnpm run ```build\n````\n\nCall `fetch()` once, `` a`b ``."
    text = md('<p>See <a href="/report">the full report</a>, <a href="#s">Jump</a> and <a href="javascript:void(0)">Click</a>, <a href="/a(b)">x</a>, <a href="https://example.com/y">https://example.com/y</a>.</p>')["markdown"]
    assert text == "See [the full report](https://example.com/report), Jump and Click, [x](<https://example.com/a(b)>), https://example.com/y."


def test_markdown_root():
    page = md('<html lang="en"><head><title>Doc Title</title></head><body>junk ad<nav><a href="/home">Home</a></nav><main><h2>Section</h2><aside>Beside.</aside><p>Body text.<nav>menu</nav></main>tail</body></html>')
    assert page["title"] == "Doc Title" and page["markdown"] == "## Section\n\nBeside.\n\nBody text.\n\nmenu" and page["links"] == [("https://example.com/home", "Home")] and page["metadata"]["language"] == "en"
    assert md("<body>out<article>in<form>too</form></article></body>")["markdown"] == "in\n\ntoo" and md("<p>Intro.</p><div>Price: <span>$19.99</span></div><hr>bare<br>text")["markdown"] == "Intro.\n\nPrice: $19.99\n\nbare text"
    assert md(None)["markdown"] == "" and md("<script>x</script><svg><text>y</text></svg>")["markdown"] == "" and md("plain")["title"] == "https://example.com/docs/page"
    assert md("<h2>T</h2><ul><li>one<li>two</ul><table><tr><th>a<th>b|c</tr><tr><td>1</tr></table>")["markdown"] == "## T\n\n- one\n- two\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_page_metadata():
    page = md('<html><head><link rel="canonical" href="/c?b"><meta name="author" content=" A. U. "><meta property="article:author" content="B"><meta name="date" content="2024-01-02"><meta name="last-modified" content="m"><meta property="og:title" content="Og"><meta property="og:description" content="d"><script type="application/ld+json">{"@type": "Article"}</script><script type="application/ld+json">broken</script></head></html>')
    assert page["title"] == "Og" and page["metadata"] == {"canonical": "https://example.com/c?b", "author": "A. U.", "articleAuthor": "B", "publishedTime": "2024-01-02", "modifiedTime": "m", "description": "d", "jsonLd": {"@type": "Article"}}


def test_reports(spark):
    known = {"source_1": ("one", "https://a.org/1", []), "source_2": ("two", "https://a.org/2", ["ok"]), "source_3": ("three", "https://a.org/3", ["thin_content"])}
    text, order, unbound = pages.renumbered("A [source_2] b [source_9] c [source_1] d [source_2] e [source_3] f [Smith 2020] g [see Fig. 2 of 2020] (source_4) [1, 2] [x](y) [Source_7 said] .", known)
    assert text == "A [1] b c [2] d [1] e f g [see Fig. 2 of 2020] [1, 2] [x](y).\n\n## Sources\n\n1. [two](https://a.org/2)\n2. [one](https://a.org/1)" and order == ["source_2", "source_1"] and unbound == ["source_9"]
    assert pages.renumbered("None [Doe et al., 2019a] here (2020).", {}) == ("None here (2020).", [], [])
    roster = [("one", "https://a.org/1"), ("two", "https://a.org/2?x=(y)"), ("three", "https://a.org/1/long")]
    text, order, unbound = pages.roster_bound("See [it](https://a.org/2?x=(y)) and [that](https://a.org/1/long) [1] [9] [2] [other](https://b.org) .", roster)
    assert text == "See it [1] and that [2] [3] [1] [other](https://b.org).\n\n## Sources\n\n1. [two](https://a.org/2?x=(y))\n2. [three](https://a.org/1/long)\n3. [one](https://a.org/1)" and order == [2, 3, 1] and unbound == ["source_9"]
    assert one(spark, pages.without_sources_section(F.col("t")), t="x\n\n## Sources\n\n1. y") == "x"
    assert one(spark, pages.without_sources_section(F.col("t")), t="x\n# Resources\ny\n### REFERENCES: z\nw") == "x\n# Resources\ny"
    assert pages.captions('{"events":[{"segs":[{"utf8":"a"},{"utf8":" b\\n"}]},{},{"segs":[{"utf8":"c"}]}]}') == "a b\nc" and pages.captions("{broken") == ""
    assert pages.captions("<x><text start='0'>It&amp;#39;s <i>a</i></text><text> </text><text>b</text></x>") == "It's a\nb" and pages.captions("<p t=1>one\ntwo</p>") == "one two"


def test_retry_classes(spark):
    now = F.lit("2015-10-21 07:28:00").cast("timestamp")
    cases = [
        ({"name": "AbortError", "statusCode": 503}, (False, False, None)), ({"statusCode": 429, "responseHeaders": {"retry-after": "2"}}, (True, True, 2000.0)), ({"statusCode": 400, "message": "Overloaded"}, (True, True, None)),
        ({"statusCode": 503, "isRetryable": False}, (False, False, None)), ({"message": "x", "cause": {"message": "y", "errors": [{}, {"message": "ECONNRESET"}]}}, (True, False, None)), ({"message": "no"}, (False, False, None)),
        ({"lastError": {"statusCode": 500, "responseHeaders": {"Retry-After": "Wed, 21 Oct 2015 07:28:05 GMT"}}}, (True, False, 5000.0)), ({"statusCode": 408, "responseHeaders": {"retry-after": "soon"}}, (True, False, None)),
        ({"errors": [{}] * 4 + [{"statusCode": 500}]}, (False, False, None)), ({"statusCode": 409, "responseHeaders": {"retry-after": "-3"}}, (True, False, 0.0)),
    ]
    df = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _) in enumerate(cases)], "k long, e string")
    got = {r["k"]: tuple(r["c"]) for r in retries.unwrap(df, "k", "e").select("k", retries.classed(F.col("errors"), now).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    search = spark.createDataFrame([("e", 500, "no", 7.0), ("e", 404, "timeout", 7.0), ("e", None, "Fetch failed", 7.0), ("TimeoutError", None, "timeout", None)], "n string, s int, m string, a double")
    assert [tuple(r[0]) for r in search.select(retries.search_classed(*map(F.col, "nsma"))).collect()] == [(True, 7.0), (False, None), (True, None), (False, None)]
    waits = spark.createDataFrame([(1, None, 0.0), (3, None, 1.0), (9, None, 0.0), (1, 9000.0, 0.0), (1, 99000.0, 0.0)], "n int, a double, d double")
    assert [r[0] for r in waits.select(retries.wait_ms(F.col("n"), F.col("a"), F.col("d"), 1000, 30000)).collect()] == [500.0, 4000.0, 15000.0, 9000.0, 30000.0]


def test_notes():
    assert pages.without_caveats("- [note] Rev $5. [source_3] The page could not be retrieved in this run. A bot-wall stood there. Page-not-found again. Lead to chase: x. It was not confirmed by the court.") == "Rev $5. It was not confirmed by the court."


def test_process_caveats():
    note = "The deal closed in 2021. The filing could not be retrieved in this run. It cost $5 (not grounded in this run).\n- This page could not be fetched.\n\n\n\nTODO check.  Done ."
    assert pages.without_process_caveats(note) == "The deal closed in 2021. It cost $5.\n- This page could not be fetched.\n\n check. Done."
    assert pages.without_process_caveats("It was not confirmed by the court.") == "It was not confirmed by the court."
    long = "The source could not be retrieved " + "x" * 320 + "."
    assert pages.without_process_caveats(long) == long


def test_tool_names(spark):
    from tessella.operators.surface import ToolRegistry, Words

    tools = ToolRegistry(spark)
    for name in ("read_source", "search", "close_slot", "9a", "a b", ""):
        with pytest.raises(ValueError):
            tools.add(name, Words, "at int, word string")
    tools.add("read", Words, "at int, word string")
    with pytest.raises(ValueError):
        tools.add("read", Words, "at int, word string")


def test_cache_prices(spark):
    df = spark.createDataFrame([(i, m, 0, 0, 1_000_000, 1_000_000) for i, m in enumerate(["glm-4.7", "GLM-4.7-Flash", "gpt-5", "unheard"])], "id int, model_id string, input long, output long, cache_read long, cache_write long")
    assert [round(r["usd"], 6) for r in metering.priced(df).withColumn("usd", metering.cost()).orderBy("id").collect()] == [0.11, 0.0, 0.125 + 1.5625, 0.3 + 3.75]


def test_coverage_update(spark):
    slots = spark.createDataFrame([("r", f"s{i}", s) for i, s in enumerate(["open", "open", "open", "answered"])], "run_id string, slot_id string, state string")
    update = spark.createDataFrame([("r", "s0", "closed"), ("r", "s0", "exhausted"), ("r", "s1", "closed"), ("r", "s3", "exhausted"), ("r", "s9", "closed")], "run_id string, slot_id string, verdict string")
    assert [r["state"] for r in ledger.covered(slots, update).orderBy("slot_id").collect()] == ["exhausted", "stated", "open", "answered"]


def test_plain_letters(spark):
    assert one(spark, normalized_answer(F.col("t")), t="The Őşğ ﬁnal ｆｕｌｌ Ångström, an Éé a²") == "osg final full angstrom ee a2"


def test_null_rows_keep_their_key(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id long, t string")
    assert sorted(map(tuple, pages.mapped(df, "id long, n long", lambda i, t: (i, len(t))).collect())) == [(1, None), (2, 1)]


def test_prices(spark):
    df = spark.createDataFrame([(i, "r", "x", m, 1_000_000, 0, 0, 0) for i, m in enumerate(["gpt-5", "GPT-5", "gpt-4o-2024-08-06", "eu.vendor.gpt-5-nano", "gemini-2.5-pro-exp", "gpt-4o-mini-x", "what", None])], "id long, run_id string, role string, model_id string, input long, output long, cache_read long, cache_write long")
    got = metering.priced(df).withColumn("usd", metering.cost()).orderBy("id").collect()
    assert [r["usd"] for r in got] == [1.25, 1.25, 2.5, 0.05, 1.25, 0.15, 3.0, 3.0]


def test_gate(spark):
    rows = [("r", i, True) for i in range(8)] + [("r", 8, False)] + [("q", i, False) for i in range(9)]
    got = {r["run_id"]: r["width"] for r in metering.aimd_fold(spark.createDataFrame(rows, "run_id string, seq long, good boolean")).collect()}
    assert got == {"r": 2, "q": 1}


def test_budget(spark):
    ops = [("r", 0, "reserve", 6.0), ("r", 1, "reserve", 6.0), ("r", 2, "settle", 5.0), ("r", 3, "release", 0.0), ("r", 4, "charge", -1.0)]
    got = metering.budget_fold(spark.createDataFrame(ops, "run_id string, seq long, op string, usd double"), 10.0).first()
    assert (got["used"], got["held"], got["exhausted"]) == (5.0, 0.0, False)


def test_near_queries_at_random(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "etas", "theta"], k=r.randint(1, 6)))) for i in range(60)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) >= 0.5}
    assert {(p["a"], p["b"]) for p in ledger.near_pairs(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()} == want


def test_slots(spark):
    rows = [(0, "s", "r", "add", "v", "central"), (1, "s", "r", "close_grounded", "v1", "central"), (2, "t", "r", "add", "v", "x"), (3, "t", "r", "close_computed", "v", "x"), (4, "t", "r", "retarget", "v", "x")]
    df = spark.createDataFrame(rows, "seq long, slot_id string, run_id string, op string, value string, importance string")
    assert {r["slot_id"]: (r["state"], r["value"]) for r in ledger.slot_states(df).collect()} == {"s": ("answered", "v1"), "t": ("open", None)}
    assert tuple(ledger.ledger_status(ledger.slot_states(df)).first()) == ("r", 2, 1, 1, False)


def test_guards(spark):
    urls = ["http://10.1.2.3/", "https://ok.com/", "ftp://x", "http://a:b@c.com", "http://localhost/", "http://100.64.0.1/x"]
    assert [one(spark, filters.url_guard(F.col("u")), u=u) for u in urls] == ["ssrf", "ok", "scheme", "credentials", "local-name", "ssrf"]


def test_journal(spark, tmp_path):
    rows = [("a/b", 1, "meta", None, None, "q", 0, 0), ("a/b", 2, "event", "run.error", None, "{}", 0, 0), ("c", 1, "event", "run.completed", "k", "{}", 0, 0), ("c", 2, "event", "x", None, "{}", 0, 0), ("d", 1, "io", None, None, "", 0, 0)]
    path = f"{tmp_path}/journal"
    catalog.append_journal(spark.createDataFrame(rows, catalog.JOURNAL_SCHEMA), path)
    (tmp_path / "journal" / "run=c" / "bad.json").write_text('{"run_id": "c", broken\n')
    got = catalog.read_journal(spark, path)
    assert got.count() == 5
    assert {r["run_id"]: (r["status"], r["question"]) for r in catalog.run_status(got).collect()} == {"a/b": ("failed", "q"), "c": ("completed", None), "d": ("incomplete", None)}


def test_cases(spark, tmp_path):
    schema = "id string, query string"
    for name, body in {"a.json": '[{"id": "1",\n "query": "x"}]', "b.jsonl": '# note\n{"id": "1", "query": "x"}\n\n', "c.csv": 'id,query\n1,x\n'}.items():
        (tmp_path / name).write_text(body)
        assert [tuple(r) for r in catalog.read_cases(spark, str(tmp_path / name), schema).collect()] == [("1", "x")]
    (tmp_path / "q.csv").write_text('id,query\r\n1,"a ""b""\nc"\r\n')
    assert catalog.read_cases(spark, str(tmp_path / "q.csv"), schema).first()["query"] == 'a "b"\nc'


def test_recorded_search(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"query": "q", "url": "http://a", "title": "t"}\n')
    spark.dataSource.register(catalog.RecordedSearch)
    got = spark.read.format("recorded_search").option("files", str(tmp_path / "r.jsonl")).load().collect()
    assert [tuple(r) for r in got] == [("q", 1, "http://a", "t", "")]


def test_t_table(spark):
    df = spark.createDataFrame([(0,), (1,), (20,), (25,), (30,)], "d long")
    assert [r["t"] for r in df.select(runs.t95(F.col("d")).alias("t")).collect()] == [0.0, 12.706, 2.086, 2.045, 1.96]


def test_bm25_is_one_scan(spark):
    df = retrieval.bm25(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "the tion")
    assert df.count() == 20
    assert retrieval.bm25(spark.createDataFrame([], "doc_id long, text string"), "the").count() == 0


def test_page_functions_take_whole_texts(spark, tmp_path):
    from tessella.plans import registry

    words = ["alpha"] * 60 + ["b", "abcdefghijk", "tail."]
    long = " ".join(words)
    headed = "x " * 400 + "\n# References\n\nof the text"
    spark.createDataFrame([(1, long), (2, headed)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    registry.load()
    rows = lambda q: {r["doc_id"]: r for r in registry.QUERIES[q](spark, str(tmp_path)).collect()}
    assert rows("fn13_renumber")[1][1:3] == ("source_1", 1)
    assert rows("fn12_notes")[1]["digest"] == hashlib.md5(f"{long} Kept.".encode()).hexdigest()
    want = {1: long, 2: ("x " * 400).rstrip()}
    assert {i: r["digest"] for i, r in rows("fn14_sources_section").items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}


def test_scope_of_unknown_ids_is_all_documents(spark, tmp_path):
    from tessella.plans import registry

    registry.load()
    for name, sources, want in (("some", ["src1", "other", None], [1]), ("none", ["a", "b", None], [1, 2, 3])):
        spark.createDataFrame(list(enumerate(sources, 1)), "doc_id long, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert sorted(r["doc_id"] for r in registry.QUERIES["jn14_scope"](spark, f"{tmp_path}/{name}").collect()) == want


def test_fetch_rules():
    from tessella.sources import fetching

    asked = []

    def web(url):
        asked.append(url)
        return fetching.recorded_web(url)

    fetch = fetching.Fetcher(web)
    assert fetch("https://h.com/r4/a") == ("https://h.com/page/a", "html", "<p>a</p>")
    assert fetch("https://h.com/r5/a")[1] == "too_many_redirects" and fetch("https://h.com/private/a")[1] == "robots_disallowed"
    assert sum(u.endswith("robots.txt") for u in asked) == 1  # once a host
    for url in ("ftp://h.com/x", "http://10.1.2.3/", "http://u:p@h.com/", "http://localhost/", "http://[::1]/", "https://h.com/" + "x" * 2048, "", "http://[bad"):
        assert fetch(url)[1] == "blocked_url"
    big = fetching.Fetcher(lambda u: (200, {"content-type": "text/html"}, b"x" * (fetching.HTML_BYTES + 1)))
    assert big("https://h.com/a")[1] == "too_large"


def test_providers():
    from tessella.sources.fetching import providers_for, result_limit

    assert providers_for({"brave": "k", "exa": "k"}) == ["exa", "brave"] and providers_for({}) == ["native"]
    assert providers_for({"exa": "k"}, "academic", {"academic": ["arxiv"]}) == ["arxiv"] and providers_for({"exa": "k"}, "news", {"academic": ["arxiv"]}) == ["exa"]
    assert [result_limit("tavily", n) for n in (None, 0, 7, 99)] == [8, 1, 7, 20] and result_limit("exa", 500) == 100
