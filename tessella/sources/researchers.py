"""Outside researchers over recorded answers: a report with its sources and its cost, or why there is none.

``recorded`` has (id, step, seq, status, body): the HTTP answers that a request got, in order of seq. Requests are independent; of one there are as many
answers as its time allowed polls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ENDED, RUN_PRICES
from ..operators.metering import token_cost
from ..plans.registry import register, rounded

SOURCE = "struct<url: string, title: string>"
URL = r"https?://[^\s)<>\]]+"


def _text(value: Column) -> Column:
    """A value that may be text or anything else, as text or as its JSON."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _once(sources: Column) -> Column:
    """Sources with an address, the first of each; an empty title is none."""
    known = F.filter(F.coalesce(sources, F.array().cast(f"array<{SOURCE}>")), lambda s: F.coalesce(s["url"], F.lit("")) != "")
    first = F.filter(known, lambda s, i: F.array_position(F.transform(known, lambda x: x["url"]), s["url"]) == i + 1)
    return F.transform(first, lambda s: F.struct(s["url"].alias("url"), F.nullif(s["title"], F.lit("")).alias("title")))


def sources_in(text: Column) -> Column:
    """Addresses in a report in the order in which they come, without the punctuation behind them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({URL})")), lambda u: F.regexp_replace(u, r"[.,;:]+$", ""))
    return F.transform(F.array_distinct(found), lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title")))


def ended(recorded: DataFrame) -> DataFrame:
    """(id, state, http): how the polling of each request ended: with the first state in which it can't go on, or the first answer that is none; null while it goes on."""
    state = F.get_json_object("body", "$.status")
    stop = (F.col("status") >= 400) | state.isin(*ENDED)
    first = F.min(F.when(stop, F.struct("seq", state.alias("state"), F.col("status").alias("http"))))
    return recorded.where("step IN ('create', 'poll')").groupBy("id").agg(first.alias("e")).select("id", "e.state", "e.http")


def _answer(recorded: DataFrame, step: str) -> DataFrame:
    """The last answer of a step of each request."""
    return recorded.where(F.col("step") == step).groupBy("id").agg(F.max_by(F.struct("status", "body"), "seq").alias("a")).select("id", F.col("a.status").alias("answered"), "a.body")


def task_runs(recorded: DataFrame, processor: str = "core") -> DataFrame:
    """(id, report, sources, cost, error) of task runs that are created, polled until they end, and then fetched."""
    both = ended(recorded).join(_answer(recorded, "result"), "id", "left")
    error = F.when(F.col("http") >= 400, F.concat(F.lit("poll HTTP "), "http")).when(F.col("state").isNull(), "timed out").when(F.col("state") != "completed", F.concat(F.lit("task run "), "state")).when(F.coalesce("answered", F.lit(599)) >= 400, F.concat(F.lit("result HTTP "), F.coalesce("answered", F.lit(599))))
    value = F.try_parse_json("body")
    content = F.coalesce(F.trim(_text(F.try_variant_get(value, "$.output.content", "variant"))), F.lit(""))
    cited = F.from_json("body", f"struct<output: struct<basis: array<struct<citations: array<{SOURCE}>>>>>")["output"]["basis"]
    cited = F.flatten(F.transform(cited, lambda b: F.coalesce(b["citations"], F.array().cast(f"array<{SOURCE}>"))))
    return _shown(both, content, _once(cited), F.lit(RUN_PRICES.get(processor)).cast("double"), error)


def polled_research(recorded: DataFrame) -> DataFrame:
    """(id, report, sources, cost, error) of research that is polled until it has finished: the last poll has the report, which names its sources."""
    both = ended(recorded).join(_answer(recorded, "poll"), "id", "left")
    error = F.when(F.col("http") >= 400, F.concat(F.lit("poll HTTP "), "http")).when(F.coalesce("state", F.lit("")) != "completed", F.concat(F.lit("research "), F.coalesce("state", F.lit("timed out"))))
    report = F.trim(F.coalesce(F.get_json_object("body", "$.output.content"), F.lit("")))
    return _shown(both, report, sources_in(report), F.get_json_object("body", "$.costDollars.total").try_cast("double"), error)


def asked_once(recorded: DataFrame, model: str = "sonar-deep-research") -> DataFrame:
    """(id, report, sources, cost, error) of questions that are answered at once, with results or citations, and tokens that cost."""
    usage = "struct<prompt_tokens: bigint, completion_tokens: bigint, citation_tokens: bigint, reasoning_tokens: bigint, num_search_queries: bigint>"
    read = F.from_json("body", f"struct<choices: array<struct<message: struct<content: string>>>, citations: array<string>, search_results: array<{SOURCE}>, usage: {usage}>")
    both = _answer(recorded, "answer").withColumn("r", read)
    error = F.when(F.col("answered") >= 400, F.concat(F.lit("HTTP "), "answered")).when(F.coalesce(F.size("r.choices"), F.lit(0)) < 1, "no choices")
    found = F.filter(F.coalesce("r.search_results", F.array().cast(f"array<{SOURCE}>")), lambda s: F.coalesce(s["url"], F.lit("")) != "")
    sources = F.when(F.size(found) > 0, F.transform(found, lambda s: F.struct(s["url"].alias("url"), F.nullif(s["title"], F.lit("")).alias("title")))).otherwise(F.transform(F.coalesce("r.citations", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title"))))
    n = lambda c: F.coalesce(f"r.usage.{c}", F.lit(0))
    cost = F.when(F.col("r.usage").isNotNull(), token_cost(F.lit(model), n("prompt_tokens"), n("completion_tokens"), n("citation_tokens"), n("reasoning_tokens"), n("num_search_queries")))
    return _shown(both, F.trim(F.coalesce(F.try_element_at("r.choices", F.lit(1))["message"]["content"], F.lit(""))), sources, cost, error)


def _shown(df: DataFrame, report: Column, sources: Column, cost: Column, error: Column) -> DataFrame:
    told = lambda c: F.when(error.isNull(), c)
    return df.select("id", told(report).alias("report"), told(sources).alias("sources"), told(cost).alias("cost"), error.alias("error"))


def _recorded(d: DataFrame) -> DataFrame:
    """Answers as three kinds of researchers give them, a document each, with failures and states in between."""
    i = F.col("doc_id")
    row = lambda step, seq, status, body: F.struct(F.lit(step).alias("step"), seq.cast("int").alias("seq"), status.cast("int").alias("status"), body.alias("body"))
    state = lambda s: F.concat(F.lit('{"status":"'), s, F.lit('"}'))
    good = F.when(i % 5 == 4, "failed").otherwise("completed")
    polls = F.transform(F.sequence(F.lit(1), (i % 4 + 1).cast("int")), lambda k: row("poll", k, F.when((i % 7 == 6) & (k == 1), 503).otherwise(200), state(F.when(k == i % 4 + 1, good).otherwise("running"))))
    content = F.when(i % 11 == 0, F.lit('{"a":1}')).otherwise(F.regexp_replace(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", "$1"))
    result = F.concat(F.lit('{"output":{"content":'), content, F.lit(',"basis":[{"citations":[{"url":"https://a.org/'), i % 3, F.lit('","title":"A"},{"url":"https://b.org"}]},{},{"citations":[{"url":"https://a.org/1","title":""},{"title":"no"}]}]}}'))
    tasks = F.concat(F.array(row("create", F.lit(0), F.lit(200), F.lit('{"run_id":"r","status":"queued"}'))), polls, F.array(row("result", F.lit(9), F.when(i % 13 == 12, 500).otherwise(200), result)))
    told = F.to_json(F.struct(good.alias("status"), F.struct(F.concat(F.lit(" See https://a.org/x). And https://b.org/y, https://a.org/x; "), "source").alias("content")).alias("output"), F.when(i % 2 == 0, F.struct((i % 9 / 100).alias("total"))).alias("costDollars")))
    research = F.array(row("poll", F.lit(1), F.lit(200), state(F.lit("running"))), row("poll", F.lit(2), F.lit(200), told))
    usage = F.struct((i % 900).alias("prompt_tokens"), (i % 70).alias("completion_tokens"), (i % 5).alias("num_search_queries"))
    results = F.when(i % 4 > 1, F.array(F.struct(F.lit("").alias("url"), F.lit("none").alias("title")), F.struct(F.concat(F.lit("https://c.org/"), i % 10).alias("url"), F.lit("C").alias("title"))))
    choices = F.when(i % 17 > 0, F.array(F.struct(F.struct(F.col("source").alias("content")).alias("message"))))
    answer = F.array(row("answer", F.lit(1), F.when(i % 19 == 0, 429).otherwise(200), F.to_json(F.struct(choices.alias("choices"), F.array(F.lit("https://d.org")).alias("citations"), results.alias("search_results"), F.when(i % 3 > 0, usage).alias("usage")))))
    rows = F.when(i % 3 == 0, tasks).when(i % 3 == 1, research).otherwise(answer)
    return d.select(F.col("doc_id").alias("id"), F.explode(rows).alias("r")).select("id", "r.*")


def _researched(d: DataFrame) -> DataFrame:
    r = _recorded(d)
    kind = lambda k: r.where(F.col("id") % 3 == k)
    every = task_runs(kind(0)).unionByName(polled_research(kind(1))).unionByName(asked_once(kind(2)))
    named = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["url"], s["title"])), " ")
    return every.select("id", F.md5("report").alias("report"), named.alias("sources"), rounded(F.col("cost"), 8).alias("cost"), "error")


SQL = """WITH t AS (SELECT doc_id AS id, text, source, doc_id % 3 AS kind, CASE
  WHEN doc_id % 3 = 0 AND doc_id % 7 = 6 THEN 'poll HTTP 503' WHEN doc_id % 3 = 0 AND doc_id % 5 = 4 THEN 'task run failed' WHEN doc_id % 3 = 0 AND doc_id % 13 = 12 THEN 'result HTTP 500'
  WHEN doc_id % 3 = 1 AND doc_id % 5 = 4 THEN 'research failed' WHEN doc_id % 3 = 2 AND doc_id % 19 = 0 THEN 'HTTP 429' WHEN doc_id % 3 = 2 AND doc_id % 17 = 0 THEN 'no choices' END AS error FROM documents)
SELECT id, CASE WHEN error IS NULL THEN md5(CASE kind WHEN 0 THEN CASE WHEN id % 11 = 0 THEN '{"a":1}' ELSE trim(text) END WHEN 1 THEN 'See https://a.org/x). And https://b.org/y, https://a.org/x; ' || source ELSE source END) END AS report,
  CASE WHEN error IS NULL THEN CASE kind WHEN 0 THEN 'https://a.org/' || (id % 3) || '|A https://b.org' || CASE WHEN id % 3 <> 1 THEN ' https://a.org/1' ELSE '' END WHEN 1 THEN 'https://a.org/x https://b.org/y' ELSE CASE WHEN id % 4 > 1 THEN 'https://c.org/' || (id % 10) || '|C' ELSE 'https://d.org' END END END AS sources,
  CASE WHEN error IS NULL THEN CASE kind WHEN 0 THEN 0.025::DOUBLE WHEN 1 THEN CASE WHEN id % 2 = 0 THEN (id % 9 / 100)::DOUBLE END ELSE floor(((id % 900 * 2 + id % 70 * 8) / 1e6 + id % 5 / 1e3 * 5) * 1e8 + 0.5) / 1e8 END END AS cost, error FROM t"""

register("sc29_researchers", "documents", _researched, SQL)
