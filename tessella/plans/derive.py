"""Typed inputs for the named queries, derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

#: Milliseconds of an events timestamp: by way of microseconds, which both engines have exactly.
MILLIS = {
    "spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000",
    "duckdb": "epoch_us(ts) // 1000",
}

DERIVED = {
    "spans": """SELECT event_id AS id, concat('run', CAST(user_id % 10 AS STRING)) AS run_id,
      CASE WHEN event_id % 10 = 9 THEN 'agent' WHEN event_id % 4 = 0 THEN 'model' WHEN event_id % 4 = 1 THEN 'io' WHEN event_id % 4 = 2 THEN 'tool' ELSE 'model' END AS kind,
      event_type AS site, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('a', CAST(user_id % 70 AS STRING)) END AS agent_id,
      {millis} AS t0, {millis} + CAST(floor(value * 60000) AS BIGINT) AS t1, CAST(floor(value * 60000) AS BIGINT) AS duration_ms,
      (event_id * 37) % 3000 AS wait_ms,
      CASE WHEN event_id % 6 = 0 THEN NULL ELSE greatest(CAST(0 AS BIGINT), CAST(floor(value * 60000) AS BIGINT) - (event_id * 37) % 3000) END AS compute_ms,
      (event_id * 13) % 1500 AS retry_ms, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS cost_cents,
      event_id % 1000 AS tok_in, event_id % 300 AS tok_out, event_id % 70 AS tok_read, event_id % 30 AS tok_write,
      CASE WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 19 = 0 THEN 'aborted' ELSE 'ok' END AS status,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('call', CAST(event_id % 397 AS STRING)) END AS call_key FROM events""",
    "agent_nodes": """SELECT concat('run', CAST(user_id % 10 AS STRING)) AS run_id, concat('a', CAST(event_id % 997 AS STRING)) AS agent_id,
      max(CASE WHEN event_id % 997 = 0 THEN NULL WHEN event_id % 997 % 41 = 7 THEN 'gone' WHEN event_id % 997 % 50 = 11 THEN concat('a', CAST(event_id % 997 * 3 + 2 AS STRING)) ELSE concat('a', CAST((event_id % 997 - event_id % 997 % 3) // 3 AS STRING)) END) AS parent_id,
      sum(CAST(floor(value * 100) AS BIGINT)) AS cost_cents, sum(CAST(floor(value * 60000) AS BIGINT)) AS self_ms FROM events GROUP BY 1, 2""",
    "runs": """SELECT concat('r', CAST(o_orderkey AS STRING)) AS run_id, concat('c', CAST(o_custkey % 200 AS STRING)) AS case_id,
      concat('k', CAST(o_orderkey % 5 AS STRING)) AS commit_sha, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat('m', CAST(o_orderkey % 3 AS STRING)) END AS model,
      o_orderkey * 7 % 100003 AS created_at, o_orderkey % 2 AS dirty,
      CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 13 = 0 THEN 'ungraded' ELSE 'scored' END AS status,
      CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey * 7919 % 1001 AS DOUBLE) / 1000 END AS normalized,
      CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey * 31 % 4000 AS DOUBLE) / 1000 END AS cost_usd,
      CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey * 17 % 900 AS DOUBLE) / 1000 END AS exa_usd,
      o_orderkey * 53 % 600000 AS latency_ms, o_orderkey % 12 AS sources, o_orderkey * 3 % 5 = 0 AS exhausted FROM orders""",
    "cases": """SELECT concat('c', CAST(c_custkey AS STRING)) AS case_id, c_mktsegment AS domain, c_name AS problem, c_custkey % 40 AS criteria_count FROM customer""",
    "grades": """SELECT concat('c', CAST(l_orderkey % 300 AS STRING)) AS case_id, CAST(l_linenumber % 3 AS INT) AS run, l_partkey % 23 AS criterion,
      CASE l_partkey % 23 % 4 WHEN 0 THEN 'factual-accuracy' WHEN 1 THEN 'breadth-and-depth-of-analysis' WHEN 2 THEN 'presentation-quality' ELSE 'citation-quality' END AS section_id,
      CAST(CASE WHEN l_partkey % 23 % 5 = 0 THEN -(l_partkey % 23 % 7) - 1 ELSE l_partkey % 23 % 11 END AS BIGINT) AS weight,
      max(CASE WHEN (l_orderkey + l_suppkey) % 3 > 0 THEN 'MET' ELSE 'UNMET' END) AS verdict, max(CASE WHEN l_suppkey % 29 = 0 THEN 'judge failed' END) AS judge_error
      FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "hits": """SELECT page_id AS hit_id, page_id % 12 AS query_no, concat('p', CAST(page_id % 3 AS STRING)) AS provider, page_id % 3 AS list_no, 1 + (page_id % 36) // 3 AS position,
      concat('https://site', CAST(page_id * 7 % 31 AS STRING), CASE page_id % 5 WHEN 0 THEN '.gov' WHEN 1 THEN '.edu' WHEN 2 THEN '.org' ELSE '.com' END, '/doc/', CAST(page_id % 29 AS STRING)) AS url,
      concat('title ', CAST(page_id AS STRING)) AS title, CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('snippet ', CAST(page_id AS STRING)) END AS snippet FROM pages""",
    "journal": """SELECT concat('run', CAST(user_id AS STRING)) AS run_id, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'meta' WHEN event_id % 9 < 5 THEN 'event' WHEN event_id % 9 < 7 THEN 'call' WHEN event_id % 9 = 7 THEN 'io' ELSE 'trace' END AS kind,
      CASE WHEN event_id % 23 = 0 THEN 'run.completed' WHEN event_id % 29 = 0 THEN 'run.error' WHEN event_id % 4 = 0 THEN 'report.delta' WHEN event_id % 4 = 1 THEN 'search.completed' WHEN event_id % 4 = 2 THEN 'source.fetched' ELSE 'tool.event' END AS type,
      CASE WHEN event_id % 9 IN (5, 6) THEN concat('key', CAST(event_id % 61 AS STRING)) END AS call_key, props AS data, CAST(floor(value * 100) AS BIGINT) AS cents, {millis} AS at_ms FROM events""",
    "slot_events": """SELECT event_id AS seq, concat('s', CAST(user_id % 60 AS STRING)) AS slot_id, concat('run', CAST(user_id % 3 AS STRING)) AS run_id,
      CASE WHEN event_type = 'signup' THEN 'add' WHEN event_type = 'error' THEN 'retarget' WHEN event_type = 'purchase' THEN 'close_grounded' WHEN event_type = 'click' THEN 'close_computed' ELSE 'exhaust' END AS op,
      concat('value ', CAST(event_id AS STRING)) AS value, CASE WHEN user_id % 2 = 0 THEN 'central' ELSE 'peripheral' END AS importance FROM events""",
    "usage": """SELECT event_id AS id, concat('run', CAST(user_id % 10 AS STRING)) AS run_id, CASE event_id % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'write' ELSE 'judge' END AS role,
      CASE event_id % 8 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'GPT-5-mini' WHEN 2 THEN 'gpt-4o-2024-08-06' WHEN 3 THEN 'vendor.gpt-4o-mini' WHEN 4 THEN 'gemini-2.5-pro-preview' WHEN 5 THEN 'unheard-of' WHEN 6 THEN 'eu.vendor.gpt-5-nano' ELSE NULL END AS model_id,
      event_id * 101 % 9000 AS input, event_id * 53 % 3000 AS output, event_id * 29 % 2000 AS cache_read, event_id * 7 % 500 AS cache_write FROM events""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of DERIVED as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = DERIVED[name].format(millis=MILLIS["spark"]).replace("//", "div").replace("https:div", "https://")
    source = body.rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(body.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_tables(names: tuple[str, ...], body: str) -> str:
    """DuckDB SQL of ``body`` with the derived tables it reads in front."""
    made = ", ".join(f"{n} AS (SELECT * FROM ({DERIVED[n].format(millis=MILLIS['duckdb'])}))" for n in names if n not in TABLES)
    body = body.strip()
    if not made:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {made}, {body[14:]}"
    return f"WITH {made}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {made} {body}"
