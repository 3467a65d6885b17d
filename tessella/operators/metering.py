"""Tokens, prices and budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import PRICES, RUN_PRICES, TOKEN_RATES
from ..plans.registry import register, rounded

UNKNOWN = (3.0, 15.0)
CACHE_READ, CACHE_WRITE, FLOOR_USD = 0.1, 1.25, 0.01
THRESHOLDS = (0.5, 0.8, 0.95)


def price_table(spark) -> DataFrame:
    """(model, usd_in, usd_out, usd_read, usd_write) for a million tokens; a cache without prices of its own has shares of in."""
    rows = [(k, float(p[0]), float(p[1]), float(p[2] if len(p) > 2 else p[0] * CACHE_READ), float(p[3] if len(p) > 3 else p[0] * CACHE_WRITE)) for k, p in PRICES.items()]
    return spark.createDataFrame(rows, "model string, usd_in double, usd_out double, usd_read double, usd_write double")


def priced(usage: DataFrame) -> DataFrame:
    """``usage`` with the model that a price was found under and its rates: by name, without date, without leading dotted parts, else by the longest
    known name that it begins or ends with. Prices are a fixed dimension of a few rows; models are looked up once each."""
    undated = F.regexp_replace(F.regexp_replace(F.lower("model_id"), r"-\d{4}-\d{2}-\d{2}$", ""), r"-\d{8}$", "")
    names = usage.select("model_id").where("model_id IS NOT NULL").distinct().withColumn("low", undated)
    dim = F.broadcast(price_table(usage.sparkSession))
    known = F.lower("model")
    tail, head = F.endswith(F.col("low"), F.concat(F.lit("."), known)), F.startswith(F.col("low"), F.concat(known, F.lit("-")))
    kind = F.when(F.col("low") == known, 0).when(tail, 1).when(head, 2)
    found = names.join(dim, tail | (F.col("low") == known) | head)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("model_id").orderBy(kind, F.desc(F.length("model")), "model"))).where("r = 1")
    out = usage.join(best.select("model_id", "model", "usd_in", "usd_out", "usd_read", "usd_write"), "model_id", "left")  # a row a model name
    rates = {"usd_in": UNKNOWN[0], "usd_out": UNKNOWN[1], "usd_read": UNKNOWN[0] * CACHE_READ, "usd_write": UNKNOWN[0] * CACHE_WRITE}
    return out.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in rates.items()})


def cost() -> Column:
    return (F.col("input") * F.col("usd_in") + F.col("output") * F.col("usd_out") + F.col("cache_read") * F.col("usd_read") + F.col("cache_write") * F.col("usd_write")) / 1_000_000


def token_cost(model: Column, prompt: Column, completion: Column, cited: Column, reasoned: Column, searches: Column) -> Column:
    """Dollars of a researcher that bills tokens and searches; a model without rates of its own has those of deep research."""
    rates = F.create_map(*[x for k, r in TOKEN_RATES.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in r]))])
    rate = F.coalesce(F.try_element_at(rates, model), F.array(*[F.lit(float(v)) for v in TOKEN_RATES["sonar-deep-research"]]))
    of = lambda n, k: F.coalesce(n, F.lit(0)) * rate[k]
    return (of(prompt, 0) + of(completion, 1) + of(cited, 2) + of(reasoned, 3)) / 1_000_000 + of(searches, 4) / 1000


def run_cost(processor: Column, told: Column) -> Column:
    """Dollars of a researcher that bills runs: what the caller was told, else the processor's price, else unknown."""
    return F.coalesce(told, F.try_element_at(F.create_map(*[F.lit(x) for pair in RUN_PRICES.items() for x in pair]), processor))


def crossings(spend: DataFrame, total: float) -> DataFrame:
    """The event at which each run's spend first reaches each share of the total."""
    running = F.sum("cents").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    reached = spend.withColumn("spent", running).withColumn("share", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where(F.col("spent") >= F.col("share") * total)
    return reached.groupBy("run_id", "share").agg(F.min("seq").alias("seq"))


def budget_fold(ops: DataFrame, total: float) -> DataFrame:
    """The meter after each run's operations in order: charge, reserve, settle, release. A run is one state, so one group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used = held = 0.0
        open_holds: list[float] = []
        for op, usd in rows.sort_values("seq")[["op", "usd"]].itertuples(index=False):
            if op == "charge" and usd > 0:
                used += usd
            elif op == "reserve" and usd > 0:
                amount = min(usd, max(0.0, total - used - held))
                if amount > 0:
                    held += amount
                    open_holds.append(amount)
            elif op in ("settle", "release") and open_holds:
                held = max(0.0, held - open_holds.pop(0))
                used += max(0.0, usd) if op == "settle" else 0.0
        return pd.DataFrame([(rows.run_id.iloc[0], round(used, 6), round(held, 6), bool(used >= total - 1e-9))], columns=["run_id", "used", "held", "exhausted"])

    return ops.groupBy("run_id").applyInPandas(fold, "run_id string, used double, held double, exhausted boolean")


def aimd_fold(signals: DataFrame, start: int = 4, least: int = 1, most: int = 16) -> DataFrame:
    """The width of each run's gate after its signals: one more after twice the width of successes, half on a throttle."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        width, clean = start, 0
        for good in rows.sort_values("seq").good:
            if not good:
                width, clean = max(least, width // 2), 0
            elif width < most:
                clean += 1
                if clean >= 2 * width:
                    width, clean = width + 1, 0
        return pd.DataFrame([(rows.run_id.iloc[0], width)], columns=["run_id", "width"])

    return signals.groupBy("run_id").applyInPandas(fold, "run_id string, width long")


#: The keyed histograms of a run's diagnostics: name, key, which events.
HISTOGRAMS = (("by_method", "method", "type = 'source.fetched'"), ("warnings", "code", "type = 'source.fetched' AND code IS NOT NULL"), ("errors", "code", "type = 'tool.event' AND code IS NOT NULL"), ("hosts", "host", "type = 'source.fetched'"),
              ("rejected_hosts", "host", "type = 'tool.event'"), ("thin_hosts", "host", "type = 'source.fetched' AND cents < 300"), ("votes", "status", "type = 'report.delta'"))


def diagnostics(events: DataFrame) -> DataFrame:
    """Counters and keyed histograms of each run from one pass: counted by run and key first, so no run is gathered before it is small."""
    kinds = F.array(*[F.when(F.expr(when), F.struct(F.lit(name).alias("name"), F.col(key).alias("key"))) for name, key, when in HISTOGRAMS])
    counted = events.groupBy("run_id", "type", kinds.alias("kinds")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    is_ = lambda *types: F.col("type").isin(*types)
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    sums = counted.groupBy("run_id").agg(
        total(is_("search.completed", "run.error")).alias("searches"), total(is_("run.error")).alias("search_failures"), total(is_("source.fetched")).alias("fetched"), total(is_("tool.event")).alias("rejected"),
        F.coalesce(F.sum(F.when(is_("source.fetched"), F.col("cents"))), F.lit(0)).cast("long").alias("chars"),
    )
    rows = counted.select("run_id", "n", F.explode(F.array_compact("kinds")).alias("k")).groupBy("run_id", "k").agg(F.sum("n").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k.key", "n"))), lambda x: F.concat_ws(":", x["key"], x["n"].cast("string"))), ",")
    wide = rows.groupBy("run_id").pivot("k.name", [h[0] for h in HISTOGRAMS]).agg(listed)
    return sums.join(wide, "run_id", "left").withColumns({h[0]: F.coalesce(F.nullif(F.col(h[0]), F.lit("")), F.lit("-")) for h in HISTOGRAMS})


def tool_histogram(steps: DataFrame) -> DataFrame:
    """Calls of each tool in the nested blocks of each run's steps."""
    blocks = steps.select("conv_id", F.explode("blocks").alias("b")).where("b.type = 'tool-call'")
    return blocks.groupBy("conv_id", F.col("b.tool").alias("tool")).agg(F.count("*").alias("n"))


def _sourced(j: DataFrame) -> DataFrame:
    return j.select("run_id", "type", "cents", F.concat(F.lit("m"), F.col("seq") % 3).alias("method"), F.when(F.col("seq") % 4 > 0, F.concat(F.lit("c"), F.col("seq") % 4)).alias("code"), F.concat(F.lit("h"), F.col("seq") % 5).alias("host"), F.element_at(F.array(F.lit("confirmed"), F.lit("refuted")), (F.col("seq") % 2 + 1).cast("int")).alias("status"))


def _steps(c: DataFrame) -> DataFrame:
    call = lambda when, name: F.when(when, F.struct(F.lit("tool-call").alias("type"), F.lit(name).alias("tool")))
    said = F.struct(F.lit("text").alias("type"), F.lit("said").alias("tool"))
    return c.select("conv_id", F.array_compact(F.array(said, call(F.col("turn") % 2 == 0, "search"), call(F.length("text") % 3 == 0, "fetch"), call(F.col("role") == "user", "note"))).alias("blocks"))


SOURCED = "SELECT run_id, type, cents, 'm' || (seq % 3) AS method, CASE WHEN seq % 4 > 0 THEN 'c' || (seq % 4) END AS code, 'h' || (seq % 5) AS host, CASE seq % 2 WHEN 0 THEN 'confirmed' ELSE 'refuted' END AS status FROM journal"
PRICED = """(SELECT u.*, coalesce(p.i, 3.0) AS usd_in, coalesce(p.o, 15.0) AS usd_out, p.m AS model FROM usage u LEFT JOIN
  (VALUES ('gpt-5', 'gpt-5', 1.25, 10.0), ('GPT-5-mini', 'gpt-5-mini', 0.25, 2.0), ('gpt-4o-2024-08-06', 'gpt-4o', 2.5, 10.0), ('vendor.gpt-4o-mini', 'gpt-4o-mini', 0.15, 0.6), ('gemini-2.5-pro-preview', 'gemini-2.5-pro', 1.25, 10.0), ('eu.vendor.gpt-5-nano', 'gpt-5-nano', 0.05, 0.4)) p(id_, m, i, o) ON u.model_id = p.id_)"""
COST = "(input * usd_in::DOUBLE + output * usd_out::DOUBLE + cache_read * usd_in::DOUBLE * 0.1::DOUBLE + cache_write * usd_in::DOUBLE * 1.25::DOUBLE) / 1000000"

register("jn15_price_lookup", "usage", lambda u: priced(u).select("id", "model", "usd_in", "usd_out"), f"SELECT id, model, usd_in::DOUBLE AS usd_in, usd_out::DOUBLE AS usd_out FROM {PRICED}")
register("jn16_exact_price", "usage", lambda u: u.withColumn("model", F.regexp_replace("model_id", r"^[^.]*\.", "")).join(F.broadcast(price_table(u.sparkSession)), "model", "left").select("id", "model", "usd_in"), "SELECT id, regexp_replace(model_id, '^[^.]*\\.', '') AS model, p::DOUBLE AS usd_in FROM usage LEFT JOIN (VALUES ('gpt-5', 1.25), ('gpt-5-mini', 0.25), ('gpt-5-nano', 0.05), ('gpt-4o', 2.5), ('gpt-4o-mini', 0.15), ('gemini-2.5-pro', 1.25)) t(m, p) ON regexp_replace(model_id, '^[^.]*\\.', '') = m")
register("ag24_usage_by_role", "usage", lambda u: u.groupBy("run_id", "role").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum(F.col("input") + F.col("output") + F.col("cache_write")).alias("fresh")), "SELECT run_id, role, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(input + output + cache_write)::BIGINT AS fresh FROM usage GROUP BY 1, 2")
register("ag25_normalised_usage", "usage", lambda u: u.select("id", F.greatest(F.lit(0), F.col("input") - F.col("cache_read") - F.col("cache_write")).alias("uncached")), "SELECT id, greatest(0, input - cache_read - cache_write) AS uncached FROM usage")
register("ag26_usage_cost", "usage", lambda u: priced(u).select("id", rounded(cost(), 8).alias("usd")), f"SELECT id, floor({COST} * 1e8 + 0.5) / 1e8 AS usd FROM {PRICED}")
register("ag28_connector_cost", "usage", lambda u: u.select("id", rounded(token_cost(F.element_at(F.array(*map(F.lit, [*TOKEN_RATES, "other"])), (F.col("id") % 4 + 1).cast("int")), F.col("input"), F.col("output"), F.col("cache_read"), F.col("cache_write"), F.col("id") % 9), 8).alias("by_token"), run_cost(F.element_at(F.array(*map(F.lit, [*RUN_PRICES, "other"])), (F.col("id") % 10 + 1).cast("int")), F.when(F.col("id") % 23 == 0, 7.0)).alias("by_run")), f"SELECT id, floor(((input * r[1] + output * r[2] + cache_read * r[3] + cache_write * r[4]) / 1e6 + (id % 9) / 1e3 * r[5]) * 1e8 + 0.5) / 1e8 AS by_token, coalesce(CASE WHEN id % 23 = 0 THEN 7.0 END, {[*RUN_PRICES.values(), 0.0]}[id % 10 + 1])::DOUBLE AS by_run FROM (SELECT *, {[[float(x) for x in r] for r in [*TOKEN_RATES.values(), TOKEN_RATES['sonar-deep-research']]]}[id % 4 + 1]::DOUBLE[] AS r FROM usage)".replace("0.0][id % 10 + 1]", "NULL][id % 10 + 1]"))
register("xs28_usage_sum", "usage", lambda u: u.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")]), "SELECT run_id, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM usage GROUP BY 1")
register("ag31_run_metrics", "usage", lambda u: u.groupBy("run_id", "role").agg(F.sum("input").alias("n")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m")).select("run_id", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("input")), "SELECT run_id, sum(input)::BIGINT AS input FROM usage GROUP BY 1")
register("ss05_thresholds", "journal", lambda j: crossings(j.where("kind = 'call'").select("run_id", "seq", "cents"), 20_000.0), "SELECT run_id, t::DOUBLE AS share, min(seq) AS seq FROM (SELECT run_id, seq, sum(cents) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM journal WHERE kind = 'call'), (VALUES (0.5), (0.8), (0.95)) v(t) WHERE spent >= t::DOUBLE * 20000 GROUP BY 1, 2")
register("ss04_budget_fold", "journal", lambda j: budget_fold(j.select("run_id", "seq", F.element_at(F.array(*map(F.lit, ("charge", "reserve", "settle", "release"))), (F.col("seq") % 4 + 1).cast("int")).alias("op"), (F.col("cents") / 100).alias("usd")), 2_000.0))
register("ss06_aimd", "journal", lambda j: aimd_fold(j.select("run_id", "seq", (F.col("seq") % 13 != 0).alias("good"))))
register("ag30_run_stats", "journal", lambda j: j.groupBy("run_id").agg(F.count_if(F.col("type") == "search.completed").alias("searches"), F.count_if(F.col("type") == "source.fetched").alias("sources"), F.max("seq").alias("last_seq"), F.sum("cents").alias("cents")), "SELECT run_id, count(*) FILTER (type = 'search.completed') AS searches, count(*) FILTER (type = 'source.fetched') AS sources, max(seq) AS last_seq, sum(cents)::BIGINT AS cents FROM journal GROUP BY 1")
register("ag10_diagnostics", "journal", lambda j: diagnostics(_sourced(j)), f"WITH j AS ({SOURCED}) SELECT run_id, count(*) FILTER (type IN ('search.completed', 'run.error')) AS searches, count(*) FILTER (type = 'run.error') AS search_failures, count(*) FILTER (type = 'source.fetched') AS fetched, count(*) FILTER (type = 'tool.event') AS rejected, coalesce(sum(cents) FILTER (type = 'source.fetched'), 0)::BIGINT AS chars, {', '.join(f'(SELECT coalesce(string_agg(k || chr(58) || n, chr(44) ORDER BY k), chr(45)) FROM (SELECT {e} AS k, count(*) AS n FROM j x WHERE x.run_id = j.run_id AND {w} GROUP BY 1)) AS {n}' for n, e, w in HISTOGRAMS)} FROM j GROUP BY run_id")
register("ag11_histogram", "journal", lambda j: j.groupBy("run_id", "type").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws(":", x["type"], x["n"].cast("string"))), ",").alias("counts")), "SELECT run_id, string_agg(type || ':' || n, ',' ORDER BY type) AS counts FROM (SELECT run_id, type, count(*) AS n FROM journal GROUP BY 1, 2) GROUP BY 1")
register("ag08_map_merge", "journal", lambda j: j.groupBy("run_id", "type").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("m")).select(F.explode("m").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n")), "SELECT type, count(*) AS n FROM journal GROUP BY 1")
register("ag20_tool_histogram", "conversations", lambda c: tool_histogram(_steps(c)), "SELECT conv_id, tool, count(*) AS n FROM (SELECT conv_id, unnest(list_filter([CASE WHEN turn % 2 = 0 THEN 'search' END, CASE WHEN length(text) % 3 = 0 THEN 'fetch' END, CASE WHEN role = 'user' THEN 'note' END], lambda x: x IS NOT NULL)) AS tool FROM conversations) GROUP BY 1, 2")
register("ag23_role_summary", "conversations", lambda c: c.groupBy("role").agg(F.count("*").alias("steps"), F.min("turn").alias("first"), F.max("turn").alias("last")), "SELECT role, count(*) AS steps, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1")
