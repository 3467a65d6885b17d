"""Evidence ledger, citations, quote grounding, near-duplicate queries, replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, query_tokens
from ..plans.ordered import numbered as in_order
from ..plans.registry import register, rounded

OPENING = ("add", "retarget")


def slot_states(events: DataFrame) -> DataFrame:
    """The last event of each slot that changes its state decides: adding and retargeting open it, closing fills it, exhausting gives it up."""
    order = Window.partitionBy("run_id", "slot_id").orderBy(F.desc("seq"))
    last = events.withColumn("r", F.row_number().over(order)).where("r = 1")
    state = F.when(F.col("op").isin(*OPENING), "open").when(F.col("op") == "exhaust", "exhausted").otherwise("answered")
    return last.select("run_id", "slot_id", state.alias("state"), F.when(state == "answered", F.col("value")).alias("value"), "importance")


def ledger_status(states: DataFrame) -> DataFrame:
    filled = F.col("state") != "open"
    return states.groupBy("run_id").agg(F.count("*").alias("slots"), F.count_if(F.col("state") == "answered").alias("answered"), F.count_if(~filled).alias("open"), F.bool_and(filled).alias("all_filled"))


def numbered(markers: DataFrame, by: str = "doc_id") -> DataFrame:
    """Citation numbers in the order in which a text first names its sources."""
    firsts = markers.groupBy(by, "source").agg(F.min("at").alias("first"))
    return firsts.withColumn("marker", F.row_number().over(Window.partitionBy(by).orderBy("first", "source")))


def grounded(quotes: DataFrame, docs: DataFrame, least: int = 12) -> DataFrame:
    """Quotes of ``least`` characters or more that their document has, white space and case aside."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    joined = quotes.join(docs.select(F.col("doc_id"), F.col("text").alias("__text")), "doc_id", "left")
    return joined.select("quote_id", F.coalesce((F.length(flat("quote")) >= least) & F.contains(flat("__text"), flat("quote")), F.lit(False)).alias("supported"))


def near_pairs(queries: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """Pairs of queries whose token sets overlap by ``least`` or more. Such sets share a token among the ceil((1 - least) * n) + 1 first
    in one order of all tokens, rare ones first, so only those are joined; the count decides."""
    sets = queries.select(key, query_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    rows = sets.select(key, F.explode("tokens").alias("t"))
    order = Window.partitionBy(key).orderBy("df", "t")
    some = rows.join(rows.groupBy("t").agg(F.count("*").alias("df")), "t").withColumn("r", F.row_number().over(order))
    some = some.join(sets.select(key, F.size("tokens").alias("n")), key).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(key, "t")
    left, right = some.select(F.col(key).alias("a"), "t"), some.select(F.col(key).alias("b"), "t")
    pairs = left.join(right, "t").where("a < b").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col(key).alias("b"), F.col("tokens").alias("y")), "b")
    return both.withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= least).select("a", "b", rounded(F.col("similarity")).alias("similarity"))


def audited(queries: DataFrame, fetched: Column, key: str, text: str) -> DataFrame:
    """One row: queries, distinct ones case and outer blanks aside, near-duplicate pairs, and queries for each that led to a fetch."""
    counts = queries.agg(F.count("*").alias("queries"), F.count_distinct(F.lower(F.trim(text))).alias("unique_exact"), F.count_if(fetched).alias("f"))
    pairs = near_pairs(queries, key, text).agg(F.count("*").alias("near_dup_pairs"))
    return counts.crossJoin(F.broadcast(pairs)).select("queries", "unique_exact", "near_dup_pairs", rounded(F.col("queries") / F.nullif(F.col("f"), F.lit(0)), 1).alias("queries_per_fetch"))  # one row each


def covered(slots: DataFrame, update: DataFrame) -> DataFrame:
    """Slots after a coverage update (run_id, slot_id, verdict): what is filled stays, exhausted beats closed, the rest stays open."""
    told = update.groupBy("run_id", "slot_id").agg(F.bool_or(F.col("verdict") == "exhausted").alias("gone"))
    state = F.when(F.col("state") != "open", F.col("state")).when(F.col("gone"), "exhausted").when(F.col("gone").isNotNull(), "stated").otherwise("open")
    return slots.join(told, ["run_id", "slot_id"], "left").select("run_id", "slot_id", state.alias("state"))


def registered(docs: DataFrame, warning: str) -> DataFrame:
    """(kind, doc_id, note) from one scan of fetched documents: each is inserted; a warning that makes it no evidence is a dead end; failed attempts before it are an escalation."""
    dead = F.try_element_at(F.filter("warnings", lambda w: F.startswith(w, F.lit(warning))), F.lit(1))
    failed = F.transform(F.filter("attempts", lambda a: ~a["ok"]), lambda a: a["method"])
    rows = F.array(F.struct(F.lit("insert").alias("kind"), F.col("source").alias("note")), F.when(dead.isNotNull(), F.struct(F.lit("dead_end").alias("kind"), dead.alias("note"))), F.when(F.size(failed) > 0, F.struct(F.lit("escalated").alias("kind"), F.array_join(failed, ",").alias("note"))))
    return docs.select("doc_id", F.explode(F.array_compact(rows)).alias("r")).select("r.kind", "doc_id", "r.note")


def source_list(sources: DataFrame, order: str, by: str = "run_id") -> DataFrame:
    """A line for each source that a run has fetched, the first of each id, in order; by its title, or its address if it has none."""
    first = F.row_number().over(Window.partitionBy(by, "source_id").orderBy(order)) == 1
    once = sources.where(F.coalesce(F.col("source_id"), F.lit("")) != "").withColumn("__first", first).where("__first")
    line = F.concat(F.lit("- ["), "source_id", F.lit("] "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")))
    return once.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("sources"))


def _asked(b: DataFrame) -> DataFrame:
    return b.select("item_id", "text").union(b.select(F.col("item_id") + 100_000, F.concat("text", F.lit(" extra")).alias("text"))).union(b.where("item_id % 4 = 0").select(F.col("item_id") + 200_000, F.concat(F.lit(" "), F.lower("text"))))


def replayed(requests: DataFrame, journal: DataFrame) -> DataFrame:
    """The k-th request of a key takes the journal's k-th entry of that key."""
    at = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("call_key").orderBy("seq")))
    return at(requests).select("call_key", "k", F.col("seq").alias("request")).join(at(journal).select("call_key", "k", F.col("seq").alias("entry")), ["call_key", "k"], "left")


def scoped(docs: DataFrame, ids: DataFrame, key: str = "source") -> DataFrame:
    """The documents of the given ids; all documents if there is no id that any of them has."""
    found = docs.join(ids.select(key), key, "left_semi")
    return found.unionByName(docs.join(F.broadcast(found.limit(1).select(F.lit(1).alias("__any"))), how="left_anti").select(found.columns))


def draft_fold(ops: DataFrame) -> DataFrame:
    """The draft after each run's set and patch operations: a patch replaces the first exact occurrence, a miss is counted."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        draft, misses = "", 0
        for op, old, new in rows.sort_values("seq")[["op", "old", "new"]].itertuples(index=False):
            if op == "set":
                draft = new
            elif old and old in draft:
                draft = draft.replace(old, new, 1)
            else:
                misses += 1
        return pd.DataFrame([(rows.run_id.iloc[0], draft, misses)], columns=["run_id", "draft", "misses"])

    return ops.groupBy("run_id").applyInPandas(fold, "run_id string, draft string, misses long")


def bounded_fifo(events: DataFrame, cap: int = 80) -> DataFrame:
    """The candidates that a first-in first-out set of ``cap`` holds in the end; one that was put out may come again."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        for key, seq in rows.sort_values("seq")[["key", "seq"]].itertuples(index=False):
            if key not in held:
                if len(held) >= cap:
                    del held[next(iter(held))]
                held[key] = seq
        return pd.DataFrame([(rows.run_id.iloc[0], k, s) for k, s in held.items()], columns=["run_id", "key", "seq"])

    return events.groupBy("run_id").applyInPandas(fold, "run_id string, key string, seq long")


def _markers(d: DataFrame) -> DataFrame:
    """Words of a text as if they named sources, each by its length."""
    some = d.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "w"))
    return some.select("doc_id", "at", F.concat(F.lit("source_"), F.length("w").cast("string")).alias("source"))


STATES = "(SELECT run_id, slot_id, CASE WHEN op IN ('add', 'retarget') THEN 'open' WHEN op = 'exhaust' THEN 'exhausted' ELSE 'answered' END AS state, CASE WHEN op LIKE 'close%' THEN value END AS value, importance FROM (SELECT *, row_number() OVER (PARTITION BY run_id, slot_id ORDER BY seq DESC) AS r FROM slot_events) WHERE r = 1)"
MARKS = "(SELECT doc_id, p AS at_, 'source_' || length(w) AS source FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)))"
ASKED = "(SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 100000, text || ' extra' FROM benchmark UNION ALL SELECT item_id + 200000, ' ' || lower(text) FROM benchmark WHERE item_id % 4 = 0)"
NUMBERED = f"(SELECT doc_id, source, min(at_)::INT AS first, row_number() OVER (PARTITION BY doc_id ORDER BY min(at_), source)::INT AS marker FROM {MARKS} GROUP BY doc_id, source)"
TOKENS = r"(SELECT item_id, list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\b(or|and|the|of|in|on|for|to|a|an|site)\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS t FROM benchmark)"

register("ss09_slot_states", "slot_events", slot_states, f"SELECT * FROM {STATES}")
register("ss10_coverage", "slot_events", lambda e: covered(slot_states(e), e.select("run_id", "slot_id", F.when(F.col("seq") % 7 == 0, "exhausted").when(F.col("seq") % 5 == 0, "closed").alias("verdict")).where("verdict IS NOT NULL AND slot_id <> 's3'")), f"SELECT s.run_id, s.slot_id, CASE WHEN state <> 'open' THEN state WHEN gone THEN 'exhausted' WHEN gone IS NOT NULL THEN 'stated' ELSE 'open' END AS state FROM {STATES} s LEFT JOIN (SELECT run_id, slot_id, bool_or(seq % 7 = 0) AS gone FROM slot_events WHERE (seq % 7 = 0 OR seq % 5 = 0) AND slot_id <> 's3' GROUP BY 1, 2) USING (run_id, slot_id)")
register("ss11_ledger_status", "slot_events", lambda e: ledger_status(slot_states(e)), f"SELECT run_id, count(*) AS slots, count(*) FILTER (state = 'answered') AS answered, count(*) FILTER (state = 'open') AS open, bool_and(state <> 'open') AS all_filled FROM {STATES} GROUP BY 1")
register("ss12_seed", "benchmark", lambda b: in_order(b.where(F.length("text") > 40).orderBy("item_id").limit(14), "r", [F.col("item_id")]).select(F.concat(F.lit("s"), "r").alias("slot_id"), "item_id"), "SELECT 's' || row_number() OVER (ORDER BY item_id) AS slot_id, item_id FROM benchmark WHERE length(text) > 40 ORDER BY item_id LIMIT 14")
register("ss13_render", "slot_events", lambda e: slot_states(e).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot_id", "state"))), lambda x: F.concat_ws("=", x["slot_id"], x["state"])), "; ").alias("ledger")), f"SELECT run_id, string_agg(slot_id || '=' || state, '; ' ORDER BY slot_id) AS ledger FROM {STATES} GROUP BY 1")
register("ss14_source_priming", "documents", lambda d: d.groupBy("lang").agg((F.max(F.regexp_extract("source", r"^src(\d+)$", 1).cast("long")) + 1).alias("next")), "SELECT lang, max(regexp_extract(source, '^src(\\d+)$', 1)::BIGINT) + 1 AS next FROM documents GROUP BY 1")
register("st11_slot_dedupe", "slot_events", lambda e: e.where("op = 'add'").withColumn("k", F.lower(F.trim(F.concat(F.lit(" Slot "), F.col("slot_id"))))).withColumn("r", F.row_number().over(Window.partitionBy("run_id", "k").orderBy("seq"))).where("r = 1").select("run_id", "k", "seq"), "SELECT run_id, 'slot ' || slot_id AS k, min(seq) AS seq FROM slot_events WHERE op = 'add' GROUP BY ALL")
register("xs25_next_slot", "slot_events", lambda e: e.groupBy("run_id").agg((F.max(F.substring("slot_id", 2, 9).cast("long")) + 1).alias("next")), "SELECT run_id, max(slot_id[2:]::BIGINT) + 1 AS next FROM slot_events GROUP BY 1")
register("so06_gap_priority", "slot_events", lambda e: slot_states(e).where("state = 'open'").withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("importance") != "central", "slot_id"))).select("run_id", "place", "slot_id", "importance"), f"SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY importance <> 'central', slot_id)::INT AS place, slot_id, importance FROM {STATES} WHERE state = 'open'")
register("jn19_gap_importance", "slot_events", lambda e: e.where("op = 'exhaust'").select("run_id", "slot_id", "seq").join(slot_states(e).select("run_id", "slot_id", "importance"), ["run_id", "slot_id"], "left"), f"SELECT a.run_id, a.slot_id, seq, b.importance FROM slot_events a LEFT JOIN {STATES} b ON a.run_id = b.run_id AND a.slot_id = b.slot_id WHERE op = 'exhaust'")
register("wn04_citation_numbers", "documents", lambda d: numbered(_markers(d)).select("doc_id", "source", "first", "marker"), f"SELECT * FROM {NUMBERED}")
register("jn11_citation_binding", "documents", lambda d: numbered(_markers(d)).join(d.select(F.concat(F.lit("source_"), F.col("doc_id")).alias("source"), "lang"), "source", "left").select("doc_id", "source", "marker", F.col("lang").isNotNull().alias("bound")), f"SELECT n.doc_id, n.source, marker, d.doc_id IS NOT NULL AS bound FROM {NUMBERED} n LEFT JOIN documents d ON n.source = 'source_' || d.doc_id")
register("jn10_uncited", "documents", lambda d: d.select(F.concat(F.lit("source_"), F.col("doc_id")).alias("source")).join(_markers(d), "source", "left_anti"), f"SELECT 'source_' || doc_id AS source FROM documents WHERE 'source_' || doc_id NOT IN (SELECT source FROM {MARKS})")
register("ag22_yield", "documents", lambda d: d.select("source", F.concat(F.lit("source_"), F.col("doc_id")).alias("id")).join(_markers(d).select(F.col("source").alias("id")).distinct().withColumn("cited", F.lit(1)), "id", "left").groupBy("source").agg(F.count("*").alias("fetched"), F.count("cited").alias("cited")), f"SELECT source, count(*) AS fetched, count(*) FILTER ('source_' || doc_id IN (SELECT source FROM {MARKS})) AS cited FROM documents GROUP BY 1")
register("jn13_grounding", "documents", lambda d: grounded(d.select(F.col("doc_id").alias("quote_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"), F.substring("text", 11, 30).alias("quote")), d), "SELECT q.doc_id AS quote_id, coalesce(length(trim(regexp_replace(lower(q.text[11:40]), '\\s+', ' ', 'g'), ' ')) >= 12 AND contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(lower(q.text[11:40]), '\\s+', ' ', 'g'), ' ')), FALSE) AS supported FROM documents q LEFT JOIN documents d ON d.doc_id = CASE WHEN q.doc_id % 3 = 0 THEN q.doc_id + 1 ELSE q.doc_id END")
register("jn14_scope", "documents", lambda d: scoped(d.select("doc_id", "source"), d.sparkSession.createDataFrame([("src1",), ("src2",), ("nowhere",)], "source string")).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'nowhere')")
register("jn09_near_queries", "benchmark", lambda b: near_pairs(_asked(b), "item_id", "text"), "SELECT x.item_id AS a, y.item_id AS b, floor(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) * 10000 + 0.5) / 10000 AS similarity FROM s x JOIN s y ON x.item_id < y.item_id WHERE len(x.t) > 0 AND len(y.t) > 0 AND len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.5".replace("SELECT x.item_id", f"WITH b AS {ASKED}, s AS " + TOKENS.replace("FROM benchmark", "FROM b") + " SELECT x.item_id", 1))
register("ag21_audit", "benchmark", lambda b: audited(_asked(b), F.col("item_id") % 3 == 0, "item_id", "text"), f"WITH b AS {ASKED}, s AS " + TOKENS.replace("FROM benchmark", "FROM b") + " SELECT (SELECT count(*) FROM b) AS queries, (SELECT count(DISTINCT lower(trim(text, ' '))) FROM b) AS unique_exact, (SELECT count(*) FROM s x JOIN s y ON x.item_id < y.item_id WHERE len(x.t) > 0 AND len(y.t) > 0 AND len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.5) AS near_dup_pairs, (SELECT floor(count(*) / count(*) FILTER (item_id % 3 = 0) * 10 + 0.5) / 10 FROM b) AS queries_per_fetch")
register("jn20_replay", "journal", lambda j: replayed(j.where("call_key IS NOT NULL AND kind = 'call' AND seq % 2 = 0"), j.where("call_key IS NOT NULL AND kind = 'call' AND seq % 2 = 1")), "SELECT call_key, k::INT AS k, a.seq AS request, b.seq AS entry FROM (SELECT call_key, seq, row_number() OVER (PARTITION BY call_key ORDER BY seq) AS k FROM journal WHERE call_key IS NOT NULL AND kind = 'call' AND seq % 2 = 0) a LEFT JOIN (SELECT call_key, seq, row_number() OVER (PARTITION BY call_key ORDER BY seq) AS k FROM journal WHERE call_key IS NOT NULL AND kind = 'call' AND seq % 2 = 1) b USING (call_key, k)")
register("ss03_resume_cost", "journal", lambda j: replayed(j.where("call_key IS NOT NULL AND seq >= 5000"), j.where("call_key IS NOT NULL AND seq < 5000")).groupBy(F.col("entry").isNotNull().alias("replayed")).agg(F.count("*").alias("calls")), "SELECT b.seq IS NOT NULL AS replayed, count(*) AS calls FROM (SELECT call_key, seq, row_number() OVER (PARTITION BY call_key ORDER BY seq) AS k FROM journal WHERE call_key IS NOT NULL AND seq >= 5000) a LEFT JOIN (SELECT call_key, seq, row_number() OVER (PARTITION BY call_key ORDER BY seq) AS k FROM journal WHERE call_key IS NOT NULL AND seq < 5000) b USING (call_key, k) GROUP BY 1")
register("ss08_trail", "events", lambda e: e.groupBy(F.concat(F.lit("q"), F.col("user_id") % 40).alias("key")).agg(F.max(F.floor("value")).alias("results"), F.min_by("event_type", "event_id").alias("reason")), "SELECT 'q' || (user_id % 40) AS key, max(floor(value))::BIGINT AS results, arg_min(event_type, event_id) AS reason FROM events GROUP BY 1")
register("ss19_stream_parts", "conversations", lambda c: c.groupBy("conv_id", "role").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")).alias("digest")), "SELECT conv_id, role, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1, 2")
register("xs22_draft_ops", "conversations", lambda c: draft_fold(c.select(F.concat(F.lit("c"), F.col("conv_id") % 50).alias("run_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.when(F.col("turn") == 0, "set").otherwise("patch").alias("op"), F.lit("the").alias("old"), F.when(F.col("turn") == 0, F.col("text")).otherwise(F.lit("THE")).alias("new"))))
register("so10_bounded_fifo", "events", lambda e: bounded_fifo(e.select(F.concat(F.lit("r"), F.col("user_id") % 5).alias("run_id"), F.concat(F.lit("u"), F.col("event_id") * 31 % 211).alias("key"), F.col("event_id").alias("seq"))))
register("xs18_register", "documents", lambda d: registered(d.select("doc_id", "source", F.when(F.length("text") < 300, F.array(F.lit("thin_content: short"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.array(F.struct(F.lit("direct").alias("method"), (F.col("doc_id") % 3 > 0).alias("ok")), F.struct(F.lit("scrape").alias("method"), (F.col("doc_id") % 2 > 0).alias("ok"))).alias("attempts")), "thin_content"), "SELECT 'insert' AS kind, doc_id, source AS note FROM documents UNION ALL SELECT 'dead_end', doc_id, 'thin_content: short' FROM documents WHERE length(text) < 300 UNION ALL SELECT 'escalated', doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'direct' END, CASE WHEN doc_id % 2 = 0 THEN 'scrape' END) FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
register("xs23_source_list", "hits", lambda h: source_list(h.select(F.col("provider").alias("run_id"), "hit_id", F.when(F.col("hit_id") % 11 > 0, F.concat(F.lit("source_"), F.col("hit_id") % 40)).alias("source_id"), F.when(F.col("hit_id") % 3 == 0, "").otherwise(F.col("title")).alias("title"), "url"), "hit_id"), "SELECT run_id, string_agg('- [' || source_id || '] ' || CASE WHEN hit_id % 3 = 0 THEN url ELSE title END, chr(10) ORDER BY hit_id) AS sources FROM (SELECT provider AS run_id, hit_id, 'source_' || (hit_id % 40) AS source_id, title, url, row_number() OVER (PARTITION BY provider, hit_id % 40 ORDER BY hit_id) AS r FROM hits WHERE hit_id % 11 > 0) WHERE r = 1 GROUP BY 1")
