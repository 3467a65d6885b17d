"""The extension surface: registered table functions, researchers, renderings of steps, sources and ledgers."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.fixed import GUESSED_VALUES, LEFTOVERS, RESERVED_TOOLS, ascii_edges
from ..functions.pages import mapped, robots_allowed
from ..plans.registry import register, rounded

RESERVED = frozenset(RESERVED_TOOLS)
NAME = re.compile(r"[A-Za-z][\w-]{0,63}")


class Researcher(Protocol):
    """What answers a question with a report, its sources and a cost."""

    def __call__(self, query: str) -> dict: ...


class ToolRegistry:
    """Named table functions: a name once, none of the reserved ones, registered with the session for SQL."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, set()

    def add(self, name: str, handler: type, returns: str | None) -> Callable:
        """Without ``returns`` the handler's analyze() says what it returns."""
        if not NAME.fullmatch(name) or name in RESERVED or name in self.names:
            raise ValueError(f"not a free tool name: {name}")
        made = udtf(handler, returnType=returns)
        self.spark.udtf.register(name.replace("-", "_"), made)
        self.names.add(name)
        return made


def table_tool(execute: Callable, adds: str) -> type:
    """A table function of ``execute(row, state, *args)`` for ``FROM tool(TABLE(rows) PARTITION BY ... ORDER BY ..., args)``.

    Its columns are those of its input and then ``adds``, whatever the input is; a column that the input has already is an error. ``row`` is a dictionary, ``state`` one
    that is empty at the begin of each part and kept from row to row; each tuple that comes back makes a row. Parts are dealt out by Spark and come row by row.
    """
    added = StructType.fromDDL(adds)

    class Tool:
        @staticmethod
        def analyze(rows: AnalyzeArgument, *args: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(rows.dataType, StructType):
                raise ValueError("the first argument has to be TABLE(...)")
            if twice := set(rows.dataType.names) & set(added.names):
                raise ValueError(f"the input has a column {min(twice)} already")
            return AnalyzeResult(schema=StructType([*rows.dataType.fields, *added.fields]))

        def __init__(self):
            self.state: dict = {}

        def eval(self, row, *args):
            for out in execute(row.asDict(), self.state, *args):
                yield (*row, *out)

    return Tool


def since_last(row: dict, state: dict, column: str):
    """How many rows ago this value of a column was there last, and how often it has been."""
    state["n"] = state.get("n", 0) + 1
    last, times = state.setdefault("seen", {}).get(row[column], (None, 0))
    state["seen"][row[column]] = (state["n"], times + 1)
    yield None if last is None else state["n"] - last, times + 1


def tooled(rows: DataFrame, tools: ToolRegistry | None = None) -> DataFrame:
    """Rows of a journal with what the tool since_last says of their types, run by run."""
    tools = tools or ToolRegistry(rows.sparkSession)
    if "since_last" not in tools.names:
        tools.add("since_last", table_tool(since_last, "ago long, times long"), None)
    return rows.sparkSession.sql("SELECT run_id, seq, type, ago, times FROM since_last(TABLE({rows}) PARTITION BY (run_id) ORDER BY (seq), 'type')", rows=rows)


class Grep:
    """Matches of a pattern in a text with their places and what stands around them."""

    def eval(self, text: str, pattern: str, ignore_case: bool, context: int, most: int):
        context, most = min(500, max(0, context)), min(200, max(1, most))
        for k, m in enumerate(re.finditer(pattern, text or "", re.I if ignore_case else 0)):
            if k == most:
                return
            yield m.start(), m[0], text[max(0, m.start() - context) : m.end() + context]


def stripped_guesses(ask: Column) -> Column:
    """A question without the figures that it guesses."""
    out = F.regexp_replace(ask, ascii_edges(GUESSED_VALUES), "")
    for pattern, by in LEFTOVERS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def step_line(role: Column, turn: Column, text: Column, most: int = 40) -> Column:
    shown = F.regexp_replace(F.substring(text, 1, most), r"\s+", " ")
    return F.format_string("#%d %s: %s", turn, role, F.when(F.length(text) > most, F.concat(shown, F.lit("…"))).otherwise(shown))


def grepped(docs: DataFrame, pattern: str) -> DataFrame:
    tool = udtf(Grep, returnType="at int, match string, around string")
    spark = docs.sparkSession
    spark.udtf.register("grep_text", tool)
    return spark.sql("SELECT d.doc_id, g.at, g.match FROM {docs} d, LATERAL grep_text(d.text, :pattern, false, 10, 200) g", args={"pattern": pattern}, docs=docs)


register("fn10_stripped_guesses", "part", lambda p: p.select("p_partkey", stripped_guesses(F.concat(F.lit("Is it $"), "p_partkey", F.lit(" or (~ 12%) of 3.5 , at "), "p_size", F.lit(" units?"))).alias("ask")), "SELECT p_partkey, 'Is it or of, at ' || p_size || ' units?' AS ask FROM part")
register("ud05_grep_table", "documents", lambda d: grepped(d, "[Tt]hat").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("at").alias("first")), "SELECT doc_id, least(200, len(regexp_extract_all(text, '[Tt]hat'))) AS n, (instr(text, regexp_extract(text, '[Tt]hat')) - 1)::INT AS first FROM documents WHERE regexp_matches(text, '[Tt]hat')")
class Words:
    """A tool that a user adds: the words of a text with their places."""

    def eval(self, text: str):
        yield from enumerate((text or "").split())


def registered(docs: DataFrame) -> DataFrame:
    """A user's tool under its name in SQL, and which names the registry takes."""
    tools = ToolRegistry(docs.sparkSession)
    tools.add("word-list", Words, "at int, word string")
    return docs.sparkSession.sql("SELECT d.item_id, count(*) AS n, max_by(w.word, w.at) AS last FROM {docs} d, LATERAL word_list(d.text) w GROUP BY d.item_id", docs=docs)


def free_names(names: DataFrame) -> DataFrame:
    """Names that a tool may take: of the allowed form, not reserved, the first of equals."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("id")) == 1
    return names.withColumn("first", first).select("id", (F.col("name").rlike(f"^{NAME.pattern}$") & ~F.col("name").isin(*RESERVED) & F.col("first")).alias("free"))


register("ud01_added_tool", "benchmark", registered, "SELECT item_id, len(w) AS n, w[-1] AS last FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0")
register("ud01_table_tool", "journal", lambda j: tooled(j.select("run_id", "seq", "type")), "SELECT run_id, seq, type, n - lag(n) OVER (PARTITION BY run_id, type ORDER BY n) AS ago, row_number() OVER (PARTITION BY run_id, type ORDER BY n) AS times FROM (SELECT run_id, seq, type, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM journal)")
register("ud02_tool_names", "events", lambda e: free_names(e.select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, ["search", "read", "grep", "read_source", "search_sources", "9lives", "my tool", "close_slot"])), (F.col("event_id") % 8 + 1).cast("int")).alias("kind")).select("id", F.when(F.col("id") % 3 == 0, F.concat("kind", F.lit("-"), (F.col("id") % 50).cast("string"))).otherwise(F.col("kind")).alias("name"))), "SELECT id, regexp_full_match(name, '[A-Za-z][\\w-]{0,63}') AND name NOT IN ('search', 'fetch', 'read_source', 'search_sources', 'run_code', 'note', 'close_slot', 'add_slot', 'retarget_slot') AND row_number() OVER (PARTITION BY name ORDER BY id) = 1 AS free FROM (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN k || '-' || (event_id % 50) ELSE k END AS name FROM (SELECT event_id, ['search', 'read', 'grep', 'read_source', 'search_sources', '9lives', 'my tool', 'close_slot'][event_id % 8 + 1] AS k FROM events))")
register("fn34_step_lines", "conversations", lambda c: c.select("conv_id", "turn", step_line(F.col("role"), F.col("turn"), F.col("text")).alias("line")), "SELECT conv_id, turn, '#' || turn || ' ' || role || ': ' || regexp_replace(text[1:40], '\\s+', ' ', 'g') || CASE WHEN length(text) > 40 THEN '…' ELSE '' END AS line FROM conversations")
register("xs20_footers", "slot_events", lambda e: e.where("op = 'add'").groupBy("run_id", "importance").agg(F.array_sort(F.collect_set("slot_id")).alias("ids")).groupBy("run_id").agg(F.array_join(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("importance", "ids"))), lambda x: x["ids"])), 1, 6), ",").alias("open_slots")), "SELECT run_id, array_to_string(list(slot_id ORDER BY importance, slot_id)[1:6], ',') AS open_slots FROM (SELECT DISTINCT run_id, importance, slot_id FROM slot_events WHERE op = 'add') GROUP BY 1")
register("xs11_case_detail", "runs cases", lambda r, c: c.join(r.where("commit_sha = 'k1'").groupBy("case_id").agg(F.max("run_id").alias("run_id")), "case_id", "left").select("case_id", F.when(F.col("run_id").isNotNull(), "run").otherwise("rubric").alias("answer"), F.coalesce("run_id", "problem").alias("key")), "SELECT case_id, CASE WHEN r.run_id IS NOT NULL THEN 'run' ELSE 'rubric' END AS answer, coalesce(r.run_id, problem) AS key FROM cases LEFT JOIN (SELECT case_id, max(run_id) AS run_id FROM runs WHERE commit_sha = 'k1' GROUP BY 1) r USING (case_id)")
register("xs10_default_commit", "runs", lambda r: r.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1).select("commit_sha"), "SELECT commit_sha FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 1")
register("xs27_scoped_grant", "events", lambda e: e.select("event_id", rounded(F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce(F.when(F.col("event_id") % 5 > 0, F.col("value") / 20), F.lit(0.15)))) * 10).alias("usd")), "SELECT event_id, floor(greatest(0.01::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN event_id % 5 > 0 THEN value / 20 END, 0.15::DOUBLE))) * 10 * 10000 + 0.5) / 10000 AS usd FROM events")
register("xs45_event_lines", "journal", lambda j: j.where("kind = 'event'").select("seq", F.format_string("[%s] %s %.2f", "run_id", "type", F.col("cents") / 100).alias("line")), "SELECT seq, printf('[%s] %s %.2f', run_id, type, cents / 100) AS line FROM journal WHERE kind = 'event'")
register("pf12_robots_match", "pages", lambda p: mapped(p.select("page_id"), "page_id long, allowed boolean", lambda i: (i, robots_allowed("User-agent: *\nDisallow: /a*c\nAllow: /abc$", "x", ("/abc", "/abcd", "/b")[i % 3]))), "SELECT page_id, page_id % 3 <> 1 AS allowed FROM pages")
register("jn12_roster_bind", "documents", lambda d: d.select("doc_id", F.explode(F.array(F.col("doc_id") % 7, F.lit(1), F.lit(9))).alias("ordinal")).join(F.broadcast(d.sparkSession.createDataFrame([(i, f"r{i}") for i in range(1, 6)], "ordinal long, member string")), "ordinal", "left").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("member"))).where("k = 1").select("doc_id", "ordinal", "member"), "SELECT DISTINCT doc_id, o AS ordinal, CASE WHEN o BETWEEN 1 AND 5 THEN 'r' || o END AS member FROM (SELECT doc_id, unnest([doc_id % 7, 1, 9]) AS o FROM documents)")
