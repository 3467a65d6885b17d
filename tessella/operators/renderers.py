"""What a run's ledger says to those who gather, check and write: contracts, audits and open slots as text, a run a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ANALYSIS_HEAD, CONTRACT_HEAD, DELIVERABLE_SHAPES, FACTS_HEAD, OPEN_HEAD, SHAPES
from ..plans.registry import register

QUOTE_CHARS = 200


def fill_value(fill: Column) -> Column:
    """A filled slot's value and where it is from; none for one that is only stated or exhausted."""
    value = fill["value"]
    return (
        F.when(fill["kind"] == "grounded", F.concat(value, F.lit(" ["), fill["source"], F.lit("]")))
        .when(fill["kind"] == "computed", F.concat(value, F.lit(" [computed from "), F.array_join(fill["computed_from"], ", "), F.lit("]")))
        .when(fill["kind"] == "given", F.concat(value, F.lit(" [given in the question]")))
    )


def slot_status(fill: Column) -> Column:
    return F.when(fill.isNull(), "open").when(fill["kind"] == "exhausted", "exhausted").otherwise("filled")


def _lines(line: Column, when: Column) -> Column:
    """Lines of a run's slots in the slots' order, null without any. A ledger is small: its slots come from one plan and its additions."""
    found = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("n"), line.alias("line")))))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x["line"]), "\n"))


def rendered(slots: DataFrame, by: str = "run_id") -> DataFrame:
    """(run_id, gather, audit, open, contract) of slots (run_id, n, id, ask, shape, kind, importance, fill), '' where there is nothing to say.

    gather: facts and analyses that are asked for. audit: every slot with its status and value. open: facts without a fill. contract: what was found, with
    what each of its shapes asks of a report, in the order in which they come, and the evidence's first QUOTE_CHARS characters.
    """
    fill = F.col("fill")
    asked = F.concat(F.lit("- ["), F.concat_ws(" · ", "id", "importance", "shape"), F.lit("] "), F.col("ask"))
    value = fill_value(fill)
    tail = F.coalesce(F.concat(F.lit(" -> "), value), F.when(fill["kind"] == "exhausted", F.concat(F.lit(" -> exhausted: "), fill["reason"])), F.lit(""))
    audit = F.concat(F.lit("["), F.concat_ws("·", F.col("id"), F.col("importance"), F.col("shape"), slot_status(fill)), F.lit("] "), F.col("ask"), tail)
    quote = F.trim(fill["quote"])
    found = F.concat(F.lit("- ["), F.col("shape"), F.lit("] "), F.col("ask"), F.lit(" -> "), value, F.when((fill["kind"] == "grounded") & (F.length(quote) > 0), F.concat(F.lit('\n    evidence: "'), F.substring(quote, 1, QUOTE_CHARS), F.lit('"'))).otherwise(""))
    fact = F.col("kind") == "fact"
    shapes = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("n", "shape"))))
    told = F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])
    legend = F.array_join(F.transform(F.array_distinct(F.transform(shapes, lambda x: x["shape"])), lambda s: F.concat(F.lit("- "), s, F.lit(": "), F.coalesce(F.element_at(told, s), F.lit("")))), "\n")
    every = slots.groupBy(by).agg(
        _lines(asked, fact).alias("facts"), _lines(asked, F.col("kind") == "analysis").alias("analyses"), _lines(audit, F.lit(True)).alias("audit"),
        _lines(asked, fact & fill.isNull()).alias("missing"), _lines(found, value.isNotNull()).alias("found"), legend.alias("legend"),
    )
    gather = F.concat_ws("\n\n", F.concat(F.lit(FACTS_HEAD + "\n"), "facts"), F.concat(F.lit(ANALYSIS_HEAD + "\n"), "analyses"))
    contract = F.concat(F.lit(CONTRACT_HEAD + "\n"), "legend", F.lit("\n\nFindings:\n"), "found")
    none = F.lit("")
    return every.select(by, gather.alias("gather"), F.coalesce("audit", none).alias("audit"), F.coalesce(F.concat(F.lit(OPEN_HEAD + "\n"), "missing"), none).alias("open"), F.coalesce(contract, none).alias("contract"))


def deliverable_shape(scope: Column) -> Column:
    """What form a report of this scope is to have."""
    single, short, broad = DELIVERABLE_SHAPES
    return F.when(scope == "single_fact", single).when(scope == "short_answer", short).otherwise(broad)


def _slots(e: DataFrame) -> DataFrame:
    """Slots of some runs, with fills of each kind, as a slot's first event has it."""
    n = F.col("n")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    fill = F.struct(
        pick("grounded", "computed", "given", "stated", "exhausted").alias("kind"), F.concat(F.lit("v"), n).alias("value"), F.concat(F.lit("source_"), n % 9).alias("source"), F.array(F.lit("a"), F.concat(F.lit("b"), n % 3)).alias("computed_from"),
        F.when(n % 10 > 0, F.concat(F.lit("  q"), n, F.lit(" "))).alias("quote"), F.concat(F.lit("r"), n).alias("reason"),
    )
    first = e.groupBy("run_id", F.col("slot_id").alias("id")).agg(F.min("seq").alias("n"), F.max("importance").alias("importance"))
    return first.select("run_id", "n", "id", "importance", F.concat(F.lit("ask "), n).alias("ask"), pick(*SHAPES).alias("shape"), F.when(n % 4 == 0, "analysis").otherwise("fact").alias("kind"), F.when(n % 7 < 5, fill).alias("fill"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    legend = f"MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in SHAPES.items())}}}"
    head = lambda x: quoted(x + "\n").replace("\n'", "' || chr(10)")
    agg = lambda line, when: f"string_agg({line}, chr(10) ORDER BY n) FILTER ({when})"
    return f"""WITH f AS (SELECT run_id, slot_id AS id, min(seq) AS n, max(importance) AS importance FROM slot_events GROUP BY 1, 2),
s AS (SELECT run_id, n, id, importance, 'ask ' || n AS ask, {list(SHAPES)}[n % {len(SHAPES)} + 1] AS shape, CASE WHEN n % 4 = 0 THEN 'analysis' ELSE 'fact' END AS kind,
  CASE WHEN n % 7 < 5 THEN ['grounded', 'computed', 'given', 'stated', 'exhausted'][n % 5 + 1] END AS fill FROM f),
v AS (SELECT *, '- [' || id || ' · ' || importance || ' · ' || shape || '] ' || ask AS line, CASE fill WHEN 'grounded' THEN 'v' || n || ' [source_' || (n % 9) || ']' WHEN 'computed' THEN 'v' || n || ' [computed from a, b' || (n % 3) || ']' WHEN 'given' THEN 'v' || n || ' [given in the question]' END AS value FROM s),
g AS (SELECT run_id, {agg('line', "kind = 'fact'")} AS facts, {agg('line', "kind = 'analysis'")} AS analyses, {agg('line', "kind = 'fact' AND fill IS NULL")} AS missing,
  string_agg('[' || id || '·' || importance || '·' || shape || '·' || CASE WHEN fill IS NULL THEN 'open' WHEN fill = 'exhausted' THEN 'exhausted' ELSE 'filled' END || '] ' || ask || coalesce(' -> ' || value, CASE WHEN fill = 'exhausted' THEN ' -> exhausted: r' || n END, ''), chr(10) ORDER BY n) AS audit,
  {agg("'- [' || shape || '] ' || ask || ' -> ' || value || CASE WHEN fill = 'grounded' AND n % 10 > 0 THEN chr(10) || '    evidence: \"q' || n || '\"' ELSE '' END", 'value IS NOT NULL')} AS found,
  list(shape ORDER BY n) FILTER (value IS NOT NULL) AS shapes FROM v GROUP BY 1),
l AS (SELECT *, array_to_string(list_transform(list_filter(shapes, lambda x, i: list_position(shapes, x) = i), lambda x: '- ' || x || ': ' || {legend}[x]), chr(10)) AS legend FROM g)
SELECT run_id, concat_ws(chr(10) || chr(10), {head(FACTS_HEAD)} || facts, {head(ANALYSIS_HEAD)} || analyses) AS gather, audit, coalesce({head(OPEN_HEAD)} || missing, '') AS open,
  coalesce({head(CONTRACT_HEAD)} || legend || chr(10) || chr(10) || 'Findings:' || chr(10) || found, '') AS contract FROM l"""


register("ss13_renderers", "slot_events", lambda e: rendered(_slots(e)), _sql())
