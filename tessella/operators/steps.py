"""Steps of traces and what is read back from untyped records: clamped text, content blocks, filters, transcripts, judged criteria, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CUT_MARK, MISSING_EVALUATION, NON_EVIDENCE, NOT_FOUND, ascii_edges
from ..plans.registry import register
from .trace import FIELD_CHARS, clamped

PARTS = "array<struct<type: string, text: string, toolName: string, input: string>>"
STEPS = "array<struct<seq: bigint, role: string, text: string>>"
CLAIMS = ("extracted", "unsupported", "verified", "confirmed", "contested", "refuted", "unverified")


def system_prompt(messages: Column, most: int = FIELD_CHARS) -> Column:
    """The text of a prompt's system messages, a blank line apart; '' without any."""
    said = F.filter(messages, lambda m: (m["role"] == "system") & m["content"].isNotNull())
    return clamped(F.array_join(F.transform(said, lambda m: m["content"]), "\n\n"), most)


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")


def content_blocks(parts: Column, most: int = FIELD_CHARS) -> Column:
    """Content of a message, PARTS, as a JSON array of blocks: texts and thoughts clamped, calls with their input read as JSON where it is some, results by name, others by type."""
    text = lambda p: quoted(clamped(F.coalesce(p["text"], F.lit("")), most))
    given = lambda p: clamped(F.coalesce(p["input"], F.lit("")), most)
    block = lambda p: (
        F.when(p["type"] == "text", F.concat(F.lit('{"type":"text","text":'), text(p), F.lit("}")))
        .when(p["type"] == "reasoning", F.concat(F.lit('{"type":"thinking","thinking":'), text(p), F.lit("}")))
        .when(p["type"] == "tool-call", F.concat(F.lit('{"type":"tool_call","name":'), quoted(p["toolName"]), F.lit(',"input":'), F.coalesce(F.to_json(F.try_parse_json(given(p))), quoted(given(p))), F.lit("}")))
        .when(p["type"] == "tool-result", F.concat(F.lit('{"type":"tool_result","toolName":'), quoted(p["toolName"]), F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":'), quoted(p["type"]), F.lit("}")))
    )
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), block), ","), F.lit("]"))


def is_evidence(warnings: Column) -> Column:
    """Whether no warning of a page makes it one that can't be cited."""
    return ~F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.rlike("(?i)" + ascii_edges(NON_EVIDENCE)))


def source_filter(meta: Column) -> Column:
    """(includeDomains, excludeDomains) of a run's untyped meta data; a list with anything but texts in it, or what is no list, is none, and without any there is no filter."""

    def listed(name: str) -> Column:
        value = F.try_variant_get(F.try_parse_json(meta), f"$.{name}", "array<variant>")
        texts = F.transform(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        return F.when(F.forall(texts, lambda t: t.isNotNull()), texts)

    include, exclude = listed("includeDomains"), listed("excludeDomains")
    return F.when(include.isNotNull() | exclude.isNotNull(), F.struct(include.alias("includeDomains"), exclude.alias("excludeDomains")))


def transcript_steps(blob: Column) -> Column:
    """Steps of a transcript blob, none of one that is missing or can't be read."""
    return F.coalesce(F.from_json(blob, STEPS), F.array().cast(STEPS))


def judged(criteria: DataFrame, evaluations: DataFrame, by: str = "case_id") -> DataFrame:
    """(by, criterion, verdict, reason, judge_error) of criteria (by, criterion) numbered from 0, from a judge's answer (by, criterion_idx, criterion_status, explanation) in one piece.

    An index that is no whole number is no answer, the last of several counts by ``seq``; a criterion without one is unmet and says so.
    """
    number = F.col("criterion_idx").try_cast("double")
    told = evaluations.where(number == F.floor(number)).select(by, number.cast("long").alias("criterion"), F.struct("seq", F.col("criterion_status").alias("status"), "explanation").alias("e"))
    last = told.groupBy(by, "criterion").agg(F.max("e").alias("e"))
    there = F.col("e").isNotNull()
    return criteria.join(last, [by, "criterion"], "left").select(
        by, "criterion", F.when(F.col("e.status") == "MET", "MET").otherwise("UNMET").alias("verdict"), F.when(there, F.coalesce("e.explanation", F.lit(""))).otherwise(NOT_FOUND).alias("reason"), F.when(~there, MISSING_EVALUATION).alias("judge_error"),
    )


def claim_health(results: DataFrame, claims: str = "claims") -> DataFrame:
    """Sums of what became of claims over results with a structure of CLAIMS; those without one count nothing. One row."""
    return results.agg(*[F.coalesce(F.sum(F.col(f"{claims}.{c}")), F.lit(0)).alias(c) for c in CLAIMS])


def _blocks(c: DataFrame) -> DataFrame:
    k = F.col("turn") % 5
    kind = F.element_at(F.array(*map(F.lit, ("text", "reasoning", "tool-call", "tool-result", "file"))), (k + 1).cast("int"))
    call = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{ "q": '), F.length("text"), F.lit(" }"))).otherwise("not json")
    parts = F.array(F.struct(kind.alias("type"), F.col("text"), F.col("role").alias("toolName"), call.alias("input")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"), F.lit("x").alias("toolName"), F.lit("y").alias("input")))
    return c.select("conv_id", "turn", content_blocks(parts.cast(PARTS)).alias("blocks"))


def _meta(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    include = F.when(i % 3 == 0, F.concat(F.lit('["a'), i % 7, F.lit('.org", "b.com"]'))).when(i % 3 == 1, F.concat(F.lit('["a.org", '), i % 7, F.lit("]"))).otherwise('"a.org"')
    meta = F.concat(F.lit('{"includeDomains": '), include, F.when(i % 5 == 0, ', "excludeDomains": ["c.net"]}').otherwise("}"))
    return e.select("event_id", source_filter(F.when(i % 11 > 0, meta)).alias("f")).select("event_id", F.array_join("f.includeDomains", "|").alias("include"), F.array_join("f.excludeDomains", "|").alias("exclude"))


def _transcripts(c: DataFrame) -> DataFrame:
    step = F.to_json(F.array(F.struct(F.col("turn").alias("seq"), "role", "text"), F.struct(F.col("turn").alias("seq"), F.lit("tool").alias("role"), F.lit("r").alias("text"))))
    blob = F.when(F.col("turn") % 4 == 0, F.lit(None)).when(F.col("turn") % 4 == 1, F.lit("[{broken")).otherwise(step)
    return c.select("conv_id", "turn", F.transform(transcript_steps(blob), lambda s: F.concat_ws(":", s["role"], F.md5(s["text"]))).alias("s")).select("conv_id", "turn", F.size("s").alias("steps"), F.array_join("s", ",").alias("read"))


def _judged(g: DataFrame) -> DataFrame:
    criteria = g.select("case_id", "criterion").distinct()
    answers = g.where("criterion % 6 <> 5").select("case_id", F.col("run").alias("seq"), F.when(F.col("criterion") % 6 == 4, F.concat("criterion", F.lit(".5"))).otherwise(F.col("criterion").cast("string")).alias("criterion_idx"), F.col("verdict").alias("criterion_status"), F.when(F.col("run") > 0, F.concat(F.lit("because "), "run")).alias("explanation"))
    return judged(criteria, answers)


def _claims(r: DataFrame) -> DataFrame:
    made = F.struct(*[(F.length("run_id") * (i + 1) + F.col("sources")).alias(c) for i, c in enumerate(CLAIMS)])
    return claim_health(r.select(F.when(F.col("status") == "scored", made).alias("claims")))


BLOCKS = """SELECT conv_id, turn, '[' || CASE turn % 5 WHEN 0 THEN '{"type":"text","text":' || to_json(text)::VARCHAR WHEN 1 THEN '{"type":"thinking","thinking":' || to_json(text)::VARCHAR
  WHEN 2 THEN '{"type":"tool_call","name":"' || role || '","input":' || CASE WHEN conv_id % 2 = 0 THEN '{"q":' || length(text) || '}' ELSE '"not json"' END WHEN 3 THEN '{"type":"tool_result","toolName":"' || role || '"' ELSE '{"type":"file"' END || '},{"type":"text","text":"' || role || '"}]' AS blocks FROM conversations"""
JUDGED = f"""WITH c AS (SELECT DISTINCT case_id, criterion FROM grades), a AS (SELECT case_id, criterion, max_by(verdict, run) AS v, max(run) AS r FROM grades WHERE criterion % 6 < 4 GROUP BY 1, 2)
SELECT case_id, criterion, CASE WHEN v = 'MET' THEN 'MET' ELSE 'UNMET' END AS verdict, CASE WHEN r IS NULL THEN '{NOT_FOUND}' WHEN r > 0 THEN 'because ' || r ELSE '' END AS reason, CASE WHEN r IS NULL THEN '{MISSING_EVALUATION}' END AS judge_error FROM c LEFT JOIN a USING (case_id, criterion)"""

register("xs32_clamp", "conversations", lambda c: c.select("conv_id", "turn", F.md5(clamped(F.col("text"), 300)).alias("digest")), f"SELECT conv_id, turn, md5(CASE WHEN length(text) > 300 THEN text[1:300] || '{CUT_MARK}' ELSE text END) AS digest FROM conversations")
register("xs32_system_prompt", "conversations", lambda c: c.select("conv_id", "turn", F.md5(system_prompt(F.array(F.struct(F.lit("system").alias("role"), F.col("text").alias("content")), F.struct(F.col("role"), F.lit("own").alias("content")), F.struct(F.lit("system").alias("role"), F.when(F.col("turn") % 2 == 0, "more").alias("content"))))).alias("digest")), "SELECT conv_id, turn, md5(text || CASE WHEN role = 'system' THEN chr(10) || chr(10) || 'own' ELSE '' END || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'more' ELSE '' END) AS digest FROM conversations")
register("fn36_blocks", "conversations", _blocks, BLOCKS)
register("pf09_non_evidence", "documents", lambda d: d.where(is_evidence(F.when(F.col("doc_id") % 4 > 0, F.array(F.concat("source", F.lit(": ok")), F.concat(F.element_at(F.array(*map(F.lit, ("Thin_Content", "thin_contents", "error_page", "slow"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(": "), "lang"))))).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 4 <> 2")
register("xs03_source_filter", "events", _meta, "SELECT event_id, CASE WHEN event_id % 11 > 0 AND event_id % 3 = 0 THEN 'a' || (event_id % 7) || '.org|b.com' END AS include, CASE WHEN event_id % 11 > 0 AND event_id % 5 = 0 THEN 'c.net' END AS exclude FROM events")
register("xs09_steps", "conversations", _transcripts, "SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN 0 ELSE 2 END::INT AS steps, CASE WHEN turn % 4 < 2 THEN '' ELSE role || ':' || md5(text) || ',tool:' || md5('r') END AS read FROM conversations")
register("jn18_judge_by_index", "grades", _judged, JUDGED)
register("ag09_claim_sums", "runs", _claims, "SELECT " + ", ".join(f"coalesce(sum(length(run_id) * {i + 1} + sources) FILTER (status = 'scored'), 0)::BIGINT AS {c}" for i, c in enumerate(CLAIMS)) + " FROM runs")
