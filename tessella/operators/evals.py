"""Rubric scoring, multi-run grading and suite summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import register, rounded

#: Sections that come first, in this order.
SECTION_ORDER = ("factual-accuracy", "breadth-and-depth-of-analysis", "presentation-quality", "citation-quality")
COVERAGE_FLOOR = 0.9


def score_columns(weight: str = "weight", verdict: str = "verdict") -> list[Column]:
    """Aggregates of a rubric: criteria, raw score, weights by sign, normalized score in [0, 1] and pass rate."""
    w, met = F.col(weight), F.col(verdict) == "MET"
    positive, negative = F.sum(F.greatest(w, F.lit(0))), F.sum(F.greatest(-w, F.lit(0)))
    raw = F.sum(F.when(met, w).otherwise(0))
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    normalized = F.when(positive > 0, clamp(raw / positive)).when(negative > 0, clamp(1 + raw / negative)).otherwise(0.0)
    passed = F.count_if(((w > 0) & met) | ((w < 0) & ~met))
    return [F.count("*").alias("criteria"), raw.alias("raw_score"), positive.alias("positive_weight"), negative.alias("negative_weight"), rounded(normalized).alias("normalized"), rounded(passed / F.count("*")).alias("pass_rate")]


def graded(grades: DataFrame) -> DataFrame:
    """Verdicts that a judge really gave."""
    return grades.where("judge_error IS NULL")


def section_scores(grades: DataFrame) -> DataFrame:
    """Scores of each case and run, whole (section ``*``) and by section, from one pass."""
    some = graded(grades)
    whole = some.groupBy("case_id", "run").agg(*score_columns()).withColumn("section_id", F.lit("*"))
    return whole.unionByName(some.groupBy("case_id", "run", "section_id").agg(*score_columns()))


def section_rank(section: str = "section_id") -> Column:
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col(section))
    return F.when(place > 0, place).otherwise(len(SECTION_ORDER) + 1)


def majority(grades: DataFrame) -> DataFrame:
    """One verdict a criterion over all runs: errored ones vote too, a tie is MET; errored only if every run is."""
    met = F.count_if(F.col("verdict") == "MET")
    votes = grades.groupBy("case_id", "criterion", "section_id", "weight").agg(met.alias("met_votes"), F.count("*").alias("runs"), F.bool_and(F.col("judge_error").isNotNull()).alias("errored"))
    return votes.withColumn("verdict", F.when(F.col("met_votes") * 2 >= F.col("runs"), "MET").otherwise("UNMET"))


def multi_run(grades: DataFrame) -> DataFrame:
    """Mean and population deviation over runs of each case's normalized score and pass rate."""
    per_run = graded(grades).groupBy("case_id", "run").agg(*score_columns())
    return per_run.groupBy("case_id").agg(
        F.count("*").alias("runs"), rounded(F.avg("normalized")).alias("normalized"), rounded(F.avg("pass_rate")).alias("pass_rate"),
        rounded(F.stddev_pop("normalized"), 3).alias("normalized_sd"), rounded(F.stddev_pop("pass_rate"), 3).alias("pass_rate_sd"),
    )


def suite(grades: DataFrame, cases: DataFrame) -> DataFrame:
    """Tasks, mean and median scores, coverage and validity over all (``*``), by domain and by section (``section:`` and its id)."""
    one = grades.where("run = 0").join(cases.select("case_id", "domain"), "case_id")
    scored = lambda *by: graded(one).groupBy("case_id", *by).agg(*score_columns()).join(one.groupBy("case_id", *by).agg(F.count("*").alias("all_criteria")), ["case_id", *by])
    sums = [F.count("*").alias("tasks"), rounded(F.avg("normalized"), 3).alias("normalized"), rounded(F.median("normalized")).alias("median"), rounded(F.avg("pass_rate"), 3).alias("pass_rate"), rounded(F.sum("criteria") / F.sum("all_criteria")).alias("coverage")]
    by_domain, by_section = scored("domain"), scored("section_id")
    whole = by_domain.agg(*sums).select(F.lit("*").alias("domain"), "*")  # a row even where no verdict counts, of none tasks
    out = whole.unionByName(by_domain.groupBy("domain").agg(*sums))
    sections = by_section.groupBy(F.concat(F.lit("section:"), "section_id").alias("domain")).agg(*sums)
    return out.unionByName(sections).withColumn("valid", F.col("coverage") >= COVERAGE_FLOOR)


def unmet(grades: DataFrame) -> DataFrame:
    """Criteria lost by section and their weight."""
    lost = graded(grades).where("(weight > 0 AND verdict = 'UNMET') OR (weight < 0 AND verdict = 'MET')")
    return lost.groupBy("case_id", "section_id").agg(F.count("*").alias("unmet"), F.sum(F.abs("weight")).alias("weight_lost"))


def unmet_by_weight(grades: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy(F.desc("weight"), "criterion", "run")
    return graded(grades).where("verdict = 'UNMET'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("case_id", "rank", "criterion", "run", "weight")


def seeded_order(seed: str, key: str) -> Column:
    """A repeatable shuffle: the SHA-256 of seed, a zero byte and the key."""
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(key)), 256)


def sampled(cases: DataFrame, seed: str, n: int) -> DataFrame:
    return cases.withColumn("h", seeded_order(seed, "case_id")).orderBy("h", "case_id").limit(n).select("case_id", "domain")


def stratified(cases: DataFrame, seed: str, n: int) -> DataFrame:
    """Round robin over domains: the first of each by hash, then the second, domains by hash within a round."""
    by = Window.partitionBy("domain").orderBy(seeded_order(seed, "case_id"), "case_id")
    ranked = cases.withColumn("round", F.row_number().over(by)).withColumn("h", seeded_order(seed, "domain"))
    return ranked.orderBy("round", "h", "domain").limit(n).select("case_id", "domain", "round")


def _score_sql(frm: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS criteria, sum(CASE WHEN verdict = 'MET' THEN weight ELSE 0 END)::BIGINT AS raw_score,
      sum(greatest(weight, 0))::BIGINT AS positive_weight, sum(greatest(-weight, 0))::BIGINT AS negative_weight,
      floor(CASE WHEN sum(greatest(weight, 0)) > 0 THEN least(1, greatest(0, sum(CASE WHEN verdict = 'MET' THEN weight ELSE 0 END) / sum(greatest(weight, 0))))
        WHEN sum(greatest(-weight, 0)) > 0 THEN least(1, greatest(0, 1 + sum(CASE WHEN verdict = 'MET' THEN weight ELSE 0 END) / sum(greatest(-weight, 0)))) ELSE 0 END * 10000 + 0.5) / 10000 AS normalized,
      floor(count(*) FILTER ((weight > 0 AND verdict = 'MET') OR (weight < 0 AND verdict = 'UNMET')) / count(*) * 10000 + 0.5) / 10000 AS pass_rate
      FROM {frm} WHERE judge_error IS NULL GROUP BY {keys}"""


PER_RUN = _score_sql("grades", "case_id, run")
SUITE = f"""FROM ({_score_sql("(SELECT * FROM grades WHERE run = 0)", "case_id")}) JOIN (SELECT case_id, count(*) AS all_criteria FROM grades WHERE run = 0 GROUP BY 1) USING (case_id) JOIN (SELECT case_id, domain AS d FROM cases) USING (case_id)"""
SECTIONS = f"""FROM ({_score_sql("(SELECT * FROM grades WHERE run = 0)", "case_id, section_id")}) JOIN (SELECT case_id, section_id, count(*) AS all_criteria FROM grades WHERE run = 0 GROUP BY 1, 2) USING (case_id, section_id) SEMI JOIN cases USING (case_id)"""
SUITE_COLS = "count(*) AS tasks, floor(avg(normalized) * 1000 + 0.5) / 1000 AS normalized, floor(median(normalized) * 10000 + 0.5) / 10000 AS median, floor(avg(pass_rate) * 1000 + 0.5) / 1000 AS pass_rate, floor(sum(criteria) / sum(all_criteria) * 10000 + 0.5) / 10000 AS coverage, floor(sum(criteria) / sum(all_criteria) * 10000 + 0.5) / 10000 >= 0.9 AS valid"

register("ag03_rubric_score", "grades", lambda g: graded(g).groupBy("case_id", "run").agg(*score_columns()), PER_RUN)
register("ag04_section_scores", "grades", lambda g: section_scores(g).withColumn("ord", section_rank()), f"SELECT *, CASE section_id WHEN 'factual-accuracy' THEN 1 WHEN 'breadth-and-depth-of-analysis' THEN 2 WHEN 'presentation-quality' THEN 3 WHEN 'citation-quality' THEN 4 ELSE 5 END::BIGINT AS ord FROM (SELECT *, '*' AS section_id FROM ({PER_RUN}) UNION ALL BY NAME ({_score_sql('grades', 'case_id, run, section_id')}))")
register("ag05_majority", "grades", majority, "SELECT *, CASE WHEN met_votes * 2 >= runs THEN 'MET' ELSE 'UNMET' END AS verdict FROM (SELECT case_id, criterion, section_id, weight, count(*) FILTER (verdict = 'MET') AS met_votes, count(*) AS runs, bool_and(judge_error IS NOT NULL) AS errored FROM grades GROUP BY 1, 2, 3, 4)")
register("ag05_multi_run", "grades", multi_run, f"SELECT case_id, count(*) AS runs, floor(avg(normalized) * 10000 + 0.5) / 10000 AS normalized, floor(avg(pass_rate) * 10000 + 0.5) / 10000 AS pass_rate, floor(stddev_pop(normalized) * 1000 + 0.5) / 1000 AS normalized_sd, floor(stddev_pop(pass_rate) * 1000 + 0.5) / 1000 AS pass_rate_sd FROM ({PER_RUN}) GROUP BY 1")
register("ag06_suite", "grades cases", suite, f"SELECT '*' AS domain, {SUITE_COLS} {SUITE} UNION ALL SELECT d, {SUITE_COLS} {SUITE} GROUP BY d UNION ALL SELECT 'section:' || section_id, {SUITE_COLS} {SECTIONS} GROUP BY section_id")
register("ag19_unmet", "grades", unmet, "SELECT case_id, section_id, count(*) AS unmet, sum(abs(weight))::BIGINT AS weight_lost FROM grades WHERE judge_error IS NULL AND ((weight > 0 AND verdict = 'UNMET') OR (weight < 0 AND verdict = 'MET')) GROUP BY 1, 2")
register("so08_unmet_by_weight", "grades", unmet_by_weight, "SELECT * FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, criterion, run)::INT AS rank, criterion, run, weight FROM grades WHERE judge_error IS NULL AND verdict = 'UNMET') WHERE rank <= 5")
register("so04_seeded_sample", "cases", lambda c: sampled(c, "seed", 25), "SELECT case_id, domain FROM cases ORDER BY sha256(concat('seed', chr(0), case_id)), case_id LIMIT 25")
register("wn05_stratified", "cases", lambda c: stratified(c, "seed", 23), "SELECT case_id, domain, round FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat('seed', chr(0), case_id)), case_id)::INT AS round FROM cases) ORDER BY round, sha256(concat('seed', chr(0), domain)), domain LIMIT 23")
register("so05_stratified_sizes", "cases", lambda c: stratified(c, "other", 40).groupBy("domain").agg(F.count("*").alias("n"), F.max("round").alias("rounds")), "SELECT domain, count(*) AS n, max(round) AS rounds FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat('other', chr(0), case_id)), case_id)::INT AS round FROM cases) ORDER BY round, sha256(concat('other', chr(0), domain)), domain LIMIT 40) GROUP BY 1")
register("pf17_case_filter", "cases", lambda c: c.where(F.col("domain").isin("BUILDING", "MACHINERY") | F.col("case_id").isin("c1", "c2", "c3")).select("case_id", "domain"), "SELECT case_id, domain FROM cases WHERE domain IN ('BUILDING', 'MACHINERY') OR case_id IN ('c1', 'c2', 'c3')")
register("ag12_mean_median", "grades", lambda g: g.groupBy("section_id").agg(rounded(F.coalesce(F.avg("weight"), F.lit(0.0))).alias("mean"), rounded(F.coalesce(F.median("weight"), F.lit(0.0))).alias("median")), "SELECT section_id, floor(coalesce(avg(weight), 0) * 10000 + 0.5) / 10000 AS mean, floor(coalesce(median(weight), 0) * 10000 + 0.5) / 10000 AS median FROM grades GROUP BY 1")
