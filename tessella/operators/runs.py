"""The run store: latest runs, commit summaries, comparisons of commits and systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import numbered
from ..plans.registry import register, rounded

# The two-sided 95 % quantiles of Student's t for 1 to 20 degrees of freedom.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.16, 2.145, 2.131, 2.12, 2.11, 2.101, 2.093, 2.086)
T95_TO_29, T95_BEYOND = 2.045, 1.96


def t95(df: Column) -> Column:
    table = F.array(*map(F.lit, T95))
    return F.when(df <= 0, 0.0).when(df <= len(T95), F.try_element_at(table, df.cast("int"))).when(df <= 29, T95_TO_29).otherwise(T95_BEYOND)


def latest(runs: DataFrame, *keys: str) -> DataFrame:
    """The newest run of each key, by time and then id; a window with a limit, which prunes before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def grid(runs: DataFrame, cases: DataFrame, commit: str) -> DataFrame:
    """All cases with their newest run of a commit, if there is one."""
    newest = latest(runs.where(F.col("commit_sha") == commit), "case_id").select("case_id", "run_id", "status", "normalized", "model")
    return cases.join(newest, "case_id", "left")


def commits(runs: DataFrame) -> DataFrame:
    newest = latest(runs, "commit_sha", "case_id").groupBy("commit_sha").agg(
        F.count("*").alias("run_count"), F.count_if(F.col("status") == "scored").alias("scored"), F.count_if(F.col("status") == "error").alias("errors"), rounded(F.avg("normalized")).alias("avg_normalized")
    )
    totals = runs.groupBy("commit_sha").agg(F.count("*").alias("total_runs"), F.max("created_at").alias("last_run"), F.max("dirty").alias("any_dirty"))
    return newest.join(totals, "commit_sha")


def diff(runs: DataFrame, cases: DataFrame, a: str, b: str) -> DataFrame:
    """Cases of both commits with the difference of their scores; null if one has none."""
    left = grid(runs, cases, a).select("case_id", "domain", F.col("normalized").alias("a"))
    right = grid(runs, cases, b).select("case_id", F.col("normalized").alias("b"))
    return left.join(right, "case_id").withColumn("delta", rounded(F.col("a") - F.col("b")))


def system_cost(used: str | None = None) -> Column:
    """The first positive of the run's own cost, the connector's and what its tokens come to."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(positive("cost_usd"), positive("exa_usd"), *([positive(used)] if used else []))


def _interval(n: Column, sd: Column) -> Column:
    return F.when(n >= 2, t95(n - 1) * sd / F.sqrt(n)).when(n == 1, 0.0)


def systems(runs: DataFrame) -> DataFrame:
    """A leaderboard: of each model and case the newest run; mean score with its 95 % interval, errors and mean cost."""
    newest = latest(runs.withColumn("model", F.coalesce("model", F.lit("unknown"))), "model", "case_id").withColumn("cost", system_cost())
    scored = (F.col("status") == "scored") & F.col("normalized").isNotNull()
    value = F.when(scored, F.col("normalized"))
    out = newest.groupBy("model").agg(
        F.count("*").alias("n"), F.count(value).alias("scored"), F.count_if(F.col("status") == "error").alias("errors"),
        F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.when(F.count(value) == 1, 0.0)).alias("sd"), rounded(F.avg(F.when(scored, F.col("cost")))).alias("mean_cost"),
    )
    half = _interval(F.col("scored"), F.col("sd"))
    return out.select("model", "n", "scored", "errors", rounded(F.col("m")).alias("mean"), rounded(F.col("sd")).alias("sd"), rounded(half).alias("ci95"), rounded(F.col("m") - half).alias("lo"), rounded(F.col("m") + half).alias("hi"), "mean_cost")


def paired(runs: DataFrame) -> DataFrame:
    """For each two systems the cases both have scored: mean difference, interval, wins, and whether it is beyond chance."""
    some = latest(runs.withColumn("model", F.coalesce("model", F.lit("unknown"))), "model", "case_id").where("status = 'scored' AND normalized IS NOT NULL").select("model", "case_id", "normalized")
    a, b = (some.select(F.col("model").alias(n), "case_id", F.col("normalized").alias(f"v{n}")) for n in "ab")
    deltas = a.join(b, "case_id").where("a < b").withColumn("delta", F.col("va") - F.col("vb"))
    out = deltas.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("delta").alias("m"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"), F.count_if(F.col("delta") > 0).alias("a_wins"))
    half = F.coalesce(_interval(F.col("n"), F.col("sd")), F.lit(0.0))
    return out.select("a", "b", "n", "a_wins", rounded(F.col("m")).alias("mean_delta"), rounded(half).alias("ci95"), ((F.col("m") - half > 0) | (F.col("m") + half < 0)).alias("significant"))


def quality(runs: DataFrame, cases: DataFrame) -> DataFrame:
    newest = latest(runs.withColumn("model", F.coalesce("model", F.lit("?"))), "model", "case_id").join(cases.select("case_id", "domain"), "case_id")
    finish = F.when(F.col("status") == "error", "error").when(F.col("exhausted"), "budget-exhausted").otherwise("completed")
    return newest.select("model", "domain", "case_id", "status", "sources", finish.alias("finish"), system_cost().alias("cost"), F.floor(F.col("latency_ms") / 1000 + 0.5).alias("latency_s"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the rest of both stays."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def evicted(runs: DataFrame, keep: int = 200) -> DataFrame:
    """run_id of all graded runs but the ``keep`` newest, newest first, ties by run_id: the kept ones are few and broadcast, the others sorted by ranges, so no task has them all.

    Of runs in the table more than once as many rows are left as there are more than kept ones."""
    graded = runs.where("status <> 'ungraded'").select("created_at", "run_id")
    kept = graded.orderBy(F.desc("created_at"), "run_id").limit(keep).groupBy(F.col("created_at").alias("at"), F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    marked = graded.join(F.broadcast(kept), F.col("created_at").eqNullSafe(F.col("at")) & F.col("run_id").eqNullSafe(F.col("id")), "left")
    again = marked.where("n IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("created_at", "run_id").orderBy("n"))).where("k > n")
    rest = marked.where("n IS NULL").select("created_at", "run_id").unionByName(again.select("created_at", "run_id"))
    return rest.orderBy(F.desc("created_at"), "run_id").select("run_id")


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs WHERE commit_sha = '{0}') WHERE rn = 1)"
BY_MODEL = "(SELECT * FROM (SELECT * REPLACE (coalesce(model, '{0}') AS model), row_number() OVER (PARTITION BY coalesce(model, '{0}'), case_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1)"
T = "(CASE WHEN {n} <= 1 THEN 0 WHEN {n} - 1 <= 20 THEN [" + ", ".join(map(str, T95)) + "][{n} - 1] WHEN {n} - 1 <= 29 THEN 2.045 ELSE 1.96 END)"
COST = "coalesce(CASE WHEN cost_usd > 0 THEN cost_usd END, CASE WHEN exa_usd > 0 THEN exa_usd END)"
R4 = "floor(({}) * 10000 + 0.5) / 10000"
GRID = "(SELECT c.*, r.run_id, r.status, r.normalized, r.model FROM cases c LEFT JOIN " + LATEST + " r ON r.case_id = c.case_id)"
COMMITS = "SELECT * FROM (SELECT commit_sha, count(*) AS run_count, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'error') AS errors, " + R4.format("avg(normalized)") + " AS avg_normalized FROM (SELECT *, row_number() OVER (PARTITION BY commit_sha, case_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1 GROUP BY 1) JOIN (SELECT commit_sha, count(*) AS total_runs, max(created_at) AS last_run, max(dirty) AS any_dirty FROM runs GROUP BY 1) USING (commit_sha)"
DIFF = f"SELECT a.case_id, a.domain, a.normalized AS a, b.normalized AS b, {R4.format('a.normalized - b.normalized')} AS delta FROM {GRID.format('k0')} a JOIN {GRID.format('k1')} b ON a.case_id = b.case_id"


def answers_summary(results: DataFrame, by: str = "commit_sha") -> DataFrame:
    """Accuracy over all answers, by exact match, and of those that a judge saw; over answers that didn't fail the share cut off by a cap, the median time and the cost."""
    share = lambda part, whole: rounded(F.when(whole > 0, part / whole))
    n, fine = F.count("*"), ~F.col("failed")
    return results.groupBy(by).agg(
        n.alias("total"), F.count_if("failed").alias("errors"), share(F.count_if("correct"), n).alias("accuracy"), share(F.count_if("exact"), n).alias("exact_accuracy"),
        share(F.count_if("judged"), F.count("judged")).alias("judge_accuracy"), share(F.count_if(fine & F.col("capped")), F.count_if(fine)).alias("cap_rate"),
        F.median(F.when(fine, F.col("latency_ms"))).alias("median_latency"), rounded(F.sum(F.when(fine, F.coalesce("cost_usd", F.lit(0.0))))).alias("cost_usd"),
    )


register("wn01_latest_per_case", "runs", lambda r: latest(r.where("commit_sha = 'k1'"), "case_id").select("case_id", "run_id", "created_at"), f"SELECT case_id, run_id, created_at FROM {LATEST.format('k1')}")
register("wn02_latest_per_commit_case", "runs", lambda r: latest(r, "commit_sha", "case_id").select("commit_sha", "case_id", "run_id"), "SELECT commit_sha, case_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY commit_sha, case_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1")
register("wn03_first_wins", "runs", lambda r: latest(r.withColumn("model", F.coalesce("model", F.lit("?"))), "model", "case_id").select("model", "case_id", "run_id"), f"SELECT model, case_id, run_id FROM {BY_MODEL.format('?')}")
register("jn01_grid", "runs cases", lambda r, c: grid(r, c, "k1"), f"SELECT * FROM {GRID.format('k1')}")
register("jn02_commit_totals", "runs", lambda r: commits(r).select("commit_sha", "run_count", "total_runs"), f"SELECT commit_sha, run_count, total_runs FROM ({COMMITS})")
register("ag01_commits", "runs", commits, COMMITS)
register("jn03_run_detail", "runs cases", lambda r, c: r.where("commit_sha = 'k2' AND case_id = 'c7'").join(c, "case_id").orderBy(F.desc("created_at"), F.desc("run_id")).limit(1).select("run_id", "case_id", "domain", "problem", "normalized"), "SELECT run_id, case_id, domain, problem, normalized FROM runs JOIN cases USING (case_id) WHERE commit_sha = 'k2' AND case_id = 'c7' ORDER BY created_at DESC, run_id DESC LIMIT 1")
register("jn04_run_case", "runs cases", lambda r, c: r.join(c.where("criteria_count > 5"), "case_id", "left").select("run_id", "case_id", "domain"), "SELECT run_id, case_id, domain FROM runs LEFT JOIN (SELECT * FROM cases WHERE criteria_count > 5) USING (case_id)")
register("jn05_unrun", "runs cases", lambda r, c: c.join(r.where("commit_sha = 'k1'"), "case_id", "left_anti").select("case_id", "domain"), "SELECT case_id, domain FROM cases WHERE case_id NOT IN (SELECT case_id FROM runs WHERE commit_sha = 'k1')")
register("jn06_diff", "runs cases", lambda r, c: diff(r, c, "k0", "k1"), DIFF)
register("jn07_baseline", "runs", lambda r: latest(r.where("commit_sha = 'k1'"), "case_id").select("case_id", F.col("normalized").alias("now")).join(latest(r.join(r.where("commit_sha <> 'k1'").groupBy("commit_sha").agg(F.max("created_at").alias("at")).orderBy(F.desc("at"), F.desc("commit_sha")).limit(1).select("commit_sha"), "commit_sha"), "case_id").select("case_id", F.col("normalized").alias("base")), "case_id", "left"), f"SELECT case_id, a.normalized AS now, b.normalized AS base FROM {LATEST.format('k1')} a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, run_id DESC) AS rn2 FROM runs WHERE commit_sha = (SELECT commit_sha FROM runs WHERE commit_sha <> 'k1' GROUP BY 1 ORDER BY max(created_at) DESC, commit_sha DESC LIMIT 1)) WHERE rn2 = 1) b USING (case_id)")
register("ag02_count_exists", "runs", lambda r: r.groupBy().agg(F.count("*").alias("runs"), F.bool_or(F.col("commit_sha") == "k9").alias("known")), "SELECT count(*) AS runs, bool_or(commit_sha = 'k9') AS known FROM runs")
register("ag14_interval", "runs", lambda r: r.where("normalized IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n"), F.avg("normalized").alias("m"), F.coalesce(F.stddev_samp("normalized"), F.lit(0.0)).alias("sd")).select("case_id", "n", rounded(F.col("m")).alias("mean"), rounded(F.col("sd")).alias("sd"), rounded(_interval(F.col("n"), F.col("sd"))).alias("ci95")), f"SELECT case_id, n, {R4.format('m')} AS mean, {R4.format('sd')} AS sd, {R4.format('CASE WHEN n >= 2 THEN ' + T.format(n='n') + ' * sd / sqrt(n) ELSE 0 END')} AS ci95 FROM (SELECT case_id, count(*) AS n, avg(normalized) AS m, coalesce(stddev_samp(normalized), 0) AS sd FROM runs WHERE normalized IS NOT NULL GROUP BY 1)")
SYSTEMS = f"SELECT model, n, scored, errors, {R4.format('m')} AS mean, {R4.format('sd')} AS sd, {R4.format('h')} AS ci95, {R4.format('m - h')} AS lo, {R4.format('m + h')} AS hi, mean_cost FROM (SELECT *, CASE WHEN scored >= 2 THEN {T.format(n='scored')} * sd / sqrt(scored) WHEN scored = 1 THEN 0 END AS h FROM (SELECT model, count(*) AS n, count(v) AS scored, count(*) FILTER (status = 'error') AS errors, avg(v) AS m, coalesce(stddev_samp(v), CASE WHEN count(v) = 1 THEN 0 END) AS sd, {R4.format('avg(CASE WHEN v IS NOT NULL THEN ' + COST + ' END)')} AS mean_cost FROM (SELECT *, CASE WHEN status = 'scored' THEN normalized END AS v FROM {BY_MODEL.format('unknown')}) GROUP BY 1))"
register("ag15_systems", "runs", systems, SYSTEMS)
PAIRED = f"SELECT a, b, n, a_wins, {R4.format('m')} AS mean_delta, {R4.format('h')} AS ci95, m - h > 0 OR m + h < 0 AS significant FROM (SELECT *, CASE WHEN n >= 2 THEN {T.format(n='n')} * sd / sqrt(n) ELSE 0 END AS h FROM (SELECT x.model AS a, y.model AS b, count(*) AS n, avg(x.normalized - y.normalized) AS m, coalesce(stddev_samp(x.normalized - y.normalized), 0) AS sd, count(*) FILTER (x.normalized - y.normalized > 0) AS a_wins FROM {BY_MODEL.format('unknown')} x JOIN {BY_MODEL.format('unknown')} y ON x.case_id = y.case_id AND x.model < y.model WHERE x.status = 'scored' AND y.status = 'scored' AND x.normalized IS NOT NULL AND y.normalized IS NOT NULL GROUP BY 1, 2))"
register("ag16_paired", "runs", paired, PAIRED)
register("jn08_paired_rows", "runs", lambda r: paired(r).select("a", "b", "n"), f"SELECT a, b, n FROM ({PAIRED})")
register("ag17_commit_view", "runs cases", lambda r, c: diff(r, c, "k0", "k1").where("delta < 0").groupBy().agg(F.count("*").alias("regressions"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("delta", "case_id"))), lambda x: x["case_id"]), ",").alias("worst_first")), f"SELECT count(*) AS regressions, coalesce(string_agg(case_id, ',' ORDER BY delta, case_id), '') AS worst_first FROM ({DIFF}) WHERE delta < 0")
register("ag18_diff_summary", "runs cases", lambda r, c: diff(r, c, "k0", "k1").groupBy().agg(F.count("*").alias("shared"), rounded(F.avg("delta"), 3).alias("avg_delta"), F.count_if(F.col("delta") < 0).alias("regressions"), F.count_if(F.col("delta") > 0).alias("improvements")), f"SELECT count(*) AS shared, floor(avg(delta) * 1000 + 0.5) / 1000 AS avg_delta, count(*) FILTER (delta < 0) AS regressions, count(*) FILTER (delta > 0) AS improvements FROM ({DIFF})")
register("so09_regressions", "runs cases", lambda r, c: diff(r, c, "k0", "k1").where("delta <> 0").orderBy("delta", "case_id").limit(15), f"SELECT * FROM ({DIFF}) WHERE delta <> 0 ORDER BY delta, case_id LIMIT 15")
register("ag29_system_cost", "runs", lambda r: r.withColumn("used", F.when(F.col("latency_ms") % 3 > 0, F.col("latency_ms") % 7 / 8.0)).withColumn("cost_usd", F.when(F.col("sources") % 4 > 0, F.col("cost_usd"))).select("run_id", system_cost("used").alias("cost")), "SELECT run_id, coalesce(CASE WHEN sources % 4 > 0 AND cost_usd > 0 THEN cost_usd END, CASE WHEN exa_usd > 0 THEN exa_usd END, CASE WHEN latency_ms % 3 > 0 AND latency_ms % 7 > 0 THEN latency_ms % 7 / 8 END)::DOUBLE AS cost FROM runs")
QUALITY = f"SELECT model, domain, case_id, status, sources, CASE WHEN status = 'error' THEN 'error' WHEN exhausted THEN 'budget-exhausted' ELSE 'completed' END AS finish, {COST} AS cost, floor(latency_ms / 1000 + 0.5)::BIGINT AS latency_s FROM {BY_MODEL.format('?')} JOIN (SELECT case_id, domain FROM cases) USING (case_id)"
register("ag32_quality", "runs cases", quality, QUALITY)
register("ag34_header", "runs cases", lambda r, c: grid(r, c, "k1").groupBy().agg(F.count("*").alias("cases"), F.count("run_id").alias("run"), rounded(F.sum(F.when(F.col("status") == "scored", F.coalesce("normalized", F.lit(0.0)))) / F.count_if(F.col("status") == "scored"), 3).alias("avg_scored")), f"SELECT count(*) AS cases, count(run_id) AS run, floor(sum(CASE WHEN status = 'scored' THEN coalesce(normalized, 0) END) / count(*) FILTER (status = 'scored') * 1000 + 0.5) / 1000 AS avg_scored FROM {GRID.format('k1')}")
register("pf16_grid_filter", "runs cases", lambda r, c: grid(r, c, "k1").where("status IS NULL OR domain = 'BUILDING'").select("case_id", "domain", "status"), f"SELECT case_id, domain, status FROM {GRID.format('k1')} WHERE status IS NULL OR domain = 'BUILDING'")
register("so07_grid_sort", "runs cases", lambda r, c: numbered(grid(r, c, "k1"), "place", [F.coalesce("normalized", F.lit(1.1)), F.col("case_id")]).select("place", "case_id", "normalized"), f"SELECT row_number() OVER (ORDER BY coalesce(normalized, 1.1), case_id) AS place, case_id, normalized FROM {GRID.format('k1')}")
register("pf27_status", "runs", lambda r: r.select("run_id", F.when(F.col("status") == "error", "error").when(F.col("normalized").isNull(), "ungraded").otherwise("scored").alias("derived")), "SELECT run_id, CASE WHEN status = 'error' THEN 'error' WHEN normalized IS NULL THEN 'ungraded' ELSE 'scored' END AS derived FROM runs")
register("st06_shared_cases", "runs", lambda r: r.where("commit_sha = 'k0'").select("case_id").intersect(r.where("commit_sha = 'k1'").select("case_id")), "SELECT case_id FROM runs WHERE commit_sha = 'k0' INTERSECT SELECT case_id FROM runs WHERE commit_sha = 'k1'")
register("st07_unrun_cases", "runs cases", lambda r, c: c.select("case_id").exceptAll(r.select("case_id").distinct()), "SELECT case_id FROM cases EXCEPT SELECT case_id FROM runs")
register("st05_model_union", "runs", lambda r: r.where("commit_sha = 'k0'").select("model").union(r.where("commit_sha = 'k1'").select("model")).distinct(), "SELECT model FROM runs WHERE commit_sha IN ('k0', 'k1') GROUP BY 1")
register("sc12_case_upsert", "cases", lambda c: upserted(c.where("criteria_count < 30"), c.where("criteria_count >= 25").withColumn("problem", F.upper("problem")), "case_id"), "SELECT * FROM cases WHERE criteria_count < 25 UNION ALL SELECT * REPLACE (upper(problem) AS problem) FROM cases WHERE criteria_count >= 25")
register("sc10_run_insert", "runs", lambda r: upserted(r.where("created_at < 60000"), r.where("created_at >= 50000").withColumn("dirty", F.lit(9).cast("long")), "run_id").groupBy("dirty").agg(F.count("*").alias("n")), "SELECT CASE WHEN created_at >= 50000 THEN 9 ELSE dirty END AS dirty, count(*) AS n FROM runs GROUP BY 1")
register("sc11_grade_update", "runs", lambda r: r.join(r.where("status = 'ungraded'").select("run_id", F.lit(0.5).alias("new")), "run_id", "left").select("run_id", F.coalesce("new", "normalized").alias("normalized"), F.when(F.col("new").isNotNull(), "scored").otherwise(F.col("status")).alias("status")), "SELECT run_id, CASE WHEN status = 'ungraded' THEN 0.5 ELSE normalized END AS normalized, CASE WHEN status = 'ungraded' THEN 'scored' ELSE status END AS status FROM runs")
register("sc10_blob_fanout", "runs", lambda r: r.select("run_id", "status", F.col("normalized").cast("string").alias("score"), F.col("sources").cast("string").alias("sources")).unpivot("run_id", ["status", "sources"], "blob", "payload").where("payload IS NOT NULL"), "SELECT run_id, 'status' AS blob, status AS payload FROM runs UNION ALL SELECT run_id, 'sources', sources::VARCHAR FROM runs")
register("sc14_blob_length", "documents", lambda d: d.select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes")), "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
register("sc15_blob_lookup", "documents", lambda d: d.where("doc_id IN (3, 5) AND lang IS NOT NULL").select("doc_id", "lang", F.md5("text").alias("digest")).orderBy("doc_id"), "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE doc_id IN (3, 5) AND lang IS NOT NULL")
register("ag27_run_cost", "runs", lambda r: r.select("run_id", F.when(F.col("cost_usd").isNull() & F.col("exa_usd").isNull(), None).otherwise(rounded(F.coalesce("cost_usd", F.lit(0.0)) + F.coalesce("exa_usd", F.lit(0.0)))).alias("total")), f"SELECT run_id, CASE WHEN cost_usd IS NULL AND exa_usd IS NULL THEN NULL ELSE {R4.format('coalesce(cost_usd, 0) + coalesce(exa_usd, 0)')} END AS total FROM runs")
register("xs46_latest_run", "runs", lambda r: latest(r, "case_id").orderBy(F.desc("created_at"), "case_id").select("case_id", "run_id", "created_at"), "SELECT case_id, run_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1")
register("ag07_accuracy", "runs", lambda r: answers_summary(r.select("commit_sha", "latency_ms", "cost_usd", (F.col("status") == "error").alias("failed"), F.coalesce(F.col("normalized") > 0.5, F.lit(False)).alias("correct"), (F.col("sources") == 7).alias("exact"), F.when(F.col("sources") % 2 == 0, F.coalesce(F.col("normalized") > 0.4, F.lit(False))).alias("judged"), F.col("exhausted").alias("capped"))), "SELECT commit_sha, count(*) AS total, count(*) FILTER (status = 'error') AS errors, floor(count(*) FILTER (normalized > 0.5) / count(*) * 1e4 + 0.5) / 1e4 AS accuracy, floor(count(*) FILTER (sources = 7) / count(*) * 1e4 + 0.5) / 1e4 AS exact_accuracy, floor(count(*) FILTER (sources % 2 = 0 AND normalized > 0.4) / nullif(count(*) FILTER (sources % 2 = 0), 0) * 1e4 + 0.5) / 1e4 AS judge_accuracy, floor(count(*) FILTER (status <> 'error' AND exhausted) / count(*) FILTER (status <> 'error') * 1e4 + 0.5) / 1e4 AS cap_rate, median(latency_ms) FILTER (status <> 'error') AS median_latency, floor(sum(coalesce(cost_usd, 0)) FILTER (status <> 'error') * 1e4 + 0.5) / 1e4 AS cost_usd FROM runs GROUP BY 1")
register("so12_eviction", "runs", evicted, "SELECT run_id FROM runs WHERE status <> 'ungraded' ORDER BY created_at DESC, run_id OFFSET 200")
