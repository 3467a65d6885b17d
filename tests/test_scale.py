"""Work that has to keep in step with its input: files, scans and what an empty group gives."""

import os
import random

from pyspark.sql import functions as F

from tessella.functions import pages
from tessella.operators import evals, runs
from tessella.plans import registry
from tessella.sources import catalog


def journal(spark, runs=150, tasks=4):
    rows = spark.range(runs * tasks, numPartitions=tasks).select(F.concat(F.lit("run"), F.col("id") % runs).alias("run_id"), F.col("id").alias("seq"), F.lit("event").alias("kind"))
    return rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("type", "string"), ("call_key", "string"), ("data", "string"), ("cents", "long"), ("at_ms", "long"))])


def files_below(path):
    return [f"{at}/{f}" for at, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".json")]


def test_files_of_a_journal_do_not_grow_with_its_runs(spark):
    path = catalog._journal_folder(journal(spark))
    assert len(files_below(path)) <= 2 * catalog.BUCKETS
    got = catalog.read_journal(spark, path)
    assert got.count() == 600 and got.select("run_id").distinct().count() == 150
    one = got.where(F.col("bucket") == catalog.journal_bucket(F.lit("run7")))
    assert sorted(r["seq"] for r in one.where("run_id = 'run7'").collect()) == [7, 157, 307, 457]


def test_runs_of_a_journal_in_either_layout(spark, tmp_path):
    some = journal(spark, 30).withColumn("run_id", F.concat("run_id", F.lit("/a b")))
    want = {f"run{i}_a_b" for i in range(30)}
    for name, buckets in (("folders", 0), ("buckets", 5)):
        catalog.append_journal(some, f"{tmp_path}/{name}", buckets)
        got = catalog.journal_runs(spark, f"{tmp_path}/{name}").collect()
        assert {r["run"] for r in got} == want and len(got) == 30 and min(r["files"] for r in got) >= 1


def test_files_of_two_appends_do_not_grow_with_the_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    some = journal(spark).withColumn("at_ms", F.col("seq"))
    got = catalog._appended(some).collect()
    assert len(files_below(str(tmp_path))) <= 4 * catalog.BUCKETS
    assert len(got) == 150 and {(r["entries"], r["numbers"], r["last"]) for r in got} == {(4, 4, 3)}


def test_a_suite_of_failed_judges_has_a_row_of_no_tasks(spark):
    grades = spark.createDataFrame([("c1", 0, 1, "citation-quality", 3, "MET", "judge failed")], "case_id string, run int, criterion long, section_id string, weight long, verdict string, judge_error string")
    cases = spark.createDataFrame([("c1", "d")], "case_id string, domain string")
    assert [tuple(r) for r in evals.suite(grades, cases).collect()] == [("*", 0, None, None, None, None, None)]
    whole = evals.suite(grades.withColumn("judge_error", F.lit(None).cast("string")), cases).collect()
    assert {r["domain"]: r["tasks"] for r in whole} == {"*": 1, "d": 1, "section:citation-quality": 1}


def test_evicted_runs_are_those_behind_the_newest(spark):
    r = random.Random(3)
    rows = [(f"r{r.randrange(40)}" if i % 9 else None, r.choice([None, *range(30)]), "scored" if i % 7 else "ungraded") for i in range(400)]
    df = spark.createDataFrame(rows, "run_id string, created_at long, status string").repartition(6)
    for keep in (0, 1, 50, 343, 1000):
        want = df.where("status <> 'ungraded'").orderBy(F.desc("created_at"), "run_id").offset(keep).select("run_id")
        got = runs.evicted(df, keep)
        assert [x[0] for x in got.collect()] == [x[0] for x in want.collect()]
    assert "GlobalLimit" not in runs.evicted(df, 50)._jdf.queryExecution().executedPlan().toString()


def test_a_reference_without_its_semicolon_stays_in_a_title(spark, tmp_path):
    head = '<html lang="en"><head><title>a &quot;b&quot; &amp;lt; &amp;&amp%s</title></head><body><p>x &amp y</p></body></html>'
    rows = [(1, "https://h.example/", head % ""), (2, "https://h.example/", head % " c")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    registry.load()
    got = registry.QUERIES["fn22_metadata"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b" &lt; &&amp', "en"), (2, 'a "b" &lt; &&amp c', "en")]
    assert pages.read_page(rows[0][2])["title"] == 'a "b" &lt; &&'  # as HTML has it
