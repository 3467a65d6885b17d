"""Numbers, running maxima, order statistics, critical paths and agent trees against loops, with one run that has most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import trace
from tessella.plans import ordered, scratch


def rows(seed=1, n=900):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(60), i) for i in range(n)]


def test_numbers_within_keys(spark):
    some = rows()
    df = spark.createDataFrame(some, "k string, v long, id long").repartition(7)
    got = ordered.numbered(df, "n", [F.col("v"), F.col("id").desc()], ["k"])
    assert got.columns == ["k", "v", "id", "n"]
    by = defaultdict(list)
    for k, v, i in some:
        by[k].append((v, -i))
    want = {(k, v, -i, n) for k, vs in by.items() for n, (v, i) in enumerate(sorted(vs), 1)}
    assert {tuple(x) for x in got.collect()} == want
    alone = ordered.numbered(df, "n", [F.col("id")]).orderBy("id").collect()
    assert [x["n"] for x in alone] == list(range(1, len(some) + 1))
    assert ordered.numbered(df.limit(0), "n", [F.col("id")], ["k"]).collect() == []


def test_running_maximum(spark):
    some = rows(2)
    placed = ordered.in_ranges(spark.createDataFrame(some, "k string, v long, id long").repartition(5), ["k"], [F.col("id")])
    got = {x["id"]: x["m"] for x in ordered.max_before(placed, ["k"], "v", "m").collect()}
    high = {}
    for k, v, i in some:
        assert got[i] == high.get(k)
        high[k] = max(v, high.get(k, v))


@pytest.mark.parametrize("percent", [0, 50, 95, 100])
def test_percentiles_by_place(spark, percent):
    r = random.Random(percent)
    some = [("hot", r.choice([-5, 0, 7, r.randrange(10**12)])) for _ in range(2000)] + [("one", 3), ("two", -(2**40)), ("two", 2**40), ("none", None), (None, 4), (None, 9)]
    got = {x["k"]: x[1] for x in trace.nth_percent(spark.createDataFrame(some, "k string, v long").repartition(6), "k", "v", percent).collect()}
    by = defaultdict(list)
    for k, v in some:
        if v is not None:
            by[k].append(v)
    assert got == {k: sorted(v)[min(len(v) - 1, percent * len(v) // 100)] for k, v in by.items()}


def test_percentiles_leave_no_run_in_one_task(spark):
    plan = ordered.nth_value(spark.range(5000).selectExpr("'hot' AS k", "id AS v"), "k", "v", F.lit(2500), "m")
    assert plan.first()["m"] == 2500


def path_by_loop(spans):
    """The greedy walk as it is told: on to the open span that reaches furthest, else to the next start."""
    out = {}
    for run in {s[0] for s in spans}:
        work = sorted((s for s in spans if s[0] == run and s[2] != "agent"), key=lambda s: (s[3], s[1]))
        at, end, steps = min(s[3] for s in spans if s[0] == run), max((s[4] for s in work), default=0), []
        while at < end:
            open_ = [s for s in work if s[3] <= at < s[4]]
            ahead = [s for s in work if s[3] > at and s[4] > at]
            if open_:
                pick = max(open_, key=lambda s: s[4])
                steps.append((pick[1], pick[4] - at))
                at = pick[4]
            elif ahead:
                at = min(s[3] for s in ahead)
            else:
                break
        out[run] = steps
    return {(run, k, i, g) for run, steps in out.items() for k, (i, g) in enumerate(steps)}


@pytest.mark.parametrize("block", [1, 3, 16_384])
def test_critical_path_equals_the_walk(spark, block):
    r = random.Random(block)
    spans = []
    for i in range(700):
        t0 = r.randrange(9000)
        run = "hot" if i % 10 else r.choice(["a", "b"])
        spans.append((run, i, r.choice(["model", "io", "tool", "agent"]), t0, t0 + r.choice([0, 1, 5, 20, 60, r.randrange(200)])))
    spans += [("idle", 1000, "io", 0, 30), ("idle", 1001, "io", 80, 120), ("long", 1002, "io", 0, 50), ("long", 1003, "io", 0, 100), ("empty", 1004, "agent", 0, 9), ("tie", 1005, "io", 5, 9), ("tie", 1006, "io", 5, 9)]
    df = spark.createDataFrame(spans, "run_id string, id long, kind string, t0 long, t1 long").repartition(5)
    assert {tuple(x) for x in trace.critical_path(df, block).collect()} == path_by_loop(spans)


def test_agent_trees(spark):
    nodes = [("r", "a", None, 1, 10), ("r", "b", "a", 2, 20), ("r", "c", "b", 4, 40), ("r", "d", "gone", 8, 80), ("r", "e", "g", 16, 1), ("r", "f", "e", 32, 1), ("r", "g", "f", 64, 1), ("r", "h", "f", 128, 1), ("r", "i", "i", 256, 1), ("q", "a", "b", 5, 5)]
    nodes += [("deep", f"n{k:03}", f"n{k - 1:03}" if k else None, 1, 1) for k in range(100)]
    got = {(x["run_id"], x["agent_id"]): (x["cost_cents"], x["self_ms"], x["agents"]) for x in trace.agent_tree(spark.createDataFrame(nodes, "run_id string, agent_id string, parent_id string, cost_cents long, self_ms long")).collect()}
    assert got["r", "a"] == (7, 70, 3) and got["r", "b"] == (6, 60, 2) and got["r", "d"] == (8, 80, 1) and got["q", "a"] == (5, 5, 1)
    # e, f and g are each other's ancestors: e is the root, then g under ... f under e
    assert got["r", "e"] == (16 + 32 + 64 + 128, 4, 4) and got["r", "f"] == (32 + 64 + 128, 3, 3) and got["r", "g"] == (64, 1, 1) and got["r", "i"] == (256, 1, 1)
    assert all(got["deep", f"n{k:03}"] == (100 - k,) * 3 for k in range(100))


def test_capture_keeps_texts_within_the_bounds(spark):
    steps = spark.createDataFrame([("c", k, "x" * (300_000 if k == 2 else 10)) for k in range(5)] + [("d", 0, None)], "conv_id string, turn long, text string").repartition(3)
    got = {(x["conv_id"], x["turn"]): x for x in trace.degraded_steps(steps).collect()}
    cut = 256 * 1024 + len("…[truncated]")
    assert len(got["c", 2]["text"]) == cut and got["c", 2]["text"].endswith("x…[truncated]") and got["c", 4]["running"] == 40 + cut and got["d", 0]["text"] is None
    short = {x["turn"]: x["text"] for x in trace.degraded_steps(steps.where("conv_id = 'c'"), 10, 32).collect()}
    assert [short[k] is not None for k in range(5)] == [True, True, False, False, False]


def test_scratch_tables_go_and_inputs_stay(spark, tmp_path):
    mine = tmp_path / "tessella-input" / "t.parquet"
    spark.range(5).write.parquet(str(mine))
    table = scratch.written(spark.range(3).toDF("x"), "some")
    scratch.dropped(spark.read.parquet(str(mine)), table)
    assert spark.read.parquet(str(mine)).count() == 5
    with pytest.raises(Exception, match=r"(?i)not.exist|path"):
        table.sparkSession.read.parquet(*table.inputFiles()).count()
