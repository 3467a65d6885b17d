"""Trace and time-interval analytics over spans: interval unions, overlap peaks, critical paths, roll-ups, anomalies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CUT_MARK
from ..plans.ordered import before_range, in_ranges, max_before, nth_value, numbered
from ..plans.registry import register, rounded
from ..plans.scratch import dropped, written

TOP_N, HIGH_WAIT_MS, SLOW_STEP_MS = 8, 750, 4_000
#: Time is cut in pieces of an hour where a run's spans are swept.
BUCKET_MS = 3_600_000
#: Candidates of a critical path that one task looks at.
BLOCK = 16_384
#: Verbatim text of a step in a trace, and of a run, in characters.
FIELD_CHARS, RUN_CHARS = 256 * 1024, 512 * 1024 * 1024


def work(spans: DataFrame) -> DataFrame:
    """Model, io and tool spans: agent spans wrap these."""
    return spans.where("kind IN ('model', 'io', 'tool')")


def compute_of() -> Column:
    return F.coalesce("compute_ms", "duration_ms")


def bucketed(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, t0, t1): spans cut at the edges of buckets of time, so that a run of any length is many small pieces of work.

    Buckets don't overlap: the time covered is the sum over them, the most at once the largest of them.
    """
    some = spans.where("t1 > t0").select(*keys, "t0", "t1")
    at = F.explode(F.sequence(F.floor(F.col("t0") / BUCKET_MS), F.floor((F.col("t1") - 1) / BUCKET_MS)))
    cut = some.select("*", at.alias("bucket"))
    return cut.select(*keys, "bucket", F.greatest("t0", F.col("bucket") * BUCKET_MS).alias("t0"), F.least("t1", (F.col("bucket") + 1) * BUCKET_MS).alias("t1"))


def union_ms(spans: DataFrame, *keys: str) -> DataFrame:
    """Wall time that each key's spans cover: in each bucket, what a span adds beyond the latest end so far, in order of start."""
    before = Window.partitionBy(*keys, "bucket").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    adds = F.greatest(F.lit(0).cast("long"), F.col("t1") - F.greatest("t0", F.coalesce("reached", "t0")))
    return bucketed(spans, *keys).withColumn("reached", F.max("t1").over(before)).groupBy(*keys).agg(F.sum(adds).alias("union_ms"))


def peak_overlap(spans: DataFrame, *keys: str) -> DataFrame:
    """The most spans at once; where one ends as another starts they don't overlap."""
    points = bucketed(spans, *keys).select(*keys, "bucket", F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t1").alias("t"), F.lit(-1).alias("d")))).alias("p"))
    steps = points.groupBy(*keys, "bucket", F.col("p.t").alias("t"), F.col("p.d").alias("d")).agg(F.sum("p.d").alias("by"))
    running = F.sum("by").over(Window.partitionBy(*keys, "bucket").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("now", running).groupBy(*keys).agg(F.max("now").alias("peak"))


def cover(spans: DataFrame) -> DataFrame:
    """Covered and idle time of each run's critical path, in closed form: the union, and what is left up to the last end."""
    bounds = spans.groupBy("run_id").agg(F.min("t0").alias("start"), F.max(F.when(F.col("kind") != "agent", F.col("t1"))).alias("last"))
    joined = bounds.join(union_ms(work(spans), "run_id"), "run_id", "left")
    covered = F.coalesce("union_ms", F.lit(0).cast("long"))
    return joined.select("run_id", covered.alias("covered_ms"), F.greatest(F.lit(0).cast("long"), F.col("last") - F.col("start") - covered).alias("idle_ms"))


def _records(spans: DataFrame) -> DataFrame:
    """(run_id, no, id, t0, t1): of each run's work the spans that reach further than all that start before them, numbered from 1 by their start.

    Others are never on the path. Starts and ends of these both ascend; of spans that start together the longest is the only one."""
    some = spans.where("kind <> 'agent' AND t1 > t0").select("run_id", "id", "t0", "t1")
    placed = in_ranges(some, ["run_id"], [F.col("t0"), F.col("t1").desc(), F.col("id")], "spans")
    far = max_before(placed, ["run_id"], "t1", "reached").where("reached IS NULL OR t1 > reached").select("run_id", "id", "t0", "t1")
    return written(numbered(far, "no", [F.col("t0")], ["run_id"]), "records")


def _next(records: DataFrame) -> DataFrame:
    """``records`` with next: the last one that starts by this one's end, or if that is itself the one behind it, after idle time."""
    start = records.select("run_id", F.col("t0").alias("t"), F.lit(0).alias("end"), F.lit(1).alias("starts"), "no")
    end = records.select("run_id", F.col("t1").alias("t"), F.lit(1).alias("end"), F.lit(0).alias("starts"), "no")
    placed = in_ranges(start.unionByName(end), ["run_id"], [F.col("t"), F.col("end"), F.col("no")], "ends")
    before = before_range(placed, ["run_id"], n=F.sum("starts")).select(F.col("run_id").alias("r"), F.col("__part").alias("p"), "n")
    here = Window.partitionBy("run_id", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("c", F.sum("starts").over(here)).join(before, (F.col("run_id") == F.col("r")) & (F.col("__part") == F.col("p")))
    ends = counted.where("end = 1").select("run_id", "no", F.greatest(F.col("no") + 1, F.col("n") + F.col("c")).alias("next"))
    last = records.groupBy("run_id").agg(F.max("no").alias("last"))
    joined = records.join(ends, ["run_id", "no"]).join(last, "run_id")
    return joined.select("run_id", "no", "id", "t0", "t1", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next"))


def critical_path(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, step, id, gained_ms): the greedy chain, always on to the open span that reaches furthest, else to the next start.

    A run's candidates are numbered and cut into blocks of so many. A block's function says of each place where the chain can come in where it
    goes out; these functions are composed by doubling, in as many rounds as the number of blocks has binary digits, which gives the place where the
    chain comes into each block, and each block then expands its own part. So a run is never in one task, and the driver sees one number a round.
    """
    steps = written(_next(_records(spans)).withColumn("block", F.call_function("div", F.col("no") - 1, F.lit(block))), "steps")

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        first, to = int(rows.no.iloc[0]), rows.next.fillna(0).astype("int64").tolist()
        out = to.copy()
        for i in range(len(to) - 1, -1, -1):
            if 0 < to[i] < first + len(to):
                out[i] = out[to[i] - first]
        return pd.DataFrame({"run_id": rows.run_id, "no": rows.no, "leaves": out})

    leaves = written(steps.select("run_id", "block", "no", "next").groupBy("run_id", "block").applyInPandas(leave, "run_id string, no long, leaves long"), "leaves")
    doors = leaves.select("run_id", F.col("leaves").alias("no")).unionByName(leaves.select("run_id", F.lit(1).cast("long").alias("no"))).where("no > 0").distinct()
    jump = written(leaves.join(doors, ["run_id", "no"]).where("leaves > 0"), "jumps")
    passed = written(leaves.where("no = 1").select("run_id", "no"), "passed")
    while not jump.isEmpty():
        more = passed.join(jump, ["run_id", "no"]).select("run_id", F.col("leaves").alias("no"))
        longer = passed.unionByName(more).distinct()
        twice = jump.alias("a").join(jump.select("run_id", F.col("no").alias("leaves"), F.col("leaves").alias("then")).alias("b"), ["run_id", "leaves"]).select("run_id", "no", F.col("then").alias("leaves"))
        passed, twice = written(longer, "passed"), written(twice, "jumps")
        dropped(jump)
        jump = twice
    entries = passed.select("run_id", F.call_function("div", F.col("no") - 1, F.lit(block)).alias("block"), F.col("no").alias("entry"))

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        first, to, at, taken = int(rows.no.iloc[0]), rows.next.fillna(0).astype("int64").tolist(), int(rows.entry.iloc[0]), []
        while first <= at < first + len(to):
            taken.append(at - first)
            at = to[at - first]
        return rows.iloc[taken][["run_id", "no", "id", "t0", "t1"]]

    taken = steps.join(entries, ["run_id", "block"]).groupBy("run_id", "block").applyInPandas(expand, "run_id string, no long, id long, t0 long, t1 long")
    placed = in_ranges(numbered(taken, "step", [F.col("no")], ["run_id"]), ["run_id"], [F.col("no")], "path")
    return max_before(placed, ["run_id"], "t1", "at").select("run_id", (F.col("step") - 1).alias("step"), "id", (F.col("t1") - F.greatest(F.col("t0"), F.coalesce("at", "t0"))).alias("gained_ms"))


def nth_percent(values: DataFrame, key: str, value: str, percent: int) -> DataFrame:
    """The value at place min(n - 1, floor(percent / 100 * n)) of each key in ascending order."""
    return nth_value(values, key, value, F.least(F.col("n") - 1, F.call_function("div", F.col("n") * percent, F.lit(100))), f"p{percent}")


def agent_tree(nodes: DataFrame) -> DataFrame:
    """(run_id, agent_id, cost_cents, self_ms, agents) summed over each agent's subtree, from its own (run_id, agent_id, parent_id, cost_cents, self_ms).

    By doubling: each round an agent hands its sum to the one that its pointer names and then points where that one points, so a round
    doubles the depth that is summed, and no agent is gathered with its ancestors. A parent that isn't there makes an orphan, which is a root. Of agents that are each other's
    ancestors the one with the smallest id is the root: what the others point to doesn't end there, so pointers left after the longest possible chain give them away.
    """
    keys = ["run_id", "agent_id"]
    there = nodes.select("run_id", F.col("agent_id").alias("parent_id"), F.lit(True).alias("known"))
    own = nodes.join(there, ["run_id", "parent_id"], "left").select(*keys, F.when(F.col("known"), F.col("parent_id")).alias("up"), "cost_cents", "self_ms", F.lit(1).cast("long").alias("agents"))
    own = written(own, "agents")
    rounds = max(1, (own.groupBy("run_id").count().agg(F.max("count")).first()[0] or 1).bit_length())
    up = written(own.where("up IS NOT NULL").select(*keys, "up", F.col("up").alias("least")), "pointers")
    for _ in range(rounds):
        if up.isEmpty():
            break
        ahead = up.select("run_id", F.col("agent_id").alias("up"), F.col("up").alias("further"), F.col("least").alias("least_there"))
        new = written(up.join(ahead, ["run_id", "up"]).select(*keys, F.col("further").alias("up"), F.least("least", "least_there").alias("least")), "pointers")
        dropped(up)
        up = new
    # what still points somewhere leads into a circle, whose members are those pointed to; each has seen its whole circle
    circle = up.join(up.select("run_id", F.col("up").alias("agent_id")).distinct(), keys, "left_semi").where("agent_id = least").select(*keys, F.lit(True).alias("cut"))
    sums = written(own.join(circle, keys, "left").withColumn("up", F.when(F.col("cut").isNull(), F.col("up"))).drop("cut"), "subtrees")
    added = ("cost_cents", "self_ms", "agents")
    while not sums.where("up IS NOT NULL").isEmpty():
        handed = sums.where("up IS NOT NULL").groupBy("run_id", F.col("up").alias("agent_id")).agg(*[F.sum(c).alias(f"more_{c}") for c in added])
        ahead = sums.select("run_id", F.col("agent_id").alias("up"), F.col("up").alias("further"))
        joined = sums.join(handed, keys, "left").join(ahead, ["run_id", "up"], "left")
        new = written(joined.select(*keys, F.col("further").alias("up"), *[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in added]), "subtrees")
        dropped(sums)
        sums = new
    return sums.drop("up")


def _totals(prefix: str = "") -> list[Column]:
    tokens = F.col("tok_in") + F.col("tok_out") + F.col("tok_read") + F.col("tok_write")
    return [F.sum(F.coalesce("cost_cents", F.lit(0).cast("long"))).alias("cost_cents"), F.sum(tokens).alias("tokens"), F.count("*").alias("spans")]


def phases(spans: DataFrame) -> DataFrame:
    some = work(spans)
    model = lambda c: F.sum(F.when(F.col("kind") == "model", c).otherwise(F.lit(0).cast("long")))
    sums = some.groupBy("run_id", "site").agg(model(compute_of()).alias("compute_ms"), model(F.col("wait_ms")).alias("wait_ms"), *_totals())
    return sums.join(union_ms(some, "run_id", "site"), ["run_id", "site"], "left").withColumnRenamed("union_ms", "wall_ms")


def agents(spans: DataFrame) -> DataFrame:
    """Own work of each agent; the subtree is the last wrapper span's duration, or the own union where there is none."""
    own = work(spans).where("agent_id IS NOT NULL")
    last = Window.partitionBy("run_id", "agent_id").orderBy(F.desc("id"))
    wrapper = spans.where("kind = 'agent' AND agent_id IS NOT NULL").withColumn("r", F.row_number().over(last)).where("r = 1").select("run_id", "agent_id", F.col("duration_ms").alias("wrapped_ms"))
    sums = own.groupBy("run_id", "agent_id").agg(*_totals()).join(union_ms(own, "run_id", "agent_id"), ["run_id", "agent_id"], "left")
    out = sums.join(wrapper, ["run_id", "agent_id"], "left")
    self_ms = F.coalesce("union_ms", F.lit(0).cast("long"))
    return out.select("run_id", "agent_id", self_ms.alias("self_ms"), F.coalesce("wrapped_ms", self_ms).alias("subtree_ms"), "cost_cents", "tokens", "spans")


def top_spans(spans: DataFrame, measure: Column, n: int = TOP_N) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc("measure"), "id")
    ranked = spans.where("kind = 'model'").withColumn("measure", measure).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("run_id", "rank", "id", "site", "measure")


def wait_ratio(spans: DataFrame) -> DataFrame:
    sums = spans.where("kind = 'model'").groupBy("run_id").agg(F.sum(compute_of()).alias("compute_ms"), F.sum("wait_ms").alias("wait_ms"))
    ratio = F.when(F.col("compute_ms") > 0, rounded(F.col("wait_ms") / F.col("compute_ms"), 2)).otherwise(0.0)
    return sums.withColumn("ratio", ratio)


def _found(rows: DataFrame, kind: str, severity: Column) -> DataFrame:
    return rows.select("run_id", F.lit(kind).alias("anomaly"), F.col("id").alias("span_id"), severity.cast("long").alias("severity_ms"))


def high_wait(spans: DataFrame) -> DataFrame:
    models = spans.where("kind = 'model'")
    joined = models.join(nth_percent(models, "run_id", "wait_ms", 95), "run_id")
    return _found(joined.where(F.col("wait_ms") >= F.greatest(F.lit(HIGH_WAIT_MS), F.col("p95"))), "high-wait", F.col("wait_ms"))


def slow_step(spans: DataFrame) -> DataFrame:
    models = spans.where("kind = 'model'").withColumn("compute", compute_of())
    joined = models.join(nth_percent(models.where("compute > 0"), "run_id", "compute", 50), "run_id", "left")
    return _found(joined.where(F.col("compute") >= F.greatest(F.lit(SLOW_STEP_MS), 3 * F.coalesce("p50", F.lit(0)))), "slow-step", F.col("compute"))


def retry_storm(spans: DataFrame) -> DataFrame:
    return _found(spans.where("kind = 'model' AND retry_ms > 1000"), "retry-storm", F.col("retry_ms"))


def error_step(spans: DataFrame) -> DataFrame:
    return _found(spans.where("kind = 'model' AND status = 'error'"), "error-step", F.lit(None))


def redundant_call(spans: DataFrame) -> DataFrame:
    good = spans.where("kind = 'model' AND status = 'ok' AND call_key <> ''")
    return good.groupBy("run_id", "call_key").agg(F.count("*").alias("calls")).where("calls > 1")


def tail_agent(spans: DataFrame) -> DataFrame:
    wrappers = spans.where("kind = 'agent'")
    typical = nth_percent(wrappers, "run_id", "duration_ms", 50).join(wrappers.groupBy("run_id").agg(F.count("*").alias("n")), "run_id")
    joined = wrappers.join(typical, "run_id").where("n > 2 AND duration_ms > 0 AND duration_ms >= 3 * p50")
    return _found(joined, "tail-agent", F.col("duration_ms"))


def anomalies(spans: DataFrame) -> DataFrame:
    """All kinds together, ranked within a run by severity; those without one come last."""
    calls = redundant_call(spans).select("run_id", F.lit("redundant-call").alias("anomaly"), F.lit(None).cast("long").alias("span_id"), F.lit(None).cast("long").alias("severity_ms"))
    found = high_wait(spans)
    for part in (slow_step(spans), retry_storm(spans), error_step(spans), calls, tail_agent(spans)):
        found = found.unionByName(part)
    return found


def ranked_anomalies(spans: DataFrame, n: int = 20) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc(F.coalesce("severity_ms", F.lit(0).cast("long"))), "anomaly", F.col("span_id").asc_nulls_last())
    return anomalies(spans).where("anomaly <> 'redundant-call'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def digest(spans: DataFrame) -> DataFrame:
    """One row a run: the totals of a run digest."""
    models = spans.where("kind = 'model'")
    out = spans.groupBy("run_id").agg(F.count("*").alias("spans"), (F.max("t1") - F.min("t0")).alias("wall_ms"))
    out = out.join(wait_ratio(spans), "run_id", "left").join(cover(spans), "run_id", "left")
    out = out.join(union_ms(spans.where("kind = 'io'"), "run_id").withColumnRenamed("union_ms", "io_ms"), "run_id", "left")
    out = out.join(peak_overlap(models, "run_id").withColumnRenamed("peak", "peak_model"), "run_id", "left")
    out = out.join(peak_overlap(spans.where("kind = 'io'"), "run_id").withColumnRenamed("peak", "peak_io"), "run_id", "left")
    return out.join(anomalies(spans).groupBy("run_id").agg(F.count("*").alias("anomalies")), "run_id", "left")


def clamped(text: Column, most: int = FIELD_CHARS) -> Column:
    """Text of a step, cut with a mark if it is longer than a field may be."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def degraded_steps(steps: DataFrame, field: int = FIELD_CHARS, total: int = RUN_CHARS) -> DataFrame:
    """Steps with their text clamped to ``field`` characters, kept while the running sum of the run stays within ``total``.

    The sum is of a range of turns and of those before it, so a long conversation isn't one window."""
    placed = in_ranges(steps.select("conv_id", "turn", clamped(F.col("text"), field).alias("text")), ["conv_id"], [F.col("turn")], "steps")
    before = before_range(placed, ["conv_id"], chars=F.sum(F.length("text"))).select(F.col("conv_id").alias("c"), F.col("__part").alias("p"), "chars")
    here = F.sum(F.length("text")).over(Window.partitionBy("conv_id", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("here", here).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("__part") == F.col("p")))
    running = (F.col("chars") + F.coalesce("here", F.lit(0))).cast("long")
    return joined.select("conv_id", "turn", F.when(running <= total, F.col("text")).alias("text"), running.alias("running"))


UNION_SQL = """sum(greatest(0, t1 - greatest(t0, coalesce(reached, t0))))::BIGINT"""
MODEL, IO, AGENT = "kind = 'model'", "kind = 'io'", "kind = 'agent'"


def _pct(value: str, percent: int, where: str) -> str:
    return f"(SELECT run_id, min(v) FILTER (r = least(n - 1, n * {percent} // 100)) AS p FROM (SELECT run_id, {value} AS v, row_number() OVER (PARTITION BY run_id ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n FROM spans WHERE {where}) GROUP BY run_id)"


def _union_sql(keys: str, where: str) -> str:
    return f"(SELECT {keys}, {UNION_SQL} AS u FROM (SELECT *, max(t1) OVER (PARTITION BY {keys} ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans WHERE t1 > t0 AND {where}) GROUP BY {keys})"


def _peak_sql(where: str) -> str:
    return f"(SELECT run_id, max(c)::BIGINT AS p FROM (SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT run_id, t0 AS t, 1 AS d FROM spans WHERE t1 > t0 AND {where} UNION ALL SELECT run_id, t1, -1 FROM spans WHERE t1 > t0 AND {where})) GROUP BY run_id)"


WORK = "kind IN ('model', 'io', 'tool')"
COMPUTE = "coalesce(compute_ms, duration_ms)"
HIGH = f"SELECT run_id, 'high-wait' AS anomaly, id AS span_id, wait_ms AS severity_ms FROM spans JOIN {_pct('wait_ms', 95, MODEL)} USING (run_id) WHERE {MODEL} AND wait_ms >= greatest(750, p)"
SLOW = f"SELECT run_id, 'slow-step' AS anomaly, id AS span_id, {COMPUTE} AS severity_ms FROM spans LEFT JOIN {_pct(COMPUTE, 50, f'{MODEL} AND {COMPUTE} > 0')} USING (run_id) WHERE {MODEL} AND {COMPUTE} >= greatest(4000, 3 * coalesce(p, 0))"
RETRY = f"SELECT run_id, 'retry-storm' AS anomaly, id AS span_id, retry_ms AS severity_ms FROM spans WHERE {MODEL} AND retry_ms > 1000"
ERROR = f"SELECT run_id, 'error-step' AS anomaly, id AS span_id, NULL::BIGINT AS severity_ms FROM spans WHERE {MODEL} AND status = 'error'"
TAIL = f"SELECT run_id, 'tail-agent' AS anomaly, id AS span_id, duration_ms AS severity_ms FROM spans JOIN {_pct('duration_ms', 50, AGENT)} USING (run_id) JOIN (SELECT run_id, count(*) AS n FROM spans WHERE kind = 'agent' GROUP BY 1) USING (run_id) WHERE kind = 'agent' AND n > 2 AND duration_ms > 0 AND duration_ms >= 3 * p"
CALLS = f"SELECT run_id, call_key, count(*) AS calls FROM spans WHERE {MODEL} AND status = 'ok' AND call_key <> '' GROUP BY ALL HAVING count(*) > 1"
ALL = f"{HIGH} UNION ALL {SLOW} UNION ALL {RETRY} UNION ALL {ERROR} UNION ALL {TAIL}"
RATIO = f"SELECT run_id, sum({COMPUTE})::BIGINT AS compute_ms, sum(wait_ms)::BIGINT AS wait_ms, CASE WHEN sum({COMPUTE}) > 0 THEN floor(sum(wait_ms) / sum({COMPUTE}) * 100 + 0.5) / 100 ELSE 0.0 END AS ratio FROM spans WHERE {MODEL} GROUP BY run_id"
COVER = f"SELECT run_id, coalesce(u, 0)::BIGINT AS covered_ms, greatest(0, l - s - coalesce(u, 0))::BIGINT AS idle_ms FROM (SELECT run_id, min(t0) AS s, max(t1) FILTER (kind <> 'agent') AS l FROM spans GROUP BY run_id) LEFT JOIN {_union_sql('run_id', WORK)} USING (run_id)"
PATH = """WITH RECURSIVE r AS MATERIALIZED (SELECT run_id, id, t0, t1, row_number() OVER (PARTITION BY run_id ORDER BY t0) AS no FROM
  (SELECT *, max(t1) OVER (PARTITION BY run_id ORDER BY t0, t1 DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans WHERE kind <> 'agent' AND t1 > t0) WHERE m IS NULL OR t1 > m),
s AS MATERIALIZED (SELECT a.run_id, a.no, greatest(a.no + 1, max(b.no)) AS next FROM r a JOIN r b ON a.run_id = b.run_id AND a.t1 >= b.t0 GROUP BY a.run_id, a.no),
p AS (SELECT run_id, no, 0::BIGINT AS step, id, t1, t1 - t0 AS gained_ms FROM r WHERE no = 1 UNION ALL
  SELECT r.run_id, r.no, p.step + 1, r.id, r.t1, r.t1 - greatest(r.t0, p.t1) FROM p JOIN s ON s.run_id = p.run_id AND s.no = p.no JOIN r ON r.run_id = s.run_id AND r.no = s.next)
SELECT run_id, step, id, gained_ms FROM p"""
TREE = """WITH RECURSIVE n AS (SELECT a.run_id, a.agent_id, b.agent_id AS up, a.cost_cents, a.self_ms FROM agent_nodes a LEFT JOIN agent_nodes b ON b.run_id = a.run_id AND b.agent_id = a.parent_id),
above AS (SELECT run_id, agent_id, up FROM n WHERE up IS NOT NULL UNION SELECT above.run_id, above.agent_id, n.up FROM above JOIN n ON n.run_id = above.run_id AND n.agent_id = above.up WHERE n.up IS NOT NULL),
ring AS (SELECT a.run_id, a.agent_id, min(a.up) AS least FROM above a JOIN above b ON b.run_id = a.run_id AND b.agent_id = a.up AND b.up = a.agent_id GROUP BY 1, 2),
f AS (SELECT n.run_id, n.agent_id, CASE WHEN ring.least = n.agent_id THEN NULL ELSE n.up END AS up, cost_cents, self_ms FROM n LEFT JOIN ring USING (run_id, agent_id)),
t AS (SELECT run_id, agent_id, agent_id AS root FROM f UNION ALL SELECT f.run_id, f.agent_id, t.root FROM t JOIN f ON f.run_id = t.run_id AND f.up = t.agent_id)
SELECT t.run_id, t.root AS agent_id, sum(cost_cents)::BIGINT AS cost_cents, sum(self_ms)::BIGINT AS self_ms, count(*) AS agents FROM t JOIN f ON f.run_id = t.run_id AND f.agent_id = t.agent_id GROUP BY 1, 2"""
TOTALS = "sum(coalesce(cost_cents, 0))::BIGINT AS cost_cents, sum(tok_in + tok_out + tok_read + tok_write)::BIGINT AS tokens, count(*) AS spans"


def _top_sql(measure: str) -> str:
    return f"SELECT * FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {measure} DESC NULLS LAST, id)::INT AS rank, id, site, {measure} AS measure FROM spans WHERE {MODEL}) WHERE rank <= 8"


register("tr02_union", "spans", lambda s: union_ms(work(s), "run_id", "agent_id"), f"SELECT run_id, agent_id, u AS union_ms FROM {_union_sql('run_id, agent_id', WORK)}")
register("tr03_peak", "spans", lambda s: peak_overlap(work(s), "run_id"), f"SELECT run_id, p AS peak FROM {_peak_sql(WORK)}")
register("tr04_cover", "spans", cover, COVER)
register("tr04_path", "spans", critical_path, PATH)
register("tr05_phases", "spans", phases, f"SELECT * FROM (SELECT run_id, site, sum(CASE WHEN {MODEL} THEN {COMPUTE} ELSE 0 END)::BIGINT AS compute_ms, sum(CASE WHEN {MODEL} THEN wait_ms ELSE 0 END)::BIGINT AS wait_ms, {TOTALS} FROM spans WHERE {WORK} GROUP BY ALL) LEFT JOIN (SELECT run_id, site, u AS wall_ms FROM {_union_sql('run_id, site', WORK)}) USING (run_id, site)")
register("tr06_agents", "spans", agents, f"SELECT run_id, agent_id, coalesce(u, 0)::BIGINT AS self_ms, coalesce(w, u, 0)::BIGINT AS subtree_ms, cost_cents, tokens, spans FROM (SELECT run_id, agent_id, {TOTALS} FROM spans WHERE {WORK} AND agent_id IS NOT NULL GROUP BY ALL) LEFT JOIN {_union_sql('run_id, agent_id', WORK + ' AND agent_id IS NOT NULL')} USING (run_id, agent_id) LEFT JOIN (SELECT run_id, agent_id, max_by(duration_ms, id) AS w FROM spans WHERE kind = 'agent' AND agent_id IS NOT NULL GROUP BY ALL) USING (run_id, agent_id)")
register("tr06_agent_tree", "agent_nodes", agent_tree, TREE)
register("jn17_agent_wrapper", "spans", lambda s: agents(s).select("run_id", "agent_id", "subtree_ms"), f"SELECT run_id, agent_id, coalesce(w, u, 0)::BIGINT AS subtree_ms FROM (SELECT DISTINCT run_id, agent_id FROM spans WHERE {WORK} AND agent_id IS NOT NULL) LEFT JOIN {_union_sql('run_id, agent_id', WORK + ' AND agent_id IS NOT NULL')} USING (run_id, agent_id) LEFT JOIN (SELECT run_id, agent_id, max_by(duration_ms, id) AS w FROM spans WHERE kind = 'agent' AND agent_id IS NOT NULL GROUP BY ALL) USING (run_id, agent_id)")
register("tr07_top_cost", "spans", lambda s: top_spans(s, F.coalesce("cost_cents", F.lit(0).cast("long"))), _top_sql("coalesce(cost_cents, 0)"))
register("tr07_top_latency", "spans", lambda s: top_spans(s, compute_of()), _top_sql(COMPUTE))
register("tr07_top_wait", "spans", lambda s: top_spans(s, F.col("wait_ms")), _top_sql("wait_ms"))
register("tr08_wait_ratio", "spans", wait_ratio, RATIO)
register("tr09_high_wait", "spans", high_wait, HIGH)
register("tr10_slow_step", "spans", slow_step, SLOW)
register("tr11_retry_error", "spans", lambda s: retry_storm(s).unionByName(error_step(s)), f"{RETRY} UNION ALL {ERROR}")
register("tr12_redundant_call", "spans", redundant_call, CALLS)
register("tr13_tail_agent", "spans", tail_agent, TAIL)
register("tr14_ranked_anomalies", "spans", ranked_anomalies, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(severity_ms, 0) DESC, anomaly, span_id NULLS LAST)::INT AS rank FROM ({ALL})) WHERE rank <= 20")
register("tr01_digest", "spans", digest, f"SELECT * FROM (SELECT run_id, count(*) AS spans, max(t1) - min(t0) AS wall_ms FROM spans GROUP BY 1) LEFT JOIN ({RATIO}) USING (run_id) LEFT JOIN ({COVER}) USING (run_id) LEFT JOIN (SELECT run_id, u AS io_ms FROM {_union_sql('run_id', IO)}) USING (run_id) LEFT JOIN (SELECT run_id, p AS peak_model FROM {_peak_sql(MODEL)}) USING (run_id) LEFT JOIN (SELECT run_id, p AS peak_io FROM {_peak_sql(IO)}) USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS anomalies FROM (SELECT run_id FROM ({ALL}) UNION ALL SELECT run_id FROM ({CALLS})) GROUP BY 1) USING (run_id)")
register("tr15_derivation", "spans", lambda s: s.select("id", F.greatest(F.lit(0).cast("long"), F.col("t1") - F.col("t0")).alias("duration_ms"), F.greatest(F.lit(0).cast("long"), F.col("t1") - F.col("t0") - F.col("wait_ms")).alias("compute_ms")), "SELECT id, greatest(0, t1 - t0) AS duration_ms, greatest(0, t1 - t0 - wait_ms) AS compute_ms FROM spans")
register("tr16_capture", "conversations", degraded_steps, f"SELECT conv_id, turn, CASE WHEN running <= {RUN_CHARS} THEN text END AS text, running FROM (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT conv_id, turn, CASE WHEN length(text) > {FIELD_CHARS} THEN text[1:{FIELD_CHARS}] || '{CUT_MARK}' ELSE text END AS text FROM conversations))")
register("tr17_rebuild", "journal", lambda j: j.where("kind = 'trace'").groupBy("run_id").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")), "SELECT run_id, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq FROM journal WHERE kind = 'trace' GROUP BY 1")
register("ag13_percentile", "spans", lambda s: nth_percent(s.where("kind = 'model'"), "run_id", "wait_ms", 95), f"SELECT run_id, p AS p95 FROM {_pct('wait_ms', 95, MODEL)}")
register("st04_work_union", "spans", lambda s: s.where("kind = 'model'").select("id", "kind").unionByName(s.where("kind = 'io'").select("id", "kind")).unionByName(s.where("kind = 'tool'").select("id", "kind")), f"SELECT id, kind FROM spans WHERE {WORK}")
register("xs33_tokens", "spans", lambda s: s.select("id", (F.col("tok_in") + F.col("tok_out") + F.col("tok_read") + F.col("tok_write")).alias("tokens")), "SELECT id, tok_in + tok_out + tok_read + tok_write AS tokens FROM spans")
register("pf13_span_filter", "spans", lambda s: s.where((F.col("kind") == "io") & F.concat_ws(" ", "site", "status", "agent_id").rlike("(?i)CLICK|abort")).select("id", "run_id", "site", "status"), "SELECT id, run_id, site, status FROM spans WHERE kind = 'io' AND regexp_matches(concat_ws(' ', site, status, agent_id), '(?i)CLICK|abort')")
register("ag33_trace_list", "spans", lambda s: digest(s).select("run_id", "ratio", "peak_model", "spans"), f"SELECT run_id, ratio, p AS peak_model, spans FROM (SELECT run_id, count(*) AS spans FROM spans GROUP BY 1) LEFT JOIN ({RATIO}) USING (run_id) LEFT JOIN {_peak_sql(MODEL)} USING (run_id)")
