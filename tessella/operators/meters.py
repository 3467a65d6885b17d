"""A run's budget as a tree of meters: charges, holds and grants, as a fold over the operations of many runs and as state of a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator, MutableMapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed import GRANT_FLOOR, GRANT_FRACTION, METER_EPSILON
from ..plans.registry import QUERIES, register
from ..plans.scratch import scratch_path

OPS = "run_id string, seq long, op string, meter string, other string, usd double, fraction double, max_usd double, min_usd double"
#: What each operation did: the amount that it moved, null if it was refused, and the meter behind it.
DONE = "run_id string, seq long, op string, meter string, amount double, spent double, remaining double, floored boolean, total double, exhausted boolean"
ROOT = "root"
LIMIT, USED, GRANTED, HELD, TOTAL, PARENT = range(6)
STATE = "meter_limit double, used double, granted double, held double, total double, parent string"
HOLD = "meter string, amount double"


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


class MeterTree:
    """Meters of one run, each one row of ``meters`` (limit, used, granted, held, total, parent), total in the root's alone, and open holds (meter, amount).

    open: the root with a limit. charge: on a meter. reserve: a hold named ``other`` on a meter, as much as there is. settle, free: a hold with what it cost, or
    nothing. grant: a child named ``other``, a fraction of what is left or at most ``max_usd``, at least ``min_usd``. release: a child, whose use its parent absorbs
    and gets the rest back; children of its own are released first, so none is left behind. close: all that is open, at a run's end.
    A name in use isn't opened again, an unknown one is refused.
    """

    def __init__(self, meters: MutableMapping[str, tuple], holds: MutableMapping[str, tuple]):
        self.meters, self.holds = meters, holds

    def remaining(self, m: tuple) -> float:
        return max(0.0, m[LIMIT] - m[USED] - m[GRANTED] - m[HELD])

    def _add(self, name: str, **by: float) -> None:
        m = list(self.meters[name])
        for field, x in by.items():
            at = {"used": USED, "granted": GRANTED, "held": HELD, "total": TOTAL}[field]
            m[at] = max(0.0, m[at] + x) if field in ("granted", "held") else m[at] + x
        self.meters[name] = tuple(m)

    def charge(self, name: str, usd: float | None) -> float | None:
        if not _finite(usd) or usd <= 0:
            return None
        self._add(name, used=usd)
        self._add(ROOT, total=usd)
        return usd

    def reserve(self, name: str, hold: str, usd: float | None) -> float | None:
        amount = min(usd, self.remaining(self.meters[name])) if _finite(usd) and usd > 0 else 0.0
        if amount <= 0 or hold in self.holds:
            return None
        self._add(name, held=amount)
        self.holds[hold] = (name, amount)
        return amount

    def settle(self, hold: str, usd: float | None) -> float | None:
        if hold not in self.holds:
            return None
        name, amount = self.holds[hold]
        del self.holds[hold]
        if name in self.meters:
            self._add(name, held=-amount)
            return self.charge(name, usd) if usd is not None else amount
        return None

    def grant(self, name: str, child: str, fraction: float | None, most: float | None, least: float | None) -> float | None:
        left = self.remaining(self.meters[name])
        if left < GRANT_FLOOR or child in self.meters:
            return None
        share = min(1.0, max(0.01, fraction)) if _finite(fraction) else GRANT_FRACTION
        amount = min(max(left * share if most is None else most, GRANT_FLOOR if least is None else least), left)
        if amount < GRANT_FLOOR:
            return None
        self._add(name, granted=amount)
        self.meters[child] = (amount, 0.0, 0.0, 0.0, 0.0, name)
        return amount

    def release(self, name: str) -> float | None:
        if name == ROOT or name not in self.meters:
            return None
        for child in [k for k, m in self.meters.items() if m[PARENT] == name]:
            self.release(child)
        m = self.meters[name]
        for hold in [k for k, h in self.holds.items() if h[0] == name]:
            del self.holds[hold]
        del self.meters[name]
        self._add(m[PARENT], granted=-m[LIMIT], used=m[USED])
        return m[LIMIT] - m[USED]

    def apply(self, op: str, meter: str, other: str | None, usd: float | None, fraction: float | None, most: float | None, least: float | None) -> tuple:
        """(amount, spent, remaining, floored, total, exhausted) after one operation."""
        if op == "open":
            amount = usd if meter == ROOT and ROOT not in self.meters and _finite(usd) and usd > 0 else None
            if amount is not None:
                self.meters[ROOT] = (usd, 0.0, 0.0, 0.0, 0.0, None)
        elif op == "settle":
            amount = self.settle(other, usd or 0.0)
        elif op == "free":
            amount = self.settle(other, None)
        elif op == "close":
            amount = sum(self.release(k) or 0.0 for k in [k for k, m in self.meters.items() if m[PARENT] == ROOT]) if ROOT in self.meters else None
        elif meter not in self.meters:
            amount = None
        elif op == "charge":
            amount = self.charge(meter, usd)
        elif op == "reserve":
            amount = self.reserve(meter, other, usd)
        elif op == "grant":
            amount = self.grant(meter, other, fraction, most, least)
        else:
            amount = self.release(meter) if op == "release" else None
        root, m = self.meters.get(ROOT), self.meters.get(meter)
        spent, left = (m[USED], self.remaining(m)) if m else (None, None)
        return amount, spent, left, left is not None and left < GRANT_FLOOR, root[TOTAL] if root else 0.0, bool(root) and root[TOTAL] >= root[LIMIT] - METER_EPSILON


def _asked(row: tuple) -> tuple:
    """Arguments of an operation, what pandas has as NaN being none."""
    return tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in row)


def metered(ops: DataFrame) -> DataFrame:
    """What each operation of each run did, DONE. Runs are dealt out and sorted, and read as a stream: a task holds the meters of one run at a time, never its operations.

    Operations of a run are taken by seq; its own order can't be split, but the meters between two of them are all that it needs."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, tree = None, MeterTree({}, {})
        for rows in batches:
            out = []
            for r in rows.astype(object).itertuples(index=False):
                if r.run_id != run:
                    run, tree = r.run_id, MeterTree({}, {})
                out.append((r.run_id, r.seq, r.op, r.meter, *tree.apply(r.op, *_asked((r.meter, r.other, r.usd, r.fraction, r.max_usd, r.min_usd)))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DONE.split(", ")])

    names = [c.split()[0] for c in OPS.split(", ")]
    return ops.select(*names).repartition("run_id").sortWithinPartitions("run_id", "seq").mapInPandas(fold, DONE)


class _Rows(dict):
    """Rows of a stream's map state by name: read at once, changed here, and what changed is written back by kept()."""

    def __init__(self, state):
        super().__init__((k[0], tuple(v)) for k, v in (state.iterator() if state.exists() else ()))
        self.state, self.before = state, dict(self)

    def kept(self) -> None:
        for name in self.before.keys() - self.keys():
            self.state.removeKey((name,))
        for name, row in self.items():
            if self.before.get(name) != row:
                self.state.updateValue((name,), row)


class Meters(StatefulProcessor):
    """The tree of each run as state, a row a meter and a row a hold; a batch's operations of a run are taken by seq, later batches come later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meters = handle.getMapState("meters", "name string", STATE)
        self.holds = handle.getMapState("holds", "name string", HOLD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        meters, holds = _Rows(self.meters), _Rows(self.holds)  # the state is asked once a batch, not once an operation
        tree = MeterTree(meters, holds)
        some = pd.concat(list(rows)).sort_values("seq").astype(object)  # of one run in one batch
        out = [(r.run_id, r.seq, r.op, r.meter, *tree.apply(r.op, *_asked((r.meter, r.other, r.usd, r.fraction, r.max_usd, r.min_usd)))) for r in some.itertuples(index=False)]
        meters.kept()
        holds.kept()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DONE.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Keep state in RocksDB, which state of several variables needs, while a stream is started and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def metered_stream(ops: DataFrame) -> DataFrame:
    """metered() of a stream of operations."""
    return ops.groupBy("run_id").transformWithStateInPandas(Meters(), DONE, "append", "none")


def journal_ops(journal: DataFrame) -> DataFrame:
    """Operations on meters as a journal's entries stand for them: a run opens with its first entry and closes where it completes; agents g0 to g4 and, below each, h0 to h4 get grants."""
    n, cents = F.pmod("seq", F.lit(23)), F.col("cents").cast("double") / 100
    k = F.pmod(F.call_function("div", F.col("seq"), F.lit(23)), F.lit(5)).cast("string")
    g, h = F.concat(F.lit("g"), k), F.concat(F.lit("h"), k)
    meter = F.when(n % 3 == 0, F.lit(ROOT)).when(n % 3 == 1, g).otherwise(h)
    first = F.col("first") == F.col("seq")
    op = F.when(first, "open").when(F.col("type") == "run.completed", "close").when(n < 3, "grant").when(n < 5, "release").when(n < 9, "reserve").when(n < 12, "settle").when(n == 12, "free").otherwise("charge")
    to = F.when(first | (F.col("type") == "run.completed"), F.lit(ROOT)).when(n < 2, F.lit(ROOT)).when(n == 2, g).when(n == 3, g).when(n == 4, h).otherwise(meter)
    other = F.when(n < 2, g).when(n == 2, h).when((n >= 5) & (n < 13), F.concat(F.lit("hold"), k))
    begun = journal.groupBy("run_id").agg(F.min("seq").alias("first"))
    return journal.join(begun, "run_id").select("run_id", "seq", op.alias("op"), to.alias("meter"), other.alias("other"), F.when(first, F.lit(60.0)).otherwise(cents).alias("usd"), F.when(n == 1, F.lit(0.3)).alias("fraction"), F.when(n == 0, F.lit(4.0)).alias("max_usd"), F.when(n == 2, F.lit(1.0)).alias("min_usd"))


def shown(done: DataFrame) -> DataFrame:
    """Amounts to a millionth."""
    return done.select("run_id", "seq", "op", "meter", *[F.round(c, 6).alias(c) for c in ("amount", "spent", "remaining")], "floored", F.round("total", 6).alias("total"), "exhausted")


def streamed(spark: SparkSession, ops: DataFrame, path: str) -> DataFrame:
    """metered_stream() of a table of operations that arrives in two parts, the stream being stopped in between; what it wrote."""
    half = (ops.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (F.col("seq") < half, F.col("seq") >= half):
        ops.where(part).write.mode("append").parquet(f"{path}/ops")
        with rocks(spark):
            stream = metered_stream(spark.readStream.schema(OPS).parquet(f"{path}/ops"))
            sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
            stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(DONE).parquet(f"{path}/rows/*")


def _stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.derive import derived

    return shown(streamed(spark, journal_ops(derived(spark, sf_dir, "journal")), scratch_path(spark, "meters")))


register("ss04_meter_tree", "journal", lambda j: shown(metered(journal_ops(j))))
QUERIES["ss04_meter_stream"] = _stream_query
