"""Streams that are stopped and go on, against what one pass over all rows gives."""

import json
import random

import pytest

from tessella.operators import meters
from tessella.streaming import reserve, subscribe


def entries(spark, low, high):
    return spark.createDataFrame([(f"run{i % 3}", i, f"t{i % 5}") for i in range(low, high)], "run_id string, seq long, type string")


def test_subscriber_goes_on_where_it_stopped(spark, tmp_path):
    at = str(tmp_path)
    subscribe.append_segments(entries(spark, 0, 40), f"{at}/journal")
    subscribe.drain(subscribe.subscribed(spark, f"{at}/journal"), at, 1)
    subscribe.drain(subscribe.subscribed(spark, f"{at}/journal"), at, 2)  # nothing new
    subscribe.append_segments(entries(spark, 40, 55), f"{at}/journal")
    subscribe.append_segments(entries(spark, 55, 60).where("run_id = 'run1'"), f"{at}/journal")
    subscribe.drain(subscribe.subscribed(spark, f"{at}/journal"), at, 3)
    got = [(r["seq"], r["drain"]) for r in spark.read.parquet(f"{at}/rows/*").collect()]
    assert sorted(got) == [(i, 1 if i < 40 else 3) for i in range(60) if i < 55 or i % 3 == 1]


def test_subscriber_starts_from_any_place(spark, tmp_path):
    at = str(tmp_path)
    subscribe.append_segments(entries(spark, 0, 40), f"{at}/journal")
    stream = subscribe.subscribed(spark, f"{at}/journal", runs="run0,run2", from_=json.dumps({"run0": 20, "run2": 35}))
    subscribe.drain(stream, f"{at}/late", 1)
    got = sorted((r["run_id"], r["seq"]) for r in spark.read.parquet(f"{at}/late/rows/*").collect())
    assert got == sorted((f"run{i % 3}", i) for i in range(40) if (i % 3 == 0 and i > 20) or (i % 3 == 2 and i > 35))


def tree():
    return meters.MeterTree({}, {})


def did(t, op, meter="root", other=None, usd=None, fraction=None, most=None, least=None):
    return t.apply(op, meter, other, usd, fraction, most, least)


def test_meter_cases():
    t = tree()
    did(t, "open", usd=10)
    assert did(t, "charge", usd=2.5)[1:5] == (2.5, 7.5, False, 2.5) and did(t, "charge", usd=-1)[0] is None
    t = tree()
    did(t, "open", usd=10)
    assert did(t, "grant", other="g", most=4.0)[0] == 4 and did(t, "charge", "g", usd=1)[4] == 1
    assert t.remaining(t.meters["root"]) == 6 and did(t, "release", "g")[0] == 3 and t.remaining(t.meters["root"]) == 9
    t = tree()
    did(t, "open", usd=0.05)
    assert did(t, "grant", other="a", most=0.04)[0] == pytest.approx(0.04) and did(t, "grant", other="b", most=0.04)[0] is None
    t = tree()
    did(t, "open", usd=10), did(t, "grant", other="p", most=5.0), did(t, "grant", "p", "c", most=2.0), did(t, "charge", "c", usd=1.5)
    assert t.remaining(t.meters["p"]) == 3 and t.meters["root"][meters.TOTAL] == 1.5
    did(t, "release", "c")
    assert t.remaining(t.meters["p"]) == 3.5 and t.meters["p"][meters.USED] == 1.5
    t = tree()
    did(t, "open", usd=1)
    assert did(t, "charge", usd=0.99)[3]
    t = tree()
    did(t, "open", usd=1)
    assert did(t, "reserve", other="h", usd=0.4)[0] == 0.4 and t.remaining(t.meters["root"]) == pytest.approx(0.6)
    assert did(t, "settle", other="h", usd=0.25)[2] == 0.75 and did(t, "settle", other="h", usd=0.4)[0] is None and t.meters["root"][meters.TOTAL] == 0.25
    t = tree()
    did(t, "open", usd=0.1)
    assert did(t, "reserve", other="h", usd=5)[0] == 0.1 and did(t, "reserve", other="i", usd=0.01)[0] is None and did(t, "settle", other="h", usd=0.08)[2] == pytest.approx(0.02)
    t = tree()
    did(t, "open", usd=10), did(t, "grant", other="p", fraction=0.5), did(t, "grant", "p", "c"), did(t, "charge", "c", usd=0.5), did(t, "reserve", "c", "h", usd=0.1)
    assert t.meters["c"][meters.LIMIT] == pytest.approx(0.75)
    did(t, "close")  # the guarantee: nothing that is open is left behind
    assert set(t.meters) == {"root"} and not t.holds and t.meters["root"][:4] == (10, 0.5, 0.0, 0.0)


def operations(n=400):
    r = random.Random(4)
    out = []
    for i in range(n):
        run = "hot" if i % 4 else r.choice(["a", "b"])
        op = r.choice(["open", "charge", "reserve", "settle", "free", "grant", "grant", "release", "close"] if i > 20 else ["open"])
        meter, other = r.choice(["root", "g1", "g2", "h1"]), r.choice(["g1", "g2", "h1"]) if op == "grant" else r.choice(["x", "y"])
        out.append((run, i, op, "root" if op in ("open", "close") else meter, other, 9.0 if op == "open" else r.choice([None, 0.3, 1.7, -1.0]), r.choice([None, 0.3, 7.0]), r.choice([None, 2.0]), r.choice([None, 0.5])))
    return out


def plain(done):
    return sorted(tuple(None if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in map(tuple, done))


def test_meters_of_a_table_and_of_a_stream_equal_the_loop(spark, tmp_path):
    ops = operations()
    trees, want = {}, []
    for run, seq, op, meter, other, *rest in ops:
        want.append((run, seq, op, meter, *trees.setdefault(run, tree()).apply(op, meter, other, *rest)))
    df = spark.createDataFrame(ops, meters.OPS).repartition(5)
    assert plain(meters.metered(df).collect()) == plain(want)
    assert plain(meters.streamed(spark, df, str(tmp_path)).collect()) == plain(want)


def test_reservations_keep_their_cap_over_a_restart(spark, tmp_path):
    r = random.Random(6)
    rows = [("hot" if i % 3 else "cold", i, f"https://s{r.randrange(30)}.org/p" + ("#x" if i % 2 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, seq long, url string").repartition(4)
    batch, stream = reserve.reserved(df, 12), reserve.streamed(df, str(tmp_path), 12)
    got = sorted(map(tuple, batch.collect()))
    seen, want = {}, []
    for run, i, url in rows:
        own, plain_url = seen.setdefault(run, []), url.split("#")[0]
        if plain_url not in own:
            own.append(plain_url)
            if len(own) <= 12:
                want.append((run, i, plain_url, len(own)))
    assert got == sorted(want) and sorted(map(tuple, stream.collect())) == got


class Asked:
    """A map state that counts what is asked of it."""

    def __init__(self, rows):
        self.rows, self.asked = dict(rows), 0

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.asked += 1
            return {"exists": lambda: bool(self.rows), "iterator": lambda: iter(list(self.rows.items())), "containsKey": lambda: key in self.rows, "getValue": lambda: self.rows.get(key),
                    "updateValue": lambda: self.rows.update({key: value}), "removeKey": lambda: self.rows.pop(key, None), "keys": lambda: iter(list(self.rows))}[name]()

        return call


def test_state_of_meters_is_asked_once_a_batch():
    state, holds, want = Asked({}), Asked({}), tree()
    for part in (range(0, 150), range(150, 300)):
        meters_, holds_ = meters._Rows(state), meters._Rows(holds)
        t = meters.MeterTree(meters_, holds_)
        for i in part:
            op = ("open", "root", None, 900.0, None, None, None) if not i else (("charge", "grant", "charge", "reserve", "settle", "release")[i % 6], "root" if i % 6 < 5 else f"g{i // 12 % 3}", f"g{i // 6 % 3}", 0.5, None, 2.0, None)
            assert t.apply(*op) == want.apply(*op)
        meters_.kept(), holds_.kept()
    assert {k[0]: v for k, v in state.rows.items()} == want.meters and {k[0]: v for k, v in holds.rows.items()} == want.holds
    assert state.asked + holds.asked < 40
