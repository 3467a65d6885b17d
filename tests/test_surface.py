"""Connectors and the extension surface."""

import pytest

from tessella.operators import surface
from tessella.sources import connectors
from tessella.streaming import journal


def test_tool_names(spark):
    tools = surface.ToolRegistry(spark)
    tools.add("find-text", surface.Grep, "at int, match string, around string")
    for bad in ("find-text", "search", "9lives", "a" * 65, "a b"):
        with pytest.raises(ValueError):
            tools.add(bad, surface.Grep, "at int")
    got = spark.sql("SELECT * FROM find_text('one two ONE', 'one', true, 2, 5)").collect()
    assert [tuple(r) for r in got] == [(0, "one", "one t"), (8, "ONE", "o ONE")]


def test_retries_end():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "done"

    assert connectors.Politeness().call(flaky) == "done" and len(calls) == 3
    with pytest.raises(ValueError):
        connectors.Politeness().call(lambda: (_ for _ in ()).throw(ValueError()))


@pytest.mark.parametrize(("url", "video"), [("https://youtu.be/abcdefghijk?t=1", "abcdefghijk"), ("https://www.youtube.com/watch?x=1&v=abcdefghijk", "abcdefghijk"), ("https://m.youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("https://youtube.com/watch?v=short", None), ("https://example.com/watch?v=abcdefghijk", None)])
def test_video_ids(url, video):
    assert connectors.video_id(url) == video


def test_tracks():
    tracks = [{"lang": "de"}, {"lang": "en", "kind": "asr"}, {"lang": "en-GB"}]
    assert connectors.picked_track(tracks) == {"lang": "en-GB"} and connectors.picked_track(tracks[:2]) == tracks[1] and connectors.picked_track([]) is None


def test_attempts(spark):
    rows = [("u", 0, False, 5.0), ("u", 1, True, 1.0), ("u", 2, True, 9.0), ("v", 0, False, 1.0), ("v", 1, False, 3.0)]
    got = connectors.attempts_by_host(spark.createDataFrame(rows, "url string, ord int, good boolean, score double")).collect()
    assert {r["url"]: r["ord"] for r in got} == {"u": 1, "v": 1}


def test_trace_files(spark, tmp_path):
    (tmp_path / "abc").mkdir()
    (tmp_path / "abc" / "r1.digest.json").write_text('{"wall_ms": 5, "cost_usd": 0.5}')
    (tmp_path / "abc" / "r1.trace.json").write_text("{}")
    assert [tuple(r) for r in connectors.trace_files(spark, str(tmp_path)).collect()] == [("abc", "r1", 5, 0.5)]


def test_a_stream_sees_all_from_its_start(spark):
    sf = "/root/testdata/sf0.001"
    got = journal.drained(journal.counters(journal.stream(spark, sf)), "complete")
    assert sum(r["n"] for r in got.collect()) == spark.read.parquet(f"{sf}/events.parquet").count()
