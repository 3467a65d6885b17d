"""Source divergence against a dense count, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter

import numpy as np

from tessella.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, n string, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    r = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("rim", "Über", "ße", "LOT", "漢")]
    rows = []
    for i in range(80):
        source = "hot" if i % 3 else r.choice(["s1", "s2", "É", None, ""])
        rows.append((i, r.choice(["en", "en", "fr", None]), source, " ".join(r.choices(words, k=r.randint(1, 60))) + "-x1y\x00z.\n"))
    rows += [rows[4], rows[4], (7, "en", "alone", None), (8, "xx", "a", "only here"), (9, "xx", "b", ""), (None, "en", "s1", "123 !!"), (10, "en", "hot", "Long " * 40_000)]
    return rows


def dense(rows, least=3, ranks=200):
    docs = [(x or "", s or "", Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or ""))) for _, x, s, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in df.items() if n >= least)
        by = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            by[s].update({t: n for t, n in c.items() if df[t] >= least})
        whole = sum(by.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, all_p = {s: share(c) for s, c in by.items()}, share(whole)
        off = lambda a, b: (a - b) ** 2 // b
        for s in by:
            found = [("pair", o, sum(off(p[s][t], p[o][t]) for t in kept)) for o in by if o != s]
            found += [("term", t, off(p[s][t], all_p[t])) for t in kept if by[s][t] and p[s][t] > all_p[t]]
            for part in ("pair", "term"):
                ranked = sorted(((item, v) for k, item, v in found if k == part), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked[: ranks if part == "term" else None], 1)]
    return sorted(out)


def test_divergences_equal_a_dense_count(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], SCHEMA).repartition(5)
    got = divergence.divergences(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == dense(rows)
    assert sorted(map(tuple, divergence.divergences(docs, ranks=2, width=16).collect())) == dense(rows, ranks=2)  # a sketch too small to rule much out
    assert divergence.divergences(docs.limit(0)).collect() == []


def test_sketch_never_underestimates_and_rules_out(spark):
    rows = [(f"w{i % 50} v{i % 7} u{i}",) for i in range(400)]
    docs = spark.createDataFrame(rows, "text string").selectExpr("'en' AS lang", "'s' AS source", "text").repartition(6)
    found = {r["term"]: r["docs"] for r in divergence.survivors(docs).groupBy("term").agg({"docs": "sum"}).withColumnRenamed("sum(docs)", "docs").collect()}
    assert {"w", "v", "u"} == set(found) and found["w"] == 400  # digits part terms
    rows = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)} rare{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'x' * (i % 9)}",) for i in range(600)]
    docs = spark.createDataFrame(rows, "text string").selectExpr("'en' AS lang", "'s' AS source", "text").repartition(6)
    exact = Counter(t for (text,) in rows for t in set(text.split()))
    kept = {r["term"] for r in divergence.survivors(docs).collect()}
    assert {t for t, n in exact.items() if n >= 3} <= kept and len(kept) < len(exact) / 2


def test_cells_survive_packing():
    cells = np.random.default_rng(1).integers(0, 4, 4096).astype(np.uint8)
    assert (divergence._unpacked(divergence._packed(cells)) == cells).all()
