"""SpotSigs against a loop over words, its pairs against all pairs, and odd texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import spot_signatures as spots
from tessella.llm.shingles import Words

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def loop(text, chain=spots.CHAIN):
    """Signatures as tuples of words."""
    w = words(text)
    if not w:
        return {("bytes", text or "")}
    common = set(spots.ANCHORS.split())
    sparse = [int(h) % spots.SPARSE == 0 for h in Words([x.encode() for x in w]).hashes()]
    found = set()
    for i in range(-1, len(w)):
        if i >= 0 and w[i] not in common and not sparse[i]:
            continue
        after = [x for x in w[i + 1 :] if x not in common][:chain]
        if after or i < 0:
            found.add((w[i] if i >= 0 else None, *after))
    return found


def corpus():
    r = random.Random(12)
    plain = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "sü") for b in ("nor", "vel", "sta", "pim", "gat", "den")]
    some = [" ".join(r.choice(["the", "of", "und", *plain]) for _ in range(r.randint(1, 90))) for _ in range(50)]
    some += [some[3] + " end", some[3], some[3].upper(), some[4].replace("the", "THE,", 1)]
    return some + [None, "", "!!! ...", "the of and", "word", "漢字かな " * 30, "😀", "x" * 5000, " ".join(r.choices(plain, k=20_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "c", "c") for i, t in enumerate(corpus())] + [(None, "nobody's text of the day", "c", "c"), (9, "another of this id", "c", "c"), (9, "another of this id", "c", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, part string").repartition(5).cache()


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_each_row_against_the_loop(spark, docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = spots.compared_with_next(docs)
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        got = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    own = {r["doc_id"]: r for r in got}
    prints = {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)]
        if 9 in (key, following[0]):
            continue  # rows of one id follow each other by a hash
        r = own[key]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[1][:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(loop(text), loop(changed))) and r["near_next"] == pytest.approx(jaccard(loop(text), loop(following[1])))
        prints.setdefault(text, set()).add(r["fingerprint"])
        assert len(r["fingerprint"]) == 8 * len(loop(text)) and spots.written_out(spots.read_in(r["fingerprint"])) == r["fingerprint"]
    assert all(len(p) == 1 for p in prints.values())


def test_one_row_and_none(spark, docs):
    one = spots.compared_with_next(docs.where("doc_id = 15")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert spots.compared_with_next(docs.limit(0)).collect() == []


def test_near_pairs_equal_all_pairs(spark):
    r = random.Random(3)
    base = [[r.choice(["the", "of", f"w{r.randrange(400)}"]) for _ in range(r.randint(30, 300))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for k, b in enumerate(base):
        for edits in (1, 3, 9):
            some = list(b)
            for at in r.sample(range(len(b)), min(edits, len(b))):
                some[at] = f"new{k}"
            texts.append(" ".join(some))
    texts += [texts[0], texts[1], None, "", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for least in (0.5, 0.8):
        members, pairs = spots.near_pairs(docs, least)
        of = {m["doc_id"]: m["class"] for m in members.collect()}
        assert len(of) == len(texts) and of[0] == of[100] and of[102] == of[103]
        got = {tuple(sorted((p["a"], p["b"]))): p["likeness"] for p in pairs.collect()}
        sets = {of[i]: loop(t) for i, t in enumerate(texts)}
        names = sorted(sets)
        want = {(a, b): jaccard(sets[a], sets[b]) for i, a in enumerate(names) for b in names[i + 1 :] if jaccard(sets[a], sets[b]) >= least}
        assert got == pytest.approx(want) and want


def test_likeness_prunes_only_below_the_threshold():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 900, r.integers(1, 700)).astype(np.uint32)) for _ in range(2))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert spots.likeness(a, b) == pytest.approx(exact)
        for least in (0.2, exact, min(1.0, exact + 0.01)):
            found = spots.likeness(a, b, least)
            assert found == pytest.approx(exact) if exact >= least else found in (0.0, pytest.approx(exact))
    assert spots.likeness(a[:0], a[:0]) == 1.0 and spots.likeness(a, a[:0]) == 0.0
