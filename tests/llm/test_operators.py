"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from tessella.llm import group_join, line_dedup, mixture, mtree, multi_index, phrase_automata, piece_codec, tag_paths, token_store, toxicity
from tessella.llm.shingles import Words, grams, least_in_window

SCHEMA = "doc_id long, text string, source string, copies string, n_words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choices(vocabulary, k=60))
    rows = []
    for i in range(40):
        own = [" ".join(r.choices(vocabulary, k=r.randint(1, 12))) for _ in range(r.randint(1, 14))]
        if i % 4 == 0:
            own.insert(len(own) // 2, passage)
        rows.append((i, "\n".join(own), f"s{i % 3}"))
    rows += [(100 + k, rows[k][1], "s0") for k in range(5)]
    for k in range(6):  # near copies
        some = rows[10][1].split(" ")
        some[-1 - k] = "changed"
        rows.append((200 + k, " ".join(some), None))
    rows += [(300, None, "s1"), (301, "", "s2"), (302, " \n\t ", None), (None, "one two", "s1"), (303, "same " * 200, "s1"), (304, "a\nb\nc\na\nb\nc\nA b", "s1"), (7, rows[7][1], "s1"), (305, "Æther\x0bÉ x ▁ <s> 😀 " + "y" * 5000, "s2"), (306, " ".join(r.choices(vocabulary, k=9000)), "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in corpus()], SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_and_gram_hashes():
    texts = [b"a bb  ccc", b"", b" bb ccc\tA", b"x"]
    w = Words(texts, lower=True)
    assert w.counts.tolist() == [3, 0, 3, 1]
    h = w.hashes()
    assert h[1] == h[3] and h[2] == h[4] and h[0] == h[5] and len(set(h.tolist())) == 4
    g = grams(h, 2)
    assert g[1] == g[3] and len(g) == 6
    x = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    for width in range(1, 8):
        assert least_in_window(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(len(x) - width + 1)]


def test_pieces_are_the_librarys(docs, spark):
    import sentencepiece

    model = piece_codec.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], bytes(r["ids"]), r["decoded_text"]) for r in piece_codec.encoded(docs, model).collect())
    want = []
    for i, t, _ in corpus():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((-1 if i is None else i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert got == sorted(want)
    own = piece_codec.codec(model)
    for i, t, _ in corpus()[:10]:
        ids = [x for s in own.split(t) for x in own.segment_ids(s)]
        assert ids == library.encode(t) and own.decode(ids) == t
    assert piece_codec.encoded(empty(spark), model).count() == 0


def test_piece_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_codec.op1_pieces(spark, sf).collect())) == sorted(want)


def test_difference_from_the_library_is_an_error(monkeypatch):
    own = piece_codec.PieceCodec(piece_codec.default_model())
    monkeypatch.setattr(own, "merge", lambda segment: list(segment))
    with pytest.raises(ValueError, match="other ids"):
        own.encode_batch(["some words that merge"])
    words_ = token_store.WordCodec(token_store.default_tokenizer())
    words_.known[b"hello"] = b"\0\0"
    with pytest.raises(ValueError, match="other ids"):
        words_.encode_batch(["hello there"])


def brute_targets(sizes, weights, most):
    total, left = sum(sizes.values()), set(sizes)
    target = dict.fromkeys(sizes, 0.0)
    pool = total
    while left:
        share = pool / sum(weights[s] for s in left)
        over = [s for s in left if share * weights[s] > most * sizes[s]]
        if not over:
            for s in left:
                target[s] = share * weights[s]
            break
        for s in over:
            target[s] = float(most * sizes[s])
            pool -= target[s]
            left.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i:02}": r.choice([0, 1, 5, 100, 10_000, 300]) for i in range(11)}
    order = sorted(sizes)
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    got = {x["source"]: x["target"] for x in mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix(docs, spark):
    dealt = mixture.allocate(docs).collect()
    assert len(dealt) == len(corpus())
    assert sorted(r["size"] for r in dealt) == sorted(len(words(t)) for _, t, _ in corpus())
    for r in dealt:
        rate = min(3.0, r["target"] / r["source_size"]) if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(np.ceil(rate)) <= 3
    again = mixture.allocate(docs.repartition(7)).collect()
    assert sorted(map(str, dealt)) == sorted(map(str, again))
    assert mixture.mix(docs).count() == sum(r["copies"] for r in dealt) and mixture.mix(docs).columns == docs.columns
    assert mixture.allocate(empty(spark)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = mixture.op2_mix(spark, "/root/testdata/sf0.1").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    sizes, taken, target, spread = {}, {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
        rate = min(3.0, r["target"] / r["source_size"]) if r["source_size"] else 0.0
        spread[s] = spread.get(s, 0.0) + r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}, 3)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= 5 * spread[s] ** 0.5 + 1


def test_mix_draws_apart(spark):
    docs = spark.createDataFrame([(None, f"one two {i}", "a") for i in range(400)] + [(7, f"x y z {i}", "b") for i in range(400)], "doc_id long, text string, source string")
    copies = {}
    for r in mixture.allocate(docs).collect():
        copies.setdefault(r["source"], []).append(r["copies"])
    assert any(len(set(c)) > 1 for c in copies.values())


def test_mix_plan_is_native(docs):
    plan = mixture.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_lines(docs, spark):
    rows = [(i, t) for i, t, _ in corpus()]
    first = {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p : p + 3]), (i, t, p))
    want = []
    for i, t in rows:
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - 2):
            if first[tuple(lines[p : p + 3])] != (i, t, p):
                gone |= {p, p + 1, p + 2}
        want.append((str(i), len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    got = [(str(r["doc_id"]), r["n_lines"], r["n_removed"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_of_one_key(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nx"), (2, "p\nq\nr\ns"), (None, "a\nb\nc\ny"), (None, "u\nv\nw"), (3, None), (3, ""), (4, "\n\n\n\n"), (5, "l\n" * 3000)]
    docs = spark.createDataFrame([(*r, "n", "k") for r in rows], "doc_id long, text string, n_lines string, kept_text string")
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    want = [(1, 0, "a\nb\nc"), (2, 0, "p\nq\nr\ns"), (2, 3, "x"), (3, 0, ""), (3, 0, ""), (4, 4, ""), (5, 2999, "l\n"), (None, 0, "u\nv\nw"), (None, 3, "y")]
    # (4: its windows at 0, 1 and 2 are equal, so lines 1 to 4 go; 5: the window of the last lines has an empty one and is new)
    want[5], want[6] = (4, 4, ""), (5, 2999, next(x[2] for x in got if x[0] == 5))
    assert got == sorted(want, key=str)
    kept = {(r["doc_id"], r["text"], r["n_lines"]) for r in line_dedup.line_stage(spark, docs, "").collect()}
    assert (2, "p\nq\nr\ns", "n") in kept and (2, "x", "n") in kept and (3, None, "n") in kept


def test_passages(docs, spark):
    rows = [(i, words(t)) for i, t, _ in corpus()]
    seen = {}
    for _, w in rows:
        for p in range(len(w) - 34):
            key = tuple(w[p : p + 35])
            seen[key] = seen.get(key, 0) + 1
    want = []
    for i, w in rows:
        gone = {p + k for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for k in range(35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = phrase_automata.dedup_passages(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], bytes(r["kept_sha"]).hex()) for r in out) == sorted(want)
    assert sum(n for _, _, n, _ in want) > 1000
    assert all(hashlib.sha256(r["kept_text"].encode()).digest() == bytes(r["kept_sha"]) for r in out if r["kept_text"] is not None)
    assert phrase_automata.dedup_passages(empty(spark)).count() == 0


def test_automaton_decides(docs, spark, monkeypatch):
    """What the automaton doesn't have stays; a part of a passage is found, and no window reaches over the end of a text."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    one, two = (r.choices(vocabulary, k=80) for _ in range(2))
    texts = [" ".join(x).encode() for x in (r.choices(vocabulary, k=20) + one[10:60] + ["x"], two, one[:40], one[40:], ["a"] * 34)]
    both = phrase_automata.PhraseAutomaton([" ".join(x).encode() for x in (one, two)])
    assert [h.tolist() for h in both.hits(texts)] == [list(range(20, 36)), list(range(46)), list(range(6)), list(range(6)), []]
    less = phrase_automata.PhraseAutomaton([" ".join(two).encode()])
    assert [h.tolist() for h in less.hits(texts)] == [[], list(range(46)), [], [], []]
    whole = {(r["doc_id"], r["n_removed"]) for r in phrase_automata.dedup_passages(docs).collect()}
    cut = phrase_automata._passages
    monkeypatch.setattr(phrase_automata, "_passages", lambda regions: cut(regions).where("xxhash64(passage) % 2 = 0"))
    part = {(r["doc_id"], r["n_removed"]) for r in phrase_automata.dedup_passages(docs).collect()}
    assert sum(n for _, n in part) < sum(n for _, n in whole)


def test_passages_of_null_ids(spark):
    r = random.Random(9)
    passage = " ".join(f"p{r.randrange(90)}" for _ in range(40))
    rows = [(None, f"a{i} {passage} b{i}") for i in range(3000)] + [(None, passage)] * 50 + [(5, f"{passage} tail")]
    got = phrase_automata.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(40, 40, 50), (41, 40, 1), (42, 40, 3000)]


def test_token_store(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    library = Tokenizer.from_file(path)
    store = token_store.write_store(docs, f"file://{tmp_path}/store", path)
    got = list((r["key"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_store.read_store(spark, store).collect())
    want, at = [], 0
    for i, t in sorted(((i, t or "") for i, t, _ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert got == want
    for i, t, _ in corpus()[::7]:
        for ids in token_store.read_document(spark, store, i):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids + [1]
    assert len(token_store.read_document(spark, store, 7)) == 2 and len(token_store.read_document(spark, store, None)) == 1 and token_store.read_document(spark, store, -5) == []
    assert sorted(r["ids_crc32"] for r in token_store.read_digests(spark, store).collect()) == sorted(w[3] for w in want)
    none = token_store.write_store(empty(spark), f"file://{tmp_path}/none", path)
    assert token_store.read_store(spark, none).count() == 0


def test_token_store_of_one_key(spark, tmp_path):
    """Rows that repeat a key with other texts, and rows without one, all stay; a hot key isn't one range."""
    rows = [(7, f"text number {i}") for i in range(300)] + [(None, f"none {i}") for i in range(40)] + [(7, None), (9, "x" * 300_000)]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/hot", token_store.default_tokenizer())
    got = token_store.read_store(spark, store).orderBy("start").collect()
    assert len(got) == len(rows) and [r["key"] for r in got] == [None] * 40 + [7] * 301 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0
    assert len(token_store.read_document(spark, store, 7)) == 301 and len(token_store.read_document(spark, store, None)) == 40
    assert spark.read.parquet(f"{store}/blocks").where("exists(keys, k -> k = 7)").select("part").distinct().count() > 1


def test_word_ids_are_the_librarys():
    path = token_store.default_tokenizer()
    own = token_store.WordCodec(path)
    r = random.Random(4)
    odd = [chr(c) for c in (*range(0x21, 0x500), *range(0x900, 0xE00), *range(0x1E00, 0x2100), *range(0xFB00, 0xFB50), 0x1F600, 0xAC00, 0x1100, 0x1161, 0x3042, 0x4E2D, 0x300, 0x345) if chr(c).isprintable()]
    texts = ["EVİ, ETKİSİ. İ. İ, \u0958, \ufb1d. h\u0331, H\u0331, A\u030a. don't, DON'T. <|endoftext|>, <|endoftext|, x\u2029y"]
    texts += [" ".join(f"{a}{c}{m}" for m in (",", ".", "!?", "'s,", "-")) for a in ("", "e", "É") for c in odd]
    texts += [" ".join("".join(r.choices(odd, k=r.randint(1, 9))) + r.choice(["", ",", "...", "'", "\u0301,"]) for _ in range(12)) for _ in range(500)]
    got = own.encode_batch(texts)
    want = [np.array(e.ids + [1], f"<u{own.width}").tobytes() for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_token_store_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.default_tokenizer())
    sf = "/root/testdata/sf0.001"
    want, at = [], 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.op5_token_store(spark, sf).collect()) == want


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_links(docs, spark, k, percent):
    sets = []
    for i, t, _ in corpus():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    want = [(str(i), len(s), str(least.get(root(a), i))) for a, (i, s) in enumerate(sets)]
    got = [(str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in group_join.linked(docs, k=k, percent=percent).collect()]
    assert sorted(got) == sorted(want)


def test_all_links(docs, spark):
    """Every link between rows, by classes and pairs of them, and the number of links of a row."""
    k, percent = 3, 60
    sets = []
    for t in [t for _, t, _ in corpus()]:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    want = [sum(1 for b, y in enumerate(sets) if b != a and x & y and 100 * len(x & y) >= percent * len(x | y)) for a, x in enumerate(sets)]
    got = group_join.link_counts(docs, k=k, percent=percent).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted((str(i), n) for (i, _, _), n in zip(corpus(), want, strict=True)) and sum(want) > 40


def test_links_of_null_ids(spark):
    """Ten thousand rows without an id: each text is fetched by its digest, not by the id."""
    rows = [(None, f"q{i} r{i} s{i % 50} t{i} u{i} v{i} w{i}") for i in range(10_000)] + [(None, "one two three four five six")] * 500 + [(3, "one two three four five six")]
    got = group_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got), key=str) == [(3, 501), (None, 10_000)]
    odd = [(None, "", 0), (None, None, 0), (None, "a b c d e f", 1), (None, "a b c d e f", 2), (5, "a b c d e f", 3), (6, "x y", 4), (6, "x y", 4), (6, "p q r", 5), (None, "l m n o p", 6), (None, "l m n o p", 6)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, n_shingles long")
    kept = sorted(((r["doc_id"], r["text"], r["n_shingles"]) for r in group_join.near_stage(spark, docs, "").collect()), key=str)
    assert kept == sorted([(None, "", 0), (None, None, 0), (5, "a b c d e f", 3), (6, "x y", 4), (6, "p q r", 5), (None, "l m n o p", 6)], key=str)


def test_links_of_nothing(spark):
    assert group_join.linked(empty(spark)).count() == 0


def vectors(n=900, dim=8, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32) / 2
    x[50:300] = x[50]  # copies
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [None] * dim), (n + 4, []), (None, x[0].tolist()), (5, x[5].tolist()), (n + 20, [1.0])]


def brute_nearest(rows, fine, measure):
    """For each row with an id divisible by 20 the (score, id) of all other rows of its length, best first."""
    good = [(i, measure(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and fine(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q is not None and q % 20 == 0:
            same = [(i, y) for b, (i, y) in enumerate(good) if b != a and len(y) == len(x)]
            scores = np.array([y for _, y in same]) @ x if same else []
            out.append((q, sorted(zip((-s for s in scores), ((i is None, i) for i, _ in same), strict=True), key=lambda z: (z[0], z[1][0], z[1][1] or 0))))
    return out


def test_mtree_is_exact(spark):
    rows = vectors() + [(40, vectors()[3][1]), (41, vectors()[40][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    want = []
    for q, found in brute_nearest(rows, lambda v: True, lambda v: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)):
        want += [(q, k + 1, i, -int(s)) for k, (s, (_, i)) in enumerate(found[:20])]
    assert sorted(map(tuple, mtree.search(df).collect()), key=str) == sorted(want, key=str)
    assert mtree.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mtree_in_blocks(spark, monkeypatch):
    from tessella.llm import vectors as shared

    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    whole, near = (sorted(map(str, f(df).collect())) for f in (mtree.search, multi_index.search))
    monkeypatch.setattr(shared, "BLOCK_BYTES", 1000)
    assert sorted(map(str, mtree.search(df).collect())) == whole
    assert sorted(map(str, multi_index.search(df).collect())) == near


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_mtree_prunes(scale):
    r = np.random.default_rng(1)
    heads = r.normal(size=(40, 6)) * 300
    x = np.floor(heads[r.integers(0, 40, 12_000)] + r.normal(size=(12_000, 6))).astype(np.int64) * scale
    tree = mtree.MTree(np.arange(12_000), np.arange(12_000), np.zeros(12_000, bool), x)
    asked = np.array([3, 77, 4_000])
    who, entry, score = tree.search(asked, x[asked], 20)
    for k, q in enumerate(asked.tolist()):
        want = sorted((-int(s), i) for i, s in enumerate(x.astype(object) @ x[q].astype(object)) if i != q)[:20]
        assert sorted((-int(s), int(tree.ids[e])) for w, e, s in zip(who, entry, score, strict=True) if w == k) == want


def recall(found, rows):
    """Share of the 20 nearest that were found, ties in score counting alike; also checks ranks, order and exact scores."""
    hit = total = 0
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r)
    for q, best in brute_nearest(rows, any, lambda v: np.array(v, float)):
        got, scores = out.get(q, []), {i: -s for s, (_, i) in best}
        best = [-s for s, _ in best[:20]]
        assert len(got) == len(best) and [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert all(abs(r["score"] - scores[r["vec_id"]]) < 1e-9 for r in got)
        placed = lambda r: (-r["score"], r["vec_id"] is None, r["vec_id"] or 0)
        assert all(placed(a) <= placed(b) for a, b in zip(got, got[1:], strict=False))
        hit += sum(r["score"] >= best[-1] - 1e-9 for r in got)
        total += len(best)
    return hit / max(1, total)


def test_multi_index(spark):
    rows = vectors(3000)
    assert recall(multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), rows) >= 0.9
    few = [(20 * i, [float(i + 1), 1.0]) for i in range(3)] + [(None, [1.0, 1.0])] * 2
    got = multi_index.search(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 12 and sum(r["vec_id"] is None for r in got) == 6
    assert multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1", "check_l"])
def test_multi_index_recall_on_the_tables(spark, table):
    """check_l has 51,282 vectors, three times a shard."""
    where = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(where):
        pytest.skip("no such table here")
    df = spark.read.parquet(where).where("embedding IS NOT NULL")
    rows = df.toPandas().sort_values("vec_id")
    ids, m = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list()).astype(float)
    found = multi_index.search(df).toPandas()
    queries = np.flatnonzero(ids % 20 == 0)
    assert len(found) == 20 * len(queries)
    scores = m[queries] @ m.T
    scores[np.arange(len(queries)), queries] = -np.inf
    least = dict(zip(ids[queries].tolist(), np.partition(scores, -20, axis=1)[:, -20].tolist(), strict=True))
    hits = sum(s >= least[q] - 1e-9 for q, s in zip(found["query_id"].tolist(), found["score"].tolist(), strict=True))
    print(table, "recall", hits / len(found))
    assert hits / len(found) >= 0.9


def test_kernel():
    """Against the sum over all shared three-symbol subsequences, counted out; what is neither letter nor digit only widens a span."""

    codes = toxicity._codes()

    def brute(w):
        symbols, out = [1, *(codes[ord(c)] for c in w), 2], {}
        for i in range(len(symbols)):
            for j in range(i + 1, len(symbols)):
                for k in range(j + 1, min(len(symbols), i + toxicity.REACH + 1)):
                    if symbols[i] and symbols[j] and symbols[k]:
                        key = (symbols[i], symbols[j], symbols[k])
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {f: v / norm for f, v in out.items()}

    some = ["idiot", "i.d.i.o.t", "idxiot", "i d i o t", "aaa", "a", "ß9é", "moron"]
    got = toxicity.kernel(some, some)
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            x, y = brute(a), brute(b)
            assert abs(got[i, j] - sum(v * y.get(f, 0) for f, v in x.items())) < 1e-5
    assert got[0, 1] > 0.4 < got[0, 2] and got[0, 7] < 0.2
    assert toxicity.windows("He's an i d i o t, (really)! " + "z" * 100) >= {"he's", "really", "z" * 40} and "an i d i o t," in toxicity.windows("he's an i d i o t, really")


def test_toxicity(spark):
    r = random.Random(2)
    plain = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("nor", "vel", "sta", "pim") for c in ("en", "is", "o", "ar")]
    insults = ["dumbnut", "scoundrel", "grimpus"]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(plain, k=30)
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(insults) + r.choice(["", "s", "."])
        rows.append((i, " ".join(w), "s", 0.5))
        labels.append((i, int(toxic)))
    clean = " ".join(plain[:20])
    # gapped, spelled apart, with inserted letters: none of them in training
    odd = {950 + k: f"{clean} {x} {clean}" for k, x in enumerate(["d.u.m.b.n.u.t", "scou-ndr-el", "scoundxrel", "grizmpus", "dumbb.nut", "GRIMPUSSES", "s.c.o.u.n.d.r.e.l!"])}
    rows += [(900, None, None, None), (901, "", "s", 0.5), (902, " ".join(plain), "s", 0.5), (None, "grimpuss", "s", 0.5), (903, clean * 4000, "s", 0.5), (904, clean * 4000 + " dumbnut", "s", 0.5), (905, "q" * 50_000, "s", 0.5), (906, rows[0][1], "s", 0.5)]
    rows += [(i, t, "s", 0.5) for i, t in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    told = spark.createDataFrame(labels + [(None, 1), (3, None), (906, 0), (902, 0)], "doc_id long, toxic int").where("doc_id % 3 <> 0 or doc_id = 906")
    model = toxicity.train(docs, told)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["predicted"] == t for i, t in labels)
    assert [got[i]["predicted"] for i in (900, 901, 902, None, 903, 904, 905)] == [0, 0, 0, 1, 0, 1, 0]
    assert [t for i, t in odd.items() if not got[i]["predicted"]] == []
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    again = toxicity.train(docs.repartition(5), told.repartition(3))
    assert again.landmarks == model.landmarks and abs(again.shift - model.shift) < 1e-3
    none = toxicity.scored(docs.limit(0), model)
    assert none.count() == 0 and toxicity.without_toxic(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.scored(docs, model).collect()] == [0, 0]


def test_toxicity_held_out(spark):
    """Recall and precision on the held-out labels; a part of the toxic ones has nothing that clean texts lack."""
    out = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in rows)
    assert caught >= 0.88 * sum(r["toxic"] for r in rows) and caught >= 0.85 * sum(r["predicted"] for r in rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><div id="cookie-notice"><p>We use cookies, please accept them all.</p></div>
<div class="content"><h1>A &amp; title</h1><p>First   paragraph, with <b>bold<br>text, and more of it.</p><p>Second one&nbsp;here; it has words.<ul><li>item one, which is long enough<li>item two, which is long too</ul>
<div class="ad">Buy now, cheap, today!</div><script>var x = "</p><p>no</p>";</script><p>Third &#8212; paragraph, also with words.</p></div>
<aside><p>Related things, many of them, to read.</p></aside><div class="comments"><p>Reader says, this is a comment, and long.</p></div><form><p>Sign up, please.</p></form><footer><p>Copyright, all of it.</p></footer></body></html>"""


def test_main_text():
    got = tag_paths.main_text(PAGE).split("\n\n")
    assert got == ["A & title", "First paragraph, with bold text, and more of it.", "Second one here; it has words.", "item one, which is long enough", "item two, which is long too", "Third — paragraph, also with words."]
    assert tag_paths.main_text("") == "" and tag_paths.main_text("<nav>a</nav>") == ""
    assert tag_paths.main_text("<p>just <!-- no --> text</p>") == "just text"
    for broken in ("<", "<p", "<p class='x", "</", "<!--", "<script>", "a<b>c", "<div>" * 500 + "deep" + "</div>" * 500, "&#xD800;&bogus;&#99999999;"):
        tag_paths.main_text(broken)


def test_undeclared_article_is_whole():
    three, seven = "Some words, in a row. " * 14, "Other words, in a row. " * 30
    for page in (
        f"<div class=content><h1>Title</h1><section><p>{three}</p></section><section><p>{seven}</p></section></div>",
        f"<div><h1>Title</h1><p>{three}</p><ul><li>{seven}</ul></div>",
        f"<nav>Menu</nav><h1>Title</h1><div><section><p>{seven}</p></section></div><table><tr><td>{three}</table><footer>End, of it.</footer>",
    ):
        got = tag_paths.main_text(page)
        assert "Title" in got and three.strip() in got and seven.strip() in got
        assert "Menu" not in got and "End" not in got
    assert tag_paths.main_text(f"<div><p>{three}</p><p>{seven}</p><ul><li>one<li>two</ul></div>").endswith("one\n\ntwo")


def test_scores_that_leave_64_bits_are_an_error(spark):
    big = [(0, [1.0e6, 2.0]), (1, [3.0e7, 0.0]), (2, [-3.0e7, 1.0])]
    got = mtree.search(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 64**2 * 30_000_000_000_000), (2, 64**2 * (-30_000_000_000_000 + 2))]
    for value in (1.9e11, 1e300, -1e300):
        with pytest.raises(ValueError, match="64 bits"):
            mtree.search(spark.createDataFrame([(0, [value, value]), (1, [value, 1.0])], "vec_id long, embedding array<double>"))


def test_dropped_spares_tables_that_are_not_ours(spark, tmp_path):
    from tessella.llm.common import dropped, table, written

    folder = tmp_path / "tessella-corpus" / "sf"
    spark.range(4).write.parquet(f"{folder}/documents.parquet")
    own = written(spark.range(3).toDF("x"), "some")
    dropped(table(spark, str(folder), "documents"), own)
    assert table(spark, str(folder), "documents").count() == 4
    assert not os.path.exists(own.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("percent", [50, 85])
def test_links_of_sets_of_many_sizes(spark, percent):
    r = random.Random(percent)
    rows = []
    for i in range(60):
        base = [f"w{r.randrange(40)}" for _ in range(r.randint(3, 60))]
        rows.append(base)
        for _ in range(3):
            some = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(some) + 1)
                some[at : at + r.randint(0, 2)] = [f"n{r.randrange(9)}"] * r.randint(0, 2)
            rows.append(some)
    texts = [" ".join(x) for x in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = {i: ({tuple(w[p : p + 2]) for p in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set()) for i, w in ((i, t.split()) for i, t in enumerate(texts))}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    pairs, members = group_join.links(docs, k=2, percent=percent)
    of = {m["doc_id"]: m["class"] for m in members.collect()}
    got = {(p["a"], p["b"]) for p in pairs.collect()}
    want = {(max(of[a], of[b]), min(of[a], of[b])) for a in sets for b in sets if a < b and of[a] is not None and of[b] is not None and of[a] != of[b] and linked(a, b)}
    assert got == want and want
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and linked(a, b):
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a in sets for b in sets if a < b and linked(a, b)):
            break
    found = {x["doc_id"]: x["component_id"] for x in group_join.linked(docs, k=2, percent=percent).collect()}
    assert found == least


def test_articles_that_are_adverts_or_comments():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    want = "\n\n".join(x.strip() for x in STORY)
    promo = "<article class='promo'><p>Buy our things, they are cheap and good, and there are many of them left.</p></article>"
    assert tag_paths.main_text(promo + f"<article>{story}</article>") == want
    assert tag_paths.main_text(f"<main>{story}<article class='comment'><p>I don't believe a word of this, and neither should you, my friends.</p></article></main>") == want
    assert tag_paths.main_text(f"<main><article class='post has-sidebar'>{story}</article><section id=comments><article><p>First of all, no. Second, no.</p></article></section></main>") == want
    assert tag_paths.main_text(f"<div>Menu</div><article class='sponsored'>{story}</article>") == want  # there is no other text


def test_bars_of_links_and_leads():
    a, b = STORY[0].strip(), STORY[1].strip()
    links = "<a href=/>Home</a> <a href=/a>About us</a>"
    assert tag_paths.main_text(f"<article><p>{a}</p><div>{links}</div><p>{b}</p></article>") == f"{a}\n\n{b}"
    assert tag_paths.main_text(f"<article><p>{a}</p><div class=related><h3>Related</h3><ul><li><a href=/x>One more</a></ul></div><p>{b}</p></article>") == f"{a}\n\n{b}"
    assert tag_paths.main_text(f"<article><p>{a}</p><div><h3>More</h3><ul><li><a href=/x>One more</a><li><a href=/y>Another</a></ul></div><h2>Part two</h2><p>{b}</p></article>") == f"{a}\n\nPart two\n\n{b}"
    assert tag_paths.main_text(f"<article><header><h1>Title</h1><p class=lead>What this is all about, in one sentence.</p><span>By A. Writer</span></header><p>{a}</p><p>{b}</p></article>") == f"Title\n\nWhat this is all about, in one sentence.\n\n{a}\n\n{b}"
    assert tag_paths.main_text(f"<header><p>A slogan, not the article.</p></header><article><p>{a}</p><p><a href=/all>{b}</a></p></article>") == f"{a}\n\n{b}"


def test_paths_choose_beside_a_declared_article():
    story, teaser = ["Some words of it, in a row. " * n for n in (9, 14, 11)], "A teaser card, with few words, of another story."
    paragraphs = "".join(f"<p>{x}</p>" for x in story)
    got = tag_paths.main_text(f"<nav>Menu</nav><article><p>{teaser}</p></article><div class=text><h1>Title</h1>{paragraphs}</div>")
    assert all(x.strip() in got for x in ("Title", *story)) and "Menu" not in got
    got = tag_paths.main_text("".join(f"<article><h2>Part</h2><p>{x}</p></article>" for x in story))
    assert got == "\n\n".join(f"Part\n\n{x.strip()}" for x in story)
    got = tag_paths.main_text(f"<div class=xyz>12 views</div><article><h1>Title</h1>{paragraphs}<p>End.</p></article><div class=xyz><span>Print</span></div>")
    assert got.startswith("Title") and got.endswith("End.")


STORY = ["Some words of it, in a row. " * n for n in (9, 14, 11)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in STORY)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>Menu, of it.</nav><article><h1>Title</h1>{PARAGRAPHS}<ul><li><a href=a>one</a><li><a href=b>two</a></ul></article></body>",
        f"<body><article><h1>Title</h1><p>{STORY[0]}</p></article><article><p>{STORY[1]}</p><p>{STORY[2]}</p><ul><li>one<li>two</ul></article><footer>Menu</footer>",
        f"<div class='content has-header'><h1>Title</h1>{PARAGRAPHS}<ol><li>one<li>two</ol></div><div class=site-header>Menu</div>",
        f"<div class='post no-comments'><h1>Title</h1>{PARAGRAPHS}<div class=share-price>one</div><fieldset>two</fieldset></div><div id=comment_list><p>Menu, {STORY[0]}</p></div>",
        f"<div id=wrap><div class=xyz>Menu</div><div><h1>Title</h1>{PARAGRAPHS}<div><span>one</span></div><div>two</div></div></div>",
        f"<main><section><h1>Title</h1>{PARAGRAPHS}</section><section><h2>one</h2><p>two, the end.</p></section></main><div class=ad-slot><p>Menu, {STORY[0]}</p></div>",
    ],
)
def test_pages_are_whole(page):
    got = tag_paths.main_text(page)
    assert got.startswith("Title\n\n") and all(x.strip() in got for x in STORY) and "one" in got and "two" in got and "Menu" not in got


def test_ratios_decide():
    page = f"<div class=xyz><span>Seen 12 times</span></div><div class=story>{PARAGRAPHS}</div><section class=abc><div>Print it</div></section>"
    assert tag_paths.main_text(page) == "\n\n".join(x.strip() for x in STORY)
    assert "Print it" in tag_paths.main_text(page, share=0.0)
    linked = "".join(f"<li><a href=x>{x}</a>" for x in STORY)
    page = f"<div class=links><ul>{linked}</ul></div><div class=story><p>{STORY[0]}</p></div>"
    assert tag_paths.main_text(page) == STORY[0].strip()
    fused = tag_paths.ratios(tag_paths.blocks(page))
    assert fused[("div", "ul", "li")] < fused[("div", "p")]


def test_empty_and_very_long_pages(spark):
    assert tag_paths.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = "<body><div>" + PARAGRAPHS * 4000 + "</div>" + "<b>" * 20_000 + "<div class='" + "a " * 100_000 + "'>" + "<p>" * 50_000
    assert len(tag_paths.main_text(long)) == 4000 * sum(len(x.strip()) + 2 for x in STORY) - 2


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x")]
    got = tag_paths.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and sorted(r["n_chars"] > 0 for r in got) == [False, False, True, True]


class Outside(HTMLParser):
    """The text blocks of a page that stand in no element which is boilerplate by its name or class; nothing else is known of the page."""

    def __init__(self):
        super().__init__()
        self.skip, self.blocks, self.own = [], [], []

    def flush(self):
        if text := " ".join("".join(self.own).split()):
            self.blocks.append(text)
        self.own = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "ul", "li", "article", "nav", "footer", "body"):
            self.flush()
        if tag in ("nav", "footer", "script", "style", "title", "div"):
            self.skip.append(tag)
        if tag == "br":
            self.own.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "ul", "li", "article", "nav", "footer", "body"):
            self.flush()
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.own.append(data)


def test_page_query(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Outside()
        parser.feed(r["html"])
        text = "\n\n".join(parser.blocks)
        want.append((r["page_id"], r["url"], text, len(text)))
    assert sorted(map(tuple, tag_paths.op9_tag_paths(spark, sf).collect())) == sorted(want)


def test_articles_of_the_tables(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert tag_paths.main_text(r["html"]) == "\n\n".join(b for b in blocks if b)
