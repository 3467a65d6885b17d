"""Each stage of the pipeline on what the stage before it kept, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import sentencepiece
from test_operators import words

import corpus_pipeline
from tessella.llm import mixture, piece_codec, toxicity
from tessella.llm.common import written


def tables(spark, folder):
    r = random.Random(8)
    plain = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("nor", "vel", "sta", "pim", "gat", "den")]
    rows, labels = [], []
    for i in range(160):
        lines = [" ".join(r.choices(plain, k=r.randint(4, 14))) for _ in range(r.randint(1, 9))]
        if i % 8 == 0:
            lines[0] += " grimpus"
        if i % 10 == 3:
            lines[1:1] = ["shared line one", "shared line two", "shared line three", "shared line four"]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    for k in (5, 6, 7, 9):
        rows.append((400 + k, rows[k][1] + " tail", "en", "s1", 0))
        rows.append((500 + k, rows[k][1], "en", None, 0))
    rows += [(600, None, None, "s1", 0), (601, "", "en", "s2", 0), (602, "few words", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_lines(texts):
    first, out = {}, {}
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p : p + 3]), (i, p))
    for i in texts:
        lines, gone = (texts[i] or "").split("\n"), set()
        for p in range(len(lines) - 2):
            if first[tuple(lines[p : p + 3])] != (i, p):
                gone |= {p, p + 1, p + 2}
        out[i] = texts[i] if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if gone and not words(out[i]):
            del out[i]
    return out


def brute_near(texts, k=5, percent=80):
    sets = {i: (lambda w: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())(words((t or "").lower())) for i, t in texts.items()}
    least = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a != b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return {i for i in texts if least[i] == i}


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "mixture", "pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = rows_of(docs), docs.columns
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        frames.append(docs)
        assert name == "pieces" or docs.columns == columns
    after = rows_of(frames[0])
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out()))
    flags = {r["doc_id"]: r["predicted"] for r in toxicity.scored(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()}
    assert after == {i: r for i, r in before.items() if not flags[i]} and all(flags[i] == (i % 8 == 0) for i in range(160))
    lines = rows_of(frames[1])
    want = brute_lines({i: r["text"] for i, r in after.items()})
    assert {i: r["text"] for i, r in lines.items()} == want and len(want) < len(after)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] != after[i]["text"] else 0) for i, r in lines.items())
    near = rows_of(frames[2])
    assert near.keys() == brute_near(want) and len(near) < len(want)
    assert all(near[i] == lines[i] for i in near)
    mixed = Counter(r["doc_id"] for r in frames[3].collect())
    dealt = {r["doc_id"]: r["copies"] for r in mixture.allocate(frames[2]).collect()}
    assert mixed == Counter({i: c for i, c in dealt.items() if c})
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in frames[4].collect())
    for (i, n, ids_sha, text_sha), copies in got.items():
        ids = library.encode(near[i]["text"] or "", add_bos=True, add_eos=True)
        assert copies == mixed[i] and n == len(ids) and ids_sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and text_sha == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert set(mixed) == {k[0] for k in got} and re.search("Scan", frames[4]._jdf.queryExecution().toString())


def test_run_on_the_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    """Columns named as the operators' own, null and repeated ids, null and empty texts, equal rows."""
    folder = str(tmp_path)
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{text} {i} other {i * 7}", "en", "s", 0) for i in range(6)] + [(None, None, None, None, 0), (None, "", "en", "s", 0), (3, "a b c\nd e f\ng h i\nj", "en", "s", 0), (3, "a b c\nd e f\ng h i\nk", "en", "t", 0), (3, "a b c\nd e f\ng h i\nk", "en", "t", 0)]
    names = ("margin", "kept_text", "n_removed", "copies", "target", "size", "component_id", "__one", "starts", "rep", "predicted")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(*r, *names) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        assert all(r[n] == n for r in docs.collect() for n in names)
