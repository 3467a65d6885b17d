"""Alignment of two tokenizers against the libraries and a loop over tokens."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import token_alignment

ODD = [None, "", " ", "  lead", "tail  ", "a  b\n\nc <s> </s> <|endoftext|> q", "▁x y▁ ▁", "é́ ﬁ ½ \x00 \x1f \x85 z", "😀😀 漢字漢字\t\tx", "x" * 4000, "a b c d", "it's we'll 12 345", "\n", "a \nb", "the the the the", "the the the the"]


def texts():
    r = random.Random(13)
    words = ["the", "of", "aligning", "tokens", "Überprüfung", "naïve", "x1", "don't", "(a)", "3.14", "foo.\nBar", "qwrtzp"]
    return [" ".join(r.choices(words, k=r.randint(1, 80))) for _ in range(60)] + ODD + [" ".join(r.choices(words, k=30_000))]


def brute(rows):
    a_path, b_path = token_alignment.default_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = token_alignment.Aligner._byte_letters()
    names = {i: p for p, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in rows:
        raw = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        left, right = [bytes(letters[c] for c in names[i]) for i in x], [piece(i) for i in y]
        if not text or b"".join(left) != raw or b"".join(right) != raw:
            found.append((0, 0, 0, Counter(), ""))
            continue
        ends = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
        groups, links = [], Counter()
        i = j = 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.update((s, t) for s in x[i:p] for t in y[j:q])
            i, j = p, q
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for f in found for p in f[3])
    most = defaultdict(int)
    for (s, _), n in count.items():
        most[s] = max(most[s], n)
    return [(n_a, n_b, g, sum(links.values()), sum(k for p, k in links.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in links.items()), digest) for n_a, n_b, g, links, digest in found]


@pytest.mark.parametrize("heavy", [token_alignment.HEAVY, 40])
def test_alignment_equals_a_loop(spark, monkeypatch, heavy):
    monkeypatch.setattr(token_alignment, "HEAVY", heavy)
    rows = texts()
    keys = [None if i == 3 else 5 if i in (8, 9) else i for i in range(len(rows))]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in zip(keys, rows, strict=True)], "doc_id long, text string, pair string, n string").repartition(3)
    got = token_alignment.scored(docs, *token_alignment.default_paths())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, *w)) for k, w in zip(keys, brute(rows), strict=True))
    assert token_alignment.scored(docs.limit(0), *token_alignment.default_paths()).collect() == []


def test_worker_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(token_alignment, "KNOWN", 10)
    own = token_alignment.Aligner(*token_alignment.default_paths())
    some = [t or "" for t in texts()[:20]]
    first, again = own.align(some), own.align(some)
    assert [x[:5] for x in first if x] == [x[:5] for x in again if x]
