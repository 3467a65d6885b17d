"""Source divergence audit: a merged count-min sketch of document frequencies discards impossible terms, the rest is counted exactly.

The sketch never underestimates, so a term that it puts below the least document frequency is below it. What survives is counted
by Spark; sources that share a term meet in a sparse join, all other terms of a pair follow from how often each count occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, table, written
from .shingles import U, Words, _mix, groups

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCS = 3
#: Ranks of the part ``term``.
TERM_RANKS = 200
#: Rows and columns of the sketch; a cell has two bits, so it is DEPTH * WIDTH / 4 bytes at every size of input (4 MB).
DEPTH, WIDTH = 4, 1 << 22
SLICE = 1 << 18
SCALE = 1_000_000_000

#: Bytes between terms: ASCII other than letters. Those from 0x80 on belong to terms.
_outside = np.zeros(256, bool)
_outside[:128] = True
_outside[65:91] = _outside[97:123] = False


def _text_groups(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes], int]]:
    """(batch, some of its texts, the row of the first), of a few MB together; a longer text is taken alone, whole."""
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        for a, b in groups(texts, 1 << 23):
            yield batch, texts[a:b], a


class _Terms:
    """The terms of some texts: their words, a hash of each that goes with its text's language, and the text of each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.words = Words(texts, lower=True, outside=_outside)
        self.owner = np.repeat(np.arange(len(texts)), self.words.counts)
        seeds = {n: int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in set(langs)}
        self.keys = _mix(self.words.hashes() + np.array([seeds[n] for n in langs], U)[self.owner]) if len(self.owner) else np.zeros(0, U)


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (_mix(keys + U((row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & U(width - 1)).astype(np.int64)


def _packed(cells: np.ndarray) -> bytes:
    four = cells.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, np.uint8)
    return np.stack([held >> s & 3 for s in (0, 2, 4, 6)], 1).reshape(-1)


def sketched(texts: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(slice, cells): the merged sketch of how many documents of ``texts`` (lang, text) have each term of each language.

    Cells stop at ``least``, at most 3, since no more is asked of them. Each task sends its sketch, merged over all of its
    documents, by slices of SLICE cells; a slice is merged as a stream, so a task holds no more than the sketch.
    """
    if not 1 <= least <= 3:
        raise ValueError("cells of two bits count up to 3 documents")
    size = min(SLICE, width)

    def count(batches):
        cells = np.zeros((depth, width), np.uint8)
        for batch, some, at in _text_groups(batches):
            terms = _Terms(some, batch.column("lang").slice(at, len(some)).to_pylist())
            # a document counts once a term
            order = np.lexsort((terms.owner, terms.keys))
            key, doc = terms.keys[order], terms.owner[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            own, n = np.unique(key[first], return_counts=True)
            for row in range(depth):
                where, back = np.unique(_cells(own, row, width), return_inverse=True)
                more = np.bincount(back, np.minimum(n, least), len(where))
                cells[row, where] = np.minimum(cells[row, where] + more, least).astype(np.uint8)
        for row in range(depth):
            for at in range(0, width, size):
                part = cells[row, at : at + size]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row * (width // size) + at // size], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["slice", "cells"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = _unpacked(data.as_buffer())
                held[k] = np.minimum(held[k] + more, least) if k in held else more
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["slice", "cells"])

    parts = texts.select("lang", "text").mapInArrow(count, "slice int, cells binary")
    return parts.repartition(min(partitions(texts.sparkSession), depth * width // size), "slice").mapInArrow(merge, "slice int, cells binary")


def survivors(texts: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of the terms that the sketch of ``texts`` (lang, source, text) doesn't rule out,
    summed over some texts; to be summed further. The sketch, of the fixed size DEPTH * WIDTH / 4 bytes, goes through the driver."""
    size = min(SLICE, width)
    cells = np.zeros((depth * width // size, size), np.uint8)
    for row in sketched(texts, least, depth, width).collect():  # the slices of one sketch
        cells[row["slice"]] = _unpacked(bytes(row["cells"]))
    shared = texts.sparkSession.sparkContext.broadcast(_packed(cells.reshape(-1)))

    def count(batches):
        sketch = _unpacked(shared.value).reshape(depth, width)
        for batch, some, at in _text_groups(batches):
            langs = batch.column("lang").slice(at, len(some)).to_pylist()
            sources = batch.column("source").slice(at, len(some)).to_pylist()
            terms = _Terms(some, langs)
            if not len(terms.keys):
                continue
            own, back = np.unique(terms.keys, return_inverse=True)
            possible = np.ones(len(own), bool)
            for row in range(depth):
                possible &= sketch[row, _cells(own, row, width)] >= least
            pairs = {}
            of_text = np.array([pairs.setdefault(p, len(pairs)) for p in zip(langs, sources, strict=True)])
            take = np.flatnonzero(possible[back])
            term, doc = back[take], terms.owner[take]
            order = np.lexsort((doc, of_text[doc], term))
            term, doc, place = term[order], doc[order], take[order]
            pair = of_text[doc]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (pair[1:] != pair[:-1])
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            begins = np.flatnonzero(new)
            if not len(begins):
                continue
            data, starts, ends = terms.words.data.tobytes(), terms.words.starts, terms.words.ends
            names = [data[starts[i] : ends[i]] for i in place[begins]]
            of_pair = list(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([of_pair[i][0] for i in pair[begins]], pa.string()), pa.array([of_pair[i][1] for i in pair[begins]], pa.string()),
                    pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.diff(np.append(begins, len(term))), pa.int64()), pa.array(np.add.reduceat(fresh.astype(np.int64), begins), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    return texts.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, by whole numbers throughout."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)"))).cast("long")


def _off(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, ranks: int = TERM_RANKS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) of ``docs``.

    Part ``pair`` ranks the other sources of the language by how far their term shares are off, summed over all terms that at least
    ``least`` documents of the language have, absent ones too; part ``term`` the source's own terms that it has more often than its language, up to rank
    ``ranks``. Null lang, source and text are ''. Groups without terms take part, a language without kept terms gives values of 0, repeated rows
    count as often as they occur, an empty table gives no rows. A very long text is looked at alone, whole. Other columns are left behind, so their
    names can't clash.

    A hot source's documents are counted where they lie and meet others as one row a term. Terms shared by sources are joined by
    (lang, term); for the rest of a pair, of which one source has no occurrence, the terms of a source are summed by
    count, of which there are few.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = survivors(texts, least, depth, width).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one_term = Window.partitionBy("lang", "term")
    summed = counts.select("lang", "source", "term", "n", F.sum("docs").over(one_term).alias("docs"), F.sum("n").over(one_term).alias("n_lang"), (F.min("source").over(one_term) == F.col("source")).alias("once"))
    kept = written(summed.where(F.col("docs") >= least).drop("docs"), "kept-terms")
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("once").alias("v"))
    per_group = texts.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    dims = per_group.join(per_lang, "lang", "left").select("lang", "source", zero("total"), zero("total_lang"), zero("v"))
    dims = written(dims.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"))), "sources")
    shares = kept.join(dims, ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("p_lang")
    )
    shares = written(shares, "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = shares.where("p > p_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _off(F.col("p"), F.col("p_lang")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    here, there = [shares.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")]) for x in "ab"]
    met = here.join(there, ["lang", "term"]).where("source_a < source_b")
    both = lambda a, b: _off(F.col(f"p_{a}"), F.col(f"p_{b}")) - _off(F.col(f"p_{a}"), F.col(f"p0_{b}")) - _off(F.col(f"p0_{a}"), F.col(f"p_{b}")) + _off(F.col(f"p0_{a}"), F.col(f"p0_{b}"))
    shared = met.groupBy("lang", "source_a", "source_b").agg(F.sum(both("a", "b")).alias("ab"), F.sum(both("b", "a")).alias("ba"))
    shared = shared.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("value")))).alias("x")).select("lang", "x.*")

    by_count = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    others = dims.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    lone = by_count.join(others, "lang").where("source <> item")
    given = lone.groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * (_off(F.col("p"), F.col("q0")) - _off(F.col("p0"), F.col("q0")))).alias("own"),
        F.sum(F.col("times") * (_off(F.col("q0"), F.col("p")) - _off(F.col("q0"), F.col("p0")))).alias("other"),
    )
    given = given.select("lang", F.explode(F.array(F.struct("source", "item", F.col("own").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("other").alias("value")))).alias("x")).select("lang", "x.*")
    absent = dims.join(others, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * _off(F.col("p0"), F.col("q0"))).alias("value"))
    pairs = absent.unionByName(given).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source, part, item, value, rank) of all documents; nulls, groups without terms, repeated rows, empty tables and other columns as divergences() says."""
    return divergences(table(spark, sf_dir, "documents"))


SQL = {
    "op11_divergence": r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS d FROM documents),
found AS (SELECT lang, source, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n_lang FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, sum(n_lang)::BIGINT AS total, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM grp LEFT JOIN counted USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::BIGINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p, 1 + 1000000000::BIGINT * (k.n_lang + 1) // (l.total + l.v) AS p_lang
  FROM totals g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - p_lang) * (p - p_lang) // p_lang)::BIGINT AS value FROM p WHERE n > 0 AND p > p_lang)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
""",
}
