"""Substring dedup with repeated-phrase automata.

1. Anchors. Of the 24 twelve-word sequences in each 35-word window the one with the smallest hash is its anchor, so equal
   windows have equal anchors, and some 8 % of all places are anchors. Texts of equal words count once, as often as they occur.
2. Recurring passages. Only windows whose anchor occurs twice are counted by their own 128-bit hash. Each recurring window is
   kept where it occurs first; consecutive ones form a passage.
3. Automata. Passages are dealt over shards, and a shard compiles all windows of its passages into an Aho-Corasick automaton. Each
   document goes, by its stretches with hot anchors, to the shards that have one of these, and is streamed through their automata: what they
   hit is what goes, nothing else.

A window of 35 words is five sequences of seven words side by side. A shard numbers the seven-word sequences of its passages, by 64-bit
hashes; a text is read as seven interleaved rows of such numbers, one for each place modulo seven, and a window is a pattern of five
numbers in one of them. A number is written with digits to the base 64, each place with letters of its own, so that no node has
more than 64 children and no pattern is met between two numbers. Hits are exact but for collisions of hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small_batches, table, written
from .shingles import Words, grams, groups, least_in_window

WINDOW, ANCHOR = 35, 12
#: Words that a symbol of the automata stands for; a window is a whole number of them.
SYMBOL = 7
#: Words of the passages of a shard, and bytes of the documents that one task streams through it.
SHARD_WORDS, TASK_BYTES = 150_000, 24 << 20


def _spans(places: np.ndarray, width: int) -> list[list[int]]:
    """Sorted starts of windows of ``width`` as merged [begin, end) stretches."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > width) + 1
    return [[int(p[0]), int(p[-1]) + width] for p in np.split(places, cut)]


def _digest(text: str) -> list[Column]:
    """Two 64-bit hashes of a whole text, by which rows with a null or repeated key are told apart."""
    return [F.xxhash64(F.lit("text"), text).alias("__one"), F.xxhash64(F.lit("again"), text).alias("__two")]


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __one, __two, n_words, words_sha, anchors) of each document: the hashes of its text, and anchors once,
    or twice if the text has them at several places; none where there is no window."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(3).to_pylist()]
            counts, shas, anchors = [], [], []
            for a, b in groups(texts):
                words = Words(texts[a:b])
                gram = grams(words.hashes(), ANCHOR)
                least = least_in_window(gram, WINDOW - ANCHOR + 1)
                for i, t in enumerate(texts[a:b]):
                    first, last = words.first[i], words.first[i] + words.counts[i] - WINDOW + 1
                    found, n = np.unique(gram[np.unique(least[first:last])] if last > first else gram[:0], return_counts=True)
                    anchors.append(np.repeat(found, np.minimum(n, 2)).view(np.int64))
                    shas.append(hashlib.sha256(b" ".join(t.split())).digest())
                counts += words.counts.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], names=[key, "__one", "__two", "n_words", "words_sha", "anchors"])

    return docs.select(key, *_digest(text), text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, __one long, __two long, n_words long, words_sha binary, anchors array<long>")


def _regions(rows: DataFrame) -> DataFrame:
    """(id, copies, at, words, anchors): the stretches of a text whose windows have hot anchors, from (id, words_sha, copies, text, hot).

    Rows whose text has other words than were looked for are left out: a key may be repeated.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, shas, copies, texts, hot = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for i, text in enumerate(texts):
                words = (text or "").encode().split()
                joined = b" ".join(words)
                if hashlib.sha256(joined).digest() != shas[i]:
                    continue
                gram = grams(Words([joined]).hashes(), ANCHOR)
                least = least_in_window(gram, WINDOW - ANCHOR + 1)
                near = np.flatnonzero(np.isin(gram[least].view(np.int64), hot[i].values.to_numpy()))
                for part in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1) if len(near) else []:
                    a, b = int(part[0]), int(part[-1]) + WINDOW
                    out[0].append(ids[i]), out[1].append(copies[i]), out[2].append(a), out[3].append(b" ".join(words[a:b]).decode())
                    out[4].append(np.unique(gram[np.unique(least[part])]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64()))], names=["id", "copies", "at", "words", "anchors"])

    return rows.mapInArrow(run, "id long, copies long, at int, words string, anchors array<long>")


def _candidate_windows(regions: DataFrame) -> DataFrame:
    """(h, g, n, id, at): the distinct windows of a region, how often each occurs in it and its copies, and where first."""

    def run(batches):
        for batch in batches:
            ids, begins, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for a, b in groups(texts):
                words = Words(texts[a:b])
                h, g = grams(words.hashes(0), WINDOW).view(np.int64), grams(words.hashes(1), WINDOW, 1).view(np.int64)
                out: list[list] = [[], [], [], [], []]
                for i in range(a, b):
                    first, last = words.first[i - a], words.first[i - a] + words.counts[i - a] - WINDOW + 1
                    _, at, n = np.unique(h[first:last], return_index=True, return_counts=True)
                    for column, values in zip(out, (h[first:last][at], g[first:last][at], n.astype(np.int64) * copies[i], np.full(len(at), ids[i]), (at + begins[i]).astype(np.int32)), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h", "g", "n", "id", "at"])

    return regions.select("id", "at", "words", "copies").mapInArrow(run, "h long, g long, n long, id long, at int")


def _passages(regions: DataFrame) -> DataFrame:
    """(passage, words, n, anchors) from (id, at, words, starts of the text's recurring windows): their runs within the region."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, at, text, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.encode().split(b" ")
                starts = np.sort(np.asarray(starts)) - at
                starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
                    a, b = int(part[0]), int(part[-1]) + WINDOW
                    passage = b" ".join(words[a:b])
                    gram = grams(Words([passage]).hashes(), ANCHOR)
                    out[0].append(f"{i}:{at + a}"), out[1].append(passage.decode()), out[2].append(b - a)
                    out[3].append(np.unique(gram[least_in_window(gram, WINDOW - ANCHOR + 1)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], names=["passage", "words", "n", "anchors"])

    return regions.select("id", "at", "words", "starts").mapInArrow(run, "passage string, words string, n long, anchors array<long>")


class PhraseAutomaton:
    """All windows of a shard's passages as patterns of an Aho-Corasick automaton."""

    def __init__(self, passages: list[bytes]):
        import ahocorasick

        hashes = []
        for a, b in groups(passages):
            words = Words(passages[a:b])
            gram = grams(words.hashes(), SYMBOL)
            hashes += [gram[first : first + n - SYMBOL + 1] for first, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True)]
        #: The seven-word sequences that have a number: their place here.
        self.known = np.unique(np.concatenate(hashes))
        self.digits = next(d for d in range(1, 12) if len(self.known) <= 64**d)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        length = WINDOW // SYMBOL * self.digits
        for own in hashes:
            numbers = np.searchsorted(self.known, own)
            for k in range(SYMBOL):
                row = self._letters(numbers[k::SYMBOL]).tobytes().decode("utf-32-le")
                for at in range(0, len(row) - length + 1, self.digits):
                    self.automaton.add_word(row[at : at + length])
        self.automaton.make_automaton()

    def _letters(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers as code points, a row each: place k has the letters from 256 + 64 k on."""
        places = np.arange(self.digits)
        return ((numbers[:, None] >> (6 * places)) % 64 + 256 + 64 * places).astype("<u4")

    def hits(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the sorted starts of its windows that the automaton has."""
        words = Words(texts)
        gram = grams(words.hashes(), SYMBOL)
        spot = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        place = np.flatnonzero((self.known[spot] == gram) & (words.texts_of(SYMBOL) >= 0))  # of the others no pattern has a number
        owner = np.searchsorted(words.first, place, "right") - 1
        row = owner * SYMBOL + (place - words.first[owner]) % SYMBOL
        order = np.argsort(row, kind="stable")
        place, row = place[order], row[order]
        breaks = np.flatnonzero((np.diff(row) != 0) | (np.diff(place) != SYMBOL)) + 1
        letters = np.insert(self._letters(spot[place]), breaks, 32, axis=0)  # blanks part the rows
        place = np.insert(place, breaks, -1)
        ends = np.fromiter((end for end, _ in self.automaton.iter(letters.tobytes().decode("utf-32-le"))), np.int64) // self.digits if len(place) else place
        starts = np.sort(place[ends] - WINDOW + SYMBOL)
        at = np.searchsorted(starts, words.first)
        return [starts[a:b] - first for a, b, first in zip(at[:-1].tolist(), at[1:].tolist(), words.first.tolist(), strict=False)]


def _stream(regions: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, starts) for each region and shard: cogroups of a shard's passages and a bounded slice of its regions. Starts are
    runs of windows, [begin, end) after another."""

    def run(left, right):
        out: list[list] = [[], []]
        if left.num_rows and right.num_rows:
            automaton = PhraseAutomaton([t.encode() for t in left.column("words").to_pylist()])
            ids, begins = right.column("id").to_pylist(), right.column("at").to_pylist()
            texts = [t.encode() for t in right.column("region").to_pylist()]
            for a, b in groups(texts):
                for i, at, starts in zip(ids[a:b], begins[a:b], automaton.hits(texts[a:b]), strict=True):
                    if len(starts):
                        out[0].append(i), out[1].append([at + x for span in _spans(starts, 1) for x in span])
        return pa.table({"id": pa.array(out[0], pa.int64()), "starts": pa.array(out[1], pa.list_(pa.int32()))})

    return passages.groupBy("shard", "slice").cogroup(regions.groupBy("shard", "slice")).applyInArrow(run, "id long, starts array<int>")


def _cut(docs: DataFrame, texts: bool) -> DataFrame:
    """(words_sha, n_removed, kept_sha, kept_text) from (words_sha, text, starts): runs of window starts, [begin, end) after another."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for sha, text, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = (text or "").encode().split()
                if hashlib.sha256(b" ".join(words)).digest() != sha:
                    continue
                gone = np.zeros(len(words) + 1, np.int64)
                for runs in starts:
                    for a, b in zip(runs[::2], runs[1::2], strict=True):
                        gone[a] += 1
                        gone[b + WINDOW - 1] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                kept = b" ".join([words[i] for i in keep.tolist()])
                out[0].append(sha), out[1].append(len(words) - len(keep)), out[2].append(hashlib.sha256(kept).digest()), out[3].append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], names=["words_sha", "n_removed", "kept_sha", "kept_text"])

    return docs.select("words_sha", "text", "starts").mapInArrow(run, "words_sha binary, n_removed long, kept_sha binary, kept_text string")


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha, kept_text) of each row: its words without those that a recurring window covers.

    kept_text is given, unless ``texts`` is false, for documents of which a part goes; it is null where all words stay and empty where all go.
    A null or empty text has no words. Fewer than 35 words have no window. Of a very long text only the stretches with hot anchors move; it is read whole where it lies and where it is cut. Rows of equal words recur with each
    other, whatever their keys; a null key is kept, and rows that repeat a key are rows of their own. An empty table gives an empty table, other columns are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(key), F.col(text))
    known = written(signatures(plain, key, text), "signatures")
    # texts of equal words once, numbered as they are written; the row to fetch the text from is one with the smallest key
    classes = known.where(F.col("n_words") >= WINDOW).groupBy("words_sha").agg(F.count("*").alias("copies"), F.min(F.struct(F.col(key).alias("key"), "__one", "__two")).alias("rep"), F.first("anchors").alias("anchors"))
    classes = written(classes.select("*", F.monotonically_increasing_id().alias("id")), "classes")
    rep = classes.select("id", "words_sha", "copies", F.col("rep.key").alias("__key"), F.col("rep.__one").alias("__a"), F.col("rep.__two").alias("__b"))
    digested = plain.select("*", *_digest(text))

    def fetched(wanted: DataFrame, *more: str) -> DataFrame:
        same = (F.col("__one") == F.col("__a")) & (F.col("__two") == F.col("__b")) & F.col(key).eqNullSafe(F.col("__key"))
        return digested.join(wanted, same).select("id", "words_sha", "copies", F.col(text).alias("text"), *more)

    places = classes.select("id", "copies", F.explode("anchors").alias("anchor"))
    twice = places.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
    hot = places.join(twice, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("hot"))
    regions = written(_regions(fetched(rep.join(hot, "id"), "hot")), "regions")

    recurring = _candidate_windows(regions).groupBy("h", "g").agg(F.sum("n").alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1")
    starts = recurring.groupBy(F.col("first.id").alias("id")).agg(F.collect_list("first.at").alias("starts"))
    passages = written(_passages(regions.select("id", "at", "words").join(starts, "id")), "passages")

    total = passages.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    # passages of one text go to one shard: what copies some of them meets few shards, however many there are
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64(F.substring_index("passage", ":", 1)), F.lit(shards)).cast("int"))
    by_anchor = dealt.select("shard", F.explode("anchors").alias("anchor")).distinct()
    routes = regions.select("id", "at", F.octet_length("words").alias("bytes"), F.explode("anchors").alias("anchor")).join(by_anchor, "anchor")
    routes = written(routes.select("id", "at", "bytes", "shard").distinct(), "routes")
    slices = written(routes.groupBy("shard").agg(F.ceil(F.sum("bytes") / TASK_BYTES).cast("int").alias("slices")), "slices")
    routed = routes.join(slices, "shard").select("id", "at", "shard", F.pmod(F.xxhash64("id", "at"), F.col("slices")).cast("int").alias("slice"))
    streams = routed.join(regions.select("id", "at", F.col("words").alias("region")), ["id", "at"])
    compiled = dealt.join(slices, "shard").select("words", "shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    spans = written(_stream(streams, compiled).groupBy("id").agg(F.collect_set("starts").alias("starts")), "spans")
    dropped(regions, passages, routes, slices)
    changed = written(_cut(fetched(rep.join(spans, "id"), "starts"), texts).dropDuplicates(["words_sha"]), "cut")
    dropped(spans, classes)
    out = known.select(key, "n_words", "words_sha").join(changed, "words_sha", "left")
    return out.select(key, "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "words_sha").alias("kept_sha"), "kept_text")


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document, a row for a row; nulls, empty and repeated rows as dedup_passages() says."""
    out = dedup_passages(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


SQL = {
    "op4_phrases": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(len(w) - 34)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, md5_number(array_to_string(w[p + 1 : p + 35], ' ')) AS g FROM s),
r AS (SELECT g FROM h GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, p + k AS at_ FROM h JOIN r USING (g), range(35) o(k)),
n AS (SELECT doc_id, list(at_) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
""",
}
