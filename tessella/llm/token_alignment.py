"""Cross-tokenizer alignment: token intervals of two vocabularies in DuckDB tables, one database an Arrow partition.

Tokens are cut into groups where one of each vocabulary ends on the same byte. An ASOF join finds each token's group, a window
sum numbers the groups, range joins give the groups and tokens of each stretch of text. Counts of id pairs are merged in Spark.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, small_batches, table, written

#: Texts of so many characters are aligned together; a longer one is taken alone, whole.
GROUP_CHARS = 1_500_000
#: DuckDB's share of a worker's memory; beyond it, it spills.
MEMORY = "200MB"
#: At most so many id pairs are looked up by broadcast: those in more than 1/HEAVY of all rows. All others meet in a shuffle, where none is hot.
HEAVY = 1 << 17

#: One space between characters that are no white space: both vocabularies begin a token with it, so neither has a token across.
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Stretches that a Python worker remembers from text to text; beyond so many it keeps those that came so often, or begins anew if these are over half of them.
KNOWN, OFTEN = 300_000, 3
NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int64))
SCHEMA = "uid long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"

#: Of new stretches s (no, frm, til) and the tokens of both sides (til, id), in bytes of all stretches in a row. A group is numbered by the sum of
#: the common ends before it.
STRETCHES = """
CREATE OR REPLACE TEMP TABLE cuts AS SELECT a.til, sum(1) OVER (ORDER BY a.til ROWS UNBOUNDED PRECEDING) AS g FROM a JOIN b ON a.til = b.til;
CREATE OR REPLACE TEMP TABLE ga AS SELECT cuts.g, a.id, a.til FROM a ASOF JOIN cuts ON a.til <= cuts.til;
CREATE OR REPLACE TEMP TABLE gb AS SELECT cuts.g, b.id, b.til FROM b ASOF JOIN cuts ON b.til <= cuts.til;
CREATE OR REPLACE TEMP TABLE na AS SELECT g, count(*) AS n, min(id) AS id FROM ga GROUP BY g;
CREATE OR REPLACE TEMP TABLE nb AS SELECT g, count(*) AS n, min(id) AS id FROM gb GROUP BY g;
CREATE OR REPLACE TEMP TABLE groups AS SELECT s.no, c.g, na.n AS n_a, nb.n AS n_b, na.id AS a, nb.id AS b
  FROM cuts c JOIN s ON c.til > s.frm AND c.til <= s.til JOIN na ON na.g = c.g JOIN nb ON nb.g = c.g;
INSERT INTO links SELECT no, (a << 15) | b AS pair, sum(times)::BIGINT AS times FROM (
  SELECT no, a, b, 1 AS times FROM groups WHERE n_a = 1 AND n_b = 1
  UNION ALL SELECT groups.no, x.id AS a, y.id AS b, x.n * y.n AS times FROM groups
    JOIN (SELECT g, id, count(*) AS n FROM ga GROUP BY g, id) x ON x.g = groups.g
    JOIN (SELECT g, id, count(*) AS n FROM gb GROUP BY g, id) y ON y.g = groups.g WHERE n_a > 1 OR n_b > 1) GROUP BY ALL;
"""
#: The groups in order, each as its ids.
NAMED = """
SELECT no, n_a, n_b, coalesce(x.ids, a::VARCHAR) || '|' || coalesce(y.ids, b::VARCHAR) AS ids FROM groups
  LEFT JOIN (SELECT ga.g, string_agg(ga.id, ',' ORDER BY til) AS ids FROM ga JOIN na ON na.g = ga.g WHERE na.n > 1 GROUP BY ga.g) x ON x.g = groups.g
  LEFT JOIN (SELECT gb.g, string_agg(gb.id, ',' ORDER BY til) AS ids FROM gb JOIN nb ON nb.g = gb.g WHERE nb.n > 1 GROUP BY gb.g) y ON y.g = groups.g ORDER BY groups.g
"""
#: Of the stretches d (doc, no) that some texts consist of.
DOCUMENTS = """
SELECT doc, list(pair) AS pairs, list(times) AS times FROM
  (SELECT doc, pair, sum(times * n)::BIGINT AS times FROM (SELECT doc, no, count(*) AS n FROM d GROUP BY doc, no) x JOIN links ON links.no = x.no GROUP BY doc, pair) GROUP BY doc
"""


class Aligner:
    """Both vocabularies in a Python worker, the bytes of their tokens, and a database."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=pieces_path)
        letter = self._byte_letters()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 15:
            raise ValueError("a pair of ids has to fit in 31 bits")
        #: A piece with a space behind something else would reach over a cut, and then texts are taken whole.
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        folder = f"{tempfile.gettempdir()}/tessella-{os.getpid()}"  # of this worker alone; DuckDB makes it if it spills and empties it
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder})
        self._forget()

    def _forget(self) -> None:
        #: The number of each known stretch, -1 if its tokens' bytes aren't its own; by number its groups and [n_a, n_b, n_groups, n_links].
        self.known: dict[str, int] = {}
        self.named: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.came = np.zeros(0, np.int32)
        self.db.execute("CREATE OR REPLACE TEMP TABLE links (no INTEGER, pair INTEGER, times BIGINT)")

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The letter that a byte-level vocabulary writes for each byte: printable ones themselves, the others those from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _thin(self) -> None:
        """Forget stretches that came seldom."""
        keep = np.flatnonzero(self.came >= OFTEN)
        if len(keep) > KNOWN // 2:
            self._forget()
            return
        new = np.full(len(self.named), -1, np.int32)
        new[keep] = np.arange(len(keep), dtype=np.int32)
        self.known = {k: int(new[i]) for k, i in self.known.items() if i >= 0 and new[i] >= 0}
        self.named = [self.named[i] for i in keep.tolist()]
        self.counts, self.came = self.counts[keep], self.came[keep] // 2
        self.db.register("kept", pa.table({"old": pa.array(keep, pa.int32()), "new": pa.array(new[keep], pa.int32())}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE links AS SELECT new AS no, pair, times FROM links JOIN kept ON links.no = kept.old")

    def stretches(self, text: str) -> list[str]:
        """``text`` cut at single spaces between other characters; each part stands behind a space."""
        if not self.cuts:
            return [text]
        plain = "▁" not in text and all(" ".join(line.split()) == line for line in text.split("\n"))  # no white space but single spaces and line ends
        return text.split(" ") if plain else CUT.split(text)

    def _learn(self, new: list[str]) -> None:
        """Tokenize and align stretches that aren't known yet."""
        raw = [b" " + k.encode() for k in new]
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + k for k in new], add_special_tokens=False)]
        b_ids = self.b.encode(new, num_threads=1)
        a, b = self.a_bytes, self.b_bytes
        if not all(fits := [b"".join([a[i] for i in x]) == r == b"".join([b[i] for i in y]) for x, y, r in zip(a_ids, b_ids, raw, strict=True)]):
            self.known.update((k, -1) for k, ok in zip(new, fits, strict=True) if not ok)
            new, raw, a_ids, b_ids = ([x for x, ok in zip(side, fits, strict=True) if ok] for side in (new, raw, a_ids, b_ids))
        if not new:
            return
        first = len(self.named)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        for name, ids, sizes in (("a", a_ids, self.a_sizes), ("b", b_ids, self.b_sizes)):
            flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
            self.db.register(name, pa.table({"til": np.cumsum(sizes[flat]), "id": flat}))
        til = np.cumsum([len(r) for r in raw])
        self.db.register("s", pa.table({"no": np.arange(first, first + len(new)), "frm": np.concatenate(([0], til[:-1])), "til": til}))
        self.db.execute(STRETCHES)
        groups = self.db.sql(NAMED).to_arrow_table()
        no, n_a, n_b = (groups.column(c).to_numpy().astype(np.int64) for c in ("no", "n_a", "n_b"))
        begins = np.searchsorted(no, np.arange(first, first + len(new)))
        self.counts = np.concatenate((self.counts, np.stack([np.add.reduceat(x, begins) for x in (n_a, n_b, np.ones_like(no), n_a * n_b)], 1)))
        lists = pa.ListArray.from_arrays(np.append(begins, len(no)).astype(np.int32), groups.column("ids").combine_chunks())
        self.named += pc.binary_join(lists, ";").to_pylist()

    def align(self, texts: list[str]) -> list[tuple | None]:
        """Of each text (n_a, n_b, n_groups, n_links, digest, pairs, times), or None without tokens."""
        gc.disable()  # many small lists and strings, none in a cycle
        try:
            return self._align(texts)
        finally:
            gc.enable()

    def _align(self, texts: list[str]) -> list[tuple | None]:
        parts = [self.stretches(t) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self._thin()
        if new := set(chain.from_iterable(parts)).difference(self.known):
            self._learn(list(new))
        out: list[tuple | None] = [None] * len(texts)
        docs, numbers = [], []
        for i, own in enumerate(parts):
            nos = [self.known[p] for p in own]
            if own and min(nos) >= 0:  # a stretch that differs makes the whole text one without tokens
                docs.append(i), numbers.append(nos)
        if not docs:
            return out
        sizes = [len(nos) for nos in numbers]
        flat = np.fromiter(chain.from_iterable(numbers), np.int32, sum(sizes))
        self.came = np.bincount(flat, minlength=len(self.named)).astype(np.int32) + np.pad(self.came, (0, len(self.named) - len(self.came)))
        totals = np.add.reduceat(self.counts[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
        self.db.register("d", pa.table({"doc": np.repeat(np.array(docs, np.int32), sizes), "no": flat}))
        found = self.db.sql(DOCUMENTS).to_arrow_table()
        pairs = dict(zip(found.column("doc").to_pylist(), zip(found.column("pairs"), found.column("times"), strict=True), strict=True))
        for i, nos, sums in zip(docs, numbers, totals.tolist(), strict=True):
            digest = hashlib.sha256(";".join([self.named[k] for k in nos]).encode()).hexdigest()
            out[i] = (*sums, digest, *(x.values.to_numpy() for x in pairs[i]))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One a Python worker, which serves many tasks."""
    claim("alignment", _aligners.clear)
    if (bytes_path, pieces_path) not in _aligners:
        _aligners[bytes_path, pieces_path] = Aligner(bytes_path, pieces_path)
    return _aligners[bytes_path, pieces_path]


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row: its id pairs, each as a << 15 | b, and how often each is linked.

    A text that is null or empty, or whose tokens' bytes aren't those of the text behind a space, has no tokens: zeros, '' and empty arrays.
    Equal stretches of a worker's texts are tokenized and aligned once, as long as it remembers them. A very long text is taken alone, whole; DuckDB spills
    what it doesn't hold. Within a group each id of one side meets each of the other once, with its number of occurrences, so long runs of one token stay small.
    Rows are independent: repeated ones give equal results, a null key stays null, an empty table gives an empty table; other columns are left behind.
    ``uid`` numbers rows within the task and is unique only once the rows are written.
    """
    small_batches(docs.sparkSession)
    schema = SCHEMA.format(kind=dict(docs.dtypes)[key])

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        own = aligner(bytes_path, pieces_path)
        for batch in batches:
            texts, begin = [t or "" for t in batch.column(1).to_pylist()], 0
            while begin < len(texts):
                end, chars = begin + 1, len(texts[begin])
                while end < len(texts) and chars + len(texts[end]) <= GROUP_CHARS:
                    chars += len(texts[end])
                    end += 1
                rows = [r or NOTHING for r in own.align(texts[begin:end])]
                n_a, n_b, n_groups, n_links, digest, pairs, times = zip(*rows, strict=True)
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                lists = [pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in col]))).astype(np.int32), np.concatenate(col).astype(kind)) for col, kind in ((pairs, np.int32), (times, np.int64))]
                numbers = pa.array(range(uid, uid + len(rows)), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, batch.column(0).slice(begin, len(rows)), *counts, pa.array(digest), *lists], names=["uid", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                uid += len(rows)
                begin = end

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, n, best): in how many of aligned() ``rows`` each id pair is linked, and whether no pair of the same a is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 15))
    counts = written(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, bytes_path: str, pieces_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """aligned() with n_best, the links whose pair is counted highest of its a, and count_sum, the counts summed over all links.

    The commonest pairs, by proof at most HEAVY of them, are looked up by broadcast where the rows lie; a pair beyond those is in at most 1/HEAVY of all
    pair rows, so none is hot in the shuffle that looks up the rest. Nulls, empty, odd, very long and repeated texts as aligned() says.
    """
    rows = written(aligned(docs, bytes_path, pieces_path, key, text), "alignments")
    counts = written(pair_counts(rows), "pair-ranks")
    all_rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = counts.where(F.col("n") > all_rows / HEAVY)
    each = rows.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    looked = each.join(F.broadcast(heavy.select("pair", "n", "best")), "pair", "left")
    sums = lambda df: df.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    light = looked.where("n IS NULL").select("uid", "pair", "times").join(counts.where(F.col("n") <= all_rows / HEAVY).select("pair", "n", "best"), "pair")
    both = looked.where("n IS NOT NULL").select("uid", "times", "n", "best").unionByName(light.select("uid", "times", "n", "best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(sums(both), "uid", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document, a row for a row; nulls, odd and repeated texts as scored() says."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_paths())
