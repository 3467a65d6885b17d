"""Line dedup by overlapping three-line windows: of each window that repeats only the first occurrence stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, word_count

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(key: Column, text: Column) -> list[Column]:
    """What names a row beyond its key: two 64-bit hashes of its text."""
    return [key.alias("__key"), F.xxhash64(F.lit("row"), text).alias("__one"), F.xxhash64(F.lit("again"), text).alias("__two")]


ROW = ("__key", "__one", "__two")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(__key, __one, __two, starts): of the rows that have any, the sorted line numbers, from 0, where windows of later occurrences begin.

    A window is ``width`` consecutive lines of one row, lines taken as they are, empty ones included.
    Its first occurrence is the one with the smallest (key, hashes of the text, line), a null key behind all others. Rows are told apart by
    key and text, so rows that repeat a key never lose each other's lines. The hash of a window is a pair of
    64-bit hashes chained over its lines. Counting keeps one row a window and task before the shuffle,
    so a window that a third of the documents have isn't gathered anywhere; the join back is on the
    window, whose hot values AQE splits.
    """
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    hashed = lambda seed: lambda a, i: F.xxhash64(F.lit(seed), *[at(a, i + k) for k in range(width)])
    lines = docs.select(*_row(F.col(key), F.col(text)), _lines(F.col(text)).alias("__lines")).where(F.size("__lines") >= width)
    windows = lines.select(
        *ROW,
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("__lines") - width), lambda i: F.struct(hashed("first")(F.col("__lines"), i).alias("h"), hashed("second")(F.col("__lines"), i).alias("g")))).alias("at", "w"),
    ).select(*ROW, "at", "w.h", "w.g")
    place = F.struct(F.col("__key").isNull().alias("none"), *ROW, "at")
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy(*ROW).agg(F.sort_array(F.collect_set("at")).alias("starts"))


def _runs(starts: Column, width: int) -> tuple[Column, Column]:
    """Begins and ends of the stretches that windows at sorted ``starts`` cover, each found by a look at its neighbour."""
    before, after = lambda i: F.element_at(starts, F.greatest(i, F.lit(1))), lambda i: F.element_at(starts, F.least(i + 2, F.size(starts)))
    begins = F.filter(starts, lambda x, i: (i == 0) | (x - before(i) > width))
    ends = F.transform(F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (after(i) - x > width)), lambda x: x + width)
    return begins, ends


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept_text: ``text`` without the lines that windows of later occurrences cover.

    A null text is an empty one of a single line. Documents of fewer than ``width`` lines have no
    window and stay whole. Rows with a null key take part, as the last of all. Rows that repeat a key with
    another text are rows of their own; rows equal in key and text are one occurrence and give
    equal results. A very long text is one row: its lines and windows are arrays of that row until they are exploded. An empty table gives an empty table. Columns of ``docs`` with one of the new names are replaced.
    """
    made = ("n_lines", "n_removed", "kept_text")
    plain = docs.drop(*[c for c in docs.columns if c in made])
    # the row goes along as a whole, so none of its names can meet one of these
    named = plain.select(F.struct("*").alias("whole"), F.col(text).alias("text"), *_row(F.col(key), F.col(text)))
    there = marked(plain, key, text, width).toDF("k", "o", "t", "starts")
    joined = named.join(there, (F.col("__one") == F.col("o")) & (F.col("__two") == F.col("t")) & F.col("__key").eqNullSafe(F.col("k")), "left")
    begins, ends = _runs(F.col("starts"), width)
    runs = joined.select("whole", "text", _lines(F.col("text")).alias("all"), begins.alias("begins"), ends.alias("ends"))
    # what stands between two stretches: from the end of one, or line 0, to the begin of the next, or the last line
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))))
    end = lambda k: F.when(k == F.size("begins"), F.size("all")).otherwise(F.element_at("begins", F.least(k + 1, F.size("begins"))))
    parts = F.transform(F.sequence(F.lit(0), F.size("begins")), lambda k: F.slice("all", begin(k) + 1, end(k) - begin(k)))
    gone = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0), lambda a, x: a + x)
    kept = F.when(F.col("begins").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))
    return runs.select("whole.*", F.size("all").cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document, a row for a row; nulls, ties, repeated rows and other columns as dedup_lines() says."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document without repeated lines, n_chars counted anew. One that had words and has none left goes.

    Rows that lose nothing are as they were, null and empty texts among them; null and repeated ids and very long texts as dedup_lines() says. The columns are
    those of ``docs``, whatever their names; columns named as dedup_lines()' own stay as they were."""
    clash = {c: f"__own_{c}" for c in ("n_lines", "n_removed", "kept_text") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(clash))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    kept = out.where((F.col("n_removed") == 0) | (word_count(F.col("kept_text")) > 0))
    made = {"n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long")), "text": text} if "n_chars" in docs.columns else {"text": text}
    kept = kept.withColumns(made).drop("n_lines", "n_removed", "kept_text").withColumnsRenamed({v: k for k, v in clash.items()})
    return kept.select(*docs.columns)


SQL = {
    "op7_line_dedup": """
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(len(l) - 2)) AS p, l FROM lines WHERE len(l) >= 3),
named AS (SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w FROM windows),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM named),
gone AS (SELECT DISTINCT doc_id, p + k AS pos FROM ranked, (VALUES (0), (1), (2)) o(k) WHERE r > 1),
sets AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(l, chr(10)) ELSE coalesce(array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END) AS kept_sha256
FROM lines LEFT JOIN sets USING (doc_id)
""",
}
