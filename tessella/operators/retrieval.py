"""Passage retrieval: overlapping windows ranked by BM25 over substrings, chunks and spans of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNK, STEP, WINDOW, occurrences, query_terms, window_starts
from ..plans.registry import register, rounded
from ..plans.scratch import written

K1, B = 1.5, 0.75


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, passage, words): windows of each document; none of an empty one."""
    # made within the generator, so that later expressions read the passage instead of cutting it anew
    cut = F.transform(window_starts(F.length(text)), lambda i: F.struct(i.alias("start"), F.lower(F.substring(F.col(text), i + 1, F.lit(WINDOW))).alias("passage")))
    return docs.select(key, F.explode(cut).alias("w")).select(key, "w.start", "w.passage").withColumn("words", F.regexp_count("passage", F.lit(r"[\p{L}\p{N}]+")))


def bm25(docs: DataFrame, query: str, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """The best windows for a query. A term counts as a substring. One scan of the texts writes a column a term; the number of
    windows that have each term and the average length are one aggregated row, so nothing but that and the top is shuffled."""
    spark = docs.sparkSession
    terms = spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    if not terms:
        return windows(docs, key=key).where("false").select(key, "start", F.lit(0.0).alias("score"))
    counts = F.struct("words", *[occurrences(F.col("passage"), F.lit(t)).alias(f"f{i}") for i, t in enumerate(terms)])
    counted = windows(docs, key=key).select(key, "start", F.explode(F.array(counts)).alias("c")).select(key, "start", "c.*")
    pool = written(counted, "windows")  # some numbers a window: both the sums and the scores read these, not the texts
    stats = pool.agg(F.count("*").alias("total"), F.avg("words").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    some = pool.where(F.greatest(*[F.col(f"f{i}") for i in range(len(terms))], F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    size = F.greatest(F.col("words"), F.lit(1)) / F.coalesce(F.nullif(F.col("mean"), F.lit(0.0)), F.lit(1.0))
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.log(1 + (F.col("total") - n + 0.5) / (n + 0.5))
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * size))
    return some.select(key, "start", rounded(score, 6).alias("score")).orderBy(F.desc("score"), key, "start").limit(limit)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """Fixed tiles of each document with their neighbours; an empty one has the tile 0-0."""
    n = F.coalesce(F.length(text), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    some = docs.select(key, n.alias("n"), count.alias("count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    end = F.least(F.col("n"), (F.col("chunk") + 1) * size)
    return some.select(key, "chunk", (F.col("chunk") * size).alias("start"), end.alias("stop"), F.when(F.col("chunk") > 0, F.col("chunk") - 1).alias("previous"), F.when(F.col("chunk") < F.col("count") - 1, F.col("chunk") + 1).alias("next"))


def budgeted_chunks(docs: DataFrame, query: str, budget: int, key: str = "doc_id", text: str = "text", size: int = 1_000) -> DataFrame:
    """(key, picked, chars): of each document the first tile and then those with most query terms that still fit, in page order."""
    terms = [t.lower() for t in query.split()]

    def pick(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text].fillna(""), strict=True):
                tiles = [t[i : i + size] for i in range(0, max(1, len(t)), size)]
                order = [0, *sorted(range(1, len(tiles)), key=lambda i: (-sum(tiles[i].lower().count(x) for x in terms), i))]
                left, picked = budget, []
                for i in order:
                    if len(tiles[i]) <= left:
                        picked.append(i)
                        left -= len(tiles[i])
                out.append((k, sorted(picked), budget - left))
            yield pd.DataFrame(out, columns=[key, "picked", "chars"])

    return docs.select(key, text).mapInPandas(pick, f"{key} long, picked array<int>, chars long")


QUERY = 'the "of the" tion'
SQL_TERMS = "['of the', 'the', 'tion']"
SQL_WINDOWS = f"(SELECT doc_id, start, lower(text[start + 1 : start + {WINDOW}]) AS passage FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - {WINDOW}) / {STEP}))::BIGINT * {STEP} + 1, {STEP})) AS start FROM documents WHERE length(text) > 0))"
SQL_BM25 = f"""WITH w AS MATERIALIZED (SELECT doc_id, start, passage, greatest(1, len(regexp_extract_all(passage, '[\\p{{L}}\\p{{N}}]+'))) AS dl, len(regexp_extract_all(passage, '[\\p{{L}}\\p{{N}}]+')) AS words FROM {SQL_WINDOWS}),
f AS (SELECT doc_id, start, dl, t, (length(passage) - length(replace(passage, t, ''))) / length(t) AS f FROM w, (SELECT unnest({SQL_TERMS}) AS t)),
s AS (SELECT count(*) AS total, avg(words) AS mean FROM w), n AS (SELECT t, count(*) FILTER (f > 0) AS n FROM f GROUP BY t)
SELECT doc_id, start::INT AS start, floor(sum(ln(1 + (total - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))) * 1e6 + 0.5) / 1e6 AS score
FROM f JOIN n USING (t), s WHERE f > 0 GROUP BY doc_id, start ORDER BY score DESC, doc_id, start LIMIT 20"""

register("fn06_bm25", "documents", lambda d: bm25(d, QUERY), SQL_BM25)
register("so03_bm25_top", "documents", lambda d: bm25(d, QUERY, 5).select("doc_id", "start"), f"SELECT doc_id, start FROM ({SQL_BM25}) ORDER BY score DESC, doc_id, start LIMIT 5")
register("wn08_windows", "documents", lambda d: windows(d).select("doc_id", "start", F.length("passage").alias("chars"), "words"), f"SELECT doc_id, start::INT AS start, length(passage)::INT AS chars, len(regexp_extract_all(passage, '[\\p{{L}}\\p{{N}}]+'))::INT AS words FROM {SQL_WINDOWS}")
register("fn04_terms", "benchmark", lambda b: b.select("item_id", F.array_join(query_terms(F.concat(F.lit('say "Exact Phrase" '), F.col("text"))), "|").alias("terms")).select("item_id", F.md5("terms").alias("digest")), "SELECT item_id, md5(array_to_string(list_distinct_ordered, '|')) AS digest FROM (SELECT item_id, list_transform(list_filter(list_transform(range(len(l)), lambda i: struct_pack(i := i, v := l[i + 1])), lambda x: list_position(l, x.v) = x.i + 1), lambda x: x.v) AS list_distinct_ordered FROM (SELECT item_id, list_concat(['exact phrase', 'say'], list_filter(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{N}_-]+'), lambda t: lower(t)), lambda t: length(t) >= 2)) AS l FROM benchmark))")
register("fn05_occurrences", "documents", lambda d: d.select("doc_id", occurrences(F.lower("text"), F.lit("the")).alias("n")), "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS n FROM documents")
register("fn23_chunks", "documents", lambda d: chunks(d).select("doc_id", "chunk", "start", "stop"), "SELECT doc_id, c::INT AS chunk, (c * 12000)::INT AS start, least(length(text), (c + 1) * 12000)::INT AS stop FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 12000))::BIGINT)) AS c FROM documents)")
register("wn09_neighbours", "documents", lambda d: chunks(d, size=2000).select("doc_id", "chunk", "previous", "next"), "SELECT doc_id, c::INT AS chunk, lag(c) OVER w::INT AS previous, lead(c) OVER w::INT AS next FROM (SELECT doc_id, unnest(range(greatest(1, ceil(length(text) / 2000))::BIGINT)) AS c FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY c)")
register("fn07_span_read", "documents", lambda d: d.select("doc_id", F.md5(F.substring("text", 101, 300)).alias("digest")), "SELECT doc_id, md5(text[101:400]) AS digest FROM documents")
register("so13_budgeted_chunks", "documents", lambda d: budgeted_chunks(d, "the and tion", 4_000))
