"""N-gram Jaccard join by a token-group matrix.

Documents of one shingle set are a class and stand for themselves once. Two sets that link share a token in their
prefixes, the tokens that come first in one order of all tokens: rare ones before frequent ones, by hash within. Candidates
come from that alone; what decides is the bound and the count over whole sets:

* a group is a bounded number of similar sets with the union of their tokens; a query opens a group only if the tokens that it shares with
  the union could be enough, and is then counted against all sets of the group at once;
* first each set meets the first set of each of its tokens, which joins copies in time linear in their number;
* then the sets that still share a token with another component are grouped by likeness, and each meets the groups with which it shares
  prefix tokens. A token all of whose sets are in one component needs no more looks, so a large group of copies costs nothing here.

For components, links within one that change nothing are not counted out; every link between components is found. links() counts all of them out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, components, dropped, small_batches, table, written
from .shingles import Words, grams, groups

#: Tokens that the frequency order knows at most: 12 bytes each, a broadcast of bounded size. Rarer ones go by hash alone.
FREQUENT, LEAST_FREQUENT = 1 << 18, 8
#: Sets in a group, and bytes of text in a task.
GROUP, TASK_BYTES, SHINGLE_BYTES = 256, 8 << 20, 7


def token_sets(texts: list[bytes], k: int, lower: bool):
    """For each text the sorted distinct hashes of its k-word shingles; of fewer words the whole sequence is one."""
    for a, b in groups(texts):
        words = Words(texts[a:b], lower)
        h = words.hashes()
        gram = grams(h, k)
        for first, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
            yield np.unique(gram[first : first + n - k + 1]) if n >= k else grams(h[first : first + n], n, 7) if n else gram[:0]


def _prefix(n: int, percent: int) -> int:
    return n + 1 + (-percent * n // 100) if n else 0


def _low_tokens(docs: DataFrame, text: str, k: int, percent: int, lower: bool) -> DataFrame:
    """The tokens lowest by hash of each set: five thirds of its prefix, so that the order has room to put frequent ones off."""

    def run(batches):
        for batch in batches:
            low = [s[: -(-5 * _prefix(len(s), percent) // 3)] for s in token_sets([(t or "").encode() for t in batch.column(0).to_pylist()], k, lower)]
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low).view(np.int64))], names=["t"])

    return docs.select(text).mapInArrow(run, "t long")


def frequent(docs: DataFrame, text: str, k: int, percent: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and the level, the binary logarithm, of the number of sets that have them; both arrays bounded."""
    counts = _low_tokens(docs, text, k, percent, lower).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    counts = written(counts.select("t", F.floor(F.log2("n")).cast("int").alias("level")), "frequent")
    held, least = 0, 99
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):  # one row a power of two
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["level"]
    top = counts.where(F.col("level") >= least).orderBy("t").toArrow()
    tokens, levels = top.column("t").to_numpy().view(np.uint64), top.column("level").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def _digest(text: str) -> list[Column]:
    """Two 64-bit hashes of a whole text, by which rows with a null or repeated key are told apart."""
    return [F.xxhash64(F.lit("text"), text).alias("__one"), F.xxhash64(F.lit("again"), text).alias("__two")]


def _signatures(docs: DataFrame, key: str, text: str, k: int, percent: int, lower: bool, order) -> DataFrame:
    """(key, __one, __two, n, set_id, prefix): the hashes of the text, size and digest of the set, and its first tokens in the order of all."""

    def run(batches):
        tokens, levels = order.value
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for s in token_sets([(t or "").encode() for t in batch.column(3).to_pylist()], k, lower):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(tokens) and len(s):
                    place = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    s = s[np.argsort(np.where(tokens[place] == s, levels[place], 0), kind="stable")]
                prefixes.append(s[: _prefix(len(s), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=[key, "__one", "__two", "n", "set_id", "prefix"])

    return docs.select(key, *_digest(text), text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, __one long, __two long, n long, set_id binary, prefix array<long>")


class TokenGroup:
    """Sets with the union of their tokens: sorted tokens, each with the set that has it."""

    def __init__(self, names: list[int], parts: list[int], sets: list[np.ndarray]):
        self.names, self.parts = np.array(names, np.int64), np.array(parts, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def links(self, name: int, part: int, query: np.ndarray, percent: int) -> list[int]:
        """Of each component below ``part`` one set that ``query`` links with."""
        low, high = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        many = high - low
        if 100 * int((many > 0).sum()) < percent * len(query):  # what it shares with the union isn't enough for any set of the group
            return []
        ends = np.cumsum(many)
        shared = np.bincount(self.owner[np.repeat(low - ends + many, many) + np.arange(ends[-1])], minlength=len(self.names))
        good = np.flatnonzero((100 * shared >= percent * (len(query) + self.sizes - shared)) & (self.parts < part) & (self.names != name))
        return self.names[good[np.unique(self.parts[good], return_index=True)[1]]].tolist()


def _verified(members: DataFrame, asked: DataFrame, texts: DataFrame, attributes: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    """(a, b): for each (grp, id) of ``asked`` and each component of the group below that of id, a set it links with, if there is one.

    ``members`` has (grp, id), ``attributes`` (id, n, component); the bytes of texts are estimated from n. Groups are packed into buckets of
    bounded bytes; the queries of a bucket are cut into slices of bounded bytes.
    """
    members = members.join(attributes, "id")
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total * SHINGLE_BYTES // TASK_BYTES))
    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int")
    # a query goes to a bucket once, with the groups there that it asks
    queries = written(asked.groupBy("id", bucket.alias("bucket")).agg(F.collect_set("grp").alias("grps")).join(attributes, "id"), "asked")
    slices = written(queries.groupBy("bucket").agg(F.ceil(F.sum("n") * SHINGLE_BYTES / TASK_BYTES).cast("int").alias("slices")), "slices")
    right = queries.join(slices, "bucket").select("id", "component", "grps", "bucket", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    right = right.join(texts.select(F.col("id"), F.col("text").alias("q_text")), "id").select(F.col("id").alias("q"), F.col("component").alias("q_part"), "q_text", "grps", "bucket", "slice")
    left = members.withColumn("bucket", bucket).join(slices, "bucket").select("grp", "id", "component", F.col("bucket").alias("m_bucket"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("m_slice"))
    left = left.join(texts.select(F.col("id"), F.col("text").alias("m_text")), "id").select("grp", F.col("id").alias("m"), F.col("component").alias("m_part"), "m_text", "m_bucket", "m_slice")

    def run(left, right):
        out: list[list] = [[], []]
        if left.num_rows and right.num_rows:
            of: dict[int, tuple[list, list, list]] = {}
            sets = token_sets([t.encode() for t in left.column("m_text").to_pylist()], k, lower)
            for g, i, part, s in zip(left.column("grp").to_pylist(), left.column("m").to_pylist(), left.column("m_part").to_pylist(), sets, strict=True):
                for column, value in zip(of.setdefault(g, ([], [], [])), (i, part, s), strict=True):
                    column.append(value)
            groups_ = {g: TokenGroup(*ms) for g, ms in of.items()}
            sets = token_sets([t.encode() for t in right.column("q_text").to_pylist()], k, lower)
            for i, part, grps, q in zip(right.column("q").to_pylist(), right.column("q_part").to_pylist(), right.column("grps").to_pylist(), sets, strict=True):
                for g in grps:
                    found = groups_[g].links(i, part, q, percent)
                    out[0] += [i] * len(found)
                    out[1] += found
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return left.groupBy("m_bucket", "m_slice").cogroup(right.groupBy("bucket", "slice")).applyInArrow(run, "a long, b long")


def _fits(a: str, b: str, percent: int):
    """Sets of these sizes can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _enough(common, n: str, least: str, most: str, percent: int):
    """``common`` tokens shared by the prefixes of a set of n and one of least to most leave room for a link.

    In one order of all tokens the prefix of one set can reach into the rest of the other, but not both ways, so what two sets share is
    what their prefixes share and at most the larger of the two rests.
    """
    rest = lambda c: F.floor((percent * F.col(c) + 99) / 100) - 1
    return (100 + percent) * (common + F.greatest(rest(n), rest(most))) >= percent * (F.col(n) + F.col(least))


class _Classes:
    """Documents of one set as classes: what both linked() and links() start from.

    ``known`` has a row for each of ``docs``, ``classes`` one for each set that isn't empty: a number, given as it is written, and
    the row to fetch the text from, one with the smallest key, a null one last. ``shared`` has the tokens that several prefixes have.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, k: int, percent: int, lower: bool):
        small_batches(docs.sparkSession)
        self.key, self.text, self.k, self.percent, self.lower = key, text, k, percent, lower
        plain = docs.select(F.col(key), F.col(text))
        order = docs.sparkSession.sparkContext.broadcast(frequent(plain, text, k, percent, lower))
        self.known = written(_signatures(plain, key, text, k, percent, lower, order), "sets")
        rep = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "__one", "__two")
        classes = self.known.where("n > 0").groupBy("set_id").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        self.classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        self.sizes = self.classes.select("id", "n")
        self.plain = plain.select("*", *_digest(text))
        rows = self.classes.select("id", F.explode("prefix").alias("t"))
        tokens = rows.groupBy("t").agg(F.count("*").alias("sets"), F.min("id").alias("head")).where("sets > 1").drop("sets")
        self.shared = written(rows.join(tokens, "t").select("t", "id", "head"), "shared")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of classes, each text once."""
        wanted = ids.join(self.classes.select("id", F.col("rep.key").alias("__key"), F.col("rep.__one").alias("__a"), F.col("rep.__two").alias("__b")), "id")
        same = (F.col("__one") == F.col("__a")) & (F.col("__two") == F.col("__b")) & F.col(self.key).eqNullSafe(F.col("__key"))
        return written(self.plain.join(wanted, same).select("id", F.col(self.text).alias("text")).dropDuplicates(["id"]), "texts")

    def verified(self, members: DataFrame, asked: DataFrame, texts: DataFrame, attributes: DataFrame) -> DataFrame:
        return written(_verified(members, asked, texts, attributes, self.k, self.percent, self.lower), "links")

    def first_links(self) -> DataFrame:
        """Links of each set with the first set of each of its tokens, if their prefixes have enough in common."""
        pairs = self.shared.where("id <> head").select(F.col("head").alias("grp"), "id").distinct()
        one = self.classes.select("id", "n", F.col("prefix").alias("own"))
        two = self.classes.select(F.col("id").alias("grp"), F.col("n").alias("m"), F.col("prefix").alias("other"))
        asked = pairs.join(one, "id").join(two, "grp").where(_fits("n", "m", self.percent) & _enough(F.size(F.array_intersect("own", "other")), "n", "m", "m", self.percent))
        asked = written(asked.select("grp", "id"), "pairs")
        heads = asked.select("grp").distinct().withColumn("id", F.col("grp"))
        texts = self.texts(asked.select("id").union(heads.select("id")).distinct())
        return self.verified(heads, asked, texts, self.sizes.withColumn("component", F.col("id")))

    def group_links(self, named: DataFrame) -> DataFrame:
        """Links by the token-group matrix from (t, id, component): for each set and component below its own one set that it links with, if there is one."""
        percent = self.percent
        mixed = named.groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("t")
        open_ = written(named.join(mixed, "t"), "open")
        # groups of similar sets: of the same most frequent open token and like size, some GROUP each, dealt by hash so that none is gathered
        # whole. Only pairs of token and size that need several pages are looked up, a small written table that the planner may broadcast
        often = open_.groupBy("t").agg(F.count("*").alias("df"))
        loose = open_.join(often, "t").groupBy("id", "component").agg(F.max(F.struct("df", "t")).alias("top")).join(self.sizes, "id")
        loose = written(loose.select("id", "component", "n", F.col("top.t").alias("lead"), F.floor(F.log("n") / math.log(100 / percent)).alias("scale")), "loose")
        many = written(loose.groupBy("lead", "scale").agg(F.count("*").alias("sets")).where(F.col("sets") > GROUP), "many")
        pages = F.coalesce(F.ceil(F.col("sets") / GROUP), F.lit(1))
        members = loose.join(many, ["lead", "scale"], "left").select("id", "component", "n", F.xxhash64("lead", "scale", F.pmod(F.xxhash64("id"), pages)).alias("grp"))
        members = written(members, "groups")
        dropped(loose, many)
        span = members.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lowest"))
        # the matrix: a row for each token and group that has it; its rows with a query's tokens count what the query shares with the union
        matrix = open_.select("t", "id").join(members.select("id", "grp"), "id").select("t", "grp").distinct().join(span, "grp")
        query = open_.select("t", "id", F.col("component").alias("own")).join(self.sizes, "id")
        met = query.join(matrix, "t").where((F.col("own") > F.col("lowest")) & (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least")))
        met = met.groupBy("grp", "id", "n", "least", "most").agg(F.count("*").alias("common")).where(_enough(F.col("common"), "n", "least", "most", percent))
        asked = written(met.select("grp", "id"), "pairs")
        used = members.join(asked.select("grp").distinct(), "grp").select("grp", "id")
        texts = self.texts(asked.select("id").union(used.select("id")).distinct())
        out = self.verified(used, asked, texts, members.select("id", "n", "component"))
        dropped(open_, members, asked, texts)
        return out


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(key, __one, __two, n_shingles, rep) of each row: two hashes of its text, and the row that stands for its component, as
    (none, key, __one, __two): the one with the smallest key, a null one last. ``rep`` is null where the set is empty."""
    own = _Classes(docs, key, text, k, percent, lower)
    links = own.first_links()
    parts = written(components(links), "parts")
    # what is left: tokens whose sets are in several components
    named = own.shared.select("t", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    final = written(components(links.unionByName(own.group_links(named))), "parts")
    dropped(links, parts, own.shared)
    reps = own.classes.select("set_id", "id", "rep").join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = reps.groupBy("component").agg(F.min("rep").alias("first"))
    named = reps.join(least, "component").select("set_id", F.col("first").alias("rep"))
    out = own.known.select(key, "__one", "__two", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return out.join(named, "set_id", "left").drop("set_id")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(key, n_shingles, component_id) of each row: component_id is the smallest key that links lead to, its own included.

    Sets a and b link when 100 * |a and b| >= percent * |a or b|. A null or empty text, or one without words, has the empty set and
    links with nothing. Rows of equal sets link, repeated keys and null keys too; a null key is never a component_id unless all keys of it are null. An
    empty table gives an empty table, other columns are left behind. Whole texts count, whatever their length.
    """
    out = grouped(docs, key, text, k, percent, lower)
    return out.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep.key")).otherwise(F.col(key)).alias("component_id"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """The join itself: every link between different sets, and which rows have which set.

    The first table has (a, b), numbers of sets with a > b, each pair once; the second has (key, n_shingles, class) of each row, class
    null where the set is empty. Rows of one class link with each other without being listed. All that linked() says of odd rows holds.
    """
    own = _Classes(docs, key, text, k, percent, lower)
    pairs = own.group_links(own.shared.select("t", "id", F.col("id").alias("component"))).distinct()
    of = own.classes.select("set_id", F.col("id").alias("class"))
    return pairs, own.known.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(of, "set_id", "left").drop("set_id")


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(key, n_shingles, class, n_links) of each row: with how many other rows it links, those of its own class included."""
    pairs, members = links(docs, key, text, k, percent, lower)
    held = written(members, "members")
    sizes = held.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("rows"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("class", "other")
    others = both.join(sizes.select(F.col("class").alias("other"), "rows"), "other").groupBy("class").agg(F.sum("rows").alias("others"))
    counted = sizes.join(others, "class", "left").select("class", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return held.join(counted, "class", "left").select(key, "n_shingles", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op8_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document, a row for a row; nulls, empty and repeated rows as linked() says."""
    return linked(table(spark, sf_dir, "documents"), k=4, percent=85)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents that links of five-word shingles at 0.8 join, the one with the smallest id stays, a null id last.

    Rows equal in id and text are one document, of which one row stays; rows that repeat an id with another text are judged by their own.
    Documents without words link with nothing and stay, all of them. An empty table stays empty; the columns are those of ``docs``.
    """
    out = grouped(docs, k=5, percent=80)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("key"), "__one", "__two")
    kept = out.where((F.col("n_shingles") > 0) & own.eqNullSafe(F.col("rep"))).select(F.col("doc_id").alias("__key"), F.col("__one").alias("__a"), F.col("__two").alias("__b")).distinct()
    same = (F.col("__one") == F.col("__a")) & (F.col("__two") == F.col("__b")) & F.col("__id").eqNullSafe(F.col("__key"))
    # the row goes along as a whole, so none of its names can meet one of these
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), *_digest("text")).join(written(kept, "kept"), same)
    bare = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text")).where(~F.coalesce(F.regexp_like("__text", F.lit(WORD)), F.lit(False)))
    return rows.dropDuplicates(["__one", "__two", "__id"]).select("__row.*").unionByName(bare.select("__row.*"))


SQL = {
    "op8_group_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS t FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, least(doc_id, (SELECT min(b) FROM r WHERE r.a = n.doc_id)) AS component_id FROM n
""",
}
