"""SpotSigs: chains of content words that follow common words are a text's signatures; their set is its fingerprint.

A fingerprint depends on the text alone. Fingerprints are compared by Jaccard, pruned by the sizes of the sets and by what a rest can still add; the
join over a table deals sets out by size, so that a set meets only those of its own and the next size class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, table, written
from .shingles import U, Words, _mix, groups

#: Content words of a chain.
CHAIN = 3
#: A word whose hash is divisible by this is an anchor in any language.
SPARSE = 16

#: Products with a threshold are rounded; bounds leave so much room, the likeness itself decides.
TINY = 1e-9

#: Common words that are anchors: the commonest of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his if in into is it its more no not of on one or our she so than that the their them there these they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind um und von vor war was wenn wie wird zu zum zur über "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous été être "
    "al como con del el ella en entre era es esta este ha hay la las lo los me más muy no nos o para pero por que se sin sobre su sus también un una y ya"
)


def _anchor_hashes(anchors: str) -> np.ndarray:
    return np.unique(Words([w.encode() for w in anchors.split()]).hashes())


class Signer:
    """Signatures of many texts at once. Words are split at ASCII white space; of each only letters, digits and what isn't ASCII count, A-Z lower-cased."""

    def __init__(self, anchors: str = ANCHORS, chain: int = CHAIN):
        self.anchors, self.chain = _anchor_hashes(anchors), chain
        self.outside = np.ones(256, bool)
        self.outside[48:58] = self.outside[65:91] = self.outside[97:123] = self.outside[128:] = False

    def sign(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct signatures of each text, as unsigned 32-bit integers.

        An anchor is a common word, a word with a hash divisible by SPARSE, or the begin of a text; its signature goes over the next content words, those
        that aren't common, fewer at the end of the text. A text without any word has one signature, of its bytes.
        """
        words = Words(texts, lower=True, outside=self.outside)
        h, owner = words.hashes(), np.repeat(np.arange(len(texts)), words.counts)
        common = np.isin(h, self.anchors)
        places = np.flatnonzero(~common)
        of_word = h[places]
        # the begin of each text stands for the anchor 0, before its first word
        spots = np.flatnonzero(common | (h % U(SPARSE) == U(0)))
        begins = words.first[:-1][words.counts > 0]
        spot, anchor = np.concatenate((spots, begins - 1)), np.concatenate((h[spots], np.zeros(len(begins), U)))
        text = np.concatenate((owner[spots], np.flatnonzero(words.counts > 0)))
        ends = np.searchsorted(places, words.first[1:])  # content words of a text end before this one
        next_ = np.searchsorted(places, spot, "right")
        value, some = _mix(anchor + U(0x51ED270B9F652295)), np.zeros(len(spot), bool)
        for _ in range(self.chain):
            there = next_ < ends[text]
            value = np.where(there, _mix(value * U(0x9E3779B97F4A7C15) + of_word[np.minimum(next_, max(len(of_word) - 1, 0))]), value) if len(of_word) else value
            some |= there
            next_ = next_ + 1
        some |= anchor == U(0)  # a text of common words alone keeps the signature of its begin
        value, text = (value >> U(32))[some], text[some]
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[fresh].astype(np.uint32), text[fresh]
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        out = [value[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(words.counts == 0):
            out[i] = np.frombuffer(hashlib.blake2b(texts[i], digest_size=4).digest(), np.uint32)
        return out

    def fingerprints(self, texts: list[bytes], most: int = 1 << 21) -> list[np.ndarray]:
        return [s for a, b in groups(texts, most) for s in self.sign(texts[a:b])]


def written_out(signatures: np.ndarray) -> str:
    """A fingerprint: eight lowercase hex digits a signature, ascending."""
    return signatures.astype(">u4").tobytes().hex()


def read_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sets of sorted signatures; 0 as soon as it can't reach ``least``. Two empty sets are alike.

    Sets whose sizes are too far apart aren't looked at. The rest is compared piece by piece, and given up when even all that is left couldn't suffice.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if len(a) < least * len(b) - TINY or not len(a) or a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    needed = least * (len(a) + len(b)) / (1 + least) - TINY
    shared, step = 0, len(a) if least <= 0 else 256
    for at in range(0, len(a), step):
        part = a[at : at + step]
        where = np.searchsorted(b, part)
        shared += int((b[np.minimum(where, len(b) - 1)] == part).sum())
        if shared + len(a) - at - len(part) < needed:
            return 0.0
    return shared / (len(a) + len(b) - shared)


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: str = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(key, size, signatures) of each row of ``docs``, signatures an ascending array of 32-bit numbers; no shuffle.

    Null and empty texts have the one signature of empty bytes. A very long text is taken alone, whole. Repeated rows give
    equal results, a null key stays null, an empty table gives an empty table, other columns are left behind.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        own = Signer(anchors, chain)
        for batch in batches:
            found = own.fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()])
            sizes = np.array([len(s) for s in found], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists], names=["key", "size", "signatures"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, size int, signatures array<bigint>")


def size_bounds(most: int, least: float) -> list[int]:
    """Sizes at which a new class begins, so that sets alike by ``least`` lie in the same class or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] / least) + 1))
    return out


def near_pairs(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", anchors: str = ANCHORS, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (key, class) of each row, equal fingerprints being one class, and (a, b, likeness) of classes alike by ``least``.

    Classes are dealt out by set size: one meets those of its own size class and of the next. There two meet if they share one of their
    rarest signatures, so many that sets without a common one of these can't be alike; a pair is compared once, by likeness(). The smallest
    and the largest size that a signature's partner may have go into the join. Copies aren't expanded into pairs. Nulls, empty and long texts, repeated rows and empty tables as
    fingerprinted() says; members has a row for a row.
    """
    rows = written(fingerprinted(docs, key, text, anchors, chain).withColumn("class", F.sha2(F.array_join("signatures", ","), 256)), "signatures")
    sets = written(rows.groupBy("class").agg(F.first("size").alias("size"), F.first("signatures").alias("signatures")), "signature-sets")
    each = sets.select("class", "size", F.explode("signatures").alias("s"))
    frequent = each.groupBy("s").agg(F.count("*").alias("n"))
    most = sets.agg(F.max("size")).first()[0] or 1
    bounds = F.array(*[F.lit(b) for b in size_bounds(most, least)])
    # rarest first; two sets alike by ``least`` share one of the first size - ceil(least * size) + 1
    ranked = each.join(frequent, "s").groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("o"))
    rare = F.slice("o", 1, (F.col("size") - F.ceil(F.col("size") * F.lit(least) - TINY) + 1).cast("int"))
    keyed = written(ranked.select("class", "size", F.size(F.filter(bounds, lambda b: b <= F.col("size"))).alias("part"), F.explode(F.transform(rare, lambda x: x["s"])).alias("s")), "rare-signatures")
    a, b = [keyed.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "size", "part")]) for x in "ab"]
    dealt = b.select("*", F.explode(F.array("part_b", F.col("part_b") - 1)).alias("part"))  # its own class and the next smaller one look for it
    met = a.withColumnRenamed("part_a", "part").join(dealt, ["s", "part"]).where((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("class_a") < F.col("class_b"))))
    met = met.where(F.col("size_a") >= F.col("size_b") * F.lit(least) - TINY).select("class_a", "class_b").distinct()
    full = met.join(sets.select(F.col("class").alias("class_a"), F.col("signatures").alias("x")), "class_a").join(sets.select(F.col("class").alias("class_b"), F.col("signatures").alias("y")), "class_b")

    def compare(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            values = [likeness(p.values.to_numpy(), q.values.to_numpy(), least) for p, q in zip(x, y, strict=True)]
            kept = [i for i, v in enumerate(values) if v >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())), pa.array([values[i] for i in kept], pa.float64())], names=["a", "b", "likeness"])

    return rows.select(F.col("key").alias(key), "class"), full.select("class_a", "class_b", "x", "y").mapInArrow(compare, "a string, b string, likeness double")


def _dealt(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``docs`` as (part, head, k, h, t), in parts that follow each other by (key, hash of the text); each part also has, as its head rows, the first
    row of the part behind it, the last part that of the first. Keys at which parts begin come from a bounded sample, one key a part reaches the driver."""
    spark = docs.sparkSession
    n = partitions(spark)
    plain = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    least = F.lit(-(1 << 63)).cast("long")
    place = F.struct(F.col("k").isNotNull().alias("some"), F.coalesce("k", least).alias("k"), F.col("h").alias("h"))
    rows = plain.count()
    sample = sorted(tuple(r[0]) for r in plain.select(place.alias("p")).sample(min(1.0, 50.0 * n / max(rows, 1)), 1).limit(200 * n).collect())
    begins = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    stop = lambda p: F.struct(F.lit(p[0]).alias("some"), F.lit(p[1]).cast("long").alias("k"), F.lit(p[2]).cast("long").alias("h"))
    # of so many begins first those a stride apart are looked at, then those of one stride
    stride = max(1, int(len(begins) ** 0.5))
    coarse = [begins[i] for i in range(0, len(begins), stride)]
    if begins:
        at = F.size(F.filter(F.array(*map(stop, coarse)), lambda b: b <= place))
        fine = F.slice(F.array(*map(stop, begins)), F.greatest((at - 1) * stride + 1, F.lit(1)), F.lit(stride))
        part = F.when(at == 0, F.lit(0)).otherwise((at - 1) * stride + F.size(F.filter(fine, lambda b: b <= place))).cast("int")
    else:
        part = F.lit(0)
    parts = plain.withColumn("part", part)
    heads = {r[0]: tuple(r[1]) for r in parts.groupBy("part").agg(F.min(place)).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    if not order:
        return parts.select("part", F.lit(True).alias("head"), "k", "h", "t"), 1
    firsts = F.array(*[stop(heads[p]) if p in heads else F.lit(None).cast("struct<some:boolean,k:bigint,h:bigint>") for p in range(order[-1] + 1)])
    befores = F.array(*[F.lit(before.get(p, 0)) for p in range(order[-1] + 1)])
    copies = F.when(F.element_at(firsts, F.col("part") + 1) == place, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("head")), F.struct(F.element_at(befores, F.col("part") + 1).alias("part"), F.lit(True).alias("head"))))
    copies = F.coalesce(copies, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("head"))))
    return parts.select(F.explode(copies).alias("x"), "k", "h", "t").select("x.part", "x.head", "k", "h", "t"), order[-1] + 1


def edited(own: str, following: str) -> str:
    """``own`` with its last floor(n/2) code points replaced by as many of the first of ``following``, or all of these."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def compared_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: str = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs`` in ascending order of the key.

    Next is the row behind it by key, after the last the first; null keys come first, rows of one key follow each other by a hash of their texts, a single row
    is next to itself. A null text is an empty one. The only shuffle deals whole texts out by ranges of (key, hash), where each row meets
    the next one; only the first row of each range goes to two. A range is read as a stream, two batches at a time. A very long text is taken alone, whole.
    Repeated rows follow each other, an empty table gives an empty table, other columns are left behind.
    """
    small_batches(docs.sparkSession)
    rows, n = _dealt(docs, key, text)
    ordered = rows.repartition(max(n, partitions(docs.sparkSession)), "part").sortWithinPartitions("part", "head", F.col("k").asc_nulls_first(), "h", "t")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        own = Signer(anchors, chain)
        for some in _followed(batches):
            texts = [t for _, t, _ in some]
            # of the next row's fingerprint only those aren't made anyway that follow the last text or come from another range
            nexts = [f for _, _, f in some]
            changed = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
            here = own.fingerprints([t.encode() for t in texts])
            there = own.fingerprints([t.encode() for t in changed])
            apart = [i for i in range(len(some)) if i + 1 == len(some) or nexts[i] is not texts[i + 1]]
            after = here[1:] + [None]
            for i, s in zip(apart, own.fingerprints([nexts[i].encode() for i in apart]), strict=True):
                after[i] = s
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in some], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                    pa.array([written_out(s) for s in here]), pa.array([written_out(s) for s in there]), pa.array([likeness(a, b) for a, b in zip(here, there, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(here, after, strict=True)], pa.float64()),
                ],
                names=names,
            )

    return ordered.mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _followed(batches, most: int = 1 << 21) -> Iterator[list[tuple]]:
    """Lists of (key, text, next text), in order, of some ``most`` characters together."""
    held: list[tuple] = []
    out: list[tuple] = []
    chars = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "head", "k", "t")), strict=True):
            # a range's own rows come first, then the head of the range behind it, of which one copy is enough
            if held and held[0][0] == row[0] and not held[0][1]:
                out.append((held[0][2], held[0][3], row[3]))
                chars += len(held[0][3])
            held = [row]
            if chars >= most:
                yield out
                out, chars = [], 0
    if out:
        yield out


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document; nulls, ties, repeated rows and empty tables as compared_with_next() says."""
    return compared_with_next(table(spark, sf_dir, "documents"))
