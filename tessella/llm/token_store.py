"""Token ids in binary files: one zstandard frame a document, a dictionary shared by all, and an offset index.

The store is a folder of two tables. ``dictionary`` has one row: bytes, sha256, id width. ``blocks`` has some MB of
frames a row with, in document order, the arrays of keys, token counts and frame lengths (offsets are their
running sums), the smallest and largest key, the number of tokens before the block in its part, and the hash of the dictionary. The index
of a document can be read without its frames, and read_document() reads one without decompressing its neighbours.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, partitions, scratch_dir, small_batches, table
from .shingles import groups

#: The dictionary is trained on so many documents at most, those whose keys hash lowest, and of a longer one on so many
#: characters in a row from a place that a hash names.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 16384, 65536
BLOCK_BYTES, LEVEL, END_ID = 1 << 20, 3, 1
#: Words that a worker remembers, some 200 bytes each, and bytes of texts that it cuts into words at a time.
REMEMBERED, GROUP_BYTES = 600_000, 1 << 20
#: Marks that the pre-tokenizer never joins to a letter or digit before them. The apostrophe isn't one.
MARKS = b".,;:!?%*#&$|)]}\"-_/+="
BLOCKS = "part int, block int, before long, first_key long, last_key long, keys array<long>, counts array<long>, lengths array<long>, width int, dict_sha256 string, frames binary"

_combining = re.compile("[\u0300-\u036f]")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(shown)))}


class WordCodec:
    """ids of whole texts through the tokenizers library, which sees each distinct word once.

    The tokenizer's pre-tokenizer drops white space and merges nothing across it, and neither NFC nor lower
    case look past it, so the ids of a text are those of its words. The words are cut at ASCII white space
    alone; what other white space stands in a word is left to the library. Which characters may be handled here, as letters that are one
    letter after normalisation and end a pre-token before a mark, is asked of the library, character by character, when the codec is made.
    The whole of one text a call, the one that hashes lowest, is compared with the library; a difference is an error.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.plain = str.maketrans(_byte_letters())
        self.letters = frozenset(c for c in map(chr, range(0x21, 0x250)) if c.isalpha() and self._stands_alone(c))

    def _stands_alone(self, c: str) -> bool:
        """Behind a letter and before a mark, c is read as the letter that lower() gives, and the mark is a token of its own."""
        shown = c.lower().encode().decode("latin-1").translate(self.plain)
        return len(c.lower()) == 1 and [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(f"a{c},"))] == [f"a{shown}", ","]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Remember the ids of new words. Marks behind such a letter or an ASCII digit are a token of their own, so that word is put together from two."""
        whole, cut, letters = [], [], self.letters
        for w in new:
            stem = w.rstrip(MARKS)
            if stem and len(stem) < len(w) and (stem[-1:].isalnum() or stem[-1] >= 0x80 and stem.decode()[-1] in letters):
                cut.append((w, stem, w[len(stem) :]))
            else:
                whole.append(w)
        whole += {x for _, *both in cut for x in both}.difference(self.known, whole)
        merge, rest = self.library.model.tokenize, []
        for w in whole:
            t = w.decode()
            if t.isalpha() and (w.isascii() or letters.issuperset(t)):  # one pre-token, straight to the library's model
                self.known[w] = array(self.code, [x.id for x in merge(t.lower().encode().decode("latin-1").translate(self.plain))]).tobytes()
            else:
                rest.append(w)
        self.known.update(zip(rest, self._library([w.decode() for w in rest]), strict=True))
        for w, stem, tail in cut:
            self.known[w] = self.known[stem] + self.known[tail]

    def words(self, text: str) -> list[bytes]:
        """The words of a text; A-Z in lower case, as the tokenizer makes them, unless a mark could combine with one or a special token stand there."""
        data = text.encode()
        if text.isascii() or not _combining.search(text):
            return data.split() if b"<|" in data else data.lower().split()
        return data.split()

    def encode_batch(self, texts: list[str], end: int = END_ID) -> list[bytes]:
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        known, last = self.known.__getitem__, array(self.code, [end]).tobytes()
        out = [b"".join([*map(known, ws), last]) for ws in split]
        probe = min((k for k, t in enumerate(texts) if t), key=lambda k: zlib.crc32(texts[k].encode()), default=None)
        if probe is not None and self._library([texts[probe]])[0] + last != out[probe]:
            raise ValueError(f"the library has other ids for {texts[probe][:200]!r}")
        return out


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    claim("words", _codecs.clear)
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def train_dictionary(docs: DataFrame, path: str, key: str, text: str) -> bytes:
    """A dictionary from a bounded sample; empty if the sample is too small to train one."""
    import zstandard

    keys = docs.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit("sample"), "k"), "k").limit(SAMPLE_DOCS)
    whole = F.coalesce(F.col(text), F.lit(""))
    begin = F.pmod(F.xxhash64(F.lit("place"), F.col(key)), F.greatest(F.length(whole) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    sample = docs.select(F.col(key).alias("k"), F.substring(whole, begin + 1, F.lit(SAMPLE_CHARS)).alias("t"))
    sample = sample.join(F.broadcast(keys), "k").orderBy("k", "t").limit(SAMPLE_DOCS)  # so many small rows at most
    ids = codec(path).encode_batch([r.t for r in sample.collect()])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def _frames(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True), zstandard.ZstdDecompressor(dict_data=shared)


def write_store(docs: DataFrame, to: str, path: str, key: str = "doc_id", text: str = "text", rows: int = 256) -> str:
    """Encode ``docs`` and write them in ascending order of ``key`` as a store in the folder ``to``; returns ``to``.

    Texts are dealt out by ranges of ``key`` and a hash of the text, the only shuffle, and sorted within; so a key that many rows have is
    spread over ranges, its rows in the order of the hash. A null text is an empty one and has the end id alone. A null key stays null
    and comes first. A very long text is encoded whole and is one frame, in a block of its own size. An empty table gives a store without blocks. Other columns are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dictionary = train_dictionary(docs, path, key, text)
    digest = hashlib.sha256(dictionary).hexdigest()
    width = codec(path).width
    spark.createDataFrame([(bytearray(dictionary), digest, width)], "bytes binary, sha256 string, width int").coalesce(1).write.parquet(f"{to}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("t")
    ordered = ordered.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        own, (pack, _), part = codec(path), _frames(shared.value), TaskContext.get().partitionId()
        keys, counts, frames, held, block, before = [], [], [], 0, 0, 0

        def row():
            there = [k for k in keys if k is not None]
            arrays = [[part], [block], [before], [min(there, default=None)], [max(there, default=None)], [keys], [counts], [[len(f) for f in frames]], [width], [digest], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], names=names)

        for big in batches:
            for at in range(0, big.num_rows, rows):
                some = big.slice(at, rows)
                texts = some.column(1).to_pylist()
                encoded = (ids for a, b in groups(texts, GROUP_BYTES) for ids in own.encode_batch(texts[a:b]))
                for k, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    frame = pack.compress(ids)
                    keys.append(k), counts.append(len(ids) // width), frames.append(frame)
                    held += len(frame)
                    if held >= BLOCK_BYTES:
                        yield row()
                        before += sum(counts)
                        keys, counts, frames, held, block = [], [], [], 0, block + 1
        if keys:
            yield row()

    longs = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), longs, longs, longs, pa.int32(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    return to


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """(key, start, n_tokens, ids binary little-endian unsigned 32-bit) of each document, start counted over the whole store.

    Blocks know how many tokens stand before them in their part; the count of each part, one number a part, passes through the driver.
    """
    shared, blocks, starts = _opened(spark, store)

    def run(batches):
        for k, start, count, ids in _documents(batches, shared.value, starts.value):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], names=["key", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """read_store() with the crc32 of the ids in place of them."""
    shared, blocks, starts = _opened(spark, store)

    def run(batches):
        for k, start, count, ids in _documents(batches, shared.value, starts.value):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def _opened(spark: SparkSession, store: str):
    row = spark.read.parquet(f"{store}/dictionary").first()
    if hashlib.sha256(bytes(row["bytes"])).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary doesn't have its hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{store}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()  # one number a part
    starts, at = {}, 0
    for part, n in sorted(map(tuple, parts)):
        starts[part], at = at, at + n
    context = spark.sparkContext
    return context.broadcast((bytes(row["bytes"]), row["sha256"])), blocks, context.broadcast(starts)


def read_document(spark: SparkSession, store: str, key: int | None) -> list[np.ndarray]:
    """The ids of each document of this key, in the store's order; none if it has none.

    Blocks are chosen by their smallest and largest key; of these only the index and the frames of the key leave the files.
    """
    shared = spark.read.parquet(f"{store}/dictionary").first()
    blocks = spark.read.schema(BLOCKS).parquet(f"{store}/blocks")
    some = blocks.where(F.exists("keys", lambda k: k.isNull())) if key is None else blocks.where((F.col("first_key") <= key) & (F.col("last_key") >= key))
    one = some.select("part", "block", "width", "dict_sha256", "frames", F.posexplode(F.arrays_zip("keys", "lengths")).alias("at", "doc"), "lengths").where(F.col("doc.keys").eqNullSafe(F.lit(key)))
    begin = F.aggregate(F.slice("lengths", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    _, unpack = _frames(bytes(shared["bytes"]))
    out = []
    for r in one.select("part", "block", "at", "width", "dict_sha256", F.substring("frames", (begin + 1).cast("int"), F.col("doc.lengths").cast("int")).alias("frame")).orderBy("part", "block", "at").collect():
        if r["dict_sha256"] != shared["sha256"]:
            raise ValueError("a block was written with another dictionary")
        out.append(np.frombuffer(unpack.decompress(bytes(r["frame"])), f"<u{r['width']}"))
    return out


def _documents(batches, dictionary: tuple[bytes, str], starts: dict):
    _, unpack = _frames(dictionary[0])
    for batch in batches:
        for r in batch.to_pylist():
            if r["dict_sha256"] != dictionary[1]:
                raise ValueError("a block was written with another dictionary")
            ends, data = list(accumulate(r["lengths"])), r["frames"]
            ids = [np.frombuffer(unpack.decompress(data[e - n : e]), f"<u{r['width']}") for e, n in zip(ends, r["lengths"], strict=True)]
            begin = starts[r["part"]] + r["before"]
            yield r["keys"], [begin + e - n for e, n in zip(accumulate(r["counts"]), r["counts"], strict=True)], r["counts"], ids


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the files, a row for a row; nulls, empty and repeated rows as write_store() says."""
    store = write_store(table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}", default_tokenizer())
    return read_digests(spark, store).withColumnRenamed("key", "doc_id")
