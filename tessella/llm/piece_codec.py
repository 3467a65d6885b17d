"""SentencePiece encoding and decoding for merge-type vocabularies.

A score-ordered agenda of adjacent symbol pairs merges each segment; what it yields is held against the
sentencepiece library in every Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import claim, small_batches, table
from .shingles import groups

SPACE = "▁"
#: Segments that a worker remembers; then it starts anew. Some 200 bytes each.
REMEMBERED = 700_000
#: Characters of texts that it cuts into segments at a time.
GROUP_CHARS = 1 << 20


class PieceCodec:
    """Encoder and decoder of one model file: BPE with byte fallback, dummy prefix, no normalisation."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        kinds = pb2.ModelProto.SentencePiece
        self.ids, self.costs, self.bytes, self.pieces = {}, {}, {}, []
        for i, p in enumerate(proto.pieces):
            self.pieces.append(("" if p.type == kinds.CONTROL else p.piece, -1))
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.pieces[-1] = ("", int(p.piece[1:-1], 16))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece], self.costs[p.piece] = i, -p.score
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        spec = proto.normalizer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if not plain or proto.trainer_spec.model_type != pb2.TrainerSpec.BPE or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only BPE models with a dummy prefix and without normalisation or user symbols are supported")
        # no merge crosses a place where no piece has these two characters side by side
        many = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in many):
            raise ValueError("a piece has a space after another character")
        single = "\n" if not any("\n" in p for p in many) else ""
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{single}]+|{SPACE}+" + f"|{single}" * bool(single)).findall
        self.lead = self.library.encode("\n") if single else None
        self.known: dict[str, bytes] = {}
        #: Segments that don't decode to themselves, and what they decode to.
        self.odd: dict[str, str] = {}

    def merge(self, segment: str) -> list[str]:
        """The pieces of a segment: of all adjacent pairs that form a piece, the best score merges first, the leftmost of equals."""
        symbols, n, cost = list(segment), len(segment), self.costs.get
        agenda = [(c, i, i + 1, pair) for i, pair in enumerate(map(add, segment, segment[1:])) if (c := cost(pair)) is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, pair = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or after[i] != j or len(left) + len(right) != len(pair):
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost(wider := pair + symbols[k])) is not None:
                    heappush(agenda, (c, i, k, wider))
            if (k := before[i]) >= 0 and (c := cost(wider := symbols[k] + pair)) is not None:
                heappush(agenda, (c, k, i, wider))
        return [s for s in symbols if s]

    def segment_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(segment):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def split(self, text: str) -> list[str]:
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, runs of byte pieces read as UTF-8, spaces restored, the dummy prefix dropped."""
        return self._strip("".join(self._raw(ids)))

    @staticmethod
    def _strip(raw: str) -> str:
        return raw[1:].replace(SPACE, " ") if raw[:1] == SPACE else raw.replace(SPACE, " ")

    def _raw(self, ids: list[int]) -> Iterator[str]:
        run = bytearray()
        for i in ids:
            piece, byte = self.pieces[i]
            if byte >= 0:
                run.append(byte)
                continue
            if run:
                yield run.decode("utf-8", "replace")
                run.clear()
            yield piece
        if run:
            yield run.decode("utf-8", "replace")

    def learn(self, new: list[str]) -> None:
        """Remember the ids of new segments, each compared with the library's; a difference is an error."""
        own = [self.segment_ids(s) for s in new]
        if self.lead is not None:  # behind a line break, a segment stands as it does within a text
            n = len(self.lead)
            for k, theirs in enumerate(self.library.encode(["\n" + s for s in new], num_threads=1)):
                if theirs[:n] != self.lead or theirs[n:] != own[k]:
                    raise ValueError(f"the library has other ids for {new[k]!r}")
        for s, ids in zip(new, own, strict=True):
            self.known[s] = array("I", ids).tobytes()
            if (shown := "".join(self._raw(ids))) != s:
                self.odd[s] = shown

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids with begin and end, little-endian unsigned 32-bit, and its decoded text.

        Every segment that is new here is compared with the library. No piece crosses the end of a segment, so the ids of a text are those
        of its segments; that is held against the library too, on the whole of one text a call, the one that hashes lowest. A
        difference is an error.
        """
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.odd.clear()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        known, odd = self.known.__getitem__, self.odd
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        ids = [b"".join([begin, *map(known, ss), end]) for ss in split]
        # what decodes to itself, segment by segment, needs no second look
        out = [(i, self._strip("".join(ss) if not odd or odd.keys().isdisjoint(ss) else "".join([odd.get(s, s) for s in ss]))) for i, ss in zip(ids, split, strict=True)]
        probe = min((k for k, t in enumerate(texts) if t), key=lambda k: zlib.crc32(texts[k].encode()), default=None)
        if probe is not None:
            theirs = self.library.encode(texts[probe], add_bos=True, add_eos=True)
            if array("I", theirs).tobytes() != out[probe][0] or self.library.decode(theirs) != out[probe][1] or self.decode(theirs) != out[probe][1]:
                raise ValueError(f"the library has other ids or another text for {texts[probe][:200]!r}")
        return out


_codecs: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """One codec a worker and model; it keeps what it has learned from one task to the next."""
    claim("pieces", _codecs.clear)
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", rows: int = 256) -> DataFrame:
    """(key, ids binary, n_tokens, decoded_text) of each row, on a narrow map without a shuffle.

    ids are little-endian unsigned 32-bit with begin and end. A null text is an empty one, which has these two ids
    alone. Rows are independent: repeated ones give equal results, a null key stays null, an empty table gives
    an empty table, other columns are left behind. A very long text is one item of its batch.
    """
    small_batches(docs.sparkSession)
    schema = f"{key} {dict(docs.dtypes)[key]}, ids binary, n_tokens long, decoded_text string"

    def run(batches):
        own = codec(model)
        for big in batches:
            for at in range(0, big.num_rows, rows):
                batch = big.slice(at, rows)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                got = [x for a, b in groups(texts, GROUP_CHARS) for x in own.encode_batch(texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([i for i, _ in got], pa.binary()), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([t for _, t in got], pa.string())],
                    names=[key, "ids", "n_tokens", "decoded_text"],
                )

    return docs.select(key, text).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", rows: int = 256) -> DataFrame:
    """encoded() with ids and text replaced by their SHA-256 where they arise, so neither travels to the JVM."""
    small_batches(docs.sparkSession)

    def run(batches):
        own = codec(model)
        for big in batches:
            for at in range(0, big.num_rows, rows):
                batch = big.slice(at, rows)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                got = [x for a, b in groups(texts, GROUP_CHARS) for x in own.encode_batch(texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got]),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, a row for a row; nulls, empty and repeated rows as encoded() says."""
    return digests(table(spark, sf_dir, "documents"), default_model())


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: one row of ids for each row of the mix, repeats included.

    A null text is an empty one, with the two outer ids alone; null and repeated ids stay; other columns are left behind."""
    model = default_model()
    out = encoded(docs.select("doc_id", "text"), model)
    return out.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded_text, 256) AS decoded_sha256")
