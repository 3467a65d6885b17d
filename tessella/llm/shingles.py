"""Hashes of words and word sequences of many texts at once, in numpy: no Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: So many bytes of text are looked at together; a longer text is taken alone, whole.
GROUP_BYTES = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _seeded(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U((seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))


_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_bytes: dict[int, np.ndarray] = {}


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``most`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of several texts: where each begins and ends in their bytes, and how many each text has."""

    def __init__(self, texts: list[bytes], lower: bool = False, outside: np.ndarray = _space):
        """``outside`` tells of each byte whether it stands between words; a line feed has to."""
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)
        blank = outside[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: Word numbers at which each text begins; one more at the end.
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        if seed not in _bytes:
            _bytes[seed] = _seeded(seed, 256)
        length = self.ends - self.starts
        total = np.concatenate(([0], np.cumsum(length)))
        inside = np.arange(total[-1]) - np.repeat(total[:-1], length)
        places = inside + np.repeat(self.starts, length)
        power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15 | 1, U))
        value = _bytes[seed][self.data[places]] * power[inside]
        return _mix(np.add.reduceat(value, total[:-1]) + length.astype(U) * U(0xA0761D6478BD642F))

    def texts_of(self, k: int) -> np.ndarray:
        """For each window of k words of the whole sequence: the text that it lies in, or -1."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.where(owner[:n] == owner[k - 1 :], owner[:n], -1)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive words, put together from sequences of one, two, four ... words."""
    if len(h) < k:
        return np.zeros(0, U)
    out, done, part, size = None, 0, h, 1
    n = len(h) - k + 1
    rest = k
    while rest:
        if rest & 1:
            piece = part[done : done + n]
            out = piece if out is None else _mix(out * U(0xC2B2AE3D27D4EB4F) + piece + U(seed))
            done += size
        rest >>= 1
        if rest:
            part = _mix(part[: len(part) - size] * U(0x9FB21C651E98DF25) + part[size:] + U(seed))
            size *= 2
    return _mix(out + U(k))


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its smallest, the leftmost of equals."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place, size = x, np.arange(len(x)), 1

    def join(a, pa, b, pb):
        right = b < a
        return np.where(right, b, a), np.where(right, pb, pa)

    while size * 2 <= width:
        value, place = join(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    if size < width:
        shift = width - size
        value, place = join(value[:n], place[:n], value[shift : shift + n], place[shift : shift + n])
    return place[:n]
