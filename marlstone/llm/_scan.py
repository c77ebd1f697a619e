"""Words, lines and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A slice of a batch holds about `SLICE` bytes (or one text, if that is longer), so memory follows the slice and not
the batch. Hashes have 64 bits and depend on the bytes only, so every process gets the same ones. A range of up to
`SHORT` bytes is hashed eight bytes at a time, each step a bijection of the hash and of the bytes; a longer one by XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 18
SHORT = 32
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GRAM = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_LENGTH, _STEP = _U(0x632BE59BD9B4E019), _U(0x9E3779B97F4A7C15)


@dataclass
class Texts:
    """`data`: the bytes of some texts on end; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self):
        self.n = len(self.offsets) - 1
        self.space = _SPACE[self.data]
        self._padded: dict[bool, bytes] = {}

    def _edges(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes not in `out`, none across two texts."""
        n = len(out)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:], last[:-1] = out[:-1], out[1:]
        cuts = self.offsets[1:-1]
        first[cuts[cuts < n]] = True
        last[cuts[cuts > 0] - 1] = True
        return np.flatnonzero(first & ~out), np.flatnonzero(last & ~out) + 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words, in order."""
        return self._edges(self.space)

    def folded(self) -> np.ndarray:
        """The bytes, A-Z as a-z."""
        return _FOLDED[self.data]

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
        """Of the byte ranges; fold: A-Z count as a-z."""
        if fold not in self._padded:
            self._padded[fold] = (_FOLDED[self.data] if fold else self.data).tobytes() + bytes(8)
        padded = self._padded[fold]
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        n = ends - starts
        h = mix(n.astype(_U) * _LENGTH + _STEP)
        left = np.flatnonzero((n > 0) & (n <= SHORT))
        for at in range(0, SHORT, 8):
            left = left[n[left] > at]
            if not len(left):
                break
            h[left] = mix(h[left] * _STEP ^ eight[starts[left] + at] & _MASK[np.minimum(n[left] - at, 8)])
        long = np.flatnonzero(n > SHORT)
        view = memoryview(padded)
        h[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        return h

    def words(self, fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """The text each word is in, and the word's hash, in order."""
        starts, ends = self._edges(self.space)
        return self.owner(starts), self.hashes(starts, ends, fold)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The text each line with a word is in, and the line's hash."""
        starts, ends = self._edges(self.data == 10)
        filled = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~self.space, out=filled[1:])
        keep = filled[ends] > filled[starts]
        starts, ends = starts[keep], ends[keep]
        return self.owner(starts), self.hashes(starts, ends, False)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text that `mask` holds."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def grams(owner: np.ndarray, words: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all windows of k words, and the windows' hashes."""
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
    h = np.zeros(len(at), _U)
    for i in range(k):
        h += words[at + i] * _GRAM[i]
        h = mix(h) if i == k - 1 else h ^ (h >> _U(29))
    return at, h


def slices(texts: pa.Array) -> Iterator[tuple[int, Texts]]:
    """Index of the first text, and the texts, of each slice of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(max(at + 1, np.searchsorted(offsets, offsets[at] + SLICE, "right") - 1))
        yield at, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
