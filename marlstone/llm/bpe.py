"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each distinct pre-token is merged by a segment tree whose leaves are the ranks of its adjacent pairs: the root names the
leftmost pair of lowest rank, a merge updates three leaves and their ancestors, and merging ends when the root is empty.
So a pre-token of n bytes takes O(n log n), however long it is. The trees of many short pre-tokens are kept in one numpy
array and merged side by side. Pre-tokens are met again and again; a bounded cache of recent ones keeps their ids.

The vocabulary file is a parameter: a `tokenizers` JSON file of kind BPE with an end-of-word suffix, NFC and lower-case
normalisers, byte-level characters and no decoder, as `public_tokenizers` has it.

Defined cases: a null or empty text has no ids and decodes to the empty string; special tokens written out in a text get
their ids, as the library does it; equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import arrow_column

CACHE, GROUP = 200_000, 1 << 20
_NONE = 1 << 62
# Fixed values of the tokenizer's split pattern; the white space is Unicode's.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
# The same, for texts whose characters all lie below U+0250: explicit classes are matched faster.
_LETTERS, _NUMERALS = ("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind) for kind in "LN")
_FAST = re.compile(rf"[{_LETTERS}]+|[{_NUMERALS}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_LETTERS}{_NUMERALS}]+")
_FAR = re.compile(r"[^\x00-ɏ]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0x100
    for b in range(256):
        table[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return table


def merge_all(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """`ids` after all merges, always the leftmost of lowest rank first. ranks: pair -> (rank, id of the merged)."""
    n = len(ids)
    if n < 2:
        return ids
    if n == 2:
        found = ranks.get((ids[0], ids[1]))
        return ids if found is None else [found[1]]
    size = 1 << (n - 2).bit_length()
    # A key is rank * size + place, so the smallest is the leftmost of the lowest rank.
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (found := ranks.get((ids[i], ids[i + 1]))) is not None:
            tree[size + i] = found[0] * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids = list(ids)
    while (root := tree[1]) != _NONE:
        i = root & (size - 1)
        j = after[i]
        ids[i] = ranks[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        h = before[i]
        for leaf, left, right in ((i, i, k), (j, -1, n), (h, h, i)):
            if not 0 <= leaf < n - 1:
                continue
            found = ranks.get((ids[left], ids[right])) if right < n else None
            key = _NONE if found is None else found[0] * size + leaf
            at = size + leaf
            if tree[at] == key:
                continue
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                small = a if a < b else b
                if tree[at] == small:
                    break
                tree[at] = small
                at >>= 1
    return [x for x in ids if x >= 0]


class Recent(dict):
    """A bounded cache: once full, its entries turn old, and go the next time unless they were asked for meanwhile."""

    def __init__(self, make: Callable[[list], list], most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def values_of(self, lists: list[list]) -> list[list]:
        """The value of each key in each list; those not known are made at once."""
        found = [list(map(self.get, keys)) for keys in lists]
        gaps = [[k for k, v in enumerate(values) if v is None] for values in found]
        if missing := {keys[k] for keys, places in zip(lists, gaps) for k in places}:
            self.fill(missing)
            for keys, values, places in zip(lists, found, gaps):
                for k in places:
                    values[k] = self[keys[k]]
        return found

    def fill(self, keys: set) -> None:
        """See that all `keys` are present."""
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most:
            self.old = dict(self)
            self.clear()
        old = self.old
        unknown = []
        for k in new:
            if k in old:
                self[k] = old[k]
            else:
                unknown.append(k)
        if unknown:
            self.update(zip(unknown, self.make(unknown)))


class Forest:
    """Segment trees of many pre-tokens, merged side by side in numpy arrays."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], n_ids: int):
        self.base = n_ids
        keys = np.array([a * n_ids + b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(_NONE))
        self.rank = np.append(np.array([r for r, _ in ranks.values()], np.int64)[order], np.int64(-1))
        self.merged = np.zeros(max((r for r, _ in ranks.values()), default=0) + 1, np.int64)
        for r, merged in ranks.values():
            self.merged[r] = merged

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """The keys of the pairs: rank * size + place, or none; an id below 0 is no symbol."""
        pair = left * self.base + right
        at = np.searchsorted(self.keys, pair)
        found = (self.keys[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at] * size + place, _NONE)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """`ids`: a row of symbols for each pre-token, padded with -1; the number of columns is a power of two and one. After all merges, -1 also stands where symbols went."""
        n, size = len(ids), ids.shape[1] - 1
        ids = np.concatenate([ids, np.full((n, 1), -1)], 1)  # a last column that is never a symbol
        width = size + 2
        tree = np.full((n, 2 * size), _NONE, np.int64)
        tree[:, size:] = self.leaves(ids[:, :size], ids[:, 1 : size + 1], np.arange(size), size)
        at = size
        while at > 1:
            at //= 2
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        after = np.tile(np.minimum(np.arange(1, width + 1), width - 1), (n, 1)).ravel()
        before = np.tile(np.arange(-1, width - 1), (n, 1)).ravel()
        ids, tree = ids.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree[rows * (2 * size) + 1]
            live = root != _NONE
            if not live.all():
                rows, root = rows[live], root[live]
            if not len(rows):
                return ids.reshape(n, width)
            sym, top = rows * width, rows * (2 * size)
            i = root & (size - 1)
            j = after[sym + i]
            ids[sym + i] = merged = self.merged[root // size]
            ids[sym + j] = -1
            k = after[sym + j]
            after[sym + i] = k
            before[sym + k] = i
            h = before[sym + i]
            # Where there is no symbol before, the pair of the merged symbol is written once more in its place.
            first = h < 0
            left = np.where(first, merged, ids[sym + h])
            right = np.where(first, ids[sym + k], merged)
            h = np.where(first, i, h)
            tree[top + size + i] = self.leaves(merged, ids[sym + k], i, size)
            tree[top + size + np.minimum(j, size - 1)] = np.where(j < size, _NONE, tree[top + 2 * size - 1])
            tree[top + size + h] = self.leaves(left, right, h, size)
            three = np.concatenate([top, top, top])
            node = np.concatenate([i, np.minimum(j, size - 1), h]) + size
            for _ in range(size.bit_length() - 1):
                node >>= 1
                child = three + 2 * node
                tree[three + node] = np.minimum(tree[child], tree[child + 1])


class Bpe:
    """A tokenizer of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        chars = byte_characters()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + suffix] for c in chars]
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forest = Forest(self.ranks, len(self.tokens))
        self.inner_ids, self.last_ids = np.array(self.inner), np.array(self.last)
        self.cache = Recent(self._pre_tokens)

    def _pre_tokens(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct pre-tokens: those of up to 33 bytes side by side, by size of their trees, longer ones alone."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([max(0, len(r) - 2).bit_length() for r in raw])
        for bits in np.unique(sizes):
            members = np.flatnonzero(sizes == bits)
            if bits > 5:
                for k in members:
                    ids = [*(self.inner[b] for b in raw[k][:-1]), self.last[raw[k][-1]]]
                    out[k] = np.array(merge_all(ids, self.ranks), "<u4").tobytes()
                continue
            for part in np.array_split(members, len(members) // 8192 + 1):
                here = [raw[k] for k in part]
                lengths = np.array([len(r) for r in here])
                row = np.repeat(np.arange(len(here)), lengths)
                column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                data = np.frombuffer(b"".join(here), np.uint8)
                ids = np.full((len(here), (1 << bits) + 1), -1, np.int64)
                ids[row, column] = np.where(column == lengths[row] - 1, self.last_ids[data], self.inner_ids[data])
                done = self.forest.merge(ids)
                kept = done >= 0
                packed, ends = done[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
                at = 0
                for k, end in zip(part.tolist(), ends):
                    out[k] = packed[at:end]
                    at = end
        return out

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one, so no final sigma
        text = text.lower()
        return (_SPLIT if _FAR.search(text) else _FAST).findall(text)

    def _group(self, texts: list[str | None]) -> list[bytes]:
        # Parts of special tokens are told from pre-tokens by their place: every second one.
        split = []
        for text in texts:
            parts = [text or ""] if self.parts is None or not text or "<|" not in text else self.parts.split(text)
            split.append([p if k % 2 else self._split(p) for k, p in enumerate(parts)])
        packed = iter(self.cache.values_of([words for parts in split for words in parts[::2]]))
        return [b"".join([b"".join(next(packed)) if isinstance(p, list) else self.special[p].to_bytes(4, "little") for p in parts]) for parts in split]

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, in groups of about a million characters."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < GROUP:
                size += len(texts[to] or "")
                to += 1
            yield from self._group(texts[at:to])
            at = to

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in array("I", ids)])


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encoder(path: str) -> Callable[..., F.Column]:
    """text -> array<int> of ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            packed = list(bpe.encode_many(texts.to_pylist()))
            offsets = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return arrow_column(run, "array<int>")


def decoder(path: str) -> Callable[..., F.Column]:
    """array<int> of ids -> text; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for lists in batches:
            yield pa.array([None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in lists.to_pylist()], pa.string())

    return arrow_column(run, "string")


def digests(path: str) -> Callable[..., F.Column]:
    """text -> n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_many(texts.to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_column(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs`."""
    return docs.select(F.col(id_col), digests(path)(F.col(text_col)).alias("_b")).select(id_col, "_b.*")
