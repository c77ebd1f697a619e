"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is the word marker and a word. Its best segmentation under a unigram model is found from left to right: the
best score of a prefix follows from the best scores of its shorter prefixes. The prefixes of all pre-tokens form a trie,
and each node's forward score is computed once, when the first pre-token with that prefix is inserted; the node where a
pre-token ends holds its count of tokens. A trie takes the distinct words of about a million characters of text that a
bounded cache of recent words doesn't have; all nodes of one depth are scored at once. Words of over `LONG` characters,
whose branches hardly share a depth, make a trie that is walked depth first, one branch's scores on a stack.

The pieces come from a SentencePiece model file, a parameter. As that file's scores only order the pieces, a piece of
rank r gets the Zipf log-probability -ln(r + 2.7). A character without a piece costs a token for each of its bytes.

Defined cases: a null or empty text has no tokens; equal rows give equal counts; a word of any length takes time in
proportion to it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import WORD, arrow_column
from marlstone.llm.bpe import GROUP, Recent

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.array([1] + [int(_BASE)] * 64, np.uint64), dtype=np.uint64)
MARKER = "▁"
BYTE_COST = -20.0
LONG = 64
_WORD = re.compile(WORD)


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
    return h


class Counter:
    """Unigram token counts with pieces {piece: log-probability}."""

    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        by_length: dict[int, list[tuple[int, float]]] = {}
        for p, score in pieces.items():
            by_length.setdefault(len(p), []).append((_hash(p), score))
        self.pieces = {}
        for n, found in by_length.items():
            found.sort()
            self.pieces[n] = (np.array([h for h, _ in found], np.uint64), np.array([s for _, s in found]))
        self.by_hash = {(n, int(h)): float(s) for n, (keys, logs) in self.pieces.items() for h, s in zip(keys, logs)}
        self.known = Recent(self._pre_tokens)

    def _deep(self, words: list[str]) -> list[int]:
        """Tokens of distinct words by a trie that is walked depth first: in order of the words, each keeps the scores of
        the prefix that it shares with the word before."""
        out, last = [0] * len(words), ""
        prefix, scores, tokens = [0], [0.0], [0]
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = MARKER + words[k]
            shared = len(commonprefix([last, word]))
            for stack in (prefix, scores, tokens):
                del stack[shared + 1 :]
            for d, c in enumerate(word[shared:], shared + 1):
                prefix.append((prefix[-1] * int(_BASE) + ord(c) + 1) % (1 << 64))
                n_bytes = len(c.encode("utf-8", "surrogatepass"))
                best, count = scores[-1] + BYTE_COST * n_bytes, tokens[-1] + n_bytes
                for n in range(1, min(d, self.longest) + 1):
                    log = self.by_hash.get((n, (prefix[d] - prefix[d - n] * int(_POWERS[n])) % (1 << 64)))
                    if log is not None and scores[d - n] + log > best:
                        best, count = scores[d - n] + log, tokens[d - n] + 1
                scores.append(best)
                tokens.append(count)
            out[k], last = tokens[-1], word
        return out

    def _pre_tokens(self, words: list[str]) -> list[int]:
        """Tokens of distinct words, from the trie of short ones and the trie of those of over `LONG` characters."""
        short = iter(self._trie([w for w in words if len(w) <= LONG]))
        long = iter(self._deep([w for w in words if len(w) > LONG]))
        return [next(short) if len(w) <= LONG else next(long) for w in words]

    def _trie(self, words: list[str]) -> list[int]:
        """Tokens of distinct words, by one trie of them all that grows a level, and so a character, at a time."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(MARKER + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        out = np.zeros(len(words), np.int64)
        # Of the last levels, by node: hash of the prefix, score, tokens, and the parent's place in the level above.
        levels = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
        node = np.zeros(len(words), np.int64)
        for d in range(1, int(lengths[0]) + 1 if len(words) else 1):
            live = int(np.searchsorted(-lengths, -d, "right"))
            char = codes[first[:live] + d - 1]
            nodes, node = np.unique(node[:live] << 21 | char, return_inverse=True)
            parent, char = nodes >> 21, nodes & 0x1FFFFF
            prefix = levels[-1][0][parent] * _BASE + char.astype(np.uint64) + np.uint64(1)
            n_bytes = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            best, count = levels[-1][1][parent] + BYTE_COST * n_bytes, levels[-1][2][parent] + n_bytes
            above = np.arange(len(nodes))
            for n in range(1, min(d, self.longest) + 1):
                above = (levels[1 - n][3] if n > 1 else parent)[above]
                if n not in self.pieces:
                    continue
                keys, logs = self.pieces[n]
                ends = prefix - levels[-n][0][above] * _POWERS[n]
                at = np.minimum(np.searchsorted(keys, ends), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == ends)
                score = levels[-n][1][above[hit]] + logs[at[hit]]
                better = score > best[hit]
                hit = hit[better]
                best[hit], count[hit] = score[better], levels[-n][2][above[hit]] + 1
            levels = [*levels[-self.longest :], (prefix, best, count, parent)]
            ended = int(np.searchsorted(-lengths, -d, "left"))
            out[order[ended:live]] = count[node[ended:live]]
        return out.tolist()

    def count_many(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Words and tokens of each text, in groups of about a million characters."""
        at = 0
        while at < len(texts):
            to, size, split = at, 0, []
            while to < len(texts) and size < GROUP:
                size += len(texts[to] or "")
                split.append(_WORD.findall(texts[to] or ""))
                to += 1
            for counts in self.known.values_of(split):
                yield len(counts), sum(counts)
            at = to

    def count(self, text: str | None) -> tuple[int, int]:
        return next(self.count_many([text]))


@lru_cache(2)
def load(path: str) -> Counter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return Counter({p: -math.log(r + 2.7) for r, p in enumerate(ranked)})


def counter(path: str) -> Callable[..., F.Column]:
    """text -> struct<n_words, n_tokens>."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = load(path)
        for texts in batches:
            found = list(c.count_many(texts.to_pylist()))
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["n_words", "n_tokens"])

    return arrow_column(run, "struct<n_words:bigint,n_tokens:bigint>")


def count_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of each row of `docs`."""
    return docs.select(F.col(id_col), counter(path)(F.col(text_col)).alias("_c")).select(id_col, "_c.*")
