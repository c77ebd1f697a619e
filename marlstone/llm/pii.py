"""Personal data: exact base patterns, and a skip-chain conditional random field that adds spans.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping for each kind. Beside them, a
CRF labels the tokens of each document as `secret`, `email` (such as addresses whose dots are spelt out) or other. Its
nodes are the active tokens: those with a digit or at sign. All other words are other; they act as the context of the
tokens behind them and are no nodes. A chain edge joins active tokens that are neighbours. Skip edges join equal tokens
of at least `SKIP_LENGTH` characters, however far apart: all occurrences have an edge to one shared node, which holds
the features of their characters once, so a label needs two steps to reach any other occurrence, and an occurrence
without a telling context says nothing against it. Shared nodes of similar tokens (of one length, one edit block apart)
have an edge of their own. Loopy belief propagation passes messages over all edges until they settle. Tokens labelled
`secret` or `email` that no base span covers become spans.

The weights of features and of the three kinds of edge are trained together, by gradient ascent on the likelihood with
the propagated marginals, over synthetic documents that this module writes itself. The driver trains, once; tasks get
the weights. A secret is told by its context (the word before, an assignment, quotes) at one place at least; a bare
digest, commit id or UUID is none, but a bare repeat of a told secret is.

Defined cases: a null or empty text has no spans; equal rows give equal results; long texts are handled whole, in time
in proportion to their length; an empty table gives an empty result. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import arrow_column

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
LABELS = ["other", "secret", "email"]
OTHER, SECRET, EMAIL = range(3)
CHAIN, SKIP, NEAR = range(3)
SKIP_LENGTH = 6
DAMPING = 0.5
#: A document's messages have settled when none changes by more than TOLERANCE in a round. An edge passes on at most four
#: fifths of a change, so that takes some hundred rounds at most; a document that swings for ENDLESS rounds is an error.
TOLERANCE, ENDLESS = 1e-5, 10_000

# Fixed values of the base patterns.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_ACTIVE = re.compile(r"[0-9@]|\[at\]|\(at\)", re.I | re.A)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # The local part's class has no at sign, so a match's local part is the whole run before its at sign.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        done = at + 1
        if start < at and (tail := _EMAIL_TAIL.match(text, at)):
            yield start, tail.end(), "email"
            done = tail.end()
        at = text.find("@", done)


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end, "ip"
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """All spans of the base patterns, by start and then kind as in KINDS."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT_OR_AT.search(text):
        found += _ips(text)
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The field: nodes with features, chain edges and skip edges.

_EDGE_PUNCT = "\"'`,;:.!?()[]{}<>#*$%&|="
# Words that announce a secret, and words that announce another kind of code.
_CUES = frozenset("token secret password passwd passphrase pwd key apikey api_key access_key auth bearer credential credentials".split())
_OTHER_CODES = frozenset("commit sha sha1 sha256 sha512 md5 digest checksum hash etag uuid guid id rev revision build merge".split())
_SPELT = re.compile(r"^[A-Za-z0-9._%+-]+(?:\[at\]|\(at\)|@)[A-Za-z0-9-]+(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]+)+$", re.I | re.A)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I | re.A)
_ASSIGNED = re.compile(r"^([A-Za-z_][A-Za-z0-9_.-]{0,63})[=:]+[\"'`]?")


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _names(words: frozenset, before: str) -> bool:
    """Whether a token's core is one of the words, or a name that ends with one, as client_secret does."""
    low = before.lower()
    return low in words or re.split("[_.-]", low)[-1] in words


def shape(core: str) -> tuple[str, ...]:
    """Features of a token's characters."""
    n = len(core)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    out = ["bias", f"len{min(n // 8, 5)}", f"digits{int(4 * digits / n) if n else 0}"]
    if digits and letters and n >= 8:
        out.append("mixed8")
    if digits and letters and n >= 16:
        out.append("mixed16")
        if all(c in "0123456789abcdefABCDEF" for c in core):
            out.append("hex")
        if _entropy(core) > 3:
            out.append("entropy")
    if _UUID.match(core):
        out.append("uuid")
    if digits == n:
        out.append("number")
    if _ACTIVE.search(core) and not _DIGIT_OR_AT.search(core) or "@" in core:
        out.append("at")
        if _SPELT.match(core):
            out.append("address")
    elif _SPELT.match(core):
        out += ["at", "address"]
    return tuple(out)


def context(known: tuple[str, ...], before: list[str], assigned: bool, quoted: bool) -> list[str]:
    """Features of a token's surroundings: the cores of the two tokens before it, an assignment sign, quotes."""
    out = []
    if quoted:
        out.append("quoted")
    if assigned:
        out.append("assigned")
    if any(_names(_CUES, b) for b in before):
        out.append("cue")
        out += [f"cue_{f}" for f in ("mixed8", "mixed16", "uuid") if f in known]
        if assigned and "mixed8" in known:
            out.append("cue_assigned")
    if any(_names(_OTHER_CODES, b) for b in before):
        out.append("code")
    return out


def similar(a: str, b: str) -> bool:
    """Equal, or of one length and different in one block of at most a quarter of the characters."""
    if a == b:
        return True
    if len(a) != len(b) or len(a) < 8:
        return False
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return diff[-1] - diff[0] < len(a) // 4


_MODULUS, _FACTOR = (1 << 61) - 1, 0x1B873593CC9E2D51


def _near(cores: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of similar cores; every two similar ones are a pair, or both a pair with a third.

    Cores of one length are similar exactly if they agree outside some window of a quarter of it. For each window the
    characters around it are a key, by rolling hashes; the cores of a key are each paired with the first of them."""
    by_length: dict[int, list[str]] = {}
    for core in cores:
        if len(core) >= 8:
            by_length.setdefault(len(core), []).append(core)
    for n, same in by_length.items():
        if len(same) < 2:
            continue
        window, found = n // 4, set()
        first: dict[tuple[int, int], list[str]] = {}
        power = [1]
        for _ in range(n):
            power.append(power[-1] * _FACTOR % _MODULUS)
        for core in same:
            sums = [0]  # of the first k characters, each times the power of its place
            for k, c in enumerate(core):
                sums.append((sums[-1] + (ord(c) + 1) * power[k]) % _MODULUS)
            for at in range(n - window + 1):
                others = first.setdefault((at, (sums[at] + sums[n] - sums[at + window]) % _MODULUS), [])
                for other in others:
                    if core[:at] == other[:at] and core[at + window :] == other[at + window :]:
                        found.add((other, core))
                        break
                else:
                    others.append(core)
        yield from sorted(found)


class Graph:
    """One document's field. Nodes are the active tokens, in order, and behind them the shared nodes of equal ones.

    spans: of the tokens; feats: of all nodes; edges: (node, node, kind).
    """

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.feats: list[list[str]] = []
        self.edges: list[tuple[int, int, int]] = []
        places: dict[str, list[int]] = {}
        shapes: dict[str, tuple[str, ...]] = {}
        before: list[str] = []
        last, sign = -9, False
        for k, m in enumerate(_TOKEN.finditer(text)):
            token = m[0]
            core = token.strip(_EDGE_PUNCT)
            if core and _ACTIVE.search(token):
                start, assigned, quoted = m.start() + token.index(core), sign, token[:1] in "\"'`"
                if (left := _ASSIGNED.match(core)) and _names(_CUES, left[1]) and left.end() < len(core):
                    before, assigned, quoted = [left[1]], True, core[left.end() - 1] in "\"'`"
                    start, core = start + left.end(), core[left.end() :]
                here = len(self.spans)
                self.spans.append((start, start + len(core)))
                known = shapes.get(core) or shapes.setdefault(core, shape(core))
                self.feats.append(context(known, before, assigned, quoted))
                if last == k - 1:
                    self.edges.append((here - 1, here, CHAIN))
                last = k
                if len(core) >= SKIP_LENGTH:
                    places.setdefault(core, []).append(here)
                else:
                    self.feats[here] += known
            sign = token[-1:] in ("=", ":")
            if core:
                before = [*before[-1:], core]
        self._skip(places, shapes)

    def _skip(self, places: dict[str, list[int]], shapes: dict[str, tuple[str, ...]]) -> None:
        """Edges of the tokens of one core to their shared node, and between the shared nodes of similar cores."""
        near = list(_near(list(places)))
        joined_up = {c for pair in near for c in pair} | {c for c, at in places.items() if len(at) > 1}
        shared = {core: len(self.spans) + k for k, core in enumerate(c for c in places if c in joined_up)}
        for core, at in places.items():
            if core in shared:
                self.feats.append(list(shapes[core]))
            else:  # the only occurrence is its own shared node
                self.feats[at[0]] += shapes[core]
        self.edges += [(at, shared[core], SKIP) for core in shared for at in places[core]]
        self.edges += [(shared[a], shared[b], NEAR) for a, b in near]


class _Messages:
    """Damped loopy sum-product over undirected edges; bonus: each edge's log weight of equal labels."""

    def __init__(self, n: int, k: int, edges: np.ndarray):
        m = len(edges)
        self.n, self.k, self.edges = n, k, edges
        self.src, self.dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        self.back = np.concatenate([np.arange(m) + m, np.arange(m)])
        self.values = np.zeros((2 * m, k))

    def incoming(self) -> np.ndarray:
        return np.stack([np.bincount(self.dst, self.values[:, j], self.n) for j in range(self.k)], 1)

    def round(self, unary: np.ndarray, bonus: np.ndarray) -> np.ndarray:
        """One round; how much each message changed."""
        into = (unary + self.incoming())[self.src] - self.values[self.back]
        e = np.exp(into - into.max(1, keepdims=True))
        new = np.log(e.sum(1, keepdims=True) + np.expm1(bonus)[:, None] * e)
        new = DAMPING * self.values + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        change, self.values = np.abs(new - self.values).max(1), new
        return change

    def keep(self, live: np.ndarray) -> None:
        """Only the edges of `live`, which holds both directions of an edge or none."""
        self.back = (np.cumsum(live) - 1)[self.back[live]]
        self.src, self.dst, self.values = self.src[live], self.dst[live], self.values[live]


def marginals(unary: np.ndarray, edges: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Log beliefs of the nodes; weights[e]: the log bonus of equal labels over edge e; owner: each node's document.

    Each document's messages run until they settle, whichever documents run beside it."""
    n, k = unary.shape
    if not len(edges):
        return unary
    messages = _Messages(n, k, edges)
    bonus = np.concatenate([weights, weights])
    settled = np.zeros((n, k))
    for at in range(1, ENDLESS + 1):
        change = messages.round(unary + settled, bonus)
        if at % 8:
            continue
        worst = np.zeros(owner[-1] + 1)
        np.maximum.at(worst, owner[messages.src], change)
        live = worst[owner[messages.src]] > TOLERANCE
        if not live.all():
            before = messages.incoming()
            messages.keep(live)
            bonus = bonus[live]
            settled += before - messages.incoming()
            if not len(messages.src):
                break
    else:
        raise RuntimeError(f"messages of a document haven't settled in {ENDLESS} rounds")
    return unary + settled + messages.incoming()


class _Batch:
    """The graphs of many documents as one: no edge joins two. tokens: the nodes that are tokens."""

    def __init__(self, graphs: list[Graph], index: dict[str, int]):
        sizes = np.array([len(g.feats) for g in graphs], np.int64)
        n_tokens = np.array([len(g.spans) for g in graphs], np.int64)
        base = np.cumsum(sizes) - sizes
        self.n = int(sizes.sum())
        self.owner = np.repeat(np.arange(len(graphs)), sizes)
        self.cuts = np.cumsum([0, *n_tokens.tolist()])
        self.tokens = np.arange(self.cuts[-1]) + np.repeat(base - self.cuts[:-1], n_tokens)
        edges = np.array([(a + b, c + b, kind) for g, b in zip(graphs, base.tolist()) for a, c, kind in g.edges], np.int64).reshape(-1, 3)
        self.edges, self.kinds = edges[:, :2], edges[:, 2]
        feats = [[index[f] for f in fs if f in index] for g in graphs for fs in g.feats]
        self.rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        self.columns = np.array([f for fs in feats for f in fs], np.int64)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, weights[self.columns, k], self.n) for k in range(len(LABELS))], 1)


class Field:
    """Weights of each feature and label, and of each kind of edge."""

    def __init__(self, names: list[str], weights: np.ndarray, edge: np.ndarray):
        self.index, self.weights, self.edge = {f: k for k, f in enumerate(names)}, weights, np.asarray(edge, float)

    def label(self, graphs: list[Graph]) -> list[np.ndarray]:
        """The label of each token."""
        b = _Batch(graphs, self.index)
        best = marginals(b.unary(self.weights), b.edges, self.edge[b.kinds], b.owner).argmax(1)[b.tokens]
        return [best[x:y] for x, y in zip(b.cuts, b.cuts[1:])]


def synthetic(seed: int, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented documents with their labelled spans: secrets, spelt-out addresses, and codes and numbers that are neither."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "on", "th", "le", "ou", "st", "en"]) for _ in range(r.randint(1, 4)))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    code = lambda letters, sizes: "".join(r.choice(letters) for _ in range(r.choice(sizes)))
    hexes = lambda *sizes: code("0123456789abcdef", sizes)
    secrets = [lambda: hexes(20, 32, 40, 64), lambda: code(alnum, (16, 20, 24, 32, 40)) + str(r.randint(0, 9)), lambda: f"{word()}{r.randint(1, 99)}{word()}{r.randint(1, 99)}{word()}"]
    codes = [lambda: hexes(40), lambda: hexes(32, 64), lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), lambda: code(alnum, (16, 24, 40)) + "7"]
    plain = [
        lambda: str(r.randint(0, 10 ** r.randint(1, 17))), lambda: f"{r.randint(1, 30)}.{r.randint(0, 99)}", lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
        lambda: f"{word()}{r.randint(1, 99)}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"@{word()}", lambda: f"({r.randint(100, 999)})", lambda: f"{r.randint(100, 999)}-{r.randint(1000, 9999)}",
    ]
    out = []
    for _ in range(n):
        items: list[tuple[str, str, int]] = []  # what stands before, the token, its label
        for _ in range(r.choice([0, 0, 1, 2])):
            s = r.choice(secrets)()
            name = lambda: r.choice([r.choice(sorted(_CUES)), f"{word()}_{r.choice(['secret', 'key', 'token'])}"])
            told = lambda: f"{name()} {r.choice(['= ', ': ', ''])}" if r.random() < 0.7 else f"{name()}{r.choice('=:')}"
            items.append((told(), s, SECRET))
            items += [(told() if r.random() < 0.3 else "", s, SECRET) for _ in range(r.choice([0, 1, 1, 2, 5]))]
            if r.random() < 0.3 and len(s) >= 16:
                at = r.randint(0, len(s) - 4)
                items.append(("", s[:at] + hexes(3) + s[at + 3 :], SECRET))
        for _ in range(r.choice([0, 1, 1, 2])):
            s = r.choice(codes)()
            items += [(f"{r.choice(sorted(_OTHER_CODES))} {r.choice([': ', '= ', '', ''])}" if r.random() < 0.6 else "", s, OTHER) for _ in range(r.choice([1, 1, 2, 4]))]
        for _ in range(r.choice([0, 0, 0, 1])):
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("[AT]", "[DOT]"), ("[at]", ".")])
            items.append(("", f"{word()}{at}{word()}{dot}com", EMAIL))
        items += [("" if r.random() < 0.9 else f"{r.choice(sorted(_CUES))} ", r.choice(plain)(), OTHER) for _ in range(r.randint(1, 6))]
        items += [("", r.choice([word(), word(), word(), r.choice(sorted(_CUES | _OTHER_CODES))]), OTHER) for _ in range(r.randint(5, 20))]
        r.shuffle(items)
        text, spans = "", []
        for lead, token, label in items:
            wrap = r.choice(['"', "'", "", ""]) if label == SECRET else r.choice(["", "", "", '"'])
            text += lead + wrap
            if label:
                spans.append((len(text), len(text) + len(token), label))
            # A word follows, so what the next token has before it is its own.
            text += f"{token}{wrap} {word()} {word()} "
        out.append((text, spans))
    return out


def fit(documents: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 300, rate: float = 0.1, decay: float = 2e-4) -> Field:
    """The field that makes the documents' labels most likely: gradient ascent (Adam) with an L2 penalty.

    The expected counts of features and of equal neighbours come from the messages, which run on from step to step.
    A shared node has the label that most of its tokens have."""
    graphs = [Graph(t) for t, _ in documents]
    names = sorted({f for g in graphs for fs in g.feats for f in fs})
    b = _Batch(graphs, {f: k for k, f in enumerate(names)})
    truth = np.zeros(b.n, np.int64)
    truth[b.tokens] = [dict(((x, y), k) for x, y, k in spans).get(s, OTHER) for g, (_, spans) in zip(graphs, documents) for s in g.spans]
    votes = np.zeros((b.n, len(LABELS)))
    skip = b.edges[b.kinds == SKIP]
    np.add.at(votes, (skip[:, 1], truth[skip[:, 0]]), 1)
    shared = np.setdiff1d(np.arange(b.n), b.tokens)
    truth[shared] = votes[shared].argmax(1)
    hot = np.eye(len(LABELS))[truth]
    same = (truth[b.edges[:, 0]] == truth[b.edges[:, 1]]).astype(float)
    weights, edge = np.zeros((len(names), len(LABELS))), np.zeros(3)
    messages = _Messages(b.n, len(LABELS), b.edges)
    size = weights.size
    moments = np.zeros((2, size + 3))
    for step in range(1, steps + 1):
        unary = b.unary(weights)
        bonus = np.concatenate([edge[b.kinds]] * 2)
        for _ in range(4):
            messages.round(unary, bonus)
        belief = unary + messages.incoming()
        p = np.exp(belief - belief.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        into = belief[messages.src] - messages.values[messages.back]  # without what came over the edge itself
        left, right = (np.exp(x - x.max(1, keepdims=True)) for x in np.split(into, 2))
        agree = np.exp(edge[b.kinds]) * (left * right).sum(1)
        agree /= left.sum(1) * right.sum(1) - (left * right).sum(1) + agree
        gap = hot - p
        slope = np.zeros_like(weights)
        np.add.at(slope, b.columns, gap[b.rows])
        tie = np.bincount(b.kinds, same - agree, 3)
        g = np.concatenate([slope.ravel(), tie]) / len(documents) - decay * np.concatenate([weights.ravel(), edge])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, edge = weights + move[:size].reshape(weights.shape), edge + move[size:]
    return Field(names, weights, edge)


@lru_cache(1)
def trained(seed: int = 7, n: int = 500) -> Field:
    """A field fitted to synthetic documents; once in a process, the driver's."""
    return fit(synthetic(seed, n))


def find(texts: list[str | None], field: Field | None = None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    field = field or trained()
    out: list[tuple[list[Span], list[Span]]] = []
    graphs: list[Graph] = []
    where: list[int] = []
    for k, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        out.append((base, base))
        if _ACTIVE.search(text):
            graphs.append(Graph(text))
            where.append(k)
    for k, g, labels in zip(where, graphs, field.label(graphs) if graphs else ()):
        if not (hits := np.flatnonzero(labels)).size:
            continue
        base = out[k][0]
        starts = np.array([s[0] for s in base], np.int64)
        ends = np.maximum.accumulate(np.array([s[1] for s in base], np.int64)) if base else starts
        extra = []
        for i in hits:
            a, b = g.spans[i]
            at = np.searchsorted(starts, b) - 1
            if at < 0 or ends[at] <= a:
                extra.append((a, b, LABELS[labels[i]]))
        out[k] = (base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans the first, and then the longest, names the whole."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_GROUP = 2000


def spans_of(field: Field):
    """text -> counts of base spans by kind, their digest, and all spans."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for at in range(0, len(texts), _GROUP):
                for base, every in find(texts.slice(at, _GROUP).to_pylist(), field):
                    kinds = [s[2] for s in base]
                    rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return arrow_column(run, "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")


def redacted(field: Field):
    """text -> the text with its spans replaced."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), _GROUP):
                part = texts.slice(at, _GROUP).to_pylist()
                out += [t if t is None or not every else redact(t, every) for t, (_, every) in zip(part, find(part, field))]
            yield pa.array(out, pa.string())

    return arrow_column(run, "string")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: its id, counts of base spans by kind, their digest, and all spans."""
    return docs.select(F.col(id_col), spans_of(trained())(F.col(text_col)).alias("_s")).select(id_col, "_s.*")


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span of its text replaced; other columns and row counts stay as they are."""
    return docs.withColumn(text_col, redacted(trained())(F.col(text_col)))
