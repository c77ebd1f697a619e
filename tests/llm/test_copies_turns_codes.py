"""SimHash near-duplicates, conversation repair and vector codes against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import _common, conversations, neardup, simhash, vector_codes
from marlstone.llm.queries import queries

from .fixtures import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


# SimHash


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(prints):
    """The smallest id reachable from each fingerprint; prints: (id, fingerprint)."""
    each = sorted({f for _, f in prints})
    group = {f: f for f in each}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in combinations(each, 2):
        if (a ^ b).bit_count() <= 4:
            group[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {f: least.get(root(f)) for f in each}


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = [(i, fingerprint(t)) for i, t in docs.items()]
    want = reached(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op11_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", want[f]) for i, f in prints}


def test_simhash_of_odd_rows(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    from .fixtures import TEXTS

    prints = [(i, fingerprint(t)) for i, t, _ in TEXTS]
    want = reached(prints)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == sorted((str(i), f"{f:016x}", want[f]) for i, f in prints)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20 and all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


@pytest.mark.parametrize("block", [1024, 3])
def test_links_of_crowded_postings(spark, monkeypatch, block):
    """Chains of flipped bits and many fingerprints that agree in three bytes, in blocks of three, are dealt anew and lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(_common, "SALTED_ROWS", 20)
    r = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(6):
            prints.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
    base = r.getrandbits(64)
    prints |= {base & 0xFFFFFF | r.getrandbits(40) << 24 for _ in range(60)}
    prints |= {base ^ sum(1 << b for b in r.sample(range(24, 64), 5)) for _ in range(60)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    classes = spark.createDataFrame([(signed(f),) for f in prints], "rep bigint")
    with _common.Scratch(spark) as scratch:
        found = {r.rep: r.comp for r in neardup.components(simhash._links(classes, scratch), scratch).collect()}
    want = reached([(signed(f), f) for f in prints])
    assert {signed(f): found.get(signed(f), signed(f)) for f in prints} == {signed(f): want[f] for f in prints}


# Conversations


def repaired(rows):
    """The contract read literally: the damage, the faults, and all edits as a DP over turns and the states of `(s?(ua)+)?`, with whole audits compared."""
    text_of = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{text_of(c)}:{text_of(t)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by[c] += [(t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names, none, out = {"u": "user", "a": "assistant"}, (10**9, "", None), {}

    def with_inserts(best):
        for _ in range(4):
            for q in range(4):
                for a in "ua":
                    x = best[step[q][a]] if a in step[q] else none
                    if x[0] < 10**9:
                        best[q] = min(best[q], (2 + x[0], "I" + x[1], (names[a] + ":", x[2])), key=lambda z: z[:2])
        return best

    for c, turns in by.items():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).digest()))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, kinds = set(), []
        for _, role, text in turns:
            words = WORD.findall(text)
            kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        best = with_inserts({0: (0, "", None), 1: none, 2: none, 3: (0, "", None)})
        for (_, role, text), kind in zip(turns[::-1], kinds[::-1]):
            new = {}
            for q in range(4):
                options = [(3 + best[q][0], "D" + best[q][1], best[q][2])]
                for a, op, price, name in ((role[:1], "K", 0, role), ("u", "R", 2, "user"), ("a", "R", 2, "assistant")):
                    if a in step[q] and kind not in ("blank", "duplicate"):
                        x = best[step[q][a]]
                        options.append((price + (kind == "truncated") + x[0], op + x[1], (f"{name}:{text}", x[2])))
                new[q] = min(options, key=lambda z: z[:2])
            best = with_inserts(new)
        cost, audit, link = best[0]
        lines = []
        while link:
            lines.append(link[0])
            link = link[1]
        faults = Counter(kinds)
        out[c] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, digest string"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repairs(spark, rows):
    turns = conversations.damage(spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA).repartition(3))
    want = repaired(rows)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversations.digest(turns).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = defaultdict(list)
    for r in sorted(conversations.repair(turns).collect(), key=lambda r: (r.turn is not None, r.turn or 0, r["at"].role.encode(), bytes(r["at"].digest), r.step)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: lines.get(c, []) for c in want} == {c: w[-1] for c, w in want.items()}


def test_conversations_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = repaired([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in queries()["op12_conversations"](spark, sf_dir).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}


@pytest.mark.parametrize("chunk", [1 << 15, 4])
def test_conversations_of_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    r = random.Random(2)
    roles = ["system", "user", "user", "assistant", "assistant", "user", "tool", None, "", "unknown"]
    texts = ["Yes.", "No!", "maybe", "", None, " \t\n", "One two.", "What? ", "a long answer, " * 300 + "ends.", "naïve café 😀"]
    rows = [(c, r.choice([None, *range(12)]), r.choice(roles), r.choice(texts)) for c in [None, *range(30)] for _ in range(r.randint(0, 9))]
    rows += [(99, 5, "user", "The same.")] * 40 + [(100, t, r.choice(roles), f"Turn {t}{r.choice('.!,')}") for t in range(150)]
    rows += [(c, t, "user", "dropped") for c in range(200, 260) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    check_repairs(spark, rows)


def test_no_conversations(spark):
    turns = conversations.damage(spark.createDataFrame([], SCHEMA))
    assert conversations.digest(turns).count() == 0 and conversations.repair(turns).count() == 0


def test_walks_by_chunks_equal_the_automaton():
    r = random.Random(1)
    end = [conversations.FAR] * 3 + [0]
    for _ in range(3000):
        rows = [(r.choice("suuaax"), r.randrange(3)) for _ in range(r.randint(0, 9))]
        codes = "".join(chr(97 + "suax".index(i) + 4 * k) for i, k in rows)
        cuts = sorted(r.randint(0, len(codes)) for _ in range(r.randint(0, 3)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        ends, at = [], end
        for p in reversed(parts):
            ends.insert(0, at)
            m = conversations.matrix(p, None)
            at = [min(conversations.FAR, min(m[4 * t + q] + at[q] for q in range(4))) for t in range(4)]
        whole = conversations.walk(codes, None, end, conversations.START, True)[0]
        role, audit = conversations.START, ""
        for k, p in enumerate(parts):
            piece, _, role, _ = conversations.walk(p, None, ends[k], role, k + 1 == len(parts))
            audit += piece
        price = {"K": 0, "R": 2, "D": 3, "I": 2}
        kinds = [k for _, k in rows]
        done = [c for c in audit if c != "I"]
        assert audit == whole and sum(price[c] for c in audit) + sum(k == 2 and c != "D" for k, c in zip(kinds, done)) == conversations._cost(at)


# Vector codes


def coded(rows, parts=16, entries=64):
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(256 * float(x))) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts if whole else 0
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min((far(v[p], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(2):
        found = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    errors = [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in nearest()]
    labels = Counter()
    for (_, _, label), (_, e) in zip(rows, errors):
        labels[label] += e
    return sorted((str(i), code, e, labels[label], sha) for (i, _, label), (code, e) in zip(rows, errors))


def plain(rows):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows)


def test_vector_codes_equal_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert plain(queries()["op13_vector_codes"](spark, sf_dir).collect()) == coded([(r.vec_id, r.embedding, r.label) for r in table.collect()])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes_of_odd_rows(spark, kind):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(32)], r.choice([None, 0, 1])) for i in range(90)]
    rows += [(5, [0.5] * 32, 1)] * 3 + [(None, [-0.001] * 32, None), (7, None, 1), (8, [None] + [0.1] * 31, 0), (9, [float("nan")] + [0.1] * 31, 0), (10, [float("-inf")] * 32, 0), (200, [2000.25] * 32, 0)]
    table = spark.createDataFrame([(*x, "c", 1) for x in rows], f"vec_id bigint, embedding array<{kind}>, label int, code string, id int").repartition(4)
    held = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert plain(vector_codes.compress(table).collect()) == coded(held)
    few = table.filter("vec_id < 3")
    assert plain(vector_codes.compress(few).collect()) == coded([(r.vec_id, r.embedding, r.label) for r in few.collect()])
    assert vector_codes.compress(table.filter("vec_id < 0")).count() == 0


def test_vectors_that_cannot_be_coded(spark):
    table = lambda *vs: spark.createDataFrame([(k, v, 0) for k, v in enumerate(vs)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(ValueError):
        vector_codes.compress(table([1.0] * 17)).collect()
    for bad in ([1.0] * 32, [1e300] * 16):
        with pytest.raises(Exception, match="components"):
            vector_codes.compress(table([1.0] * 16, bad)).collect()


def test_decoded_vectors_are_near(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vector_codes.learn(table)
    rows = table.select("embedding", vector_codes.encoder(books)("embedding").alias("c")).collect()
    for r in rows:
        whole = np.floor(np.array(r.embedding, dtype=np.float64) * 256)
        assert int(((whole - vector_codes.decode(r.c.code, books) * 256) ** 2).sum()) == r.c.error


def test_a_folder_without_a_setting(spark, monkeypatch):
    conf = type(spark.conf)
    kept = conf.get
    monkeypatch.setattr(conf, "get", lambda self, key, *a: (a[0] if a else None) if key == "spark.checkpoint.dir" else kept(self, key, *a))
    assert _common.scratch_dir(spark) == _common.scratch_dir(spark) and _common.scratch_dir(spark).startswith("file:///")
    assert _common.Scratch(spark).table(spark.range(3).select(F.col("id")), "t").count() == 3


@pytest.mark.parametrize("name", ["op12_conversations", "op13_vector_codes"])
def test_sql_says_the_same(spark, sf_dir, name):
    import duckdb

    from marlstone.llm.queries import oracle_sql

    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'").fetchall()
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = queries()[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, found.fetchall()))
