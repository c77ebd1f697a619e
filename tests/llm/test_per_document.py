"""Operators that give a row for each row: BPE, token counts, media, quality, personal data."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import _scan, bpe, media, pii, quality, token_counts
from marlstone.llm.queries import tokenizer_file

from .fixtures import TEXTS, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")



@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, library):
    path = tokenizer_file("word_bpe_49k.json")
    got = sorted(map(tuple, bpe.encode_documents(documents(spark), path).collect()), key=str)
    want = []
    for i, t, _ in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(empty(spark), path).count() == 0


def test_bpe_on_random_texts(library):
    mine, r = bpe.load(tokenizer_file("word_bpe_49k.json")), random.Random(5)
    letters = [*"abcdesr 'tlm.,!\n\t\x85\xa0²½_9éÀΣςİſß中한١Ⅷ😀́​", "<|endoftext|>", "'re", "'LL"]
    for _ in range(2000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == ids, s
        assert mine.decode(mine.encode(s)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_columns_round_trip(spark):
    path = tokenizer_file("word_bpe_49k.json")
    docs = documents(spark).filter("doc_id = 1")
    row = docs.select(bpe.decoder(path)(bpe.encoder(path)("text")).alias("t"), bpe.encoder(path)("text").alias("ids")).first()
    assert row.t.replace("</w>", "").split() == TEXTS[0][1].split() and len(row.ids) == len(row.t.split())


def test_segment_tree_merges_leftmost_lowest_first():
    r = random.Random(1)
    ranks = {(a, b): (k, 10 + k) for k, (a, b) in enumerate([(1, 2), (2, 1), (10, 1), (1, 1), (11, 11), (12, 2), (13, 13)])}

    def plain(ids):
        while found := [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]:
            _, i = min(found)
            ids = [*ids[:i], ranks[ids[i], ids[i + 1]][1], *ids[i + 2 :]]
        return ids

    forest = bpe.Forest(ranks, 32)
    for _ in range(500):
        ids = [r.choice([1, 2]) for _ in range(r.randint(1, 17))]
        assert bpe.merge_all(ids, ranks) == plain(ids)
        row = np.full((1, 17), -1)
        row[0, : len(ids)] = ids
        assert [x for x in forest.merge(row)[0].tolist() if x >= 0] == plain(ids)


def test_token_counts_equal_plain_dynamic_programming(spark):
    pieces = {"▁a": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁ab": -3.5, "aba": -2.6, "中": -4.0}
    c = token_counts.Counter(pieces)

    def plain(word):
        word, best = "▁" + word, [(0.0, 0)]
        for d in range(1, len(word) + 1):
            n_bytes = len(word[d - 1].encode())
            here = (best[-1][0] + token_counts.BYTE_COST * n_bytes, best[-1][1] + n_bytes)
            for n in range(1, min(d, 3) + 1):
                if (p := pieces.get(word[d - n : d])) is not None and best[d - n][0] + p > here[0]:
                    here = best[d - n][0] + p, best[d - n][1] + 1
            best.append(here)
        return best[-1][1]

    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab中é  ") for _ in range(r.randint(0, 90)))
        words = WORD.findall(text)
        assert c.count(text) == (len(words), sum(map(plain, words)))
    long = "ab" * 200
    assert c.count(long) == (1, plain(long))
    deep = ["ab" * 40 + tail for tail in ("", "a", "中b", "abab" * 30)] + ["é" * 70, "b" + "ab" * 60]
    assert c._pre_tokens(deep) == list(map(plain, deep))
    path = tokenizer_file("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_counts.count_documents(documents(spark), path).collect()}
    assert got[4].n_tokens == got[5].n_tokens == got[6].n_words == 0 and got[7].n_words == 2 and got[9].n_words == 60_000
    assert got[11].n_tokens == token_counts.load(path)._deep(["x" * 30_000])[0]
    assert token_counts.count_documents(empty(spark), path).count() == 0


def test_media_round_trip(spark):
    got = {(r.doc_id, r.n_bytes): r for r in media.digest_documents(documents(spark)).collect()}
    for i, t, _ in TEXTS:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        row = got[i, len(raw)]
        assert (row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert row.media_sha256 == hashlib.sha256(media.to_wave(payload)).hexdigest() and row.media_bytes == len(media.to_wave(payload))
    assert len({r.feature for (i, _), r in got.items() if i in (1, 2)}) == 1
    assert media.digest_documents(empty(spark)).count() == 0


def test_media_decoders():
    ulaw, alaw = media.ulaw_table(), media.alaw_table()
    assert [ulaw[k] for k in (0x00, 0x80, 0xFF, 0x7F, 0x8F)] == [-32124, 32124, 0, 0, 16764]
    assert [alaw[k] for k in (0x2A, 0xAA, 0xD5, 0x55)] == [-32256, 32256, 8, -8]
    r = np.random.default_rng(3)
    data = r.integers(0, 256, (5, 36), dtype=np.uint8)
    steps, moves = media._STEPS, media._INDEX

    def plain(block):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:]:
            for nibble in (int(byte) & 15, int(byte) >> 4):
                step = int(steps[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + int(moves[nibble])))
                out.append(value)
        return out

    assert media.decode_ima(data.ravel(), 36).tolist() == [plain(b) for b in data]
    assert media.from_wave(media.to_wave(data.tobytes(), media.IMA, 8000, 36)) == (media.IMA, 8000, 36, data.tobytes())
    assert media.double(np.array([5, 5, 5], np.int16)).tolist() == [5] * 6 and not len(media.double(np.zeros(0, np.int16)))
    with pytest.raises(ValueError):
        media.from_wave(b"no sound")


def test_media_pcm_column(spark):
    stored = media.store_documents(documents(spark)).select(media.to_pcm("media").alias("w")).first()
    tag, rate, _, data = media.from_wave(stored.w)
    assert (tag, rate) == (media.PCM, 16000) and len(data) % 4 == 0


def test_quality_measures(spark):
    got = quality.judge(documents(spark))
    assert got.count() == len(TEXTS)
    rows = {r.doc_id: r for r in got.collect()}
    for i, t, _ in TEXTS:
        words = WORD.findall(t or "")
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        counts, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if counts[w] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        row = rows[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, i
        assert row.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not row.kept or not row.base_failed
    assert rows[1].kept and rows[None].kept and not rows[4].kept and not rows[13].kept
    assert quality.judge(empty(spark)).count() == 0


def thue_morse(n):
    """A word of two letters and its complement: a polynomial hash modulo a power of two takes them for one."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(1024)
    rows = [(1, f"one two three four {x} and then one two three four {y}", "a")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).first()
    assert got.n_repeat_words == 0


def test_range_hashes_tell_ranges_apart():
    r = random.Random(8)
    words = list(dict.fromkeys(["".join(r.choice("ab") for _ in range(r.choice([1, 7, 8, 9, 16, 31, 32, 33, 40, 200]))) for _ in range(3000)]))
    texts = [f"{w}  {w.upper()} x" for w in words]
    (_, t), = list(_scan.slices(pa.array(["\n".join(texts)])))
    _, plain = t.words(False)
    _, folded = t.words(True)
    assert len(set(folded[0::3].tolist())) == len(words) and (folded[0::3] == folded[1::3]).all() and not (plain[0::3] == plain[1::3]).any()


def test_host_at_the_limit_is_not_bad(spark):
    """All hosts alike: the shrunken rate is the mean, here the limit itself."""
    rows = [(k, "x" if k % 2 else "plain words that follow each other without any symbols at all in here", h) for k in range(20) for h in ("a", "b")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r.host_rate for r in got} == {0.5} and not any(r.host_bad for r in got)


def test_bad_hosts_judge_by_tight_limits(spark):
    clean = "plain words that follow each other without any symbols at all in here"
    mild = clean + " ### $$"
    junk = "### $$$ %%% &&& *** ### $$$ %%% &&& *** ### aa"
    rows = [(k, junk if k % 10 else mild, "bad") for k in range(100)] + [(200 + k, mild if k % 2 else clean, "good") for k in range(100)] + [(400, clean, "bad")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[0].host_bad and not got[0].kept and got[400].kept and got[201].kept and not got[201].host_bad


def test_quality_filter_keeps_columns(spark):
    docs = documents(spark)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, None}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns(spark, sf_dir):
    r = random.Random(4)
    for _ in range(5000):
        s = "".join(r.choice("1234.@a-b +() ") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(s) == plain_spans(s), s
    got = {r.doc_id: r for r in pii.detect(documents(spark)).collect()}
    for i, t, _ in TEXTS:
        spans = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in spans) for k in pii.BASE]
        assert set(pii.joined(spans).split(",")) <= set(got[i].spans.split(",")) or not spans
    assert (got[12].n_email, got[12].n_ip, got[12].n_card, got[12].n_phone) == (1, 1, 1, 1)
    assert pii.detect(empty(spark)).count() == 0
    long = ("1" * 40_000) + "@" + "a" * 40_000
    assert pii.base_spans(long) == []


def scored(field, seed=1234, n=300):
    """Right, wrong and missed entity tokens on held-out documents."""
    held = pii.synthetic(seed, n)
    right = wrong = missed = 0
    graphs = [pii.Graph(t) for t, _ in held]
    for g, (_, spans), labels in zip(graphs, held, field.label(graphs)):
        truth = {(a, b): k for a, b, k in spans}
        for span, label in zip(g.spans, labels):
            want = truth.get(span, 0)
            right += label == want > 0
            wrong += label > 0 and label != want
            missed += want > 0 and label != want
    return right, wrong, missed


def without_edges():
    field = pii.trained()
    return pii.Field(list(field.index), field.weights, np.zeros(3))


def test_field_on_held_out_documents():
    right, wrong, missed = scored(pii.trained())
    assert wrong <= 0.02 * right and missed <= 0.04 * right
    bare = scored(without_edges())
    assert bare[1] > 3 * wrong and bare[2] > 3 * missed  # the edges carry what single tokens don't tell
    assert (pii.trained().edge[[pii.SKIP, pii.NEAR]] > 1).all()


def enumerated(unary, edges, weights):
    """Marginals by all labellings."""
    n, k = unary.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(w for (a, b), w in zip(edges, weights) if labels[a] == labels[b])
        out[range(n), labels] += math.exp(score)
    return out / out.sum(1, keepdims=True)


def beliefs(unary, edges, weights, owner=None):
    b = pii.marginals(unary, np.array(edges, np.int64).reshape(-1, 2), np.array(weights), np.zeros(len(unary), np.int64) if owner is None else owner)
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(6)
    for _ in range(20):  # exact on trees
        n = int(r.integers(2, 8))
        unary, edges = r.normal(0, 1.5, (n, 3)), [(int(r.integers(0, k)), k) for k in range(1, n)]
        weights = r.normal(0.5, 2, n - 1)
        assert np.allclose(beliefs(unary, edges, weights), enumerated(unary, edges, weights), atol=1e-4)
    for _ in range(20):  # near on loops of moderate weights
        unary, edges = r.normal(0, 1.5, (5, 3)), [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]
        weights = r.uniform(0, 1.5, 5)
        assert np.abs(beliefs(unary, edges, weights) - enumerated(unary, edges, weights)).max() < 0.06
    # Documents that run side by side don't touch each other.
    unary = r.normal(0, 1.5, (4, 3))
    both = beliefs(unary, [(0, 1), (2, 3)], [1.0, 2.0], np.array([0, 0, 1, 1]))
    assert np.allclose(both[:2], enumerated(unary[:2], [(0, 1)], [1.0]), atol=1e-4)


def found(text, field=None):
    (_, spans), = pii.find([text], field)
    return [text[a:b] for a, b, k in spans if k == "secret"]


def test_skip_edges_carry_a_label_to_bare_repeats():
    secret = "Ab3dEf6hIj9kLmN0"
    text = f'password = "{secret}" and much later, far from any cue, some words and then {secret} again'
    assert found(f"far from any cue, some words and then {secret} again") == []
    assert found(text) == [secret, secret] and len(found(text, without_edges())) < 2
    (_, spans), = pii.find([text])
    assert pii.redact(text, spans).count("[SECRET]") == 2 and secret not in pii.redact(text, spans)
    assert len(found('password = "hunter2hunter2" ' + "and then some words hunter2hunter2 " * 30)) == 31
    assert len(found(f"{secret} word " * 500 + f"password: {secret} " + f"word {secret} " * 500)) == 1001
    other = secret[:5] + "zz9" + secret[8:]
    assert found(f'api_key: "{secret}" was changed to {other} today') == [secret, other]


def test_codes_that_are_no_secrets():
    sha, uuid = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "123e4567-e89b-12d3-a456-426614174000"
    for text in (f"commit {sha} is merged and {sha} is reverted", f"md5: 9b0b3c6a43eb78aa99cbd7049c572391 of the file", f"request id {uuid} and {uuid}", f"see {sha} there", "key 12 and token v1.2.3"):
        assert found(text) == []
    assert found(f'token = "{sha}" here') == [sha] and found(f"API_KEY={sha} here") == [sha] and found("client_secret: q8Zr7Lw2Xk5Vn9Tb") == ["q8Zr7Lw2Xk5Vn9Tb"]
    text = "write to BOB[AT]example[DOT]com or jane(at)mail.example(dot)org"
    (_, spans), = pii.find([text])
    assert [(text[a:b], k) for a, b, k in spans] == [("BOB[AT]example[DOT]com", "email"), ("jane(at)mail.example(dot)org", "email")]


def test_redaction_with_clashing_and_absent_columns(spark):
    docs = documents(spark).drop("n_chars").withColumn("spans", F.lit("s")).withColumn("n_email", F.lit(1))
    assert pii.redact_documents(docs).columns == docs.columns
    assert {r.doc_id for r in pii.detect(docs).filter("n_email > 0").collect()} == {12}


def test_clean_texts_have_no_spans(spark):
    clean = ["no digits at all here", "in 1999 there were 12 of 345 and 6.5 of them", "version 1.2.3 and item a12, room b7", "4111111111111112 is not a card"]
    assert all(every == [] for _, every in pii.find(clean))
    docs = documents(spark)
    assert pii.redact_documents(docs).columns == docs.columns and pii.redact_documents(docs).count() == len(TEXTS)
