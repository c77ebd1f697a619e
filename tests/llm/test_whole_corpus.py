"""Operators that look at the whole corpus: near-duplicates, sharding, mixing, token shards, HTML weights, the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import _common, html_extract, mixing, neardup, sharding, token_shards
from marlstone.llm._common import Scratch
from marlstone.llm.queries import queries

from .fixtures import TEXTS, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def components_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((root(a), root(b)))
                group[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = components_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    rows = neardup.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: r for r in rows}
    want = components_by_brute_force([(i, t) for i, t, _ in TEXTS if i is not None])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert got[None].component_id is None and got[None].kept and got[4].kept and got[8].component_id == 7 and got[10].component_id == 9
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_a_chain_of_near_copies_in_one_bucket(spark, monkeypatch):
    """A large group whose members aren't all linked to its smallest, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == components_by_brute_force(rows)


def test_a_template_that_many_texts_share(spark, monkeypatch):
    """Crowded buckets of texts that aren't linked are dealt anew by rare shingles, and lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(3)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"u{k // 2}w{j}" for j in range(25)]
        own[r.randrange(25)] = f"x{k}"
        rows.append((k, " ".join(template + own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    inner = neardup._shared_rare
    monkeypatch.setattr(neardup, "_shared_rare", lambda *a: seen.append(1) or inner(*a))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs).collect()}
    assert got == components_by_brute_force(rows) and len({c for _, c in got.values()}) < 60 and seen


def test_words_that_polynomial_hashes_confuse(spark):
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2)}


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        neardup.components(links, Scratch(spark), rounds=2)


def test_skew_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(_common, "SALTED_ROWS", 10)
    monkeypatch.setattr(_common, "HOT_KEYS", 5)
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    small = spark.range(0, 120, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = _common.skew_join(big, small, ["k"], "id", how=how)
        assert "SortMergeJoin" not in how and sorted(map(str, got.collect())) == sorted(map(str, big.join(small, ["k"], how).collect()))


def test_near_duplicates_leave_one_table(spark, sf_dir):
    before = set(folders(spark))
    neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)).count()
    assert len(set(folders(spark)) - before) == 1


def folders(spark):
    from pathlib import Path

    folder = Path(_common.scratch_dir(spark).removeprefix("file://"), "marlstone")
    return [p.name for p in folder.iterdir()] if folder.exists() else []


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])
    regs = lambda x: neardup.registers(x, np.array([0]))[0]
    assert (np.maximum(regs(a), regs(b)) == regs(np.union1d(a, b))).all()
    more, less = (regs(a) > regs(b)).sum(), (regs(a) < regs(b)).sum()
    size = np.array([2000])
    assert neardup.likely(size, size, np.array([more]), np.array([less]), 0.55)[0]  # the similarity is 1600 / 2400
    assert not neardup.likely(size, size, np.array([more]), np.array([less]), 0.8)[0]


def test_components_of_paths_and_cycles(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a bigint, b bigint")
    got = {r.rep: r.comp for r in neardup.components(links, Scratch(spark)).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_deduplicate(spark):
    docs = documents(spark)
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 15] and left.filter("doc_id IS NULL").count() == 1


def test_sharding_laws(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.range(1000, 1500).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("hot").alias("source")))
    rows = sharding.interleave(docs).collect()
    again = sharding.interleave(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 24
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    hot = Counter(r.shard for r in rows if r.shard_source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 3
    assert sorted(r.position for r in rows) == list(range(len(rows)))


def test_sharding_odd_rows(spark):
    rows = sharding.interleave(documents(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.size for r in rows if r.doc_id in (4, 5)} == {8}
    assert sharding.interleave(empty(spark)).count() == 0


def targets_by_iteration(sizes):
    """Targets by handing out excess again and again."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weights[s] / open_weight for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing_targets_and_takes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.expr("CASE WHEN doc_id % 50 = 0 THEN 'tiny' WHEN doc_id % 7 = 0 THEN NULL ELSE source END"))
    rows = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.mix_source] += r.size
        taken[r.mix_source] += r.taken
        longest[r.mix_source] = max(longest[r.mix_source], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    want = targets_by_iteration(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.mix_source], rel_tol=1e-9) and r.source_size == sizes[r.mix_source]
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_pivotal_rounding_keeps_expectations(spark):
    """Over many draws, each document is taken as often as its probability says."""
    rows = spark.range(4000).select(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")).alias("key"), F.floor(F.col("id") / 200).alias("place"), F.lit(0.3).alias("p"), (1.0 + F.col("id") % 3).alias("w"), F.xxhash64("id").alias("draw"), (F.col("id") % 3).alias("item"))
    got = mixing.pivotal_round(rows, 5, 19, Scratch(spark)).groupBy("item").agg(F.avg("take").alias("m")).collect()
    assert len(got) == 3 and all(abs(r.m - 0.3) < 0.04 for r in got)


def test_mixing_odd_rows(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.taken == 0 for r in rows if r.size == 0)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows if r.taken)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_mixing_rows_that_repeat(spark, monkeypatch):
    """Rows equal in all columns, more of them than a task's share, come as often as the mix takes them all."""
    monkeypatch.setattr(mixing, "MANY", 20)
    rows = [(7, "one text of five words", "a")] * 500 + [(k, f"text number {k} of six words", "bcd"[k % 3]) for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    assert got == Counter({k: n for k, n in copies.items() if n}) and got[7] > 20


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000, 4097])
def test_permutation_is_a_bijection(n):
    x = np.arange(n)
    y = token_shards.permute(x, n)
    assert sorted(y.tolist()) == x.tolist() and token_shards.permute(y, n, inverse=True).tolist() == x.tolist()
    if n >= 1000:
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.15


def test_token_shards_round_trip(spark, tmp_path):
    docs = documents(spark)
    placed = token_shards.text_sequences(docs, shard_slots=64)
    rows = placed.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    token_shards.write_shards(placed, f"file://{tmp_path}/out")
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    found = defaultdict(dict)
    stride = token_shards.HEADER + token_shards.SEQUENCE + 1
    for shard, f in enumerate(files):
        data = f.read_bytes()
        assert len(data) % stride == 0
        for k, (doc, seq, ids) in enumerate(token_shards.read_records(data, 0, len(data) // stride)):
            found[shard * 64 + k] = (doc, seq, ids)
    for r in rows:
        assert found[r.slot][:2] == (r.doc_id, r.seq) and len(found[r.slot][2]) == r.n_tokens and r.shard_offset == r.slot % 64 * stride
    texts = defaultdict(dict)
    for doc, seq, ids in found.values():
        texts[doc][seq] = ids
    want = {-1 if i is None else i: (t or "").encode() for i, t, _ in TEXTS if t and i != 13}
    assert {i: b"".join(p[k] for k in sorted(p)) for i, p in texts.items() if i != 13} == want
    again = token_shards.text_sequences(docs.repartition(5), shard_slots=64).select("doc_id", "seq", "slot").filter("doc_id <> 13")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.seq, r.slot) for r in rows if r.doc_id != 13)
    assert token_shards.text_sequences(empty(spark)).count() == 0


def test_stored_shards_hold_the_documents(spark):
    """Shards written with a real vocabulary and read back record by record."""
    from marlstone.llm import bpe
    from marlstone.llm.queries import tokenizer_file

    path = tokenizer_file("word_bpe_49k.json")
    options = {"shard_slots": 64, "file_slots": 16}
    with Scratch(spark) as scratch:
        placed = token_shards.sequences(documents(spark), "doc_id", "text", token_shards.token_ids(path), width=2, shard_slots=64, scratch=scratch)
        out = f"{scratch.folder}-shards"
        token_shards.write_shards(placed, out, 16)
        want = sorted((r.doc_id, r.seq, r.n_tokens, r.slot, r.shard, r.shard_offset, bytes(r.record)) for r in placed.collect())
    got = token_shards.stored_records(spark, out, width=2, **options).collect()
    assert sorted((r.doc_id, r.seq, r.n_tokens, r.slot, r.shard, r.shard_offset, bytes(r.record)) for r in got) == want and len({r.shard for r in got}) > 2
    ids = defaultdict(dict)
    for r in got:
        ids[r.doc_id][r.seq] = bytes(r.record)[16 : 16 + 2 * r.n_tokens]
    encoder = bpe.load(path)
    for i, t, _ in TEXTS:
        if i != 13 and t and t.strip():
            assert np.frombuffer(b"".join(ids[-1 if i is None else i][k] for k in sorted(ids[-1 if i is None else i])), "<u2").tolist() == np.frombuffer(encoder.encode(t), "<u4").tolist()
    assert token_shards.digest_shards(empty(spark), path).count() == 0


def test_packed_ids(spark):
    lists = spark.createDataFrame([(1, [1, 70000]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    rows = token_shards.sequences(lists, "doc_id", "ids", lambda c: token_shards.pack(c, F.lit(4)), width=4).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 2)] and rows[0].record[16:24] == np.array([1, 70000], "<u4").tobytes()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site name</h2></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad --><{tag}><h1>A  title &amp; more</h1><p><b>First.<br><p>Second
 part &lt;x&gt; of it, with some more words.</p><div class="ad">Buy now</div><form><input><button>Send</button></form><p>Last w<em>or</em>d.</p></{end}>
<section id="comments"><p>Nice read, thank you very much indeed</p></section><aside class="sidebar">Popular posts</aside><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div class='post-content'", "div"])
def test_extract_main_text(tag):
    page = PAGE.replace("{tag}", tag).replace("{end}", tag.split()[0])
    assert html_extract.extract(page) == "A title & more First. Second part <x> of it, with some more words. Last word."


BAR = '<ul class="menu">' + '<li><a href="#">Some link words</a></li>' * 8 + "</ul>"
PROSE = "<p>" + "Plain words of the text itself run on and on here. " * 4 + "</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        # A notice that nothing names: only the scan leaves it out.
        (f"<body><div>Please note our hours</div>{BAR}<div>{PROSE}</div><div><table>{'<tr><td>x</td></tr>' * 30}</table></div></body>", 1),
        (f"<body><div class='wrap'><p>Welcome here</p>{BAR}{PROSE}{PROSE}{BAR}<p>All rights</p></div></body>", 2),
        (f"<body><div>{PROSE}<div class='ad'>Buy it now</div><p>Last.</p></div><div class='sidebar'>Popular posts</div></body>", 1),
    ],
)
def test_the_scan_decides(page, want):
    weights = html_extract.DEFAULT
    prose = " ".join(re.sub("<[^>]+>", "", PROSE).split())
    p = html_extract.Page(page)
    got = html_extract.extract(page)
    assert got in (" ".join([prose] * want), prose + " Last.")
    whole = (0, len(p.kind))
    assert p.blocks(whole, p.dropped(whole, weights)) != got


@pytest.mark.parametrize("name", ["comments", "entry-comments", "post-comments", "commentList", "article-comment-section"])
def test_reader_comments_go(name):
    for page in (f"<article>{PROSE}<div class='{name}'><p>Nice read, thanks to you all</p></div></article>", f"<div>{PROSE}</div><div id='{name}'><p>{'Nice read. ' * 30}</p></div>"):
        assert "Nice" not in html_extract.extract(page)
    assert html_extract.extract(f"<div class='post has-comments'>{PROSE}</div>").startswith("Plain words")


def test_text_behind_letters_that_lower_to_two():
    page = "<p>" + "İ" * 60 + "</p><SCRIPT>var x = 1;</Script><p>the words that follow are all kept</p>"
    assert html_extract.extract(page) == "İ" * 60 + " the words that follow are all kept"


def test_unmatched_tags_cost_nothing():
    import time

    n = 60_000
    for page in ("<b>" * n + "</i>" * n, "<i>" * n + "</div>" * n, "<i><article>" + "<b>" * n + "</i>" * n, "<p>a" * n):
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 20  # a quadratic reader takes minutes


def test_ties_of_weights():
    """On a page whose text all weights find, the weights in the middle of the grid are taken; without labels the default."""
    page = f"<body><nav><a>Home page</a></nav><article>{PROSE}</article><footer>The end of it</footer></body>"
    weights = html_extract.fit([page] * 3)
    assert weights in html_extract.GRID and weights not in (html_extract.GRID[0], html_extract.GRID[-1]) and weights == html_extract.fit([page] * 3)
    assert html_extract.fit([]) == html_extract.fit(["<p>no label</p>"]) == html_extract.DEFAULT


def test_extract_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "just text"), (4, "u", "<p>open <b>tags"), (5, "u", "<" * 5000), (6, "u", "<div>" * 3000 + "deep words here"), (7, "u", "<!-- never closed"), (7, "u", "<p>same id</p>"), (8, None, PAGE[:300])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    texts = {(r.page_id, r.text) for r in got.collect()}
    assert {(1, ""), (2, ""), (3, "just text"), (4, "open tags"), (6, "deep words here"), (7, ""), (7, "same id")} <= texts
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_region_is_the_best_contiguous_run():
    page = html_extract.Page("<div><p>one two three</p><p>a</p><hr><hr><hr><hr><hr><p>four five six seven eight</p></div>")
    worth = [-1.0 if k < 0 else float(n) for k, n in zip(page.kind, page.size)]
    best = max((sum(worth[a:b]), -a, b) for a in range(len(worth)) for b in range(a, len(worth) + 1))
    a, b = page.region((-1.0, -2.0, -6.0))
    assert sum(worth[a:b]) == best[0]


def test_articles_of_the_table(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: " ".join(html.unescape(re.sub("<[^>]+>", " ", re.search("<article>(.*?)</article>", r.html, re.S)[1])).split()) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()} == want


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    from marlstone.llm import bpe, pii, quality
    from marlstone.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    groups = components_by_brute_force([(i, t) for i, t, _ in rows])
    rows = [(i, t, s) for i, t, s in rows if groups[i][1] == i]
    spans = pii.find([t for _, t, _ in rows])
    rows = [(i, pii.redact(t, every), s) for (i, t, s), (_, every) in zip(rows, spans)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    copies = {r.doc_id: r.copies for r in mixed if r.taken}
    encoder = bpe.load(tokenizer_file("word_bpe_49k.json"))
    digest = {i: hashlib.sha256(encoder.encode(t)).hexdigest() for i, t, _ in rows}
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == Counter({(i, digest[i]): n for i, n in copies.items()})


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and docs.columns == empty(spark).columns


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))
