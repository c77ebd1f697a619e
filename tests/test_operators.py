"""Micro-fixtures for tokenizers, ranking, graphs, chunkers, readers, cleaning and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.functions import clean, terms, text, vector
from marlstone.operators import chunking, graph, retrieval
from marlstone.sources import formats
from marlstone.streaming import events


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_search_tokens(spark):
    got = one(spark, "知识图谱", text.search_tokens)
    assert sorted(map(len, got)) == [1] * 4 + [2] * 3 + [3] * 2
    assert sorted(one(spark, "foo3 中文 1.5", text.search_tokens)) == sorted(["foo3", "中", "文", "中文", "3", "1.5"])
    assert one(spark, None, text.search_tokens) == [] and one(spark, "", text.search_tokens) == []
    assert one(spark, "Ärger im Café_1 中文", text.words) == ["ärger", "im", "café_1", "中文"]
    assert one(spark, "an a", lambda c: text.bigrams(text.words(c))) == ["an"]


def test_quality(spark):
    score = lambda s: one(spark, s, text.quality_score)
    assert score(None) == score("") == score("  ") == 0.0
    assert score("This is a normal sentence with enough words to be good.") == 1.0
    assert score("1234567890123456") <= 0.4 + 1e-9
    assert score("This is fine text, yes, it is.\n\nThis is fine text, yes, it is.") == pytest.approx(0.8)
    assert score("This is fine text but aaaaa it repeats a letter") == pytest.approx(0.7)


def test_canonical_url(spark):
    url = lambda s: one(spark, s, text.canonical_url)
    assert url(" HTTPS://Example.COM/Path/?b=1#top ") == "https://example.com/Path?b=1" and url("http://a.b/") == "http://a.b"


def test_fusion_ties_and_missing_ids(spark):
    rows = lambda *ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id bigint, rank int")
    fused = {r.id: r for r in retrieval.rrf([("vector", rows(1, 2, None), 0.6), ("keyword", rows(2, 3), 0.4)]).collect()}
    assert set(fused) == {1, 2, 3} and fused[2].sources == "keyword,vector" and fused[2].score == pytest.approx(0.6 / 62 + 0.4 / 61)
    best = retrieval.top(spark.createDataFrame([(5, 1.0), (3, 1.0), (4, 2.0)], "id bigint, score double"), 2)
    assert [(r.id, r["rank"]) for r in best.orderBy("rank").collect()] == [(4, 1), (3, 2)]


def test_bm25_ranks_the_rare_term_first(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "  "), (4, None), (5, "delta")], "id bigint, text string")
    got = retrieval.top(retrieval.bm25(docs, "alpha beta", "id", "text"), 5).collect()
    assert [r.id for r in got] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.bm25(spark.createDataFrame([(1, "a")], "id bigint, text string"), "x" * 20_000, "id", "text")


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], lambda v: vector.cosine(v, F.array(F.lit(0.0), F.lit(0.0))), "array<double>") == 0.0
    assert one(spark, [3.0, 4.0], lambda v: vector.cosine(v, v), "array<double>") == pytest.approx(1.0)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "r", 0.3), ("a", "b", "r", 0.8), ("b", "a", "r", 1.0), ("c", "c", "r", 1.0), ("b", "x", "r", 1.0), ("b", "d", "s", 1.0)], "source string, target string, relation string, weight double")
    nodes = spark.createDataFrame([(i,) for i in "abcde"], "id string")
    assert {r.id: r.degree for r in graph.degree(edges).collect()} == {"a": 3, "b": 5, "c": 2, "x": 1, "d": 1}
    merged = {(r.source, r.target): r.weight for r in graph.merge_edges(edges, nodes).collect()}
    assert merged == {("a", "b"): 0.8, ("b", "a"): 1.0, ("c", "c"): 1.0, ("b", "d"): 1.0}
    seeds = nodes.filter("id = 'a'")
    assert {r.id: r.step for r in graph.reach(edges, seeds, 3).collect()} == {"a": 0, "b": 1, "x": 2, "d": 2}
    assert {r.id for r in graph.isolated(nodes, edges).collect()} == {"e"}
    assert [(r.a, r.b, r.weight) for r in graph.merge_pairs(edges).filter("a = 'a'").collect()] == [("a", "b", 1.0)]


def test_packing():
    sentences = " ".join(f"Sentence number {k} is here." for k in range(200))
    chunks = chunking.pack(sentences, 300, 40)
    assert all(0 < len(c) <= 340 for c in chunks) and all(f"number {k} " in " ".join(chunks) for k in range(200))
    assert chunking.pack("", 100, 10) == [] and chunking.pack("x" * 1000, 100, 10)
    with pytest.raises(ValueError):
        chunking.pack("a", 10, 10)
    kids = chunking.parents_and_children("A line. " * 300)
    assert all(len(c) <= 450 + 120 for _, c in kids)
    assert chunking.parents_and_children("short") == [(0, "short")]
    table = "\n".join(["| a | b |", "|---|---|", *[f"| {k} | x |" for k in range(45)]])
    assert [c.count("\n") for c in chunking.table_chunks(table)] == [21, 21, 6] and all(c.startswith("| a | b |") for c in chunking.table_chunks(table))
    assert chunking.code_chunks("```py\nimport x\ndef f():\n  pass\ndef g():\n  pass\n```") == [("py", "import x"), ("py", "def f():\n  pass"), ("py", "def g():\n  pass")]
    assert chunking.qa_chunks("Q: one?\nyes\nQ: two?\nno") == ["one?\nyes", "two?\nno"]
    assert len(chunking.chapters("intro\n第一章 a\nx\n第二章 b\ny")) == 3


def test_chunk_columns(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id bigint, text string")
    assert [(r.id, r.chunk_index, r.content) for r in chunking.fixed_chunks(docs, "id", "text", 3).collect()] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]
    heads = spark.createDataFrame([(1, "pre\n# A\nx\n# B\ny")], "id bigint, text string")
    assert [r.content for r in chunking.heading_chunks(heads, "id", "text").collect()] == ["pre", "# A\nx", "# B\ny"]
    assert chunking.chunk_with(docs, "id", "text", chunking.pack).count() == 1


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_html", ".html"), data)
    return out.getvalue()


def test_readers(spark, tmp_path):
    assert formats.convert("a.csv", b"name,note\na,a|b\nc") == "| name | note |\n| --- | --- |\n| a | a\\|b |\n| c |  |"
    assert formats.convert("a.json", b'[{"a": 1}, {"b": 2}]').startswith("| a | b |") and "## k" in formats.convert("a.json", b'{"k": "v"}')
    assert formats.convert("a.xml", b"<r><a>1</a></r>") == "# r\n- **a**: 1"
    assert formats.convert("a.yaml", b"product: x\nmodules:\n  - one\n") == "- **product**: x\n- **modules**\n  - one"
    assert formats.convert("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'f6rld}") == "Hello\nWörld"
    assert formats.convert("a.svg", b"<svg><text>hi <tspan>you</tspan></text></svg>") == "hi you"
    assert formats.convert("a.odt", _zip(content_xml="<o><h>T</h><p>body</p></o>")) == "T\n\nbody"
    assert formats.convert("a.docx", _zip(word__document_xml="<d><p><t>one</t></p><p><t>two</t></p></d>")) == "one\n\ntwo"
    assert formats.convert("a.epub", _zip(a_html="<h1>T</h1><p>x</p>")) == "# T\n\nx"
    assert formats.convert("a.xlsx", _zip(xl__worksheets__sheet1_xml="<s><row><c><v>1</v></c><c><v>2</v></c></row></s>")) == "| 1 | 2 |\n| --- | --- |"
    assert formats.convert("a.html", b"<nav>x</nav><h2>T</h2><ul><li>a</li></ul><p>b &amp; c</p>") == "## T\n\n- a\n\nb & c"
    with pytest.raises(ValueError):
        formats.convert("a.exe", b"")
    (tmp_path / "a.md").write_bytes("﻿hällo".encode())
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.json").write_bytes(b"{broken")
    got = {r.path.rpartition("/")[2]: r for r in formats.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.md"].text == "hällo" and got["b.exe"].error and got["c.json"].error and len(got["a.md"].content_hash) == 64


def test_reader_columns(spark):
    page = one(spark, "---\na: 1\nb: x: y\n---\nbody", formats.frontmatter)
    assert page.meta == {"a": "1", "b": "x: y"} and page.body == "body"
    rss = "<rss><channel><item><title>T</title><link>http://l</link><pubDate>d</pubDate></item></channel></rss>"
    assert [tuple(i) for i in one(spark, rss, formats.feed_items)] == [("T", "http://l", "d")]
    assert one(spark, "<broken", formats.feed_items) == []
    assert one(spark, "x\n| a | b |\n|---|---|\n| 1 | 2 |\n", formats.markdown_tables) == [["| a | b |", "| 1 | 2 |"]]


def test_cleaning(spark):
    assert one(spark, "a  b\r\n\r\n\r\n\r\n![x](y.png) ", clean.clean_markdown) == "a b\n\n[x]"
    assert one(spark, "a\n- 12 -\nPage 3\nb", clean.drop_page_numbers) == "a\nb"
    assert one(spark, "a  b\n```\nx  y\n```\n| c  d |", clean.clean_outside_code) == "a b\n```\nx  y\n```\n| c  d |"
    assert one(spark, "a\na\nb\na", clean.drop_adjacent_repeats) == "a\nb\na"
    assert one(spark, "# A\ntext\n## B 1", terms.outline_titles) == ["A", "B 1"]
    assert [one(spark, s, clean.heading_level) for s in ("## x", "1.2 x", "第三章", "x")] == [2, 2, 1, 0]
    assert [one(spark, s, clean.line_kind) for s in ("", "# h", "- a", "| a |", "> q", "plain")] == ["blank", "heading", "list_item", "table_row", "quote", "paragraph"]
    red = one(spark, {"token": "t", "query": "abc", "h": "Bearer xyz"}, clean.redact_map, "map<string,string>")
    assert red["token"] == "[REDACTED]" and red["query"].startswith("len=3 sha256=") and red["h"] == "Bearer [REDACTED]"
    assert one(spark, "Ã¤ rger", clean.repair_mojibake) == "ä rger" and one(spark, "ä", clean.repair_mojibake) == "ä"
    assert one(spark, "a/b/c.md", lambda c: terms.folder_affinity(c, F.lit("a/b/d.md"))) == pytest.approx(0.56)
    assert one(spark, "a/x/c.md", lambda c: terms.folder_affinity(c, F.lit("a/b/d.md"))) == pytest.approx(0.07)
    at = F.lit("2024-01-01 08:30:00").cast("timestamp")
    assert [one(spark, s, lambda c: clean.cron_due(c, at)) for s in ("30 8 * * *", "*/15 7-9 * * *", "0 8 * * *", "1,30 8 * * 0")] == [True, True, False, True]
    times = [one(spark, s, lambda c: terms.parsed_time(c).cast("string")) for s in ("Mon, 1 Jan 2024 10:00:00 +0200", "2024-01-01T08:00:00Z", "soon")]
    assert times == ["2024-01-01 08:00:00", "2024-01-01 08:00:00", None]
    diff = one(spark, "a\nb", lambda c: clean.line_diff(c, F.lit("a\nc\nd")))
    assert (diff.added, diff.removed) == (2, 1)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.unionByName(table.limit(50)).repartition(3).write.parquet(f"file://{source}")
    stream = events.read_events(spark, f"file://{source}")
    events.run_available(events.once(stream), f"file://{tmp_path}/once", f"file://{tmp_path}/c1")
    assert spark.read.parquet(f"file://{tmp_path}/once").count() == table.count()
    events.run_available(events.windowed_counts(stream, late="3650 days"), f"file://{tmp_path}/w", f"file://{tmp_path}/c2")
    assert spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"file://{tmp_path}/w").count() >= 0
    query = events.running_last(events.read_events(spark, f"file://{source}")).writeStream.format("memory").queryName("last_types").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c3").start()
    query.awaitTermination()
    assert spark.table("last_types").count() >= table.select("user_id").distinct().count()
    assert events.sessions(events.read_events(spark, f"file://{source}")).isStreaming


def test_partition_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    formats.write_partitioned(rows, f"file://{tmp_path}/t", "k")
    formats.write_partitioned(rows.filter("k = 'a'").withColumn("v", F.lit(9)), f"file://{tmp_path}/t", "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [("a", 9), ("b", 2)]


def test_cjk_terms(spark):
    from marlstone.functions import terms as X

    row = spark.createDataFrame([("知识图谱 foo3 中文 1.5", "笔记-知识图谱2024_the-graph.md")], "a string, b string").select(
        X.full_text_terms(F.col("a")).alias("f"), X.resource_terms(F.col("a")).alias("r"), X.rewrite_terms(F.col("a")).alias("w"), X.file_name_terms(F.col("b")).alias("n")
    ).first()
    assert sorted(row.f) == sorted(["知", "识", "图", "谱", "知识", "识图", "图谱", "知识图", "识图谱", "中", "文", "中文", "foo3", "1", "5"])
    assert row.r == sorted(["知识图谱", "知识", "识图", "图谱", "中文", "foo3"]) and row.w == sorted(["知识图谱", "知识", "识图", "图谱", "中文", "foo3"])
    assert {"graph", "知识", "图谱", "知识图谱2024"} <= set(row.n) and not {"the", "md", "笔记"} & set(row.n)


def test_outline_points_and_dates(spark):
    from marlstone.functions import terms as X

    text = "# One #\n\n```\n# no\n```\n## *Two*\n- a point of some length\n- short\n\n" + "A paragraph that is long enough to be a thesis of the text. " * 2
    row = spark.createDataFrame([(text,)], "t string").select(X.outline_titles(F.col("t")).alias("o"), X.key_points(F.col("t")).alias("k"), X.thesis(F.col("t")).alias("s")).first()
    assert row.o[:1] == ["One"] and "Two" in row.o and row.k[0] == "a point of some length" and row.s.startswith("A paragraph")
    times = spark.createDataFrame([("Sat, 28 Nov 2026 10:00:00 +0100",), ("2026-11-28T09:00:00Z",), ("28 Nov 2026 09:00:00 GMT",), ("2026-11-28T09:00:00",), ("soon",), (None,)], "t string")
    got = [r.u for r in times.select(F.date_format(X.parsed_time(F.col("t")), "yyyy-MM-dd HH:mm").alias("u")).collect()]
    assert got == ["2026-11-28 09:00"] * 4 + [None] * 2


def test_text_graph(spark):
    from marlstone.operators import extract as E

    docs = spark.createDataFrame([(1, "知识图谱分为甲类方法、乙类方法。依据《民法典》第三条，2021年。"), (2, "知识图谱基于统一存储。"), (3, None), (4, "")], "id bigint, t string")
    known = spark.createDataFrame([("知识图谱",)], "name string")
    nodes, edges = E.text_graph(docs, "id", "t", known)
    got = {(r.head, r.relation, r.tail) for r in edges.collect()}
    attributes = {("知识图谱", "includes", "甲类方法"), ("知识图谱", "includes", "乙类方法"), ("知识图谱", "depends_on", "统一存储"), ("民法典", "includes", "第三条")}
    assert got == attributes | {("知识图谱", "has_type", "甲类方法"), ("知识图谱", "has_type", "乙类方法"), ("甲类方法", "co_occurs_with", "乙类方法")}
    kinds = {r.name: r.type for r in nodes.collect()}
    assert kinds["民法典"] == "law" and kinds["2021年"] == "time" and kinds["知识图谱"] == "concept"


def test_splitters(spark):
    from marlstone.operators import chunking as C
    from marlstone.operators import layout as Y

    text = "".join(f"Sentence number {k} is here. " for k in range(200))
    chunks = C.split_long(text, 300, 60)
    assert all(len(c) <= 300 + C.AHEAD and c.endswith(".") for c in chunks[:-1]) and len(chunks) > 10
    assert "".join(C.split_long("x" * 1000, 100, 0)) == "x" * 1000
    with pytest.raises(ValueError):
        C.split_long("x", 100, 100)
    news = "前言\n2026-01-02 正文：第一篇。内容。\n2026-01-03 正文：第二篇。"
    assert C.news_chunks(news) == ["前言", "2026-01-02 正文：第一篇。内容。", "2026-01-03 正文：第二篇。"]
    assert C.packed_parts("第一条 甲。第二条 乙。", "law", 8, 0) == ["第一条 甲。", "第二条 乙。"]
    layout = Y.chunks("# A\ntext\n| a |\n|---|\n| b |\n12\n![x](y)\nend")
    assert [c for *_, c in layout] == ["# A\n\ntext", "| a |\n|---|\n| b |", "![x](y)", "end"]


def test_html_text_and_chains(spark):
    from marlstone.operators import files as L

    page = "<body><nav>menu</nav><article><p>one &amp; two</p><div class='ad'>buy</div><p>three</p></article><footer>f</footer></body>"
    rows = spark.createDataFrame([(page,), (None,), ("<p>bare",)], "h string").select(L.html_text("h").alias("t")).collect()
    assert [r.t for r in rows] == ["one & two three", "", "bare"]
    pages = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 9)], "id bigint, ref bigint")
    assert {r.id: r.chain for r in L.embed_chains(pages).collect()} == {1: [1, 2, 3], 2: [2, 3, 1], 3: [3, 1, 2], 4: [4]}


def test_previous_id_of_a_group(spark):
    from marlstone.operators.ordered import previous

    rows = [(k % 3 or None, k * k) for k in range(200)]
    want = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        want[i] = max((j for h, j in rows if h == g and j < i), default=None)
    docs = spark.createDataFrame(rows, "g int, i long")
    for per_range in (1, 7, 4096):
        assert {r.i: r.before for r in previous(docs, "g", "i", per_range).collect()} == want
    assert previous(docs.filter("i < 0"), "g", "i").collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_degree_capped_edges_are_the_greedy_ones(spark, seed):
    import random

    from marlstone.operators.ordered import degree_capped

    dice = random.Random(seed)
    pairs = sorted({(min(dice.randrange(9), dice.randrange(9)), dice.randrange(9)) for _ in range(60)})
    dice.shuffle(pairs)
    want, degree = [], {}
    for k, (a, b) in enumerate(pairs):
        if degree.get(("a", a), 0) < 2 or degree.get(("b", b), 0) < 2:
            want.append(k)
            for end in (("a", a), ("b", b)):
                degree[end] = degree.get(end, 0) + 1
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a int, b int")
    assert len(want) < len(pairs)
    assert sorted(r.k for r in degree_capped(edges, 2).collect()) == want
    assert degree_capped(edges.filter("k < 0"), 2).collect() == []
