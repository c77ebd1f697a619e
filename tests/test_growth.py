"""What lies on disk and what is done again and again must grow with the rows, not with their pairs or their shuffles."""

import random
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.operators import extract, filegraph
from marlstone.operators import index as I
from marlstone.plans import registry


def _held(spark) -> dict[Path, int]:
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {f: f.stat().st_size for f in Path(folder).rglob("*.parquet") if f.is_file()}


def _added(spark, before: dict[Path, int]) -> int:
    return sum(n for f, n in _held(spark).items() if f not in before)


def _files(spark, n: int):
    r = random.Random(5)
    words = [f"word{k}" for k in range(60)]
    rows = [(k, f"host{k % 3}/s{k % 2}/{' '.join(r.sample(words, 2))}.md", words[k % 7], [words[k % 5]], " ".join(r.sample(words, 40))) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "id bigint, path string, name string, headings array<string>, content string")


def test_candidates_write_files_but_no_pairs(spark, monkeypatch):
    files, before = _files(spark, 160), _held(spark)
    whole = filegraph.candidates(files).collect()
    assert len(whole) > 160 * 159 / 4 and _added(spark, before) < 160 * 1000
    monkeypatch.setattr(filegraph, "BLOCK", 25)
    assert sorted(filegraph.candidates(files).collect()) == sorted(whole)


def test_edges_need_the_first_candidates_of_files_only(spark):
    r = random.Random(6)
    pairs = r.sample([(a, b) for a in range(40) for b in range(a + 1, 40)], 500)
    # A file's folder is its number modulo five; a candidate of two files of a folder may be one of that folder.
    rows = [(a, b, "t", round(r.random(), 2), f"f{a % 5}" if a % 5 == b % 5 and r.random() < 0.9 else None) for a, b in pairs]
    found = spark.createDataFrame(rows, "a bigint, b bigint, type string, score double, folder string")
    links = {(0, 1), (0, 2), (3, 4), (0, 5), (0, 6)}
    degree, folders, want = Counter(x for p in links for x in p), Counter(), set()
    for a, b, _, s, f in sorted(rows, key=lambda e: (-e[3], e[0], e[1])):
        if (degree[a] < 3 or degree[b] < 3) and not (f and folders[f] >= 2):
            folders[f] += 1
            degree.update((a, b))
            want.add((a, b))
    got = {(e.a, e.b) for e in filegraph.graph(found, spark.createDataFrame(sorted(links), "source bigint, target bigint")).collect()}
    assert got == want | links
    keyed = found.withColumn("k", F.struct((-F.col("score")).alias("s"), "a", "b"))
    assert filegraph.firsts(keyed, 3).count() < 300


def _shuffled(spark) -> int:
    """Bytes of shuffle files that are there."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*") if f.is_file())


def _texts(spark, n: int):
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 300))) + r.choice(["", " 3.5 3.5", " 知识图谱", " !"]), f"s{k % 3}") for k in range(n)]
    return spark.createDataFrame([*rows, (n, "", "s"), (n + 1, None, "s"), (n + 2, "...", "s")], "id bigint, text string, source string")


def test_an_index_leaves_neither_tokens_nor_shuffles(spark):
    docs, held, before = _texts(spark, 400), _held(spark), _shuffled(spark)
    ix = I.build(docs, "id", "text", ("source",))
    beside = sum(f.stat().st_size for f in _held(spark) if f not in held and "/index-" not in str(f))
    assert beside < 20_000 and _shuffled(spark) - before < 20_000
    got = {(r.token, r.id): (r.tf, r.dl, r.source) for r in I.hits(ix).collect()}
    tokens = [(r.id, r.source, r.t) for r in docs.filter("length(trim(text)) > 0").select("id", "source", I.TOKENIZERS["search"](F.col("text")).alias("t")).collect()]
    assert got == {(w, i): (n, len(t), s) for i, s, t in tokens for w, n in Counter(t).items()} and len(got) > 10_000
    assert {(r.id, r.dl) for r in ix.docs.collect()} == {(i, len(t)) for i, _, t in tokens}


def test_many_queries_are_answered_within_windows(spark, monkeypatch):
    monkeypatch.setattr(I, "WINDOW", 16)
    ix = I.build(_texts(spark, 200), "id", "text")
    asked = spark.createDataFrame([(1, "w1 w2 w2 w3"), (2, "知识 w7"), (3, "nothing"), (4, None), (5, " ".join(f"w{k}" for k in range(200)))], "q bigint, t string")
    found = I.best_for_each(ix, asked, "q", "t", 4)
    got = {q: [] for q in range(1, 6)}
    for r in found.orderBy("query", "rank").collect():
        got[r.query].append((r.id, r.score))
    assert got == {r.q: [(h.id, h.score) for h in I.best(ix, r.t or "", 4).orderBy("rank").collect()] for r in asked.collect()}


def _rows_joined(df) -> int:
    """The most rows that a join of the plan has made."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_backlinks_of_one_word_are_counted_once(spark, tmp_path):
    heads = ["<h1>Alpha x</h1>", "<h1>Beta</h1>", "", "<h1> y</h1>"]
    links = ['<a href="/Alpha">', '<a href="/Alpha"><a href="/Alpha"><a href="/Beta">', '<a href="/">', "", '<a href="/Gamma">']
    pages = [(k, heads[k % 4] + links[k % 5]) for k in range(200)] + [(300, None), (301, "<h1>Gamma</h1>"), (302, '<h1>Own</h1><a href="/Own">')]
    spark.createDataFrame(pages, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = registry.queries()["J12_backlinks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["J12_backlinks"]).fetchall())
    assert sorted(map(tuple, df.select("target", "backlinks").collect())) == want and (301, 40) in want and len(want) > 150
    assert 0 < _rows_joined(df) < 500


def test_implied_triples_look_for_nothing_else(spark, monkeypatch):
    runs, calls, make, real = [], [], extract.F.arrow_udf, extract.scheduled
    monkeypatch.setattr(extract.F, "arrow_udf", lambda run, kind: runs.append(run) or make(run, kind))
    monkeypatch.setattr(extract, "scheduled", lambda spans: calls.append(spans) or real(spans))
    text = "检索系统分为：向量模型、关键词模型。北京大学由张三设计"
    table = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id bigint, text string")
    got = extract.implicit_triples(table, "id", "text").collect()
    assert {(r.id, r.head, r.relation, r.tail, r.weight) for r in got} == {(1, *x) for x in extract.implied(text.split("。")[0])} and got
    calls.clear()
    assert len(list(runs[0](iter([pa.array([text, ""])])))[0]) == 2 and not calls


def test_embedding_links_name_their_neighbours(spark, tmp_path):
    r = random.Random(8)
    vectors = [[round(r.gauss(0, 1), 2) for _ in range(4)] for _ in range(50)]
    rows = [*enumerate([*vectors, *vectors[:10], [0.0] * 4, [0.0] * 4]), (90, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["J9_embedding_links"](spark, str(tmp_path)).select("id", "class_id", "links", "neighbours").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["J9_embedding_links"]).fetchall())
    assert all(x.links == len(x.neighbours) for x in got) and sum(x.links for x in got) > 200


def test_keyword_pairs_name_the_items(spark, tmp_path):
    texts = ["Alpha beta 1", "beta ALPHA 2", "Alpha beta 1", "gamma delta", "gamma, and delta", "beta gamma delta", "omega", "omega omega", "alone", "a 1", "", None]
    spark.createDataFrame([*enumerate(texts, 5)][::-1], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, registry.queries()["J8_keyword_pairs"](spark, str(tmp_path)).select("a", "b", "k").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["J8_keyword_pairs"]).fetchall())
    assert {(5, 6, 2), (5, 7, 2), (8, 9, 2), (11, 12, 1)} < set(got)
