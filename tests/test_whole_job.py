
import io
import json
import re
import zipfile

import duckdb
import numpy as np

from marlstone.operators import chunking, graph, retrieval
from marlstone.plans import pages, registry
from marlstone.sources import formats


def test_tag_pairs_of_all_brands(spark):
    rows = [(1, ["X", "large"]), (2, ["Y", "large"]), (3, ["X", "large"]), (4, ["Z", "small"]), (5, [])]
    items = spark.createDataFrame(rows, "id bigint, tags array<string>")
    classes = graph.tag_classes(items)
    pairs = graph.tag_class_pairs(classes, 0.2)
    assert sorted((r.a, r.b, r.n_a, r.n_b, round(r.similarity, 3)) for r in pairs.collect()) == [(1, 1, 2, 2, 1.0), (1, 2, 2, 1, 0.333)]
    members = {r.id: (r.class_id, r.links) for r in graph.tag_class_members(items, classes, pairs).collect()}
    assert members == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (4, 0)}


def test_all_vector_neighbours(spark):
    v = np.random.default_rng(3).normal(size=(60, 4))
    v[7] = 0
    ids = [5 * k + 1 for k in range(60)]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id bigint, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    close = unit @ unit.T >= 0.6
    want = {i: [j for k, j in enumerate(ids) if close[n, k] and k != n] for n, i in enumerate(ids)}
    for block in (1000, 7):
        got = retrieval.vector_neighbours(table, "id", "v", 0.6, block, strip=3).collect()
        assert {r.id: r.neighbours for r in got} == want and len(got) == 60


def test_vector_links_count_copies(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(40, 3)).round(1).tolist()
    v += [v[2]] * 9 + [v[7]] * 2 + [[0.0, 0.0, 0.0]] * 2 + [None] * 2
    ids = [3 * k for k in range(len(v))]
    table = spark.createDataFrame(list(zip(ids, v)), "id bigint, v array<double>")
    cosine = lambda x, y: np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) if x and y and any(x) and any(y) else -1
    want = {i: (min(j for j, y in zip(ids, v) if y == x), sum(cosine(x, y) >= 0.8 - 1e-12 for j, y in zip(ids, v) if j != i)) for i, x in zip(ids, v)}
    for block in (1000, 9):
        got = {r.id: (r.class_id, r.links) for r in retrieval.vector_links(table, "id", "v", 0.8, block, strip=4).collect()}
        assert got == want


def test_different_texts_of_one_keyword_set_are_linked(spark, tmp_path):
    texts = ["Alpha beta 1", "beta ALPHA 2", "Alpha beta 1", "gamma delta", "gamma, and delta", "beta gamma delta", "omega", "omega omega", "alone", "a 1", "a 2", "", None]
    spark.createDataFrame(list(enumerate(texts, 5)), "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {i: set(re.findall("[a-z]{4,}", (s or "").lower())) for i, s in enumerate(texts, 5)}
    near = lambda x, y: (k := len(x & y)) >= 3 or k and k / len(x | y) >= 0.15
    want = sorted((i, j, len(x & y)) for i, x in words.items() for j, y in words.items() if i < j and near(x, y))
    queries, sql = registry.queries(), registry.oracle_sql()
    pairs = [tuple(r) for r in queries["J8_shared_keywords"](spark, str(tmp_path)).select("a", "b", "n_a", "n_b", "k").collect()]
    groups = {}
    for r in queries["J8_keyword_members"](spark, str(tmp_path)).collect():
        groups.setdefault(r.class_id, []).append(r.id)
    assert all((n, m) == (len(groups[a]), len(groups[b])) for a, b, n, m, _ in pairs)
    assert sorted((min(i, j), max(i, j), k) for a, b, _, _, k in pairs for i in groups[a] for j in groups[b] if a != b or i < j) == want
    assert (5, 6, 2) in want and (11, 12, 1) in want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert sorted(con.execute(sql["J8_shared_keywords"]).fetchall()) == sorted(pairs)


def test_all_links_of_a_page(spark):
    html = "".join(f'<a href="/{k % 13}">x</a>' for k in range(30))
    table = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    every = [f"/{k}" for k in range(13)]
    assert [r.u for r in pages.image_dedup_all(lambda name: table).collect()] == every
    assert [r.u for r in pages._distinct_links(table, 8).collect()] == every[:8]


def test_prose_beside_tables_and_code_is_kept(spark):
    assert chunking.table_chunks("before\n\n| a | b |\n|---|---|\n| 1 | 2 |\nbetween\n| no | separator |\n| 3 | 4 |\nafter") == ["before", "| a | b |\n|---|---|\n| 1 | 2 |", "between", "| no | separator |\n| 3 | 4 |", "after"]
    assert chunking.table_chunks("only prose") == chunking.code_texts("only prose") == ["only prose"]
    assert chunking.table_chunks("") == chunking.code_texts(" \n") == []
    assert chunking.code_texts("before\n```py\nx = 1\ndef f():\n  pass\n```\nafter\n```sh\n```\n```js\nopen") == ["before", "```py\nx = 1\n```", "```py\ndef f():\n  pass\n```", "after", "```sh\n\n```", "```js\nopen\n```"]
    docs = spark.createDataFrame([(1, "a\n```py\nx\n```"), (2, "b")], "id bigint, text string")
    assert [(r.id, r.content) for r in chunking.chunk_with(docs, "id", "text", chunking.code_texts).orderBy("id", "chunk_index").collect()] == [(1, "a"), (1, "```py\nx\n```"), (2, "b")]


def test_readers_keep_all_rows():
    n = 2500
    assert formats.convert("a.csv", "\n".join(["k,v", *(f"{k},x" for k in range(n))]).encode()).count("\n") == n + 1
    assert formats.convert("a.json", json.dumps([{"k": k} for k in range(n)]).encode()).endswith(f"| {n - 1} |")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", "<s>" + "".join(f"<row><c><v>{k}</v></c></row>" for k in range(n)) + "</s>")
    assert formats.convert("a.xlsx", sheet.getvalue()).endswith(f"| {n - 1} |")
    assert formats.markdown_table([["a"], ["1"], ["2"]], 1) == "| a |\n| --- |\n| 1 |"


def test_contained_passages_are_found_behind_any_character(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    passages = {1: long, 2: "short one", 3: "end here", 4: "x", 5: "", 6: "中文 passage of some words", 7: "not there at all", 8: None}
    texts = {1: f'a "{long}" b', 2: "a (short one), then", 3: "so end here.", 4: "axb", 5: "[中文 passage of some words]", 6: "", 7: None, 8: long[1:], 9: "z" * 500 + long + "z" * 500}
    table = lambda rows: spark.createDataFrame(list(rows.items()), "id bigint, text string")
    got = {(r.doc, r.passage) for r in retrieval.containing(table(texts), table(passages), "id", "id").collect()}
    assert got == {(d, p) for d, t in texts.items() for p, s in passages.items() if t is not None and s is not None and s in t}
