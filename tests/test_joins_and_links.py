"""Similarity joins, greedy edges, terms in texts, words like others, and page trees against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import filegraph, linking, ordered, simjoin
from marlstone.plans import filegraph as plan


def test_sets_with_enough_in_common(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 5)
    r = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    sets = {k: sorted(set(r.choices(words, [1 / (1 + j) for j in range(40)], k=r.randint(0, 9)))) for k in range(80)}
    sets[90], sets[91], sets[92] = sets[3], None, [None, "w1", "w1"]
    items = spark.createDataFrame(list(sets.items()), "id int, ws array<string>")
    classes = simjoin.set_classes(items, "id", "ws")
    need = lambda m: F.when(m <= 6, 1).when(m <= 13, 2).otherwise(3)
    pairs = simjoin.similar_sets(classes, need, lambda k, m, n: (k >= 3) | (k / (m + n - k) >= 0.15))
    plain = {i: frozenset(w for w in s or () if w) for i, s in sets.items()}
    first = {}
    for i in sorted(plain):
        if plain[i]:
            first.setdefault(plain[i], i)
    near = lambda x, y: (k := len(x & y)) >= 3 or k and k / len(x | y) >= 0.15
    reps = sorted((i, s) for s, i in first.items())
    want = sorted((a, b, len(x & y)) for a, x in reps for b, y in reps if a < b and near(x, y))
    assert sorted((p.a, p.b, p.k) for p in pairs.collect()) == want and len(want) > 100
    links = {r.id: (r.class_id, r.links) for r in simjoin.members(items, classes, pairs, "id", "ws").collect()}
    assert links == {i: (first.get(s, i), sum(1 for j, o in plain.items() if j != i and s and o and (s == o or near(s, o)))) for i, s in plain.items()}


@pytest.mark.parametrize("least", [0.2, 0.6])
def test_vectors_with_a_cosine(spark, monkeypatch, least):
    monkeypatch.setattr(simjoin, "BLOCK", 7)
    r = random.Random(2)
    rows = {k: {f"t{min(int(r.expovariate(0.2)), 30)}": r.choice([1.0, 2.1, 3.7]) for _ in range(r.randint(0, 8))} for k in range(70)}
    rows[80] = {"t1": 0.0}
    table = spark.createDataFrame([*rows.items(), (81, None)], "id int, m map<string,double>")
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    cosine = lambda v, w: round(sum(x * w.get(k, 0) for k, x in v.items()) / (norm(v) * norm(w)), 9) if norm(v) and norm(w) else 0
    want = {(a, b): cosine(v, w) for a, v in rows.items() for b, w in rows.items() if a < b and cosine(v, w) >= least}
    got = {(p.a, p.b): p.similarity for p in simjoin.similar_vectors(table, "id", "m", least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want) and len(want) > 20


def test_the_file_graph_is_the_greedy_one(spark, sf_dir):
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    files = plan._files(t).withColumn("path", F.concat(F.substring("path", 1, 1), F.lit("/"), F.element_at(F.split("path", "/"), -1)))  # few folders
    found = filegraph.candidates(files)
    candidates = sorted(found.collect(), key=lambda e: (-e.score, e.a, e.b))
    links = {tuple(sorted((r.source, r.target))) for r in plan._links(t).collect() if r.source != r.target}
    for fixed in (links, set()):
        degree, per_folder, taken = Counter(x for pair in fixed for x in pair), Counter(), set()
        most = 3 if fixed else 5
        for e in candidates:
            if degree[e.a] >= most and degree[e.b] >= most or e.folder and per_folder[e.folder] >= 2:
                continue
            per_folder[e.folder] += 1
            degree[e.a] += 1
            degree[e.b] += 1
            if (e.a, e.b) not in fixed:
                taken.add((e.a, e.b, e.type))
        table = spark.createDataFrame(sorted(fixed), "source bigint, target bigint")
        got = {(e.a, e.b, e.type) for e in filegraph.graph(found, table).collect()}
        assert got == taken | {(*p, "file_link") for p in fixed}
    assert any(e.folder for e in candidates) and links and len({e.type for e in candidates}) >= 2


def test_chains_of_waiting_edges_are_an_error(spark):
    edges = spark.createDataFrame([(k, k, k + 1) for k in range(12)], "k int, a int, b int")
    assert sorted(r.k for r in ordered.degree_capped(edges, 1, one_space=True).collect()) == list(range(12))
    with pytest.raises(RuntimeError):
        ordered.degree_capped(edges.withColumn("g", F.lit("one")), 1, one_space=True, group="g", group_most=12, rounds=0)


@pytest.mark.parametrize("most", [1000, 2])
def test_terms_that_texts_hold(spark, monkeypatch, most):
    monkeypatch.setattr(linking, "AUTOMATON_TERMS", most)
    texts = {1: "The Café opens", 2: "", 3: None, 4: "中文字符 and more", 5: "aaa", 6: "x" * 5000 + "needle"}
    terms = ["café", "THE", "字符", "a", "aa", "needle", "absent", "", None, "the"]
    table = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    words = spark.createDataFrame([(w,) for w in terms], "term string")
    want = sorted({(i, w.lower()) for i, s in texts.items() if s for w in terms if w and w.lower() in s.lower()})
    assert sorted((r.id, r.term) for r in linking.holding(table, words, "id", "text").collect()) == want
    skills = spark.createDataFrame([(7, "The"), (3, "needle"), (9, "a"), (1, "")], "id int, term string")
    assert {r.id: r.skill for r in linking.first_held(table, skills, "id", "text").collect()} == {1: 7, 2: None, 3: None, 4: 9, 5: 9, 6: 3}


def test_words_like_others(spark):
    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(40)] + ["a" * 70]
    asked = ["ab", "aab", "b", "abba", "a" * 80]
    like = lambda a, b: a != b and min(len(a), len(b)) >= 2 and (a in b or b in a or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1)
    table = spark.createDataFrame([(w,) for w in set(words)], "term string")
    got = sorted((r.word, r.term) for r in linking.like_words(table, asked).collect())
    assert got == sorted((q, w) for q in asked for w in set(words) if like(q, w))
    assert linking.like_words(table, []).collect() == []


def test_deep_trees_and_circles(spark):
    parent = {1: None, **{k: k - 1 for k in range(2, 32)}, 40: 41, 41: 42, 42: 40, 43: 40, 50: 99, 51: 50, 60: 60, 70: 5, 71: 5}
    nodes = spark.createDataFrame([(k, p, f"t{k}") for k, p in parent.items()], "id int, parent int, title string")
    got = {r.id: (r.path, r.depth) for r in linking.tree_places(nodes).collect()}
    want = {}
    for k in parent:
        path, at = [], k
        while at is not None and at in parent and len(path) <= 60:
            path.insert(0, f"t{at}")
            at = parent[at]
        if at is None:
            want[k] = (path, len(path) - 1)
    assert got == want and max(d for _, d in want.values()) == 30
    assert linking.tree_places(nodes.filter("id < 0")).count() == 0
