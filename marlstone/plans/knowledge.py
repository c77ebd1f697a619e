"""Graph building from texts, and document relations, over texts made of the tables' own fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators import extract as E
from marlstone.operators import retrieval as R
from marlstone.operators import simjoin as S
from marlstone.operators._lineage import cut
from marlstone.plans._base import query
from marlstone.plans.graphs import _EDGES, _NODES, _edges, _nodes

_SENTENCES = "s AS (SELECT o_orderkey AS id, '依据《' || o_orderpriority || '》第' || (o_orderkey % 90 + 1) || '条，' || year(o_orderdate) || '年的项目方法：' || o_orderstatus || '类，' || (o_custkey % 50) || '号。' AS text FROM orders)"


def _sentences(t):
    """Sentences about orders in the style of the texts that the patterns are for."""
    c = lambda x: F.col(x).cast("string")
    text = F.concat(F.lit("依据《"), "o_orderpriority", F.lit("》第"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("条，"), F.year("o_orderdate").cast("string"), F.lit("年的项目方法："), c("o_orderstatus"), F.lit("类，"), (F.col("o_custkey") % 50).cast("string"), F.lit("号。"))
    return t("orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query("G7_text_entities", f"WITH {_SENTENCES} SELECT id, regexp_extract(text, '《([^》]+)》', 1) AS name, 'law' AS type FROM s UNION ALL SELECT id, regexp_extract(text, '(第[0-9]+条)', 1), 'term' FROM s UNION ALL SELECT id, regexp_extract(text, '([0-9]{{4}}年)', 1), 'time' FROM s UNION ALL SELECT id, '项目方法', 'concept' FROM s")
def text_entities(t):
    return E.entities(_sentences(t), "id", "text")


@query("G9_implicit_triples", f"""WITH {_SENTENCES}, p AS (SELECT id, regexp_extract(text, '《([^》]+)》', 1) AS law, regexp_extract(text, '(第[0-9]+条)', 1) AS art, regexp_extract(text, '：(.*)。', 1) AS items FROM s)
SELECT id, law AS head, 'includes' AS relation, art AS tail, 0.9::DOUBLE AS weight FROM p UNION ALL SELECT id, '项目方法', 'includes', i, 0.7 FROM (SELECT id, unnest(string_split(items, '，')) AS i FROM p) WHERE length(i) >= 2""")
def implicit_triples(t):
    return E.implicit_triples(_sentences(t), "id", "text")


_ATTR = "a AS (SELECT p_partkey AS id, (['知识图谱', '检索系统', '向量模型', '数据平台'])[p_partkey % 4 + 1] AS head, (['分为', '基于'])[p_partkey % 2 + 1] AS verb, CASE WHEN p_partkey % 2 = 0 THEN '甲类方法、乙类方法' ELSE '统一存储' END AS tail FROM part)"


def _statements(t):
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    text = F.concat(pick(["知识图谱", "检索系统", "向量模型", "数据平台"], k % 4), pick(["分为", "基于"], k % 2), F.when(k % 2 == 0, F.lit("甲类方法、乙类方法")).otherwise(F.lit("统一存储")), F.lit("。"))
    return t("part").select(k.alias("id"), text.alias("text"))


def _known(t):
    return t("region").limit(1).select(F.explode(F.array(*map(F.lit, ["知识图谱", "检索系统", "向量模型", "数据平台"]))).alias("name"))


@query("G13_attribute_edges", f"WITH {_ATTR} SELECT id, head, CASE verb WHEN '分为' THEN 'includes' ELSE 'depends_on' END AS relation, unnest(string_split(tail, '、')) AS tail, 0.7::DOUBLE AS weight FROM a")
def attribute_edges(t):
    return E.attribute_edges(_statements(t), "id", "text", _known(t))


@query("G6_text_graph", f"""WITH {_ATTR}, e AS (SELECT id, head, verb, unnest(string_split(tail, '、')) AS tail FROM a),
u AS (SELECT id, head, CASE verb WHEN '分为' THEN 'includes' ELSE 'depends_on' END AS relation, tail, 0.7 AS weight FROM e UNION ALL SELECT id, head, 'has_type', tail, 0.8 FROM e WHERE verb = '分为' UNION ALL SELECT id, '甲类方法', 'co_occurs_with', '乙类方法', 0.3 FROM a WHERE verb = '分为')
SELECT head, relation, tail, max(weight)::DOUBLE AS weight, count(DISTINCT id) AS n_docs FROM u GROUP BY ALL""")
def text_graph(t):
    return E.text_graph(_statements(t), "id", "text", _known(t))[1]


@query("G8_validated_triples", f"""WITH x AS (SELECT p_partkey AS id, p_partkey % 3 AS k FROM part) SELECT id, '某类行为' AS head, CASE k WHEN 0 THEN 'constitutes' WHEN 1 THEN 'not_constitutes' ELSE 'excludes' END AS relation, '侵权责任' AS tail FROM x""")
def validated_triples(t):
    k = F.col("p_partkey") % 3
    text = F.concat(F.lit("某类行为"), F.when(k == 0, "构成").when(k == 1, "尚不构成").otherwise("不属于"), F.lit("侵权责任。"))
    docs = t("part").select(F.col("p_partkey").alias("id"), text.alias("text"), F.when(k == 2, "belongs_to").otherwise("constitutes").alias("relation"))
    triples = docs.select("id", F.lit("某类行为").alias("head"), "relation", F.lit("侵权责任").alias("tail"))
    more = triples.limit(3).withColumn("tail", F.lit("一个"))  # no valid name: left out
    return E.validated(triples.unionByName(more), docs, "id", "text")


@query("G5_answer_context", f"""WITH {_NODES}, e AS (SELECT label, type, row_number() OVER (ORDER BY id) AS place FROM nodes WHERE type = 'nation' ORDER BY id LIMIT 10), p AS (SELECT n_name AS a, r_name AS b, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY n_nationkey LIMIT 5)
SELECT 'entities:' || chr(10) || (SELECT string_agg('- ' || label || ' (' || type || ')', chr(10) ORDER BY place) FROM e) || chr(10) || chr(10) || 'relations:' || chr(10) || (SELECT string_agg('- ' || a || ' → ' || b, chr(10) ORDER BY place) FROM p) AS context""")
def answer_context(t):
    found = _nodes(t).filter("type = 'nation'").orderBy("id").limit(10).select("label", "type", F.col("id").alias("place"))
    paths = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("start"), F.col("r_name").alias("end"), F.col("n_nationkey").alias("place"))
    return E.answer_context(found, paths)


@query("G4_paths_within_two", f"WITH {_EDGES}, u AS (SELECT DISTINCT source AS x, target AS y FROM edges WHERE relation = 'in' UNION SELECT target, source FROM edges WHERE relation = 'in'), s AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey < 8), p AS (SELECT a.id AS a, b.id AS b FROM s a JOIN u x ON x.x = a.id JOIN u y ON y.x = x.y JOIN s b ON b.id = y.y AND a.id < b.id GROUP BY ALL) SELECT a, b FROM p ORDER BY a, b LIMIT 5")
def paths_within_two(t):
    """Of the entities of a question, pairs that two edges join, five at most."""
    e = _edges(t).filter("relation = 'in'").select(F.col("source").alias("x"), F.col("target").alias("y"))
    u = e.union(e.select("y", "x")).distinct()
    s = t("nation").filter("n_nationkey < 8").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"))
    one = s.join(u, F.col("a") == F.col("x")).select("a", F.col("y").alias("mid"))
    two = one.join(u.select(F.col("x").alias("mid"), F.col("y").alias("b")), "mid").join(s.select(F.col("a").alias("b")), "b", "left_semi")
    return two.filter("a < b").select("a", "b").distinct().orderBy("a", "b").limit(5)


@query("G14_document_relations", r"""WITH g AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS tags, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS ws FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.tags, b.tags)) AS t, len(a.tags) + len(b.tags) AS tn, len(list_intersect(a.ws, b.ws)) AS k, len(a.ws) + len(b.ws) AS kn FROM g a JOIN g b ON a.item_id < b.item_id),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
u AS (SELECT a, b, 'thematic_similarity' AS relation, least(1.0, 2 * t / (tn - t)) AS weight FROM p WHERE t > 0 AND t / (tn - t) >= 0.2
UNION ALL SELECT a, b, CASE WHEN k >= 3 THEN 'shared_entities' ELSE 'thematic_similarity' END, least(1.0, k / (kn - k) * 1.5 + 0.2) FROM p WHERE k > 0 AND (k >= 3 OR k / (kn - k) >= 0.15)
UNION ALL SELECT a.vec_id, b.vec_id, 'semantic_similarity', least(1.0, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.6 * sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))
SELECT a, b, round(max(weight), 6)::DOUBLE AS weight, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM u GROUP BY a, b""")
def document_relations(t):
    """Relations of three kinds, merged by pair: tags (words of nine letters or more) in common, keywords in common, and vectors of a cosine of 0.6."""
    items = t("benchmark").select("item_id", T.matches(F.lower("text"), "[a-z]{9,}").alias("tags"), T.matches(F.lower("text"), "[a-z]{4,}").alias("ws"))
    jaccard = lambda k, m, n: k / (m + n - k)

    def pairs(column, need, accept, weight):
        """Pairs of items by classes of equal sets; a class's own items are pairs, too."""
        classes = cut(S.set_classes(items, "item_id", column), "classes")
        found = S.similar_sets(classes, need, accept).select("a", "b", "k")
        found = found.unionByName(classes.filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.size("terms").cast("long").alias("k")))
        of = items.select(F.col("item_id"), F.array_sort(F.array_distinct(column)).alias("terms")).join(classes.select("terms", "class_id"), "terms")
        side = lambda end: of.select(F.col("class_id").alias(end), F.col("item_id").alias(f"i_{end}"), F.size("terms").alias(f"m_{end}"))
        # A class and itself: each pair once. Two classes: each of one with each of the other, as edges between items are the result here.
        rows = found.join(side("a"), "a").join(side("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("i_a") < F.col("i_b")))
        kind, w = weight(F.col("k"), jaccard(F.col("k"), F.col("m_a"), F.col("m_b")))
        return rows.select(F.col("i_a").alias("a"), F.col("i_b").alias("b"), kind.alias("relation"), F.least(F.lit(1.0), w).alias("weight"))

    tags = pairs("tags", lambda m: F.ceil(0.2 * m - 1e-9), lambda k, m, n: jaccard(k, m, n) >= 0.2, lambda k, j: (F.lit("thematic_similarity"), 2 * j))
    few = lambda m: F.when(m <= 6, 1).when(m <= 13, 2).otherwise(3)
    words = pairs("ws", few, lambda k, m, n: (k >= 3) | (jaccard(k, m, n) >= 0.15), lambda k, j: (F.when(k >= 3, "shared_entities").otherwise("thematic_similarity"), j * 1.5 + 0.2))
    vectors = t("embeddings").join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = R.vector_neighbours(vectors, "vec_id", "embedding", 0.6).select(F.col("id").alias("a"), F.explode("neighbours").alias("b")).filter("a < b")
    of = lambda c, v: vectors.select(F.col("vec_id").alias(c), F.col("embedding").cast("array<double>").alias(v))
    near = near.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", F.lit("semantic_similarity").alias("relation"), F.least(F.lit(1.0), V.cosine(F.col("x"), F.col("y"))).alias("weight"))
    return E.merged_relations([tags, words, near]).withColumn("weight", F.round("weight", 6))


@query("G19_alias_upsert", "WITH o AS (SELECT lower(n_name) AS alias, r_name AS term FROM nation JOIN region ON r_regionkey = n_regionkey), u AS (SELECT lower(n_name) AS alias, 'elsewhere' AS term FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'nowhere', 'elsewhere') SELECT coalesce(u.alias, o.alias) AS alias, coalesce(u.term, o.term) AS term FROM o FULL JOIN u USING (alias)")
def alias_upsert(t):
    """A table of aliases with new and changed ones put in."""
    old = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("n_name").alias("alias"), F.col("r_name").alias("term"))
    new = t("nation").filter("n_nationkey % 5 = 0").select(F.lower("n_name").alias("alias")).union(t("region").limit(1).select(F.lit("nowhere"))).withColumn("new", F.lit("elsewhere"))
    return old.join(new, "alias", "full").select("alias", F.coalesce("new", "term").alias("term"))
