"""Graph queries over the foreign-key graph: region, nation, customer, supplier, part and orders are nodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import graph as G
from marlstone.operators import linking as K
from marlstone.plans._base import query

_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS label, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation
UNION ALL SELECT 'c' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, 'part' FROM part)"""
_EDGES = """edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in' AS relation, 1.0::DOUBLE AS weight FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in', 1.0 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based_in', 1.0 FROM supplier
UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'supplies', l_quantity FROM lineitem)"""


def _nodes(t):
    of = lambda name, p, key, label: t(name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(name).alias("type"))
    out = of("region", "r", "r_regionkey", "r_name")
    for x in (("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name")):
        out = out.unionByName(of(*x))
    return out


def _edges(t):
    def of(name, p, key, q, other, relation, weight=None):
        return t(name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("source"), F.concat(F.lit(q), F.col(other).cast("string")).alias("target"), F.lit(relation).alias("relation"), (F.lit(1.0) if weight is None else F.col(weight)).alias("weight"))

    out = of("nation", "n", "n_nationkey", "r", "n_regionkey", "in")
    out = out.unionByName(of("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in")).unionByName(of("supplier", "s", "s_suppkey", "n", "s_nationkey", "based_in"))
    return out.unionByName(of("lineitem", "s", "l_suppkey", "p", "l_partkey", "supplies", "l_quantity"))


@query("A16_degree", f"WITH {_EDGES}, e AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) SELECT id, count(*) AS degree FROM e GROUP BY id")
def degree(t):
    return G.degree(_edges(t))


@query("A17_edge_merge", f"WITH {_NODES}, {_EDGES} SELECT source, target, relation, max(weight) AS weight FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY ALL")
def edge_merge(t):
    return G.merge_edges(_edges(t), _nodes(t))


@query("A18_pair_merge", f"WITH {_EDGES} SELECT least(source, target) AS a, greatest(source, target) AS b, max(weight) AS weight, arg_min(relation, (-weight, relation)) AS relation, string_agg(DISTINCT relation, ';' ORDER BY relation) AS relations FROM edges GROUP BY 1, 2")
def pair_merge(t):
    return G.merge_pairs(_edges(t))


@query("A19_relation_counts", f"WITH {_EDGES} SELECT relation, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM edges GROUP BY relation")
def relation_counts(t):
    return _edges(t).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


_REACH = """RECURSIVE {edges}, st AS (SELECT DISTINCT source, target FROM edges{back}), w(id, step) AS (SELECT '{seed}', 0 UNION SELECT target, step + 1 FROM w JOIN st ON st.source = w.id WHERE step < {depth}), m AS (SELECT id, min(step) AS step FROM w GROUP BY id)"""
_BACK = " UNION SELECT target, source FROM edges"


@query("G1_k_hop_subgraph", "WITH " + _REACH.format(edges=_EDGES, back=_BACK, seed="r0", depth=2) + " SELECT DISTINCT source, target, relation FROM edges WHERE source IN (SELECT id FROM m WHERE step < 2) OR target IN (SELECT id FROM m WHERE step < 2)")
def k_hop_subgraph(t):
    edges = _edges(t)
    seeds = t("region").filter("r_regionkey = 0").select(F.lit("r0").alias("id"))
    return G.subgraph_edges(edges.select("source", "target", "relation"), G.reach(edges, seeds, 1), 2)


@query("G2_reasoning_path", "WITH " + _REACH.format(edges=_EDGES, back=_BACK, seed="r0", depth=3) + " SELECT id, step FROM m")
def reasoning_path(t):
    seeds = t("region").filter("r_regionkey = 0").select(F.lit("r0").alias("id"))
    return G.reach(_edges(t), seeds, 3)


@query("G3_downstream", "WITH " + _REACH.format(edges=_EDGES, back="", seed="s1", depth=3) + " SELECT id, step FROM m")
def downstream(t):
    seeds = t("supplier").filter("s_suppkey = 1").select(F.lit("s1").alias("id"))
    return G.reach(_edges(t), seeds, 3, directed=True)


@query("G4_two_hop_pairs", f"WITH {_EDGES}, b AS (SELECT source, target FROM edges WHERE relation = 'based_in') SELECT x.source AS a, y.source AS b FROM b x JOIN b y ON x.target = y.target AND x.source < y.source")
def two_hop_pairs(t):
    b = _edges(t).filter("relation = 'based_in'").select("source", "target")
    y = b.select(F.col("source").alias("b"), "target")
    return b.select(F.col("source").alias("a"), "target").join(y, "target").filter("a < b").select("a", "b")


# Edges of large lineitems only, so that most nodes have none.
_FEW = "few AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE l_quantity >= 49)"


@query("G10_isolated_nodes", f"""WITH {_NODES}, {_FEW}, rep AS (SELECT type, min(id) AS target FROM nodes GROUP BY type)
SELECT id AS source, target, 'has_type' AS relation, 0.5::DOUBLE AS weight FROM nodes JOIN rep USING (type) WHERE id <> target AND id NOT IN (SELECT source FROM few) AND id NOT IN (SELECT target FROM few)""")
def isolated_nodes(t):
    """Each node without an edge gets one to its type's representative, the node of the smallest id."""
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    few = t("lineitem").filter("l_quantity >= 49").select(of("s", "l_suppkey").alias("source"), of("p", "l_partkey").alias("target"))
    nodes = _nodes(t)
    first = F.broadcast(nodes.groupBy("type").agg(F.min("id").alias("target")))  # a row a type
    alone = G.isolated(nodes, few).join(first, "type").filter("id <> target")
    return alone.select(F.col("id").alias("source"), "target", F.lit("has_type").alias("relation"), F.lit(0.5).alias("weight"))


@query("G17_delete_cascade", f"WITH {_EDGES} SELECT relation, count(*) AS n FROM edges WHERE source <> 'n3' AND target <> 'n3' GROUP BY relation")
def delete_cascade(t):
    gone = t("nation").filter("n_nationkey = 3").select(F.lit("n3").alias("id"))
    return G.drop_node(_nodes(t), _edges(t), gone)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("J10_edge_labels", f"WITH {_NODES}, {_EDGES} SELECT e.source, e.target, coalesce(a.label, '') AS source_label, coalesce(b.label, '') AS target_label FROM (SELECT DISTINCT source, target FROM edges) e LEFT JOIN nodes a ON a.id = e.source LEFT JOIN nodes b ON b.id = e.target")
def edge_labels(t):
    e = _edges(t).select("source", "target").distinct()
    of = lambda end: _nodes(t).select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    out = e.join(of("source"), "source", "left").join(of("target"), "target", "left")
    return out.select("source", "target", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_label", "target_label")])


@query("J21_related_nodes", f"WITH {_EDGES}, n AS (SELECT target AS id FROM edges WHERE source = 'n1' UNION SELECT source FROM edges WHERE target = 'n1') SELECT id FROM n ORDER BY id LIMIT 20")
def related_nodes(t):
    e = _edges(t)
    near = e.filter("source = 'n1'").select(F.col("target").alias("id")).union(e.filter("target = 'n1'").select("source")).distinct()
    return near.orderBy("id").limit(20)


@query("P7_node_search", f"WITH {_NODES} SELECT id, label FROM nodes WHERE contains(lower(label), '00001') ORDER BY id LIMIT 25")
def node_search(t):
    return _nodes(t).filter(F.contains(F.lower("label"), F.lit("00001"))).select("id", "label").orderBy("id").limit(25)


@query("P8_limit_then_type", f"WITH {_NODES} SELECT id, type FROM (SELECT * FROM nodes ORDER BY id LIMIT 100) WHERE type = 'customer'")
def limit_then_type(t):
    return _nodes(t).orderBy("id").limit(100).filter("type = 'customer'").select("id", "type")


@query("T8_visible_subgraph", f"WITH {_EDGES.replace('edges AS', 'every AS')}, edges AS (SELECT * FROM every WHERE relation <> 'supplies'), e AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id ORDER BY degree DESC, id LIMIT 42) SELECT source, target, count(*) AS n FROM edges WHERE source IN (SELECT id FROM d) AND target IN (SELECT id FROM d) GROUP BY ALL")
def visible_subgraph(t):
    edges = _edges(t).filter("relation <> 'supplies'")
    best = F.broadcast(G.degree(edges).orderBy(F.desc("degree"), "id").limit(42).select("id"))
    kept = edges.join(best.withColumnRenamed("id", "source"), "source", "left_semi").join(best.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


_TAG_CLASSES = """tag AS (SELECT p_partkey AS id, list_sort(list_distinct(list_append(string_split(p_type, ' '), p_brand))) AS tags FROM part),
c AS (SELECT min(id) AS id, count(*) AS n, tags FROM tag WHERE len(tags) > 0 GROUP BY tags)"""


def _tags(t):
    tags = F.concat(F.coalesce(F.split("p_type", " "), F.array().cast("array<string>")), F.array("p_brand"))
    return t("part").select(F.col("p_partkey").alias("id"), F.array_sort(F.array_distinct(F.array_compact(tags))).alias("tags"))


@query("J7_tag_overlap_classes", f"""WITH {_TAG_CLASSES} SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS similarity
FROM c a JOIN c b ON a.id < b.id OR (a.id = b.id AND a.n > 1) WHERE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) >= 0.2""")
def tag_overlap_classes(t):
    """All pairs of parts, of all brands, as pairs of classes of equal tags; J7_tag_overlap_members has the members."""
    return G.tag_class_pairs(G.tag_classes(_tags(t)), 0.2)


@query("J7_tag_overlap_members", f"""WITH {_TAG_CLASSES} SELECT x.id, c.id AS class_id, (SELECT count(*) FROM tag y WHERE y.id <> x.id AND len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags))) >= 0.2) AS links FROM tag x JOIN c ON c.tags = x.tags""")
def tag_overlap_members(t):
    items = _tags(t)
    classes = G.tag_classes(items)
    return G.tag_class_members(items, classes, G.tag_class_pairs(classes, 0.2))


@query("F9_similar_labels", "WITH n AS (SELECT n_nationkey AS id, n_name AS label, list_distinct(string_split(lower(n_name), '')) AS c FROM nation) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 3) AS similarity FROM n a JOIN n b ON a.id < b.id WHERE len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) > 0.3")
def similar_labels(t):
    """All pairs of nations, a table of fixed size."""
    n = t("nation").select(F.col("n_nationkey").alias("a"), F.array_distinct(F.filter(F.split(F.lower("n_name"), ""), lambda c: c != "")).alias("x"))
    s = T.jaccard(F.col("x"), F.col("y"))
    return n.join(F.broadcast(n.toDF("b", "y")), F.col("a") < F.col("b")).filter(s > 0.3).select("a", "b", F.round(s, 3).alias("similarity"))


_TITLE = "string_split(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), ' ')"


@query("J11_entity_linking", f"""WITH n AS (SELECT page_id AS node, unnest([{_TITLE}[1], {_TITLE}[2]]) AS term FROM pages), m AS (SELECT term, count(DISTINCT node) AS nodes FROM n WHERE term <> '' GROUP BY term)
SELECT i.item_id, m.term, m.nodes FROM benchmark i JOIN m ON contains(lower(i.text), m.term)""")
def entity_linking(t):
    """Terms of nodes (pages, whose label and property are the first two words of their titles) that a passage holds, with the number of nodes that have each."""
    words = F.split(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), " ")
    nodes = t("pages").select(F.col("page_id").alias("node"), F.explode(F.array_distinct(F.slice(words, 1, 2))).alias("term")).filter("term <> ''")
    known = nodes.groupBy("term").agg(F.count_distinct("node").alias("nodes"))
    return K.holding(t("benchmark"), known, "item_id", "text").join(known, "term").select(F.col("id").alias("item_id"), "term", "nodes")


@query("F44_page_tree", """WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 4 THEN NULL WHEN p_partkey % 50 = 0 THEN p_partkey + 25 WHEN p_partkey % 50 = 25 THEN p_partkey - 25 ELSE p_partkey // 3 END AS up, p_brand AS title, p_size FROM part),
tr(id, path, depth) AS (SELECT id, title, 0 FROM p WHERE up IS NULL UNION ALL SELECT p.id, tr.path || '/' || p.title, depth + 1 FROM p JOIN tr ON tr.id = p.up)
SELECT tr.id, path, depth, row_number() OVER (PARTITION BY up ORDER BY p_size, title, tr.id) AS place FROM tr JOIN p ON p.id = tr.id""")
def page_tree(t):
    """Parts as pages: most hang on the third of their number, some on each other in circles, which belong to no tree; siblings by size and title."""
    k = F.col("p_partkey")
    up = F.when(k < 4, None).when(k % 50 == 0, k + 25).when(k % 50 == 25, k - 25).otherwise(F.floor(k / 3))
    nodes = t("part").select(k.alias("id"), up.alias("parent"), F.col("p_brand").alias("title"), "p_size")
    found = K.tree_places(nodes).join(nodes, "id")
    place = F.row_number().over(Window.partitionBy("parent").orderBy("p_size", "title", "id"))
    return found.select("id", F.array_join("path", "/").alias("path"), "depth", place.alias("place"))


@query("G12_sentence_cooccurrence", r"""WITH s AS (SELECT item_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS k FROM benchmark),
w AS (SELECT item_id, k, x AS w, row_number() OVER (PARTITION BY item_id, k ORDER BY length(x) DESC, x) AS r FROM (SELECT DISTINCT item_id, k, unnest(regexp_extract_all(lower(s), '[a-z]{6,}')) AS x FROM s))
SELECT least(a.w, b.w) AS a, greatest(a.w, b.w) AS b, count(*) AS n FROM w a JOIN w b ON a.item_id = b.item_id AND a.k = b.k AND b.r BETWEEN a.r + 1 AND a.r + 2 GROUP BY 1, 2""")
def sentence_cooccurrence(t):
    """Each sentence's terms, longest first, are paired with the next two: linear in the terms, by windows instead of a join."""
    s = t("benchmark").select("item_id", F.posexplode(F.split("text", "\\.", -1)).alias("k", "s"))
    w = s.select("item_id", "k", F.explode(F.array_distinct(T.matches(F.lower("s"), "[a-z]{6,}"))).alias("w"))
    order = Window.partitionBy("item_id", "k").orderBy(F.length("w").desc(), "w")
    near = w.select("w", F.array(F.lead("w", 1).over(order), F.lead("w", 2).over(order)).alias("next"))
    pairs = near.select("w", F.explode("next").alias("o")).filter("o IS NOT NULL")
    return pairs.groupBy(F.least("w", "o").alias("a"), F.greatest("w", "o").alias("b")).agg(F.count(F.lit(1)).alias("n"))
