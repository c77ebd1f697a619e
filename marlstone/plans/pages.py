"""Wiki-like page queries, links, permissions, evidence and cleaning, over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import clean as C
from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators import simjoin as S
from marlstone.operators._lineage import cut
from marlstone.operators.linking import like_words
from marlstone.operators.ordered import previous
from marlstone.plans._base import query


@query("P9_wiki_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src7') OR contains(lower(text), 'token =') OR lang = 'fr'")
def wiki_search(t):
    return t("documents").filter(F.contains(F.lower("source"), F.lit("src7")) | F.contains(F.lower("text"), F.lit("token =")) | (F.col("lang") == "fr")).select("doc_id")


@query("P10_page_list", "SELECT p_partkey, p_name FROM part WHERE p_size = 10 ORDER BY p_size, p_name, p_partkey")
def page_list(t):
    return t("part").filter("p_size = 10").orderBy("p_size", "p_name", "p_partkey").select("p_partkey", "p_name")


@query("P11_permissions", """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'editor' END, CASE WHEN s.n >= 40 THEN 'writer' END, 'reader') AS role
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON s.source = d.source""")
def permissions(t):
    """A page's own role, else its space's, else reader."""
    page = t("labels").filter("quality = 1").select("doc_id", F.lit("editor").alias("page_role"))
    space = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n >= 40").select("source", F.lit("writer").alias("space_role"))
    return t("documents").select("doc_id", "source").join(page, "doc_id", "left").join(space, "source", "left").select("doc_id", F.coalesce("page_role", "space_role", F.lit("reader")).alias("role"))


@query("P12_zero_overlap_filter", "SELECT vec_id FROM (SELECT e.vec_id, d.text, e.label FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) WHERE contains(lower(text), 'the') OR contains(lower(text), 'token') OR label / 10.0 >= 0.45")
def zero_overlap_filter(t):
    rows = t("embeddings").select(F.col("vec_id"), "label").join(t("documents").select(F.col("doc_id").alias("vec_id"), F.lower("text").alias("text")), "vec_id")
    overlap = F.exists(F.array(F.lit("the"), F.lit("token")), lambda x: F.contains(F.col("text"), x))
    return rows.filter(overlap | (F.col("label") / 10.0 >= 0.45)).select("vec_id")


@query("P13_scope_and_dates", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-12-31' ORDER BY o_orderkey LIMIT 400")
def scope_and_dates(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").filter(F.col("o_orderstatus").isin("F", "O") & day.between("1995-01-01", "1996-12-31")).orderBy("o_orderkey").limit(400).select("o_orderkey")


@query("P14_freshness_window", "WITH p AS (SELECT page_id, try_cast(nullif(regexp_extract(url, '([0-9]+)$', 1), '') AS INT) AS age FROM pages) SELECT page_id FROM p WHERE age IS NULL OR age <= 500")
def freshness_window(t):
    age = F.regexp_extract("url", "([0-9]+)$", 1).try_cast("int")
    return t("pages").filter(age.isNull() | (age <= 500)).select("page_id")


@query("P17_citation_validity", "WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\(([0-9]+)\\)', 1)) AS n FROM documents) SELECT doc_id, count(*) AS cited, count(*) FILTER (n::INT BETWEEN 1 AND 500) AS valid FROM c GROUP BY doc_id")
def citation_validity(t):
    c = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(([0-9]+)\)"), F.lit(1))).alias("n"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("n").try_cast("int").between(1, 500)).alias("valid"))


@query("P18_display_content", "SELECT d.doc_id, coalesce(nullif(p.text, ''), d.text) AS content FROM documents d LEFT JOIN benchmark p ON p.item_id = d.doc_id")
def display_content(t):
    parent = t("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("parent"))
    return t("documents").select("doc_id", "text").join(parent, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("parent", F.lit("")), "text").alias("content"))


@query("P20_newest_lists", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey ORDER BY newest DESC, o_custkey LIMIT 50")
def newest_lists(t):
    g = t("orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"))
    return g.orderBy(F.desc("newest"), "o_custkey").limit(50)


@query("J5_priority_merge", """WITH u AS (SELECT lower(source) AS k, doc_id, 0 AS p FROM documents WHERE lang = 'de' UNION ALL SELECT lower(source), doc_id, 1 FROM documents WHERE lang = 'en'),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, doc_id) AS r FROM u) SELECT k, doc_id, p FROM r WHERE r = 1""")
def priority_merge(t):
    of = lambda lang, p: t("documents").filter(F.col("lang") == lang).select(F.lower("source").alias("k"), "doc_id", F.lit(p).alias("p"))
    return of("de", 0).unionByName(of("en", 1)).groupBy("k").agg(F.min(F.struct("p", "doc_id")).alias("b")).select("k", "b.doc_id", "b.p")


_KEYWORDS = """kw AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS ws FROM benchmark), kc AS (SELECT ws, min(item_id) AS c, count(*) AS n FROM kw WHERE len(ws) > 0 GROUP BY ws),
kp AS (SELECT a.c AS a, b.c AS b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.ws, b.ws)) AS k, len(a.ws) AS m_a, len(b.ws) AS m_b FROM kc a JOIN kc b ON a.c < b.c)"""


def _keyword_pairs(t):
    """Classes of items with one set of keywords, and pairs of classes with three in common or 0.15 of them."""
    items = t("benchmark").select("item_id", T.matches(F.lower("text"), "[a-z]{4,}").alias("ws"))
    classes = cut(S.set_classes(items, "item_id", "ws"), "classes")
    # One in common is 0.15 of sets of six at most, two of thirteen.
    need = lambda m: F.when(m <= 6, 1).when(m <= 13, 2).otherwise(3)
    return items, classes, cut(S.similar_sets(classes, need, lambda k, m, n: (k >= 3) | (k / (m + n - k) >= 0.15)), "pairs")


@query("J8_shared_keywords", f"WITH {_KEYWORDS} SELECT a, b, n_a, n_b, k FROM kp WHERE k >= 3 OR k / (m_a + m_b - k) >= 0.15 UNION ALL SELECT c, c, n, n, len(ws) FROM kc WHERE n > 1")
def shared_keywords(t):
    """Pairs of keyword sets, named by the first item that has them, with the items of each; a = b is a set of several items, which
    are linked with each other. J8_keyword_members has each item's set."""
    _, classes, pairs = _keyword_pairs(t)
    n = lambda end: classes.select(F.col("class_id").alias(end), F.col("n").alias(f"n_{end}"))
    own = classes.filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.size("terms").cast("long").alias("k"))
    return pairs.join(n("a"), "a").join(n("b"), "b").select("a", "b", "n_a", "n_b", "k").unionByName(own)


@query("J8_keyword_pairs", r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM w GROUP BY item_id),
c AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a, b, k FROM c JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE k >= 3 OR k / (x.n + y.n - k) >= 0.15""")
def keyword_pairs(t):
    """All pairs of items that share keywords: the pairs of J8_shared_keywords, and of the items of one set, with the items themselves."""
    items, classes, pairs = _keyword_pairs(t)
    terms = F.array_sort(F.array_distinct("ws"))
    held = cut(items.select("item_id", terms.alias("terms")).join(classes, "terms").select("item_id", "class_id", F.size("terms").cast("long").alias("k")), "members")
    of = lambda end: held.select(F.col("class_id").alias(f"c_{end}"), F.col("item_id").alias(end))
    apart = pairs.select(F.col("a").alias("c_a"), F.col("b").alias("c_b"), "k").join(of("a"), "c_a").join(of("b"), "c_b")
    within = held.select(F.col("class_id").alias("c_a"), F.col("item_id").alias("a"), "k").join(of("b"), F.col("c_a") == F.col("c_b")).filter("a < b")
    return apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "k").unionByName(within.select("a", "b", "k"))


@query("J8_keyword_members", f"""WITH {_KEYWORDS}, e AS (SELECT a AS c, n_b AS n FROM kp WHERE k >= 3 OR k / (m_a + m_b - k) >= 0.15 UNION ALL SELECT b, n_a FROM kp WHERE k >= 3 OR k / (m_a + m_b - k) >= 0.15), l AS (SELECT c, sum(n)::BIGINT AS n FROM e GROUP BY c)
SELECT item_id AS id, coalesce(kc.c, item_id) AS class_id, coalesce(kc.n - 1 + coalesce(l.n, 0), 0) AS links FROM kw LEFT JOIN kc ON kc.ws = kw.ws LEFT JOIN l ON l.c = kc.c""")
def keyword_members(t):
    """Each item's class and the number of items that it shares keywords with."""
    items, classes, pairs = _keyword_pairs(t)
    return S.members(items, classes, pairs, "item_id", "ws")


@query("F11_label_cosine", """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), v AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label)
SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], v.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(v.v, v.v))), 6) AS cosine FROM embeddings e JOIN v ON v.label = e.label""")
def label_cosine(t):
    e = t("embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return e.join(centre, "label").select("vec_id", F.round(V.cosine(F.col("embedding").cast("array<double>"), F.col("v")), 6).alias("cosine"))


@query("A20_store_stats", "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, count(DISTINCT label) AS kbs FROM embeddings")
def store_stats(t):
    return t("embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.count_distinct("label").alias("kbs"))


@query("A26_evidence_clusters", "SELECT left(coalesce(nullif(source, ''), lang), 40) AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def evidence_clusters(t):
    k = F.substring(F.coalesce(F.nullif("source", F.lit("")), "lang"), 1, 40)
    return t("documents").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("A34_parent_groups", "WITH k AS (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents), g AS (SELECT doc_id, left(substring(text, i * 500 + 1, 500), 80) AS prefix, i FROM k) SELECT doc_id, prefix, min(i) AS first, count(*) AS n FROM g GROUP BY doc_id, prefix")
def parent_groups(t):
    from marlstone.operators.chunking import fixed_chunks

    c = fixed_chunks(t("documents"), "doc_id", "text", 500)
    return c.groupBy(F.col("id").alias("doc_id"), F.substring("content", 1, 80).alias("prefix")).agg(F.min("chunk_index").cast("long").alias("first"), F.count(F.lit(1)).alias("n"))


@query("U8_entity_merge", "WITH e AS (SELECT lower(c_mktsegment) AS name, 'customer' AS source, 0 AS p FROM customer UNION ALL SELECT lower(p_brand), 'part', 1 FROM part) SELECT name, arg_min(source, p) AS source, count(*) AS n FROM e GROUP BY name")
def entity_merge(t):
    e = t("customer").select(F.lower("c_mktsegment").alias("name"), F.lit("customer").alias("source"), F.lit(0).alias("p")).unionByName(t("part").select(F.lower("p_brand").alias("name"), F.lit("part").alias("source"), F.lit(1).alias("p")))
    return e.groupBy("name").agg(F.min_by("source", "p").alias("source"), F.count(F.lit(1)).alias("n"))


def _distinct_links(pages, most: int | None = None):
    """page_id and u: each distinct link of a page once; only the first `most` by place, if given (the reference has 8, or 12 for evidence)."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.explode(links if most is None else F.slice(links, 1, most)).alias("u"))


@query("U13_image_dedup", "WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS p FROM pages), d AS (SELECT page_id, u, min(p) AS p FROM i GROUP BY page_id, u) SELECT page_id, u FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY p) <= 8")
def image_dedup(t):
    """The first eight distinct links of a page, the feature's limit; U13_image_dedup_all has all."""
    return _distinct_links(t("pages"), 8)


@query("U13_image_dedup_all", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages")
def image_dedup_all(t):
    return _distinct_links(t("pages"))


@query("F13_overlap_cosine", r"WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), q AS (SELECT w AS q FROM w WHERE item_id = (SELECT min(item_id) FROM benchmark)) SELECT item_id, round(len(list_intersect(w, q)) / sqrt(len(w) * len(q)), 6) AS overlap FROM w, q WHERE len(w) > 0")
def overlap_cosine(t):
    w = t("benchmark").select("item_id", F.array_distinct(T.matches(F.lower("text"), "[a-z]+")).alias("w"))
    q = w.agg(F.min_by("w", "item_id").alias("q"))
    return w.crossJoin(F.broadcast(q)).filter(F.size("w") > 0).select("item_id", F.round(F.size(F.array_intersect("w", "q")) / F.sqrt(F.size("w") * F.size("q")), 6).alias("overlap"))


@query("F17_fuzzy_terms", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark) SELECT w FROM w WHERE w = 'the' OR contains(w, 'the') OR contains('the', w) OR (length(w) = 3 AND hamming(w, 'the') <= 1)")
def fuzzy_terms(t):
    w = t("benchmark").select(F.explode(F.array_distinct(T.matches(F.lower("text"), "[a-z]{2,}"))).alias("w")).distinct()
    return like_words(w, ["the"], "w").select(F.col("term").alias("w")).unionByName(w.filter("w = 'the'"))


@query("F23_clean_markdown", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS cleaned FROM documents")
def clean_markdown(t):
    return t("documents").select("doc_id", C.clean_markdown(F.col("text")).alias("cleaned"))


_MIXED = "coalesce(text, '') || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || '|  a   b  |' || chr(10) || 'c   d' || chr(10) || lang"


@query("F25_clean_outside_code", f"""WITH d AS (SELECT doc_id, string_split({_MIXED}, '```') AS p FROM documents),
e AS (SELECT doc_id, list_transform(p, lambda s, k: CASE WHEN k % 2 = 0 THEN s ELSE array_to_string(list_transform(string_split(s, chr(10)), lambda x: CASE WHEN starts_with(trim(x, ' '), '|') THEN x ELSE regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g') END), chr(10)) END) AS p FROM d)
SELECT doc_id, md5(array_to_string(p, '```')) AS cleaned FROM e""")
def clean_outside_code(t):
    """Whole texts, each with itself as fenced code behind it, a table line and a plain one: blanks are squeezed outside of code and tables only."""
    text = F.coalesce("text", F.lit(""))
    page = F.concat(text, F.lit("\n```\n"), text, F.lit("\n```\n|  a   b  |\nc   d\n"), "lang")
    return t("documents").select("doc_id", F.md5(C.clean_outside_code(page)).alias("cleaned"))


@query("F48_adjacent_repeats", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), k AS (SELECT doc_id, line, p, lag(line) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM l) SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS cleaned FROM k WHERE b IS NULL OR b <> line GROUP BY doc_id")
def adjacent_repeats(t):
    return t("documents").select("doc_id", C.drop_adjacent_repeats(F.col("text")).alias("cleaned"))


@query("F29_query_rewrite", r"SELECT item_id, replace(regexp_replace(regexp_replace(trim(lower(text), ' '), '^(?:please|could you|can you|tell me)\s+', ''), '[?？!！.。\s]+$', ''), 'the', 'this') || '?' AS rewritten FROM benchmark")
def query_rewrite(t):
    return t("benchmark").select("item_id", C.rewrite_query(F.col("text"), {"the": "this"}).alias("rewritten"))


_REDACTED = """json_extract_string(props, '$.k') AS k, '[REDACTED]' AS api_key, 'len=' || length(event_type) || ' sha256=' || left(sha256(event_type), 16) AS prompt, 'by Bearer [REDACTED] at ' || event_id AS note"""


def event_properties():
    """An event's properties as a map, with a key, a prompt and a note that holds a bearer token, made of the event's own fields."""
    more = F.create_map(F.lit("api_key"), F.col("user_id").cast("string"), F.lit("prompt"), F.col("event_type"), F.lit("note"), F.concat(F.lit("by Bearer t"), F.col("user_id").cast("string"), F.lit(" at "), F.col("event_id").cast("string")))
    return F.map_concat(F.from_json("props", "map<string,string>"), more)


@query("F30_redacted_properties", f"SELECT event_id, {_REDACTED} FROM events")
def redacted_properties(t):
    """Secret-like keys become a mark, text-like ones length and digest, bearer tokens in other values a mark."""
    rows = t("events").select("event_id", C.redact_map(event_properties()).alias("p"))
    return rows.select("event_id", *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("k", "api_key", "prompt", "note")])


@query("F37_heading_level", r"SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[0-9]+(?:\.[0-9]+)*[.\s]\s*\S')) AS numbered, count(*) FILTER (regexp_matches(line, '^#{1,6}\s')) AS marked FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def heading_levels(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("level", C.heading_level(F.col("line")))
    marked = F.col("line").rlike(r"^#{1,6}\s")
    return lines.groupBy("doc_id").agg(F.count_if((F.col("level") > 0) & ~marked).alias("numbered"), F.count_if((F.col("level") > 0) & marked).alias("marked"))


@query("F38_line_kinds", r"""WITH l AS (SELECT lang, trim(unnest(string_split(text, chr(10))), ' ') AS s FROM documents),
k AS (SELECT lang, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^#{1,6}\s') OR regexp_matches(s, '^[0-9]+(?:\.[0-9]+)*[.\s]\s*\S') OR regexp_matches(s, '^第[一二三四五六七八九十百千0-9]+[章节]') THEN 'heading' WHEN regexp_matches(s, '^[-*+•]\s+|^[0-9]+[)）]') THEN 'list_item'
  WHEN regexp_matches(s, '^\|.*\|$') THEN 'table_row' WHEN starts_with(s, '```') THEN 'code_fence' WHEN starts_with(s, '>') THEN 'quote' WHEN regexp_matches(s, '^(?:Figure|Table|图|表)\s*[0-9]+') THEN 'caption' WHEN regexp_matches(s, '^\[[0-9]+\]') THEN 'reference' ELSE 'paragraph' END AS kind FROM l)
SELECT lang, kind, count(*) AS n FROM k GROUP BY lang, kind""")
def line_kinds(t):
    lines = t("documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("lang", C.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("F40_cron_due", "SELECT event_id, (minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18) AS due FROM events")
def cron_due(t):
    return t("events").select("event_id", C.cron_due(F.lit("*/15 8-18 * * 1"), F.col("ts")).alias("due"))


@query("F42_context_string", "WITH b AS (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 8) SELECT string_agg('[' || item_id || '] ' || left(text, 1500), chr(10) ORDER BY item_id) AS context FROM b")
def context_string(t):
    b = t("benchmark").orderBy("item_id").limit(8).select("item_id", F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("] "), F.substring("text", 1, 1500)).alias("s"))
    return b.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "s"))), lambda x: x["s"]), "\n").alias("context"))


@query("F43_version_diff")
def version_diff(t):
    """Each document against the one before it in its source."""
    docs = t("documents").select("doc_id", "source", "text")
    known = previous(docs.select("source", "doc_id"), "source", "doc_id").filter("before IS NOT NULL").select("doc_id", F.col("before").alias("earlier"))
    pairs = docs.join(known, "doc_id").join(docs.select(F.col("doc_id").alias("earlier"), F.col("text").alias("before")), "earlier").filter("before IS NOT NULL")
    return pairs.select("doc_id", C.line_diff(F.col("before"), F.col("text")).alias("d")).select("doc_id", "d.added", "d.removed", "d.ratio", F.size("d.changes").alias("changes"))


@query("F15_hash_embedding")
def hash_embedding(t):
    v = C.hash_embedding(F.col("text"))
    return t("benchmark").select("item_id", F.size(v).alias("n"), F.round(V.norm(v), 5).alias("norm"))


@query("F50_day_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY 1")
def day_counts(t):
    return t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@query("R23_similar_nodes", "WITH n AS (SELECT s_suppkey AS id, list_distinct(string_split(lower(s_name), '')) AS c FROM supplier), q AS (SELECT c AS q FROM n WHERE id = 1) SELECT id, round(len(list_intersect(c, q)) / len(list_distinct(list_concat(c, q))), 3) AS similarity FROM n, q WHERE id <> 1 AND len(list_intersect(c, q)) / len(list_distinct(list_concat(c, q))) > 0.3 ORDER BY similarity DESC, id LIMIT 10")
def similar_nodes(t):
    n = t("supplier").select(F.col("s_suppkey").alias("id"), F.array_distinct(F.filter(F.split(F.lower("s_name"), ""), lambda c: c != "")).alias("c"))
    s = T.jaccard(F.col("c"), F.col("q"))
    hits = n.crossJoin(F.broadcast(n.filter("id = 1").select(F.col("c").alias("q")))).filter((F.col("id") != 1) & (s > 0.3))
    return hits.select("id", F.round(s, 3).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(10)


@query("R24_review_selection", "SELECT o_orderkey, o_orderstatus = 'F' AS handled, o_orderpriority = '1-URGENT' AS used FROM orders ORDER BY o_orderstatus = 'F', o_orderpriority = '1-URGENT', o_orderdate, o_orderkey LIMIT 20")
def review_selection(t):
    handled, used = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    return t("orders").orderBy(handled, used, "o_orderdate", "o_orderkey").limit(20).select("o_orderkey", handled.alias("handled"), used.alias("used"))


@query("R27_file_score", "SELECT doc_id, (CASE WHEN contains(lower(source), 'src1') THEN 8 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 0.35 ELSE 0 END)::DOUBLE AS score FROM documents")
def file_score(t):
    has = lambda c, k, w: F.when(F.contains(F.lower(c), F.lit(k)), w).otherwise(0.0)
    return t("documents").select("doc_id", (has("source", "src1", 8.0) + has("text", "token", 5.0) + has("text", "the", 0.35)).alias("score"))


@query("G11_containment", "WITH a AS (SELECT DISTINCT p_brand AS label FROM part), b AS (SELECT DISTINCT p_brand || ' ' || p_type AS label FROM part) SELECT b.label AS whole, a.label AS part FROM a JOIN b ON starts_with(b.label, a.label || ' ')")
def containment(t):
    """Labels that hold a brand: the brand is cut out and joined by equality, which no pair of labels outside the result enters."""
    a = t("part").select(F.col("p_brand").alias("part")).distinct()
    b = t("part").select(F.concat_ws(" ", "p_brand", "p_type").alias("whole")).distinct().withColumn("part", F.split("whole", " ")[0])
    return b.join(a, "part").select("whole", "part")


@query("G18_paged_edges", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def paged_edges(t):
    return t("orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(200).limit(100)


@query("G15_keyword_anchors", r"WITH p AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, ' ')), lambda s: length(s) > 10) AS s FROM benchmark) SELECT item_id, len(s[1:5]) AS anchors, s[1] AS first FROM p")
def keyword_anchors(t):
    s = F.slice(F.filter(F.transform(F.split("text", r"\.", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 10), 1, 5)
    return t("benchmark").select("item_id", F.size(s).cast("long").alias("anchors"), F.try_element_at(s, F.lit(1)).alias("first"))


@query("S18_numeric_profile", "WITH u AS (SELECT 'qty' AS name, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) SELECT name, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, count(v) AS n FROM u GROUP BY name")
def numeric_profile(t):
    long = t("lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot([], ["qty", "discount", "tax"], "name", "v")
    return long.groupBy("name").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query("S20_frontmatter", "SELECT item_id, 'benchmark' AS kind, text AS body FROM benchmark")
def frontmatter(t):
    from marlstone.sources.formats import frontmatter as split

    page = F.concat(F.lit("---\nkind: benchmark\nid: x\n---\n"), F.col("text"))
    return t("benchmark").select("item_id", split(page).alias("f")).select("item_id", F.col("f.meta")["kind"].alias("kind"), F.col("f.body").alias("body"))
