"""Local keyword and hybrid search, page search and context, over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import ann
from marlstone.operators import retrieval as R
from marlstone.operators.linking import holding
from marlstone.plans._base import query
from marlstone.plans.retrieval import _BM, _LISTS, _VEC, QUERY, WORDS, _best, _candidates, _vectors

_ASCII = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


def _word_score(words: str, least: int, early: bool) -> str:
    """SQL of the scored texts `sc`."""
    later = " + least(coalesce(list_sum(list_transform(hit, lambda x: 0.1 - (strpos(t, x) - 1) / greatest(length(t), 1) * 0.1)), 0), 0.2)" if early else ""
    bi = "list_distinct(flatten(list_transform({}, lambda x: list_transform(range(1, length(x)), lambda i: substring(x, i, 2)))))"
    long_words = f"list_filter({words.format(f'$${QUERY}$$')}, lambda x: length(x) >= 2)"
    return f"""qq AS (SELECT list_distinct(list_filter({words.format(f'$${QUERY}$$')}, lambda x: length(x) >= {least})) AS q, {long_words if early else f'list_distinct({long_words})'} AS lw),
w AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t, list_distinct(list_filter({words.format('text')}, lambda x: length(x) >= {least})) AS ws, q, lw, list_filter(lw, lambda x: contains(lower(coalesce(text, '')), x)) AS hit FROM documents, qq),
sc AS (SELECT id, list_has_any(lw, ws) AS shares, round(len(list_intersect(q, ws)) / len(q) * 0.5 + len(list_intersect({bi.format('lw')}, {bi.format('ws')})) / len({bi.format('lw')}) * 0.3 + least(len(hit) * 0.1, 0.3){later}, 9) AS score FROM w)"""


@query("R6_local_keyword_search", f"WITH {_word_score(WORDS, 1, True)} SELECT id, round(score, 6) AS score FROM sc WHERE shares AND score > 0 ORDER BY sc.score DESC, id LIMIT 20")
def local_keyword_search(t):
    best = R.word_search(t("documents"), QUERY, "doc_id", "text").orderBy(F.desc("score"), "id").limit(20)
    return best.withColumn("score", F.round("score", 6))


def _browser_words(text):
    return T.matches(F.lower(text), f"[{T.CJK}]+|[a-z0-9_]+")


@query("R7_browser_hybrid_search", f"""WITH {_word_score(_ASCII, 2, False)}, {_VEC}, k AS (SELECT id, score FROM sc WHERE score > 0 ORDER BY score DESC, id LIMIT 15), v AS (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 15),
u AS (SELECT id, score / max(score) OVER () * 0.4 AS part FROM k UNION ALL SELECT id, score / max(score) OVER () * 0.6 FROM v) SELECT id, round(sum(part), 6) AS score FROM u GROUP BY id ORDER BY sum(part) DESC, id LIMIT 5""")
def browser_hybrid_search(t):
    words = R.word_search(t("documents"), QUERY, "doc_id", "text", _browser_words, least=2, position=False, fall_back=False)
    merged = R.weighted_merge([(R.top(_vectors(t), 15), R.VECTOR_WEIGHT), (R.top(words, 15), R.KEYWORD_WEIGHT)])
    return merged.orderBy(F.desc("score"), "id").limit(5).withColumn("score", F.round("score", 6))


_PAGE = "CASE WHEN contains(lower({title}), '{q}') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower({content}), '{q}') THEN 2.0 ELSE 0 END + len(list_filter({tags}, lambda x: contains(lower(x), '{q}'))) * 1.5"


@query("R16_natural_language_search", f"""WITH {_VEC}, p AS (SELECT doc_id AS id, source || '/' || lang AS title, ({_PAGE.format(title="source || '/' || lang", content="text", tags="[lang, source]", q="src1")})::DOUBLE AS score FROM documents),
w AS (SELECT id, title, score, 0 AS l FROM p WHERE score > 0), v AS (SELECT id, 'SRC' || (id % 40) || '/en' AS title, score * 2 AS score, 1 AS l FROM vs ORDER BY vs.score DESC, id LIMIT 20),
u AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY l, score DESC, id) AS place FROM (FROM w UNION ALL FROM v)) SELECT id, title, round(score, 6) AS score FROM u WHERE place = 1""")
def natural_language_search(t):
    """Pages found by their text, and vectors at twice their score; the first of a title stays."""
    title = F.concat_ws("/", "source", "lang")
    docs = t("documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    pages = docs.select(F.col("doc_id").alias("id"), title.alias("title"), R.page_score("src1", title, F.col("text"), F.array("lang", "source")).alias("score")).filter("score > 0")
    vectors = R.top(_vectors(t), 20).select("id", F.concat(F.lit("SRC"), (F.col("id") % 40).cast("string"), F.lit("/en")).alias("title"), (F.col("score") * 2).alias("score"))
    return R.first_titles([pages, vectors]).select("id", "title", F.round("score", 6).alias("score"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("R17_related_pages", f"""WITH p AS (SELECT page_id, {_TITLE} AS title, html FROM pages), me AS (SELECT page_id AS me, lower(string_split(title, ' ')[1]) AS q FROM p WHERE page_id % 20 = 0),
s AS (SELECT me, page_id, CASE WHEN contains(lower(title), q) THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(html), q) THEN 2.0 ELSE 0 END AS score FROM me, p WHERE page_id <> me AND q <> '')
SELECT me AS page_id, page_id AS related_id, score::DOUBLE AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY me ORDER BY score DESC, page_id) <= 5""")
def related_pages(t):
    """For the query set of every 20th page: the five other pages that hold the first word of its title, in title or content."""
    p = t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")
    queries = p.filter("page_id % 20 = 0").select(F.col("page_id").alias("me"), F.lower(F.split("title", " ")[0]).alias("q")).filter("q <> ''")
    # One pass over each page finds the queries' distinct words that it holds; pages are never paired with each other.
    held = holding(p, queries.select("q").distinct(), "page_id", "html", "q").select(F.col("id").alias("page_id"), F.col("term").alias("q"))
    score = F.when(F.contains(F.lower("title"), "q"), 3.0).otherwise(0.0) + 2.0
    found = held.join(p.select("page_id", "title"), "page_id").select("q", F.col("page_id").alias("related_id"), score.alias("score"))
    # Six of a word are enough, as a page is not related to itself.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "related_id")
    found = found.withColumn("place", F.row_number().over(best)).filter("place <= 6")
    mine = Window.partitionBy("me").orderBy(F.desc("score"), "related_id")
    hits = queries.join(found, "q").filter("related_id <> me").withColumn("place", F.row_number().over(mine)).filter("place <= 5")
    return hits.select(F.col("me").alias("page_id"), "related_id", "score")


_TERMS = "list_distinct(regexp_extract_all(lower($$the token of src1 and reha$$), '[a-z0-9][a-z0-9_-]+'))"
_EVIDENCE = f"""tt AS (SELECT {_TERMS} AS terms), x AS (SELECT doc_id AS id, source, text, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS hay, terms FROM documents, tt),
ev AS (SELECT id, source, text, len(list_filter(terms, lambda w: contains(hay, w))) AS overlap, len(list_filter(terms, lambda w: contains(lower(coalesce(source, '')), w))) AS titled, len(terms) AS n FROM x)"""


def _evidence(t):
    terms = T.agent_terms(F.lit("the token of src1 and reha"))
    source = F.coalesce("source", F.lit(""))
    score = R.evidence_score(terms, F.concat_ws(" ", source, F.coalesce("text", F.lit(""))), source)
    return t("documents").select(F.col("doc_id").alias("id"), "text", score.alias("score")).filter("score IS NOT NULL")


@query("R18_file_evidence", f"WITH {_EVIDENCE} SELECT id, round(overlap / n + 2 * titled / n, 6) AS score FROM ev WHERE overlap > 0")
def file_evidence(t):
    return _evidence(t).select("id", F.round("score", 6).alias("score"))


@query("R19_context_resolve", f"""WITH {_EVIDENCE}, {_BM}, f AS (SELECT id, text, overlap / n + 2 * titled / n AS score, 0 AS l FROM ev WHERE overlap > 0 ORDER BY score DESC, id LIMIT 8),
k AS (SELECT bm.id, d.text, bm.score, 1 AS l FROM bm JOIN documents d ON d.doc_id = bm.id ORDER BY bm.score DESC, bm.id LIMIT 8),
u AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY l, score DESC, id) AS place FROM (FROM f UNION ALL FROM k)), r AS (SELECT u.* FROM u, tt WHERE place = 1 AND list_bool_or(list_transform(terms, lambda w: contains(lower(text), w))))
SELECT id, l AS source_rank, round(score, 6) AS score FROM r ORDER BY l, r.score DESC, id LIMIT 12""")
def context_resolve(t):
    """Evidence of files and of the keyword search: without texts that share no term, equal texts once, twelve at most."""
    files = _evidence(t).orderBy(F.desc("score"), "id").limit(8).withColumn("l", F.lit(0))
    best = _best(t, 8).select("id", "score")
    known = t("documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(best), "id").select("id", "text", "score", F.lit(1).alias("l"))
    place = F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("l", F.desc("score"), "id"))
    terms = T.agent_terms(F.lit("the token of src1 and reha"))
    rows = files.unionByName(known).withColumn("place", place).filter("place = 1").filter(F.exists(terms, lambda w: F.contains(F.lower("text"), w)))
    return rows.orderBy("l", F.desc("score"), "id").limit(12).select("id", F.col("l").alias("source_rank"), F.round("score", 6).alias("score"))


@query("T3_retrieval_depth", "SELECT DISTINCT turn AS k, greatest(8 * turn, 20, 30, 5) AS depth FROM conversations")
def retrieval_depth(t):
    k = F.col("turn")
    return t("conversations").select(k.alias("k"), F.greatest(8 * k, F.lit(20), F.lit(30), F.lit(5)).alias("depth")).distinct()


@query("T4_rerank_depth", f"""WITH {_BM}, cand AS (SELECT bm.id, bm.score, length(d.text) AS n FROM bm JOIN documents d ON d.doc_id = bm.id ORDER BY bm.score DESC, bm.id LIMIT 50),
two AS (SELECT *, score - least(n / 500, 1.0) * 0.05 AS s FROM cand ORDER BY score DESC, id LIMIT 20) SELECT id, round(s, 6) AS score FROM two ORDER BY s DESC, id LIMIT 10""")
def rerank_depth(t):
    """Of 50 candidates 2k go to the reranker and k stay; fewer than k would pass through."""
    two = _candidates(t).orderBy(F.desc("score"), "id").limit(20)
    again = two.withColumn("s", F.col("score") - F.least(F.length("text") / 500, F.lit(1.0)) * 0.05)
    return again.orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 6).alias("score"))


@query("R12e_heading_and_block", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, s, CASE WHEN starts_with(s, '# ') THEN 1 WHEN starts_with(s, '## ') THEN 2 WHEN starts_with(s, '### ') THEN 3 ELSE 0 END AS level,
  CASE WHEN starts_with(s, '# ') THEN 'heading_h1' WHEN starts_with(s, '## ') THEN 'heading_h2' WHEN starts_with(s, '|') THEN 'table' WHEN starts_with(s, '```') THEN 'code_block' ELSE 'paragraph' END AS block FROM l),
f AS (SELECT doc_id, first(s ORDER BY i) AS heading, first(level ORDER BY i) AS level, first(block ORDER BY i) AS block FROM b GROUP BY doc_id),
q AS (SELECT list_distinct(regexp_extract_all(lower('the license of reha and token'), '[\\p{L}\\p{N}_]+')) AS q)
SELECT doc_id, round(CASE WHEN heading = '' THEN 0.3 ELSE least(1.0, len(list_intersect(q, list_distinct(regexp_extract_all(lower(heading), '[\\p{L}\\p{N}_]+')))) / len(q) + CASE level WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 WHEN 3 THEN 0.1 ELSE 0.05 END) END, 6) AS heading_score,
  CASE block WHEN 'heading_h1' THEN 0.85 WHEN 'heading_h2' THEN 0.8 WHEN 'table' THEN 0.7 WHEN 'code_block' THEN 0.5 ELSE 0.6 END::DOUBLE AS block_score FROM f, q""".replace("\\\\", "\\"))
def heading_and_block(t):
    """The reranker's heading and block features of each document, by its first line."""
    first = F.split("text", "\n", -1)[0]
    starts = lambda p: F.startswith("s", F.lit(p))
    level = F.when(starts("# "), 1).when(starts("## "), 2).when(starts("### "), 3).otherwise(0)
    block = F.when(starts("# "), "heading_h1").when(starts("## "), "heading_h2").when(starts("|"), "table").when(starts("```"), "code_block").otherwise("paragraph")
    rows = t("documents").filter("text IS NOT NULL").select("doc_id", first.alias("s"))
    return rows.select("doc_id", F.round(R.heading_relevance("the license of reha and token", F.col("s"), level), 6).alias("heading_score"), R.block_type_score(block).alias("block_score"))


@query("A29_hit_rank", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS q, q.label AS want, v.label AS got, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS score FROM q JOIN v ON v.vec_id <> q.vec_id),
r AS (SELECT q, want, got, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT count(DISTINCT q) AS queries, round(avg(hit), 6) AS recall_at_5 FROM (SELECT q, max((rank <= 5 AND want = got)::INT) AS hit FROM r GROUP BY q)""")
def hit_rank(t):
    """The share of query vectors, every 20th, that have a vector of their label among the first five of the search."""
    v = t("embeddings").select("vec_id", "label", "embedding")
    found = R.search_many(v.filter("vec_id % 20 = 0"), v, "vec_id", "embedding", 5)
    labels = v.select("vec_id", "label")
    of = lambda c, n: labels.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    hits = found.join(of("query", "want"), "query").join(of("id", "got"), "id").groupBy("query").agg(F.max((F.col("want") == F.col("got")).cast("int")).alias("hit"))
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 6).alias("recall_at_5"))


@query("R5_index_search")
def index_search(t):
    """The ten nearest to every twentieth vector by the inverted-file index over all vectors; the tests hold its recall against R.search_many."""
    e = t("embeddings")
    model = ann.fit_cells(e, "vec_id", "embedding")
    probes = ann.probes_for(e, "vec_id", "embedding", model, 10)
    found = ann.search(e.filter("vec_id % 20 = 0"), ann.index(e, "vec_id", "embedding", model), model, "vec_id", "embedding", 10, probes)
    return found.select("query", "id", F.round("score", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))
