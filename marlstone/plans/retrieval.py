"""Search, fusion, reranking and retrieval evaluation over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import clean as C
from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators import index as I
from marlstone.operators import retrieval as R
from marlstone.operators._lineage import cut
from marlstone.plans._base import query

QUERY = "the that with und les que der token"
TOKENS = """concat(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))"""
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_TOK = f"tok AS (SELECT doc_id AS id, source, text, {TOKENS} AS tokens FROM documents WHERE length(trim(text)) > 0)"
_BM = f"""{_TOK}, st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
q AS (SELECT token, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all('{QUERY}', '[a-z]+')) AS token) GROUP BY token),
tf AS (SELECT id, source, dl, token, count(*) AS tf FROM (SELECT id, source, len(tokens) AS dl, unnest(tokens) AS token FROM tok) GROUP BY ALL),
hit AS (SELECT tf.*, qtf FROM tf JOIN q USING (token)), df AS (SELECT token, count(*) AS df FROM hit GROUP BY token),
bm AS (SELECT id, source, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM hit JOIN df USING (token), st GROUP BY id, source)"""
_VEC = """vq AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vs AS (SELECT vec_id AS id, label, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, vq)"""


def _query_vector(t) -> list[float]:
    return t("embeddings").filter("vec_id = 0").first()["embedding"]


def _index(t) -> I.Index:
    """The stored index of documents; the first search of a session builds it."""
    return I.of_table(t("documents"), "doc_id", "text", ("source",))


def _bm25(t, keep=()):
    found = I.scores(_index(t), QUERY)
    return found.select("id", *keep, "score")


def _best(t, k: int):
    return I.best(_index(t), QUERY, k).select("id", "score", "rank")


def _vectors(t):
    return R.vector_search(t("embeddings"), _query_vector(t), "vec_id", "embedding")


@query("A1_term_frequency", f"WITH {_TOK} SELECT id, token, count(*) AS tf, len(any_value(tokens)) AS dl FROM (SELECT id, tokens, unnest(tokens) AS token FROM tok) GROUP BY id, token")
def term_frequency(t):
    return R.postings(t("documents"), "doc_id", "text")


@query("A2_document_frequency", f"WITH {_TOK}, d AS (SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(tokens) AS token FROM tok) GROUP BY token) SELECT token, df, round(ln(((SELECT count(*) FROM tok) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d")
def document_frequency(t):
    docs = t("documents").filter(F.length(F.trim("text")) > 0)
    df = docs.select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(R.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query("A3_corpus_stats", f"WITH {_TOK}, v AS (SELECT count(DISTINCT token) AS v FROM (SELECT unnest(tokens) AS token FROM tok)) SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avg_dl, any_value(v) AS vocabulary FROM tok, v")
def corpus_stats(t):
    vocabulary = R.postings(t("documents"), "doc_id", "text").agg(F.count_distinct("token").alias("vocabulary"))
    return R.corpus_stats(t("documents"), "doc_id", "text").withColumn("avg_dl", F.round("avg_dl", 6)).crossJoin(vocabulary)


@query("R1_bm25_topk", f"WITH {_BM} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_topk(t):
    return _best(t, 10).withColumn("score", F.round("score", 6))


@query("R2_bm25_by_source", f"WITH {_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM bm) SELECT source, id, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def bm25_by_source(t):
    ranked = _bm25(t, ["source"]).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id")))
    return ranked.filter("rank <= 3").select("source", "id", F.round("score", 6).alias("score"), "rank")


@query("P1_kb_filter", f"WITH {_BM} SELECT id, source, round(score, 6) AS score FROM bm WHERE source IN ('src1', 'src3') ORDER BY score DESC, id LIMIT 20")
def kb_filter(t):
    hits = _bm25(t, ["source"]).filter(F.col("source").isin("src1", "src3"))
    return hits.orderBy(F.desc("score"), "id").limit(20).select("id", "source", F.round("score", 6).alias("score"))


@query("R3_vector_topk", f"WITH {_VEC} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vs ORDER BY score DESC, id LIMIT 10")
def vector_topk(t):
    return R.top(_vectors(t), 10).withColumn("score", F.round("score", 6))


@query("P2_vector_threshold", f"WITH {_VEC} SELECT label, count(*) AS n, round(max(score), 6) AS best FROM vs WHERE score >= 0.2 GROUP BY label")
def vector_threshold(t):
    scored = R.vector_search(t("embeddings"), _query_vector(t), "vec_id", "embedding", 0.2)
    return scored.join(t("embeddings").select(F.col("vec_id").alias("id"), "label"), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("P3_searchable_mask", "WITH m AS (SELECT count(DISTINCT label) > 1 AS mixed FROM embeddings) SELECT vec_id, label FROM embeddings, m WHERE len(embedding) = 64 AND (NOT mixed OR label = 0)")
def searchable_mask(t):
    e = t("embeddings")
    mixed = e.agg((F.count_distinct("label") > 1).alias("mixed"))
    return e.crossJoin(F.broadcast(mixed)).filter((F.size("embedding") == 64) & (~F.col("mixed") | (F.col("label") == 0))).select("vec_id", "label")


@query("F16_embedding_sanity", "SELECT vec_id, sqrt(list_dot_product(e, e)) > 0.1 AND sqrt(list_dot_product(e, e) / 64 - list_avg(e) * list_avg(e)) > 0.01 AS sane, round(list_avg(e), 6) AS mean FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def embedding_sanity(t):
    return t("embeddings").select("vec_id", V.sane(F.col("embedding")).alias("sane"), F.round(V.mean(F.col("embedding")), 6).alias("mean"))


@query("A21_index_model_status", "SELECT label, count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings GROUP BY label")
def index_model_status(t):
    d = F.size("embedding").cast("long")
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("min_dim"), F.max(d).alias("max_dim"), (F.min(d) == F.max(d)).alias("consistent"))


_LISTS = f"{_BM}, {_VEC}, b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY score DESC, id LIMIT 30), v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vs ORDER BY score DESC, id LIMIT 30)"


@query("R8_hybrid_search", f"""WITH {_LISTS}, u AS (SELECT id, 0.6 / (60 + rank) AS part, 'vector' AS s FROM v UNION ALL SELECT id, 0.4 / (60 + rank), 'keyword' FROM b)
SELECT id, round(sum(part), 6) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY id ORDER BY sum(part) DESC, id LIMIT 10""")
def hybrid_search(t):
    fused = R.rrf([("vector", R.top(_vectors(t), 30), R.VECTOR_WEIGHT), ("keyword", _best(t, 30), R.KEYWORD_WEIGHT)])
    return fused.orderBy(F.desc("score"), "id").limit(10).withColumn("score", F.round("score", 6))


@query("R9_multi_list_fusion", f"""WITH {_LISTS}, l AS (SELECT id, rank, 1.0 AS w FROM b UNION ALL SELECT id, rank, 0.7 FROM v UNION ALL SELECT id, row_number() OVER (ORDER BY id DESC), 0.7 FROM (SELECT id FROM b ORDER BY id DESC LIMIT 10))
SELECT id, round(sum(w / (60 + rank)), 6) AS score FROM l GROUP BY id""")
def multi_list_fusion(t):
    base = _best(t, 30)
    variant = base.orderBy(F.desc("id")).limit(10).select("id", F.row_number().over(Window.orderBy(F.desc("id"))).alias("rank"))
    return R.rrf([("base", base, 1.0), ("vector", R.top(_vectors(t), 30), 0.7), ("variant", variant, 0.7)]).select("id", F.round("score", 6).alias("score"))


@query("R10_max_norm_merge", f"""WITH {_LISTS}, vn AS (SELECT id, score / max(score) OVER () AS v FROM v), bn AS (SELECT id, score / max(score) OVER () AS k FROM b),
o AS (SELECT id, score / max(score) OVER () AS o FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 60)), f AS (SELECT coalesce(vn.id, bn.id) AS id, v, k FROM vn FULL JOIN bn ON vn.id = bn.id)
SELECT id, round(coalesce(v * 0.6, 0) + coalesce(k * 0.4, 0) + CASE WHEN v IS NOT NULL AND k IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS score FROM f
UNION ALL SELECT id, round(o * 0.2, 6) FROM o WHERE id NOT IN (SELECT id FROM f)""")
def max_norm_merge(t):
    hits = _best(t, 60)
    return R.max_norm_merge(R.top(_vectors(t), 30), hits.filter("rank <= 30"), hits).withColumn("score", F.round("score", 6))


_CAND = f"{_BM}, cand AS (SELECT bm.id, bm.score, d.text FROM bm JOIN documents d ON d.doc_id = bm.id ORDER BY bm.score DESC, bm.id LIMIT 50)"


def _candidates(t):
    best = _best(t, 50).select("id", "score")
    return t("documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(best), "id")


@query("R11_rule_rerank", f"""WITH {_CAND}, qq AS (SELECT list_distinct({WORDS.format(f"'{QUERY}'")}) AS q),
w AS (SELECT id, score, lower(text) AS t, list_distinct({WORDS.format('text')}) AS c FROM cand),
g AS (SELECT *, list_distinct(flatten(list_transform(q, lambda x: list_transform(range(1, length(x)), lambda i: substring(x, i, 2))))) AS qb, list_distinct(flatten(list_transform(c, lambda x: list_transform(range(1, length(x)), lambda i: substring(x, i, 2))))) AS cb FROM w, qq)
SELECT id, round(score + len(list_intersect(q, c)) / len(q) * 0.3 + len(list_intersect(qb, cb)) / len(qb) * 0.2
  + least(len(list_filter(q, lambda x: length(x) >= 2 AND contains(t, x))) * 0.05, 0.2) - least(length(t) / 500, 1.0) * 0.05, 6) AS rule_score FROM g""")
def rule_rerank(t):
    return R.rule_rerank(_candidates(t), QUERY, "text").select("id", F.round("rule_score", 6).alias("rule_score"))


@query("R12_composite_rerank", f"""WITH {_CAND}, qq AS (SELECT {WORDS.format(f"'{QUERY}'")} AS p, list_distinct({WORDS.format(f"'{QUERY}'")}) AS q),
w AS (SELECT id, score, lower(text) AS t, {WORDS.format('text')} AS c, q, p FROM cand, qq),
f AS (SELECT id, score, t, c, q, p, list_filter(q, lambda x: length(x) >= 2) AS m FROM w),
s AS (SELECT *, list_filter(m, lambda x: contains(t, x)) AS hit FROM f),
e AS (SELECT id, score, CASE WHEN contains(t, '{QUERY}') THEN least(1.0, 0.5 + length('{QUERY}') / greatest(length(t), 1) * 10) ELSE len(hit) / greatest(len(q), 1) END AS exact_match,
  len(list_intersect(m, c)) / len(m) AS keyword_coverage, coalesce(list_sum(list_transform(list_filter(p, lambda x: contains(t, x)), lambda x: length(x))), 0) / list_sum(list_transform(p, lambda x: length(x))) AS phrase_match,
  CASE WHEN contains(t, '{QUERY}') THEN 1 - (strpos(t, '{QUERY}') - 1) / greatest(length(t), 1) ELSE coalesce(1 - (list_min(list_transform(hit, lambda x: strpos(t, x))) - 1) / greatest(length(t), 1), 0) END AS position,
  CASE WHEN length(t) < 20 THEN 0.2 WHEN length(t) < 50 THEN 0.4 WHEN length(t) < 200 THEN 0.7 WHEN length(t) < 1000 THEN 1.0 WHEN length(t) < 2000 THEN 0.8 ELSE 0.5 END AS length_quality,
  list_sum(list_transform(m, lambda x: ln(1 + len(list_filter(c, lambda y: y = x))))) / (ln(1 + len(c)) * len(m)) AS semantic_density FROM s)
SELECT id, round(exact_match, 6) AS exact_match, round(keyword_coverage, 6) AS keyword_coverage, round(phrase_match, 6) AS phrase_match, round(position, 6) AS position, length_quality, round(semantic_density, 6) AS semantic_density,
  round(score * 0.2 + exact_match * 0.15 + keyword_coverage * 0.15 + phrase_match * 0.12 + position * 0.05 + 0.3 * 0.1 + 0.5 * 0.05 + length_quality * 0.08 + semantic_density * 0.1, 6) AS rerank_score FROM e""")
def composite_rerank(t):
    out = R.composite_rerank(_candidates(t), QUERY, "text")
    six = ["exact_match", "keyword_coverage", "phrase_match", "position", "semantic_density", "rerank_score"]
    return out.select("id", "length_quality", *[F.round(c, 6).alias(c) for c in six])


@query("W3_score_calibration", f"""WITH {_LISTS}, c AS (SELECT b.id, b.rank, b.score, v.id IS NOT NULL AS in_both FROM b LEFT JOIN v ON v.id = b.id),
n AS (SELECT *, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-9) AS z, 1 - (rank - 1) / (count(*) OVER () - 1) AS s FROM c),
r AS (SELECT id, rank, 0.52 + z * 0.28 + s * 0.15 + CASE WHEN in_both THEN 0.04 ELSE 0 END AS raw FROM n)
SELECT id, rank, round(greatest(0.35, least(0.96, CASE WHEN rank = 1 THEN greatest(raw, 0.86) ELSE raw END)), 6) AS display_score FROM r""")
def score_calibration(t):
    best = _best(t, 30).join(R.top(_vectors(t), 30).select("id", F.lit(True).alias("both")), "id", "left").withColumn("both", F.coalesce("both", F.lit(False)))
    return R.calibrate(best).select("id", "rank", F.round("display_score", 6).alias("display_score"))


@query("U2_candidates_in_kb", f"WITH {_BM} SELECT id FROM bm INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def candidates_in_kb(t):
    return _bm25(t).select("id").intersect(t("documents").filter("lang = 'en'").select(F.col("doc_id").alias("id")))


@query("U7_fuzzy_multi_query_union", f"WITH {_LISTS}, u AS (SELECT id, score FROM b UNION ALL SELECT id, score FROM v) SELECT id, round(max(score), 6) AS score FROM u GROUP BY id")
def multi_query_union(t):
    lists = _best(t, 30).select("id", "score").unionByName(R.top(_vectors(t), 30).select("id", "score"))
    return lists.groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


@query("R14_full_text_search", """WITH tok AS (SELECT doc_id AS id, lower(source) AS title, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
tf AS (SELECT id, title, term, count(*) AS tf FROM tok GROUP BY ALL), e AS (SELECT *, unnest(['token', 'the', 'src1', 'the']) AS q FROM tf),
p AS (SELECT id, CASE WHEN term = q THEN tf * CASE WHEN contains(title, q) THEN 3.0 ELSE 1.0 END
  WHEN length(term) >= 2 AND length(q) >= 2 AND (contains(term, q) OR contains(q, term) OR (length(term) = length(q) AND hamming(term, q) <= 1)) THEN tf * 0.5 END AS part FROM e)
SELECT id, round(sum(part)::DOUBLE, 6) AS score FROM p WHERE part IS NOT NULL GROUP BY id""")
def full_text_search(t):
    """Words like the query's are sought in the stored index's vocabulary; only their postings are read."""
    words = I.of_table(t("documents"), "doc_id", "text", ("source",), "words")
    return I.full_text(words, ["token", "the", "src1", "the"], "source").withColumn("score", F.round("score", 6))


@query("D10_positional_index", "WITH tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS position FROM tok) SELECT term, id, count(*) AS n, min(position) AS first, max(position) AS last FROM p GROUP BY term, id")
def positional_index(t):
    p = R.positional_index(t("documents"), "doc_id", "text")
    return p.select("term", "id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).cast("long").alias("first"), F.element_at("positions", -1).cast("long").alias("last"))


@query("R15_wiki_score", "SELECT doc_id, (CASE WHEN contains(lower(source), 'src1') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 2.0 ELSE 0 END + CASE WHEN contains(lang, 'en') THEN 1.5 ELSE 0 END)::DOUBLE AS score FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'the') OR contains(lang, 'en')")
def wiki_score(t):
    parts = [(F.lower("source"), "src1", 3.0), (F.lower("text"), "the", 2.0), (F.col("lang"), "en", 1.5)]
    hits = [F.contains(c, F.lit(k)) for c, k, _ in parts]
    score = sum((F.when(h, w).otherwise(0.0) for h, (_, _, w) in zip(hits, parts)), F.lit(0.0))
    return t("documents").filter(hits[0] | hits[1] | hits[2]).select("doc_id", score.alias("score"))


@query("F45_resource_score", """WITH x AS (SELECT doc_id, lower(text) AS t, unnest(['the', 'token']) AS q FROM documents)
SELECT doc_id, round(sum(least(5, (length(t) - length(replace(t, q, ''))) // length(q)) * 1.0)::DOUBLE, 6) AS score FROM x GROUP BY doc_id""")
def resource_score(t):
    text = F.lower("text")
    hits = lambda q: F.least(F.lit(5), F.floor((F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / len(q)))
    return t("documents").select("doc_id", (hits("the") + hits("token")).cast("double").alias("score"))


@query("A29_retrieval_evaluation", """WITH d AS (SELECT doc_id, text FROM documents), h AS (SELECT b.item_id, count(d.doc_id) AS hits FROM benchmark b LEFT JOIN d ON contains(d.text, b.text) GROUP BY b.item_id)
SELECT count(*) AS items, count(*) FILTER (hits > 0) AS found, round(count(*) FILTER (hits > 0) / count(*), 6) AS recall FROM h""")
def retrieval_evaluation(t):
    """The share of passages that some document contains; no search runs here."""
    items = t("benchmark").select("item_id")
    hits = R.containing(t("documents"), t("benchmark"), "doc_id", "item_id").groupBy(F.col("passage").alias("item_id")).agg(F.count_distinct("doc").alias("hits"))
    every = items.join(hits, "item_id", "left")
    return every.agg(F.count(F.lit(1)).alias("items"), F.count("hits").alias("found"), F.round(F.count("hits") / F.count(F.lit(1)), 6).alias("recall"))


@query("A29_keyword_ranks", f"""WITH {_TOK}, st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok), tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM tok) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), qt AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (token) JOIN df USING (token), st GROUP BY item_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM sc), b AS (SELECT item_id, min(rank) AS rank FROM (SELECT r.item_id, r.rank FROM r JOIN documents d ON d.doc_id = r.id JOIN benchmark b ON b.item_id = r.item_id AND contains(d.text, b.text) WHERE r.rank <= 10) GROUP BY item_id),
w AS (SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT count(*) AS items, round(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_at_1, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_at_10, round(coalesce(sum(1 / rank), 0) / count(*), 6)::DOUBLE AS mean_reciprocal_rank FROM w LEFT JOIN b USING (item_id)""")
def keyword_ranks(t):
    """Retrieval evaluation: each passage that some document contains is a query to the keyword index; where among the first ten a containing document stands."""
    items = t("benchmark")
    right = R.containing(t("documents"), items, "doc_id", "item_id").select(F.col("passage").alias("query"), F.col("doc").alias("id"))
    right = cut(right, "right")
    hits = I.best_for_each(_index(t), items, "item_id", "text", 10).join(right, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    every = right.select("query").distinct().join(hits, "query", "left")
    share = lambda k: F.round(F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 6).alias(f"recall_at_{k}")
    return every.agg(F.count(F.lit(1)).alias("items"), share(1), share(5), share(10), F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("mean_reciprocal_rank"))


@query("A29_hybrid_ranks")
def hybrid_ranks(t):
    """The same by both searches and their fusion: vectors of texts are hash embeddings. One row a search: the share of passages with a containing document among the first five, and the mean reciprocal rank in ten."""
    items = t("benchmark")
    right = cut(R.containing(t("documents"), items, "doc_id", "item_id").select(F.col("passage").alias("query"), F.col("doc").alias("id")), "right")
    words = cut(I.best_for_each(_index(t), items, "item_id", "text", 30).select("query", "id", "rank"), "words")
    asked = items.select(F.col("item_id").alias("id"), C.hash_embedding(F.col("text")).alias("v"))
    docs = t("documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), C.hash_embedding(F.col("text")).alias("v"))
    vectors = cut(R.search_many(asked, docs, "id", "v", 30, same_space=False).select("query", "id", "rank"), "vectors")
    part = lambda rows, w: rows.select("query", "id", (F.lit(w) / (R.RRF_K + F.col("rank"))).alias("part"))
    fused = part(vectors, R.VECTOR_WEIGHT).unionByName(part(words, R.KEYWORD_WEIGHT)).groupBy("query", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    wanted, out = right.select("query").distinct(), None
    for name, rows in (("keyword", words), ("vector", vectors), ("hybrid", fused)):
        hits = rows.filter("rank <= 10").join(right, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
        every = wanted.join(hits, "query", "left").agg(F.lit(name).alias("search"), F.count(F.lit(1)).alias("items"), F.round(F.count_if(F.col("rank") <= 5) / F.count(F.lit(1)), 6).alias("recall_at_5"), F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("mean_reciprocal_rank"))
        out = every if out is None else out.unionByName(every)
    return out
