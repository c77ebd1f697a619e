"""Exact deduplication, set operations, feeds and table merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.plans._base import query


@query("A14_exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_duplicates(t):
    g = t("documents").groupBy(F.sha2("text", 256).alias("hash"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query("A15_keep_newest", "SELECT max(doc_id) AS doc_id, count(*) - 1 AS removed FROM documents GROUP BY sha256(text)")
def keep_newest(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.max("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("removed")).drop("h")


_ITEM = r"""item AS (SELECT page_id, lower(regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', ''), '^([^?]*)', 1), '/+$', '') || regexp_extract(b, '(\?.*)$', 1) AS url,
 regexp_extract(html, '<title>([^<]*)', 1) AS title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS b FROM pages))"""


def _items(t):
    content = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "\\s+", " "))
    return t("pages").select("page_id", T.canonical_url(F.col("url")).alias("url"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), content.alias("content"))


@query("U5_feed_url_dedup", f"WITH {_ITEM} SELECT url, min(page_id) AS page_id, count(*) AS n FROM item GROUP BY url")
def feed_url_dedup(t):
    return _items(t).groupBy("url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


_PRINT = r"sha256(regexp_replace(lower(title || ' ' || substring(content, 1, 1200)), '[^\p{L}\p{N}_]+', '', 'g'))"


def _fingerprint():
    return F.sha2(F.regexp_replace(F.lower(F.concat_ws(" ", "title", F.substring("content", 1, 1200))), "[^\\p{L}\\p{N}_]+", ""), 256)


@query("U6_story_fingerprint", f"WITH {_ITEM} SELECT {_PRINT} AS fingerprint, min(page_id) AS page_id, count(*) AS n FROM item GROUP BY 1")
def story_fingerprint(t):
    return _items(t).groupBy(_fingerprint().alias("fingerprint")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


_SCORED = f"""{_ITEM}, sc AS (SELECT *, lower(title || ' ' || content) AS t FROM item),
s AS (SELECT page_id, title, content, CASE WHEN contains(t, 'casino') THEN 0 ELSE greatest(0, least(100, m * 18 + CASE WHEN m > 0 THEN least(length(content) / 1000, 1) * 35 ELSE 0 END)) END AS score
  FROM (SELECT *, contains(t, 'the')::INT + contains(t, 'and')::INT + contains(t, 'with')::INT AS m FROM sc))"""


def _scored(t):
    text = F.lower(F.concat_ws(" ", "title", "content"))
    m = sum((F.contains(text, F.lit(k)).cast("int") for k in ("the", "and", "with")), F.lit(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), m * 18 + F.when(m > 0, F.least(F.length("content") / 1000, F.lit(1.0)) * 35).otherwise(0.0)))
    return _items(t).withColumn("score", F.when(F.contains(text, F.lit("casino")), 0.0).otherwise(score))


@query("R20_feed_score", f"WITH {_SCORED} SELECT page_id, round(score::DOUBLE, 4) AS score FROM s")
def feed_score(t):
    return _scored(t).select("page_id", F.round("score", 4).alias("score"))


@query("T9_daily_briefing", f"WITH {_SCORED}, d AS (SELECT *, row_number() OVER (PARTITION BY {_PRINT} ORDER BY page_id) AS r FROM s WHERE score >= 45) SELECT page_id, round(score::DOUBLE, 4) AS score FROM d WHERE r = 1 ORDER BY score DESC, page_id LIMIT 10")
def daily_briefing(t):
    good = _scored(t).filter("score >= 45").withColumn("fingerprint", _fingerprint())
    # First of each story by min over a struct, which combines before the shuffle.
    first = good.groupBy("fingerprint").agg(F.min(F.struct("page_id", "score")).alias("f"))
    return first.select("f.page_id", F.round("f.score", 4).alias("score")).orderBy(F.desc("score"), "page_id").limit(10)


@query("P15_min_length", f"WITH {_ITEM} SELECT page_id FROM item WHERE length(content) >= 400 OR contains(content, '***')")
def min_length(t):
    return _items(t).filter((F.length("content") >= 400) | F.contains("content", F.lit("***"))).select("page_id")


@query("U1_label_union", "SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def label_union(t):
    return t("documents").filter("lang = 'de'").select("doc_id").union(t("labels").filter("toxic = 1").select("doc_id")).distinct()


@query("U3_missing_labels", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_labels(t):
    return t("documents").select("doc_id").distinct().join(t("labels"), "doc_id", "left_anti")


@query("U4_evidence_dedup", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY left(sha256(text), 20) ORDER BY n_chars DESC, doc_id) AS r FROM documents), k AS (SELECT doc_id, n_chars FROM r WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 12) SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS evidence_index FROM k")
def evidence_dedup(t):
    key = F.substring(F.sha2("text", 256), 1, 20)
    best = t("documents").groupBy(key.alias("k")).agg(F.min(F.struct((-F.col("n_chars")).alias("m"), "doc_id", "n_chars")).alias("b"))
    first = best.select("b.doc_id", "b.n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(12)
    return first.withColumn("evidence_index", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))


@query("U11_variant_dedup", "SELECT item_id, len(list_distinct(regexp_extract_all(text, '[^ ]+'))) AS n FROM benchmark")
def variant_dedup(t):
    return t("benchmark").select("item_id", F.size(F.array_distinct(T.matches(F.col("text"), "[^ ]+"))).cast("long").alias("n"))


@query("U12_insert_new_ids", "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def insert_new_ids(t):
    return t("documents").select("doc_id", "text").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("K2_upsert", "WITH u AS (SELECT c_custkey AS id, left(c_name, 128) AS name, 0 AS v FROM customer UNION ALL SELECT s_suppkey, left(s_name, 128), 1 FROM supplier) SELECT id, arg_max(name, v) AS name FROM u GROUP BY id")
def upsert(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.substring("c_name", 1, 128).alias("name"), F.lit(0).alias("v"))
    new = t("supplier").select(F.col("s_suppkey").alias("id"), F.substring("s_name", 1, 128).alias("name"), F.lit(1).alias("v"))
    return rows.unionByName(new).groupBy("id").agg(F.max_by("name", "v").alias("name"))


@query("K3_delete_by_key", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND length(trim(text)) > 0")
def delete_by_key(t):
    return t("documents").filter(~F.col("source").isin("src1", "src2") & (F.length(F.trim("text")) > 0)).select("doc_id")


@query("J20_duplicate_lookup", "WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT doc_id, first_id FROM documents JOIN h ON h.h = sha256(text) WHERE doc_id <> first_id")
def duplicate_lookup(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "h").filter("doc_id <> first_id").select("doc_id", "first_id")


@query("J18_index_reconciliation", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'indexed' END AS status FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def index_reconciliation(t):
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_vector"))
    s = t("labels").select("doc_id", F.lit(True).alias("has_label"))
    status = F.when(F.col("has_vector").isNull(), "missing").when(F.col("has_label").isNull(), "unlabelled").otherwise("indexed")
    return t("documents").select("doc_id").join(e, "doc_id", "left").join(s, "doc_id", "left").select("doc_id", status.alias("status"))


@query("J19_source_coverage", "SELECT source, count(*) AS expected, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def source_coverage(t):
    s = t("labels").select("doc_id", F.lit(1).alias("hit"))
    return t("documents").select("doc_id", "source").join(s, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"), (F.count(F.lit(1)) - F.count("hit")).alias("missing"))


@query("J17_used_sources", "SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS used FROM documents d")
def used_sources(t):
    good = t("labels").filter("quality = 1").select("doc_id").distinct().withColumn("used", F.lit(True))
    return t("documents").select("doc_id").join(good, "doc_id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
