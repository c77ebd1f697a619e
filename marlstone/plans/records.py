"""Terms, outlines, file trees, links and index keeping over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import clean as C
from marlstone.functions import terms as X
from marlstone.functions import text as T
from marlstone.operators import files as L
from marlstone.operators import index as I
from marlstone.operators.linking import first_held
from marlstone.plans._base import query
from marlstone.plans.pages import _REDACTED, event_properties
from marlstone.plans.retrieval import _TOK
from marlstone.sources import formats as S

@query("F2_full_text_terms", "SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL)")
def full_text_terms(t):
    w = t("documents").filter("text IS NOT NULL").select("doc_id", X.full_text_terms(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("F5_resource_terms", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))), ' ') AS terms FROM benchmark")
def resource_terms(t):
    return t("benchmark").select("item_id", F.array_join(X.resource_terms(F.col("text")), " ").alias("terms"))


@query("F6_rewrite_terms", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))), ' ') AS terms FROM conversations WHERE text IS NOT NULL")
def rewrite_terms(t):
    return t("conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.array_join(X.rewrite_terms(F.col("text")), " ").alias("terms"))


@query("F7_file_name_terms", """WITH p AS (SELECT p_partkey, string_split_regex(trim(lower(regexp_replace(p_name || '-' || p_brand || '.md', '[_\\-+~()\\[\\]{}#.,/|:;!?]', ' ', 'g'))), '\\s+') AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'note', 'notes', 'md')))), ' ') AS terms FROM p""".replace("\\\\", "\\"))
def file_name_terms(t):
    return t("part").select("p_partkey", F.array_join(X.file_name_terms(F.concat(F.col("p_name"), F.lit("-"), F.col("p_brand"), F.lit(".md"))), " ").alias("terms"))


@query("F14_folder_affinity", """WITH f AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/')[:-2] AS d FROM pages), x AS (SELECT d, min(page_id) AS folder, count(*) AS n FROM f WHERE len(d) > 0 GROUP BY d)
SELECT a.folder AS a, b.folder AS b, a.n AS n_a, b.n AS n_b, round(CASE WHEN a.d = b.d THEN 0.42 ELSE 0 END + least(0.28, 0.07 * len(list_filter(range(1, least(len(a.d), len(b.d)) + 1), lambda i: a.d[:i] = b.d[:i]))), 6)::DOUBLE AS affinity FROM x a JOIN x b ON a.d[1] = b.d[1] AND (a.folder < b.folder OR (a.folder = b.folder AND a.n > 1))""")
def folder_affinity(t):
    """Of all pages: folders of one host, each named by its first page, with their numbers of pages; any two pages of them have the affinity."""
    path = F.regexp_replace("url", "^https?://", "")
    pages = t("pages").select("page_id", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("d")).filter("d <> ''")
    x = pages.groupBy("d").agg(F.min("page_id").alias("folder"), F.count(F.lit(1)).alias("n")).withColumn("host", F.split("d", "/")[0])
    y = x.toDF("e", "b", "n_b", "host")
    pairs = x.join(y, "host").filter((F.col("folder") < F.col("b")) | ((F.col("folder") == F.col("b")) & (F.col("n") > 1)))
    file = lambda c: F.concat(c, F.lit("/x"))
    return pairs.select(F.col("folder").alias("a"), "b", F.col("n").alias("n_a"), "n_b", F.round(X.folder_affinity(file("d"), file("e")), 6).alias("affinity"))


@query("F28_outline_and_points", """WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '<[^>]+>', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g') AS c FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, trim(regexp_replace(regexp_replace(c, '(?m)^[ \\t]*[-*_]{3,}[ \\t]*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')[:6000] AS c FROM d),
p AS (SELECT doc_id, list_transform(string_split_regex(c, '\\n{2,}'), lambda x: trim(regexp_replace(regexp_replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), '^#+ *', ''), '[*_`]+', '', 'g'))) AS ps FROM e),
f AS (SELECT doc_id, list_filter(ps, lambda x: length(replace(x, ' ', '')) >= 35 AND NOT starts_with(x, 'http'))[1] AS x FROM p)
SELECT doc_id, coalesce(CASE WHEN length(replace(x, ' ', '')) > 220 THEN x[:180] || '...' ELSE x END, '') AS thesis FROM f""".replace("\\\\", "\\"))
def thesis(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", X.thesis(F.col("text")).alias("thesis"))


@query("F21_html_text")
def html_text(t):
    return t("pages").select("page_id", L.html_text("html").alias("text"))


@query("F46_split_by_count", "SELECT doc_id AS id, i AS part, text[i * 3000 + 1:(i + 1) * 3000] AS content FROM (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 3000 + 1)::INT)) AS i FROM documents WHERE length(text) > 0)")
def split_by_count(t):
    return L.split_long(t("documents"), "doc_id", "text", "char_count", 3000).select("id", F.col("part").cast("long").alias("part"), "content")


@query("F46_split_by_chapter", """WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(chr(10) || text, '\\n(#{1,3}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')) AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS id, count(*) AS parts, max(length(c)) AS longest FROM s GROUP BY doc_id""".replace("\\\\", "\\"))
def split_by_chapter(t):
    parts = L.split_long(t("documents"), "doc_id", "text", "chapter")
    return parts.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.max(F.length("content")).cast("long").alias("longest"))


@query("F46_split_by_paragraph")
def split_by_paragraph(t):
    return L.split_long(t("documents"), "doc_id", "text", "paragraph", 3000)


@query("F47_skill_match", """WITH s AS (SELECT n_nationkey AS id, lower(n_name) AS term FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name) FROM region UNION ALL SELECT 200, 'the'),
g AS (SELECT doc_id, lower(text) AS goal FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(id) AS skill FROM g LEFT JOIN s ON contains(goal, term) GROUP BY doc_id""")
def skill_match(t):
    """The first enabled skill one of whose terms a text holds."""
    skills = t("nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("term")).union(t("region").select(F.col("r_regionkey") + 100, F.lower("r_name"))).union(t("nation").limit(1).select(F.lit(200), F.lit("the")))
    return first_held(t("documents").filter("text IS NOT NULL"), skills, "doc_id", "text").select("doc_id", F.col("skill").cast("int").alias("skill"))


@query("F49_parsed_times", "SELECT event_id, ts AS mail, ts AS iso, NULL::TIMESTAMP AS neither FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def parsed_times(t):
    """Event times written as RFC 2822 and ISO 8601 texts and read again."""
    ts = F.date_trunc("second", F.col("ts"))
    mail, iso = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = lambda c: X.parsed_time(c).cast("timestamp_ntz")
    return t("events").select("event_id", plain(mail).alias("mail"), plain(iso).alias("iso"), plain(F.lit("soon")).alias("neither"))


_FILES = "f AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path, length(html) AS size FROM pages), m AS (SELECT *, string_split(path, '/')[1] AS folder, string_split(path, '/')[-1] AS name FROM f)"


def _files(t):
    f = t("pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.length("html").cast("long").alias("size"))
    return f.withColumn("folder", F.split("path", "/")[0]).withColumn("name", F.element_at(F.split("path", "/"), -1))


@query("A32_file_tree_stats", f"WITH {_FILES}, s AS (SELECT list(path ORDER BY path)[:12] AS samples FROM m) SELECT count(*) AS files, count(DISTINCT folder) AS folders, count(*) FILTER (regexp_matches(name, '7$')) AS markdown, sum(size)::BIGINT AS total_size, array_to_string(any_value(samples), ',') AS samples FROM m, s")
def file_tree_stats(t):
    """Files, folders, files of one kind (a name that ends with 7 stands in for an extension), bytes, and twelve samples."""
    f = _files(t)
    samples = f.select("path").orderBy("path").limit(12).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("samples"))
    return f.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("folder").alias("folders"), F.count_if(F.col("name").rlike("7$")).alias("markdown"), F.sum("size").alias("total_size")).crossJoin(samples)


@query("S21_tree_order", """WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages), s AS (SELECT string_split(path, '/') AS s FROM p),
e AS (SELECT DISTINCT array_to_string(s[:k], '/') AS path, array_to_string(s[:k - 1], '/') AS folder, s[k] AS name, k AS level, k < len(s) AS is_folder FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM s))
SELECT path, folder, level, is_folder, row_number() OVER (PARTITION BY folder ORDER BY name LIKE '%9' DESC, NOT is_folder, name) AS place FROM e""")
def tree_order(t):
    """Entries of all folders at any depth: those that are put first (here: whose name ends with 9), then folders before files, then by name."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    s = t("pages").select(F.split(path, "/", -1).alias("s")).distinct()
    part = s.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("level"))
    upto = lambda k: F.array_join(F.slice("s", F.lit(1), k), "/")
    e = part.select(upto(F.col("level")).alias("path"), upto(F.col("level") - 1).alias("folder"), F.element_at("s", F.col("level")).alias("name"), "level", (F.col("level") < F.size("s")).alias("is_folder")).distinct()
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.endswith("name", F.lit("9")).desc(), F.col("is_folder").desc(), "name"))
    return e.select("path", "folder", "level", "is_folder", place.alias("place"))


@query("P19_narrow_scan", "SELECT doc_id AS id, lang, coalesce(source, '') AS kb_id, coalesce(n_chars, 0) AS n_chars FROM documents")
def narrow_scan(t):
    return t("documents").select(F.col("doc_id").alias("id"), "lang", F.coalesce("source", F.lit("")).alias("kb_id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("P21_link_candidates", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 20")
def link_candidates(t):
    return t("part").filter(F.contains(F.lower("p_name"), F.lit("a"))).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20)


@query("J14_embed_resolution", """WITH RECURSIVE n AS (SELECT n_nationkey AS id, (n_nationkey * 3 + 1) % 25 AS ref FROM nation), r AS (SELECT id, ref, [id] AS seen, 1 AS depth FROM n
UNION ALL SELECT r.id, n.ref, list_append(seen, n.id), depth + 1 FROM r JOIN n ON n.id = r.ref WHERE depth < 5 AND NOT list_contains(seen, r.ref))
SELECT id, max(depth)::INT AS depth, array_to_string(arg_max(seen, depth), '>') AS chain FROM r GROUP BY id""")
def embed_resolution(t):
    """Pages that embed each other, followed five deep; a page that stands in the chain already isn't followed again."""
    n = t("nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("ref"))
    return L.embed_chains(n, 5).select("id", "depth", F.array_join("chain", ">").alias("chain"))


@query("J15_alias_map", "WITH a AS (SELECT lower(r_name) AS alias, 'region ' || r_regionkey AS page FROM region), l AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE n_name END AS link FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT n_nationkey, link, coalesce(page, link) AS page FROM l LEFT JOIN a ON a.alias = lower(link)")
def alias_map(t):
    links = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("link"))
    aliases = t("region").select(F.lower("r_name").alias("alias"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("page"))
    return links.join(aliases, F.lower("link") == F.col("alias"), "left").select("n_nationkey", "link", F.coalesce("page", "link").alias("page"))


@query("S15_api_items", """WITH e AS (SELECT event_id, value, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, coalesce(k, '') || ' | value ' || coalesce(round(value, 2)::DECIMAL(18,2)::VARCHAR, '0') AS content FROM e WHERE value IS NOT NULL""")
def api_items(t):
    """Feed items from JSON records: their fields joined by bars, missing ones left out as empty."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return t("events").filter("value IS NOT NULL").select("event_id", F.concat(k, F.lit(" | value "), F.round("value", 2).cast("decimal(18,2)").cast("string")).alias("content"))


@query("S15_trending_items", """SELECT p_name AS title, 'https://github.com/' || replace(p_brand, '#', '') || '/p' || p_partkey AS link, p_type || ' & more' AS content, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size::VARCHAR END AS stars FROM part WHERE p_partkey % 5 <> 0""")
def trending_items(t):
    """Parts as cards of pages of trending projects, ten a page; cards of people (every fifth) are no projects."""
    k = F.col("p_partkey")
    link = F.when(k % 5 == 0, F.concat(F.lit("/login/u"), k.cast("string"))).otherwise(F.concat(F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/p"), k.cast("string")))
    stars = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<span>"), F.col("p_size").cast("string"), F.lit(" stars today</span>")))
    card = F.concat(F.lit('<article class="x Box-row"><h2 class="h">\n<a href="'), link, F.lit('">'), F.col("p_name"), F.lit("</a></h2><p class='d'> "), F.col("p_type"), F.lit(" &amp; <b>more</b> </p>"), stars, F.lit("</article>"))
    pages = t("part").select(card.alias("c"), F.floor(k / 10).alias("page")).groupBy("page").agg(F.concat(F.lit("<html><article class='other'>x</article>"), F.array_join(F.collect_list("c"), "\n")).alias("html"))
    return pages.select(F.inline(S.trending_items(F.col("html"))))


@query("S16_collected_items", """WITH c AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) AS link, length(html) AS n FROM pages), g AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(link, '[0-9]+$', '') ORDER BY page_id) AS place FROM c WHERE n >= 40)
SELECT page_id, link FROM g WHERE place = 1""")
def collected_items(t):
    """Fetched items of 40 characters or more, one for each address but for its number, the first."""
    c = t("pages").select("page_id", F.lower(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "")).alias("link"), F.length("html").alias("n")).filter("n >= 40")
    return c.groupBy(F.regexp_replace("link", "[0-9]+$", "").alias("key")).agg(F.min_by(F.struct("page_id", "link"), "page_id").alias("x")).select("x.*")


@query("K5_index_save_load", f"WITH {_TOK} SELECT token, count(DISTINCT id) AS n_docs, count(*) AS n_hits, max(len(tokens)) AS longest FROM (SELECT id, tokens, unnest(tokens) AS token FROM tok) GROUP BY token")
def index_save_load(t):
    """The stored inverted index that searches use, opened again from its folder: each token's documents and hits, from its blocks."""
    built = I.of_table(t("documents"), "doc_id", "text", ("source",))
    return I.hits(I.load(built.spark, built.folder)).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_hits"), F.max("dl").cast("long").alias("longest"))


@query("K1_vector_store", "SELECT label, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total FROM embeddings GROUP BY label")
def vector_store(t):
    """Vectors committed as a table and read back."""
    e = L.stored(t("embeddings"), "vectors")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 3).alias("total"))


@query("K4_replaced_partition", "SELECT n_regionkey AS doc_key, count(*) AS n, max(n_name) AS last FROM (SELECT n_regionkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name FROM nation) GROUP BY n_regionkey")
def replaced_partition(t):
    """A document's part of a stored graph replaced by a dynamic partition overwrite; the other parts stay."""
    n = t("nation").select(F.col("n_regionkey").alias("doc_key"), "n_name")
    new = n.filter("doc_key = 2").select("doc_key", F.lower("n_name").alias("n_name"))
    return L.replaced(n, new, "doc_key").groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("last"))


@query("S23_store_scan", "SELECT vec_id, label, CASE WHEN label = 0 THEN 'default' ELSE 'kb' || label END AS kb_id FROM embeddings ORDER BY vec_id LIMIT 10000")
def store_scan(t):
    """The first 10,000 rows of a vector store with their knowledge base's name; that many is the feature."""
    return t("embeddings").orderBy("vec_id").limit(10_000).select("vec_id", "label", F.when(F.col("label") == 0, "default").otherwise(F.concat(F.lit("kb"), F.col("label").cast("string"))).alias("kb_id"))


@query("R4_model_filtered_search", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, q WHERE label <> 3) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def model_filtered_search(t):
    """Hits of another model (here: of label 3) are left out before the limit, so none has to be fetched in excess."""
    from marlstone.operators import retrieval as R

    q = t("embeddings").filter("vec_id = 0").first()["embedding"]
    return R.vector_search(t("embeddings").filter("label <> 3"), q, "vec_id", "embedding").orderBy(F.desc("score"), "id").limit(10).withColumn("score", F.round("score", 6))


@query("K8_redacted_append", f"SELECT event_id, event_type, {_REDACTED} FROM events")
def redacted_append(t):
    """Telemetry rows with secrets in their properties redacted, as they are appended to the stored log."""
    e = t("events").select("event_id", "event_type", C.redact_map(event_properties()).alias("p"))
    return L.stored(e, "telemetry").select("event_id", "event_type", *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("k", "api_key", "prompt", "note")])
