"""Scalar and per-document text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.plans._base import query


@query("F1_search_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) + len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS n_tokens FROM documents")
def search_tokens(t):
    return t("documents").select("doc_id", F.size(T.search_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("F3_words", r"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)")
def words(t):
    w = T.words(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("F4_agent_terms", "SELECT doc_id, len(list_distinct(x)) AS n_terms, x[1] AS first_term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]+') AS x FROM documents)")
def agent_terms(t):
    terms = T.agent_terms(F.col("text"))
    return t("documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.try_element_at(terms, F.lit(1)).alias("first_term"))


@query("F8_character_bigrams", r"SELECT item_id, len(list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, length(x)), lambda i: substring(x, i, 2)))))) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)")
def character_bigrams(t):
    return t("benchmark").select("item_id", F.size(T.bigrams(T.words(F.col("text")))).cast("long").alias("n"))


@query("F10_word_jaccard", r"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\S+')) AS a, list_distinct(regexp_extract_all(lower(reply), '\S+')) AS b FROM p WHERE reply IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(b) = 0 THEN 0 ELSE least(1.0, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 2.5) END, 3) AS similarity FROM w""")
def word_jaccard(t):
    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t("conversations").withColumn("reply", reply).filter("reply IS NOT NULL")
    a, b = (F.array_distinct(T.matches(F.lower(c), "\\S+")) for c in ("text", "reply"))
    return pairs.select("conv_id", "turn", F.round(F.when(F.size(b) == 0, 0.0).otherwise(F.least(F.lit(1.0), T.jaccard(a, b) * 2.5)), 3).alias("similarity"))


@query("F19_snippet", "SELECT doc_id, CASE WHEN p > 0 THEN substring(text, greatest(p - 50, 1), p - greatest(p - 50, 1) + 105) ELSE substring(text, 1, 200) END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'token') AS p FROM documents)")
def snippet(t):
    return t("documents").select("doc_id", T.snippet(F.col("text"), F.lit("token")).alias("snippet"))


@query("F18_highlight", "SELECT item_id, regexp_replace(regexp_replace(text, 'the', '<mark>the</mark>', 'gi'), 'mark', '<mark>mark</mark>', 'gi') AS html FROM benchmark")
def highlight(t):
    return t("benchmark").select("item_id", T.highlight(F.col("text"), ["the", "mark"]).alias("html"))


@query("F20_canonical_url", r"""SELECT page_id, lower(regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', ''), '^([^?]*)', 1), '/+$', '') || regexp_extract(b, '(\?.*)$', 1) AS url
FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS b FROM pages)""")
def canonical_url(t):
    return t("pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("F22_published_date", r"SELECT page_id, nullif(regexp_extract(html, '(20[0-9]{2})[-/.]([01]?[0-9])[-/.]([0-3]?[0-9])', 0), '') AS published, length(html) AS n FROM pages")
def published_date(t):
    return t("pages").select("page_id", F.nullif(F.regexp_extract("html", r"(20[0-9]{2})[-/.]([01]?[0-9])[-/.]([0-3]?[0-9])", 0), F.lit("")).alias("published"), F.length("html").cast("long").alias("n"))


_SENT = "list_filter(list_transform(regexp_split_to_array(text, '[。！？\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 0)"


_QUALITY = rf"""WITH x AS (SELECT doc_id, text, greatest(length(regexp_replace(text, '[ \n]', '', 'g')), 1) AS n, string_split(text, chr(10)) AS lines, {_SENT} AS s,
  list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '\s+', '', 'g')), lambda p: length(p) > 0) AS ps FROM documents)
SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE
  - CASE WHEN len(regexp_extract_all(text, '[a-zA-Z]')) < 10 THEN 0.3 ELSE 0 END
  - CASE WHEN len(regexp_extract_all(text, '[0-9]')) / n > 0.6 THEN 0.3 ELSE 0 END
  - CASE WHEN len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s.,;:!?“”‘’（）—…·\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}-]')) / n > 0.3 THEN 0.2 ELSE 0 END
  - CASE WHEN len(s) > 0 AND list_sum(list_transform(s, lambda v: length(v))) / len(s) < 5 THEN 0.2 ELSE 0 END
  - CASE WHEN len(ps) >= 2 AND len(list_distinct(ps)) < len(ps) THEN 0.2 ELSE 0 END
  - CASE WHEN len(lines) > 5 AND len(list_filter(lines, lambda v: length(trim(v, ' ')) BETWEEN 1 AND 2)) / len(lines) > 0.5 THEN 0.15 ELSE 0 END
  - CASE WHEN regexp_matches(text, '[a-zA-Z]{{20,}}') OR regexp_matches(text, '{"|".join("(?:" + (chr(92) + c if not c.isalnum() else c) + "){5,}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789éèêçàäöüßáíóúñ#*$%&!|., =")}') THEN 0.3 ELSE 0 END)), 3) AS score
FROM x"""


@query("F26_text_quality", _QUALITY)
def text_quality(t):
    return t("documents").select("doc_id", T.quality_score(F.col("text")).alias("score"))


@query("P16_valid_documents", f"SELECT * FROM ({_QUALITY}) WHERE score >= 0.4")
def valid_documents(t):
    return t("documents").select("doc_id", T.quality_score(F.col("text")).alias("score")).filter("score >= 0.4")


@query("F27_mojibake_score", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) - 12 * len(regexp_extract_all(text, '\x{fffd}')) AS score FROM documents")
def mojibake_score(t):
    return t("documents").select("doc_id", (F.size(T.words(F.col("text"))) - 12 * T.count_of(F.col("text"), "�")).cast("long").alias("score"))


@query("F32_content_ids", "SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 20) AS item_key, md5(text) AS md5 FROM documents")
def content_ids(t):
    h = F.sha2("text", 256)
    return t("documents").select("doc_id", h.alias("content_hash"), F.substring(h, 1, 20).alias("item_key"), F.md5("text").alias("md5"))


@query("F33_trim_sentence", r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN cut >= 186 THEN substring(text, 1, cut) ELSE substring(text, 1, 300) || '……' END AS summary
FROM (SELECT doc_id, text, length(regexp_extract(substring(text, 1, 300), '(?s)^(.*[。！？.!?])', 1)) AS cut FROM documents)""")
def trim_sentence(t):
    return t("documents").select("doc_id", T.trim_sentence(F.col("text"), 300).alias("summary"))


_TAGS = {"secret": ["token ="], "license": ["license", "licensed"], "network": ["@mail", "+1 ("], "table": [" | "]}


@query("F34_auto_tags", "SELECT doc_id, list_filter(['secret', 'license', 'network', 'table'], lambda g: CASE g WHEN 'secret' THEN contains(s, 'token =') WHEN 'license' THEN contains(s, 'license') WHEN 'network' THEN contains(s, '@mail') OR contains(s, '+1 (') ELSE contains(s, ' | ') END)::VARCHAR AS tags FROM (SELECT doc_id, lower(substring(text, 1, 5000)) AS s FROM documents)")
def auto_tags(t):
    sample = F.lower(F.substring("text", 1, 5000))
    tags = []
    for name, keys in _TAGS.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(sample, F.lit(k))
        tags.append(F.when(hit, F.lit(name)))
    found = F.filter(F.array(*tags), lambda x: x.isNotNull())
    return t("documents").select("doc_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("tags"))


@query("F35_strategy_detection", r"""WITH x AS (SELECT doc_id, text[1:5000] AS s, list_transform(string_split(text, chr(10))[1:200], lambda l: trim(l, ' ')) AS l FROM documents),
n AS (SELECT *, len(list_filter(l, lambda v: regexp_matches(v, '^[0-9]+(\.[0-9]+)*[.\s]\s*\S'))) AS num FROM x)
SELECT doc_id, CASE WHEN len(regexp_extract_all(s, '第[一二三四五六七八九十百千0-9]+[条章节款]')) >= 3 THEN 'law' WHEN len(regexp_extract_all(s, '(?m)^\s*(?:Q\s*[:：]|问题?\s*[:：])')) >= 3 THEN 'qa'
  WHEN len(list_filter(l, lambda v: regexp_matches(v, '^第[一二三四五六七八九十百千0-9]+[章回]|^(?i)chapter\s+[0-9]+'))) >= 2 THEN 'book' WHEN len(list_filter(l, lambda v: regexp_matches(v, '^#{1,6}\s'))) + num >= 4 AND num >= 3 THEN 'academic'
  WHEN len(regexp_extract_all(s, '[“「][^”」]+[”」]')) >= 5 AND length(s) / greatest(len(string_split_regex(s, '\n\s*\n')), 1) < 200 THEN 'novel' ELSE 'semantic' END AS strategy FROM n""")
def strategy_detection(t):
    return t("documents").select("doc_id", T.detect_strategy(F.col("text")).alias("strategy"))


_INTENTS = [("greeting", ["hello", "hallo", "hola"]), ("compare", ["compare", "vs"]), ("secret", ["token=", "password"]), ("list", ["the", "les", "die"])]


@query("F36_intent", r"""SELECT conv_id, turn, CASE WHEN contains(p, 'hello') OR contains(p, 'hallo') OR contains(p, 'hola') THEN 'greeting' WHEN contains(p, 'compare') OR contains(p, 'vs') THEN 'compare'
WHEN contains(p, 'token=') OR contains(p, 'password') THEN 'secret' WHEN contains(p, 'the') OR contains(p, 'les') OR contains(p, 'die') THEN 'list' ELSE 'generic' END AS intent
FROM (SELECT conv_id, turn, regexp_replace(lower(text), '[\s！？!，。,.、？?：:]+', '', 'g') AS p FROM conversations)""")
def intent(t):
    return t("conversations").select("conv_id", "turn", T.classify_intent(F.col("text"), _INTENTS).alias("intent"))


@query("F39_token_estimate", "SELECT doc_id, length(text) // 2 AS listing, length(text) // 2 + 1 AS memory FROM documents")
def token_estimate(t):
    n = F.floor(F.length("text") / 2)
    return t("documents").select("doc_id", n.alias("listing"), (n + 1).alias("memory"))


@query("F41_run_keys", "SELECT event_id, left(sha256('briefing:1:' || strftime(ts, '%Y-%m-%d')), 24) AS run_key, isoyear(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week FROM events")
def run_keys(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    week = F.concat(F.expr("extract(YEAROFWEEK FROM ts)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return t("events").select("event_id", F.substring(F.sha2(F.concat(F.lit("briefing:1:"), day), 256), 1, 24).alias("run_key"), week.alias("week"))


@query("F52_json_decode", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_decode(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"))


@query("W9_repeated_lines", "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) BETWEEN 1 AND 80 AND line NOT SIMILAR TO '[#|].*|- .*' GROUP BY doc_id, line) SELECT doc_id, line, n FROM c WHERE n >= 4")
def repeated_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line", F.trim("line"))
    short = lines.filter((F.length("line").between(1, 80)) & ~F.col("line").rlike("^(?:[#|]|- )"))
    return short.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")


@query("U9_line_dedup", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
k AS (SELECT doc_id, line, p, lower(regexp_replace(line, '\s+', '', 'g')) AS key FROM l), g AS (SELECT doc_id, key, min(p) AS p FROM k WHERE key <> '' GROUP BY doc_id, key)
SELECT doc_id, count(*) AS kept FROM g GROUP BY doc_id""")
def line_dedup(t):
    key = F.lower(F.regexp_replace("line", "\\s+", ""))
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("key", key).filter("key <> ''")
    first = lines.groupBy("doc_id", "key").agg(F.min("p").alias("p"), F.max_by("line", F.length("line")).alias("line"))
    return first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("F31_safe_rewrite", r"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (SELECT conv_id, turn, text, r, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(r), '[a-z0-9]+')) AS b FROM p WHERE r IS NOT NULL)
SELECT conv_id, turn, length(r) <= greatest(4 * length(text), 80) AND len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.25 AS safe FROM w""")
def safe_rewrite(t):
    pairs = t("conversations").withColumn("r", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("r IS NOT NULL")
    a, b = (F.array_distinct(T.matches(F.lower(c), "[a-z0-9]+")) for c in ("text", "r"))
    safe = (F.length("r") <= F.greatest(4 * F.length("text"), F.lit(80))) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)) >= 0.25)
    return pairs.select("conv_id", "turn", safe.alias("safe"))


@query("R21_answer_evaluation", r"""WITH p AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
w AS (SELECT conv_id, turn, lower(answer) AS c, list_distinct(regexp_extract_all(lower(text), '\S+')) AS q, list_distinct(regexp_extract_all(lower(answer), '\S+')) AS a FROM p WHERE role = 'user' AND answer IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.5 ELSE least(1.0, len(list_intersect(q, a)) / len(q) * 1.5) END, 3) AS relevancy,
round(CASE WHEN len(q) = 0 THEN 0.5 ELSE len(list_filter(q, lambda x: contains(c, x))) / len(q) END, 3) AS recall FROM w""")
def answer_evaluation(t):
    pairs = t("conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'user' AND answer IS NOT NULL")
    q, a = (F.array_distinct(T.matches(F.lower(c), "\\S+")) for c in ("text", "answer"))
    n = F.greatest(F.size(q), F.lit(1))
    some = lambda x: F.round(F.when(F.size(q) == 0, 0.5).otherwise(x), 3)
    return pairs.select("conv_id", "turn", some(F.least(F.lit(1.0), F.size(F.array_intersect(q, a)) / n * 1.5)).alias("relevancy"), some(F.size(F.filter(q, lambda x: F.contains(F.lower("answer"), x))) / n).alias("recall"))
