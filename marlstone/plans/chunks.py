"""Chunking queries over documents and pages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from marlstone.operators import chunking as C
from marlstone.operators import layout as Y
from marlstone.plans._base import query
from marlstone.sources import formats as S


@query("C1_general_chunks")
def general_chunks(t):
    return C.chunk_with(t("documents"), "doc_id", "text", C.pack)


@query("C8_parent_child_chunks")
def parent_child_chunks(t):
    return C.chunk_with(t("documents"), "doc_id", "text", C.parents_and_children)


@query("C11_fixed_chunks", "WITH k AS (SELECT doc_id AS id, text, unnest(range(0, (length(text) + 499) // 500)) AS chunk_index FROM documents) SELECT id, chunk_index::INT AS chunk_index, substring(text, chunk_index * 500 + 1, 500) AS content FROM k")
def fixed_chunks(t):
    return C.fixed_chunks(t("documents"), "doc_id", "text", 500)


@query("C12_heading_sections", r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
s AS (SELECT id, line, p, sum(CASE WHEN p = 1 OR regexp_matches(line, '^[A-Z][a-z]+\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) - 1 AS section FROM l)
SELECT id, section::INT AS section, count(*)::INT AS n_lines FROM s GROUP BY id, section""")
def heading_sections(t):
    return C.heading_chunks(t("documents"), "doc_id", "text", r"^[A-Z][a-z]+\.$").select("id", "section", "n_lines")


@query("C13_sentences", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[。！？；.!?;\n]'), lambda s: s), lambda s: length(trim(s, ' ')) > 0)) AS n FROM documents")
def sentence_split(t):
    parts = F.filter(F.split("text", r"[。！？；.!?;\n]", -1), lambda s: F.length(F.trim(s)) > 0)
    return t("documents").select("doc_id", F.size(parts).cast("long").alias("n"))


@query("C14_chunk_quality", """WITH k AS (SELECT doc_id AS id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents), c AS (SELECT id, substring(text, i * 500 + 1, 500) AS s FROM k)
SELECT id, count(*) AS chunks, count(*) FILTER (length(s) < 10) AS tiny, count(*) FILTER (NOT regexp_matches(s, '[。！？.!?]$')) AS mid_sentence FROM c GROUP BY id""")
def chunk_quality(t):
    c = C.fixed_chunks(t("documents"), "doc_id", "text", 500)
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.length("content") < 10).alias("tiny"), F.count_if(~F.col("content").rlike("[。！？.!?]\\z")).alias("mid_sentence"))


@query("A31_chunk_pollution", "WITH k AS (SELECT doc_id AS id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents), c AS (SELECT id, substring(text, i * 1000 + 1, 1000) AS s FROM k) SELECT count(*) AS chunks, count(*) FILTER (len(regexp_extract_all(s, 'token =')) > 1) AS polluted, count(*) FILTER (contains(s, 'Licen')) AS boilerplate FROM c")
def chunk_pollution(t):
    c = C.fixed_chunks(t("documents"), "doc_id", "text", 1000)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.regexp_count("content", F.lit("token =")) > 1).alias("polluted"), F.count_if(F.contains("content", F.lit("Licen"))).alias("boilerplate"))


@query("S7_html_to_markdown")
def html_to_markdown(t):
    return t("pages").select("page_id", S.html_markdown(F.col("html")).alias("markdown"))


@query("S13_image_links", r"SELECT page_id, len(regexp_extract_all(html, '<img[^>]*>')) AS images, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS links FROM pages")
def image_links(t):
    return t("pages").select("page_id", F.regexp_count("html", F.lit("<img[^>]*>")).cast("long").alias("images"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).cast("long").alias("links"))


@query("S19_structured_records", "SELECT p_partkey, json_object('name', p_name, 'size', p_size) AS record FROM part ORDER BY p_partkey LIMIT 50")
def structured_records(t):
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return t("part").orderBy("p_partkey").limit(50).select("p_partkey", record.alias("record"))


@query("C2_semantic_chunks")
def semantic_chunks(t):
    return C.chunk_with(t("documents"), "doc_id", "text", C.semantic_chunks)


@query("C3_news_chunks")
def news_chunks(t):
    """Each source's documents of one language as articles under dated markers."""
    marked = F.concat(F.lit("2026-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" 正文："), F.col("text"))
    return C.chunk_with(t("documents").filter("text IS NOT NULL").select("doc_id", marked.alias("text")), "doc_id", "text", C.news_chunks)


@query("C7_long_text_windows")
def long_text_windows(t):
    return C.chunk_with(t("documents"), "doc_id", "text", C.split_long)


@query("C9_layout_chunks")
def layout_chunks(t):
    """Chunks by layout: sections under headings, tables and images whole, headers, footers and page numbers left out."""
    return Y.layout_chunks(t("documents"), "doc_id", "text")


@query("C10_layout_blocks", r"""WITH l AS (SELECT page_id, trim(s, ' ') AS s, i FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), 1) AS i FROM pages)),
p AS (SELECT page_id, s, i, s <> '' AND NOT regexp_matches(s, '^[0-9]{1,4}$') AS para FROM l), q AS (SELECT *, para AND NOT coalesce(lag(para) OVER (PARTITION BY page_id ORDER BY i), false) AS starts FROM p)
SELECT page_id AS id, count(*) FILTER (starts) AS paragraphs, count(*) FILTER (s <> '' AND NOT para) AS page_numbers, coalesce(sum(length(regexp_replace(s, '\s+', '', 'g'))), 0)::BIGINT AS chars FROM q GROUP BY page_id""")
def layout_blocks(t):
    """Blocks of pages without their tags, of which the test tables' have two kinds: how many of each, and all their characters but white space."""
    pages = t("pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    b = Y.layout_blocks(pages, "page_id", "text")
    chars = F.sum(F.length(F.regexp_replace("content", r"\s+", ""))).alias("chars")
    found = b.groupBy("id").agg(F.count_if(F.col("type") == "paragraph").alias("paragraphs"), F.count_if(F.col("type") == "page_number").alias("page_numbers"), chars)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t("pages").select(F.col("page_id").alias("id")).join(found, "id", "left").select("id", zero("paragraphs"), zero("page_numbers"), zero("chars"))


def _register(kind):
    @query(f"C4_{kind}_chunks")
    def chunks(t):
        return C.chunk_with(t("documents"), "doc_id", "text", partial(C.packed_parts, kind=kind))


for _kind in C.STARTS:
    _register(_kind)


@query("A30_chunk_quality_report", """WITH c AS (SELECT doc_id, unnest(range(0, ((length(text) - 1) // 500 + 1)::INT)) AS i, text FROM documents WHERE length(text) > 0), x AS (SELECT doc_id, text[i * 500 + 1:(i + 1) * 500] AS c FROM c)
SELECT count(*) AS chunks, count(*) FILTER (length(trim(c)) < 20) AS too_short, count(*) FILTER (length(regexp_replace(c, '[^0-9]', '', 'g')) > 0.5 * length(c)) AS mostly_digits,
  count(*) FILTER (NOT regexp_matches(c, '[.!?;。！？；]\\s*$')) AS open_end, count(*) FILTER (contains(c, '###')) AS marks FROM x""".replace("\\\\", "\\"))
def chunk_quality_report(t):
    """Issues and warnings over all chunks of 500 characters."""
    c = F.col("content")
    return C.fixed_chunks(t("documents"), "doc_id", "text", 500).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.length(F.trim(c)) < 20).alias("too_short"), F.count_if(F.length(F.regexp_replace(c, "[^0-9]", "")) > 0.5 * F.length(c)).alias("mostly_digits"),
        F.count_if(~c.rlike(r"[.!?;。！？；]\s*$")).alias("open_end"), F.count_if(F.contains(c, F.lit("###"))).alias("marks"),
    )
