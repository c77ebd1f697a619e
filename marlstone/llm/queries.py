"""The queries op1 to op13 over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, conversations, html_extract, media, mixing, neardup, pii, quality, sharding, simhash, token_counts, token_shards, vector_codes


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_documents(_documents(spark, sf_dir))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.digest_shards(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("shard_source").alias("source"), "position")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("mix_source").alias("source"), "copies")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_media, op3_token_shards, op4_bpe, op5_neardup, op6_sharding, op7_mixing, op8_token_counts, op9_quality, op10_pii, op11_simhash, op12_conversations, op13_vector_codes)}


_SQL_WORD = r"[^\x20\x09-\x0D]+"

_OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_WORD}') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '{_SQL_WORD}') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(source, chr(0)) AS host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
    100 * n_symbols > {quality.LOOSE["symbols"]} * n_words OR 100 * n_dup_lines > {quality.LOOSE["lines"]} * n_lines AS loose,
    100 * n_symbols > {quality.TIGHT["symbols"]} * n_words OR 100 * n_dup_lines > {quality.TIGHT["lines"]} * n_lines AS tight FROM m),
o AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR loose)::DOUBLE AS f FROM b GROUP BY host),
p AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM o),
k AS (SELECT mu, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, mu * (1 - mu) / v - 1)) ELSE 1e6 END AS k FROM p),
v AS (SELECT host, (f + mu * k) / (n + k) > {quality.HOST_LIMIT} AS bad FROM o, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT CASE WHEN bad THEN tight ELSE loose END AS kept
FROM b JOIN v USING (host)
"""


def _option(op: str, cost: str, line: str, state: str) -> str:
    """An edit and what follows it: its cost, audit and lines."""
    return f"{{'c': {cost} + {state}.c, 'a': '{op}' || {state}.a, 't': list_concat({line}, {state}.t)}}"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _edits(state: str, after: dict[str, str]) -> str:
    """The best that consumes a row in a state; after: the states that roles lead to."""
    own = " ".join(f"WHEN initial = '{r}' THEN {_option('K', 'cut', '[line]', s)}" for r, s in after.items())
    named = {"u": "user", "a": "assistant"}
    turned = [f"CASE WHEN NOT gone THEN {_option('R', '2 + cut', f"['{named[r]}:' || text]", s)} END" for r, s in after.items() if r != "s"]
    return _least(_option("D", "3", "[]::VARCHAR[]", state), f"CASE WHEN gone THEN NULL {own} END", *turned)


def _insert(role: str, state: str) -> str:
    return _option("I", "2", f"['{role}:']", state)


_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
_OP12 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {_BITS}), 4294967295) % 20 AS fate FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, fate FROM f WHERE fate <> 0),
e AS (SELECT conv_id, turn, role, text FROM d UNION ALL SELECT conv_id, turn, role, text FROM d WHERE fate = 3),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM e),
r AS (SELECT *, said = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(said, 1) NOT IN ('.', '!', '?') AS cutoff, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, blank OR again AS gone, CASE WHEN cutoff THEN 1 ELSE 0 END AS cut, role || ':' || text AS line FROM r),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cutoff AND NOT again AND NOT blank) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
w AS (SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS s1, {{'c': 2, 'a': 'I', 't': ['assistant:']}} AS s2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s3 FROM c
UNION ALL SELECT conv_id, i, {_least("b0", _insert("user", "v2"))}, {_least("b1", _insert("user", "v2"))}, v2, {_least("b3", _insert("user", "v2"))} FROM (SELECT conv_id, i, b0, b1, b3, {_least("b2", _insert("assistant", "b3"))} AS v2 FROM (
  SELECT g.conv_id, g.i, {_edits("s0", {"s": "s1", "u": "s2"})} AS b0, {_edits("s1", {"u": "s2"})} AS b1, {_edits("s2", {"a": "s3"})} AS b2, {_edits("s3", {"u": "s2"})} AS b3
  FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1))),
z AS (SELECT conv_id, s0 FROM w WHERE i = 1), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_PARTS, _ENTRIES, _SCALE = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE


def _assigned(books: str) -> str:
    """Of each part of each vector, the distance and number of the nearest entry."""
    return f"SELECT id, x.p, any_value(x.x) AS x, min({{'d': list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': b.k}}) AS m FROM x JOIN {books} b ON b.p = x.p GROUP BY id, x.p"


def _learnt(books: str, assigned: str) -> str:
    mean = "(s - ((s % n) + n) % n) // n"
    sums = f"SELECT p, k, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, m.k AS k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {assigned}) GROUP BY p, k, i"
    return f"SELECT b.p, b.k, coalesce(u.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT p, k, list({mean} ORDER BY i) AS x FROM ({sums}) GROUP BY p, k) u ON u.p = b.p AND u.k = b.k"


_OP13 = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {_SCALE})::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT id, p, e[p * (len(e) // {_PARTS}) + 1 : (p + 1) * (len(e) // {_PARTS})] AS x FROM v, (SELECT unnest(range({_PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS k, x FROM x WHERE id <= {_ENTRIES}), a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_learnt("b0", "a0")}), a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_learnt("b1", "a1")}),
f AS (SELECT id, string_agg(lpad(lower(to_hex(m.k)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM ({_assigned("b2")}) GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (id), h
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_neardup": _OP5, "op9_quality": _OP9, "op12_conversations": _OP12, "op13_vector_codes": _OP13}
