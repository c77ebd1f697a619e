"""Conversation windows and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.plans._base import query

def _by():
    return Window.partitionBy("conv_id")


@query("W4_token_budget", """WITH c AS (SELECT conv_id, turn, length(text) // 2 + 1 AS tokens, sum(length(text) // 2 + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, tokens FROM c WHERE total <= 200 OR r = 1""")
def token_budget(t):
    c = t("conversations").filter("role <> 'system'").withColumn("tokens", F.floor(F.length("text") / 2) + 1)
    newest = _by().orderBy(F.desc("turn"))
    total = F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("total", total).withColumn("r", F.row_number().over(newest)).filter("total <= 200 OR r = 1").select("conv_id", "turn", "tokens")


@query("W5_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_messages(t):
    return t("conversations").withColumn("r", F.row_number().over(_by().orderBy(F.desc("turn")))).filter("r <= 3").select("conv_id", "turn", "role")


@query("W6_compression_batch", """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0)
SELECT conv_id, turn FROM c WHERE n - 2 >= 3 AND r <= n - 2 AND r <= 3""")
def compression_batch(t):
    c = t("conversations").filter("role IN ('user', 'assistant') AND length(text) > 0")
    c = c.withColumn("r", F.row_number().over(_by().orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(_by()))
    return c.filter("n - 2 >= 3 AND r <= n - 2 AND r <= 3").select("conv_id", "turn")


@query("W7_previous_turn_change", "SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS change FROM conversations")
def previous_turn_change(t):
    n = F.length("text").cast("long")
    return t("conversations").select("conv_id", "turn", (n - F.lag(n).over(_by().orderBy("turn"))).alias("change"))


@query("A28_session_summary", """SELECT conv_id, count(*) AS messages, left(arg_min(text, turn) FILTER (role = 'user' AND length(text) > 0), 36) AS title, left(arg_max(text, turn), 72) AS preview, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def session_summary(t):
    first = F.min_by(F.when((F.col("role") == "user") & (F.length("text") > 0), F.col("text")), F.when((F.col("role") == "user") & (F.length("text") > 0), F.col("turn")))
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.substring(first, 1, 36).alias("title"), F.substring(F.max_by("text", "turn"), 1, 72).alias("preview"), F.max_by("role", "turn").alias("last_role"))


@query("R26_context_rewrite", r"""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, regexp_extract(before, '([A-Z][a-z]+)', 1) || ': ' || text AS rewritten FROM p WHERE role = 'user' AND regexp_matches(lower(text), '(^|[^a-z])(it|this|that)([^a-z]|$)') AND regexp_extract(before, '([A-Z][a-z]+)', 1) <> ''""")
def context_rewrite(t):
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    p = t("conversations").withColumn("entity", F.regexp_extract(before, "([A-Z][a-z]+)", 1))
    hit = p.filter((F.col("role") == "user") & F.lower("text").rlike("(^|[^a-z])(it|this|that)([^a-z]|$)") & (F.col("entity") != ""))
    return hit.select("conv_id", "turn", F.concat_ws(": ", "entity", "text").alias("rewritten"))
