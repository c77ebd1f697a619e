"""Batch forms of the streaming operators, which share their column logic."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import index as I
from marlstone.operators._lineage import forget_at_exit, shared_folder
from marlstone.plans._base import query
from marlstone.plans.retrieval import TOKENS
from marlstone.streaming import events as E


@query("X1_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(t):
    by = t("events").groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("X3_lookback_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def lookback_window(t):
    last = t("events").agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return t("events").crossJoin(F.broadcast(last)).filter("ts >= since").select("event_id")


@query("X4_idempotent_keys", "SELECT count(DISTINCT event_type || strftime(ts, '%Y-%m-%d')) AS runs FROM events")
def idempotent_keys(t):
    return t("events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct().agg(F.count(F.lit(1)).alias("runs"))


@query("X5_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(t):
    by = t("events").groupBy("user_id", F.session_window(F.col("ts"), "30 minutes").alias("s"))
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


@query("X6_rolling_compression", """WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0)
SELECT conv_id, r // 2 AS step, list(turn::BIGINT ORDER BY turn) AS turns FROM m WHERE n >= 4 + r // 2 * 2 GROUP BY conv_id, r // 2""")
def rolling_compression(t):
    """The batches of events.rolling_compression(trigger=4, keep=2, batch=2) over whole conversations: batch s goes once 4 + 2 s messages are there."""
    said = t("conversations").filter("role IN ('user', 'assistant') AND length(text) > 0")
    by = Window.partitionBy("conv_id")
    m = said.withColumn("step", F.floor((F.row_number().over(by.orderBy("turn")) - 1) / 2)).withColumn("n", F.count(F.lit(1)).over(by))
    return m.filter("n >= 4 + step * 2").groupBy("conv_id", "step").agg(F.array_sort(F.collect_list(F.col("turn").cast("bigint"))).alias("turns"))


_USES = "SELECT user_id, event_type AS session, event_id, epoch_us(ts) // 1000 AS ms FROM events"
_DAY = 86_400_000


def _uses(t):
    return t("events").select("user_id", F.col("event_type").alias("session"), "event_id", "ts")


@query("X5_session_expiry", f"""WITH u AS ({_USES}), g AS (SELECT *, coalesce((ms - lag(ms) OVER w > {_DAY})::INT, 1) AS new FROM u WINDOW w AS (PARTITION BY user_id, session ORDER BY ms, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, session ORDER BY ms, event_id) AS k FROM g), l AS (SELECT user_id, max(ms) AS latest FROM u GROUP BY user_id)
SELECT user_id, session, min(ms) AS started, max(ms) AS last, count(*) AS n, CASE WHEN any_value(latest) - max(ms) > {_DAY} THEN 'expired' ELSE 'open' END AS ended FROM s JOIN l USING (user_id) GROUP BY user_id, session, k""")
def session_expiry(t):
    """Sessions that end after a day of silence; without a cap, that can be said in SQL."""
    return E.replayed_sessions(_uses(t), _DAY, 1 << 40)


@query("X5_session_store")
def session_store(t):
    """Two open sessions a user at most, of a day's silence: the least recently used one makes room. Tests hold this against the stream with state."""
    return E.replayed_sessions(_uses(t), _DAY, 2)


@query("X8_incremental_index", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 30 = 0 THEN source ELSE text END AS text FROM documents WHERE NOT (doc_id % 7 = 1 AND doc_id % 3 <> 2)),
tok AS (SELECT doc_id, unnest({TOKENS}) AS token FROM d WHERE length(trim(text)) > 0) SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM tok GROUP BY token""")
def incremental_index(t):
    """Three increments of a changing corpus, each a micro-batch of a stream into the stored index: new documents by a third,
    in the second also new texts of some of the first, in the third also deletions."""
    docs = t("documents").select("doc_id", "text", "source", F.lit(False).alias("deleted"))
    part = lambda k: docs.filter(F.pmod("doc_id", F.lit(3)) == k)
    replaced = docs.filter("doc_id % 30 = 0").withColumn("text", F.col("source"))
    deleted = docs.filter("doc_id % 7 = 1 AND doc_id % 3 <> 2").withColumn("deleted", F.lit(True))
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/increments-{uuid.uuid4().hex}"
    forget_at_exit(spark, folder)
    I.create(spark, f"{folder}/index")
    for rows in (part(0), part(1).unionByName(replaced), part(2).unionByName(deleted)):
        rows.write.mode("append").parquet(f"{folder}/changes")
        E.index_batches(spark.readStream.schema(docs.schema).parquet(f"{folder}/changes"), f"{folder}/index", f"{folder}/checkpoint")
    return I.hits(I.load(spark, f"{folder}/index")).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_hits"))
