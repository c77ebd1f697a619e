"""Event and audit analytics over events; user_id is the task, event_type the event's name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators._lineage import cut
from marlstone.plans._base import query


@query("A6_events_by_name", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_by_name(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A7_distinct_tasks", "SELECT event_type, count(DISTINCT user_id) + count(*) FILTER (user_id IS NULL) AS tasks FROM events GROUP BY event_type")
def distinct_tasks(t):
    return t("events").groupBy("event_type").agg((F.count_distinct("user_id") + F.count_if(F.col("user_id").isNull())).alias("tasks"))


@query("A8_first_intent_per_task", """WITH e AS (SELECT user_id, coalesce(json_extract_string(props, '$.k'), 'unknown') AS intent, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'view')
SELECT intent, count(*) AS n FROM e WHERE r = 1 GROUP BY intent""")
def first_intent(t):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = t("events").filter("event_type = 'view'").select("user_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")).alias("intent"), r.alias("r"))
    return e.filter("r = 1").groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query("A9_success_rate", "SELECT round(c / nullif(c + f, 0), 4) AS rate FROM (SELECT count(DISTINCT user_id) FILTER (event_type = 'purchase') AS c, count(DISTINCT user_id) FILTER (event_type = 'error') AS f FROM events)")
def success_rate(t):
    of = lambda name: F.count_distinct(F.when(F.col("event_type") == name, F.col("user_id")))
    counts = t("events").agg(of("purchase").alias("c"), of("error").alias("f"))
    return counts.select(F.round(F.try_divide("c", F.col("c") + F.col("f")), 4).alias("rate"))


@query("A10_latest_pass_rate", "WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click') SELECT count(*) AS n, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM l WHERE r = 1")
def latest_pass_rate(t):
    # The latest row of a task by max_by, which combines before the shuffle, unlike a window.
    latest = t("events").filter("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return latest.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 4).alias("rate"))


@query("A11_effective_deliveries", "SELECT count(DISTINCT (event_type, coalesce(user_id, event_id))) AS n FROM events WHERE event_type IN ('purchase', 'signup')")
def effective_deliveries(t):
    e = t("events").filter(F.col("event_type").isin("purchase", "signup"))
    return e.select("event_type", F.coalesce("user_id", "event_id").alias("k")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("A12_freshness", "SELECT greatest(0, date_sub('second', max(ts), TIMESTAMP '2030-01-01 00:00:00')) AS seconds FROM events")
def freshness(t):
    return t("events").agg(F.greatest(F.lit(0), F.expr("timestampdiff(SECOND, max(ts), TIMESTAMP_NTZ '2030-01-01 00:00:00')")).alias("seconds"))


@query("A13_audit_stats", "SELECT event_type, count(*) AS total, count(*) FILTER (ts::DATE = (SELECT max(ts)::DATE FROM events)) AS today FROM events GROUP BY event_type")
def audit_stats(t):
    last = t("events").agg(F.max("ts").cast("date").alias("last"))
    return t("events").crossJoin(F.broadcast(last)).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ts").cast("date") == F.col("last")).alias("today"))


@query("A24_histogram_quantiles", """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(v) AS n, round(list_sum(v), 4) AS total, v[least((len(v) * 0.5)::DECIMAL(18,4)::DOUBLE // 1, len(v) - 1)::INT + 1] AS p50, v[least(floor(len(v) * 0.9), len(v) - 1)::INT + 1] AS p90, v[least(floor(len(v) * 0.95), len(v) - 1)::INT + 1] AS p95, v[least(floor(len(v) * 0.99), len(v) - 1)::INT + 1] AS p99 FROM l""".replace("(len(v) * 0.5)::DECIMAL(18,4)::DOUBLE // 1", "floor(len(v) * 0.5)"))
def histogram_quantiles(t):
    # Nearest rank without interpolation. Approximate quantiles cut each type's values into 64 parts of about one size; the
    # parts' exact counts tell which of them hold the ranks wanted, and only the values of those are put in order.
    e = t("events").filter("value IS NOT NULL")
    cuts = [k / 64 for k in range(1, 64)]
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.percentile_approx("value", cuts, 1_000).alias("cuts"))
    n = cut(n)
    part = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    steps = e.join(F.broadcast(n.select("event_type", "cuts")), "event_type").groupBy("event_type", part.alias("part"), "value").agg(F.count(F.lit(1)).alias("c"))
    steps = cut(steps)
    sums = steps.groupBy("event_type", "part").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("event_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("at")) for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]))
    parts = sums.withColumn("before", before).join(n.select("event_type", "n"), "event_type").withColumn("w", wanted)
    parts = parts.filter("w.at >= before AND w.at < before + c").select("event_type", "part", "before", "w.*")  # four rows a type
    upto = F.sum("c").over(Window.partitionBy("event_type", "part", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = steps.join(F.broadcast(parts), ["event_type", "part"]).withColumn("upto", F.col("before") + upto).filter("upto > at")
    at = found.groupBy("event_type").pivot("name", ["p50", "p90", "p95", "p99"]).agg(F.min("value"))
    return n.select("event_type", "n", "total").join(at, "event_type")


@query("A25_counter_gauge", "SELECT event_type, round(sum(value), 4) AS counter, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY event_type")
def counter_gauge(t):
    return t("events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


@query("P4_audit_filter_page", "SELECT event_id, event_type, user_id, value FROM events WHERE event_type = 'click' AND value >= 10 AND ts >= TIMESTAMP '2000-01-01' ORDER BY event_id LIMIT 20 OFFSET 20")
def audit_filter_page(t):
    e = t("events").filter("event_type = 'click' AND value >= 10 AND ts >= TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    return e.select("event_id", "event_type", "user_id", "value").orderBy("event_id").offset(20).limit(20)


@query("P5_newest_events", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_events(t):
    return t("events").filter("event_type = 'error'").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("P6_json_property_filter", "SELECT event_id FROM events WHERE coalesce(nullif(json_extract_string(props, '$.mode'), ''), nullif(json_extract_string(props, '$.k'), ''), 'agent') = '7'")
def json_property_filter(t):
    prop = lambda k: F.nullif(F.get_json_object("props", k), F.lit(""))
    return t("events").filter(F.coalesce(prop("$.mode"), prop("$.k"), F.lit("agent")) == "7").select("event_id")


@query("T6_page_with_totals", "SELECT event_id, count(*) OVER () AS total, ceil(count(*) OVER () / 50.0)::BIGINT AS pages FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 50 OFFSET 50")
def page_with_totals(t):
    e = t("events").filter("event_type = 'signup'")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    page = e.select("event_id").orderBy("event_id").offset(50).limit(50)
    return page.crossJoin(F.broadcast(total)).select("event_id", "total", F.ceil(F.col("total") / 50.0).alias("pages"))


@query("X7_task_expiry", "SELECT user_id, max(ts) AS last_seen, date_sub('second', max(ts), (SELECT max(ts) FROM events)) > 86400 AS expired FROM events GROUP BY user_id")
def task_expiry(t):
    last = t("events").agg(F.max("ts").alias("now"))
    seen = t("events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).crossJoin(F.broadcast(last))
    return seen.select("user_id", "last_seen", (F.expr("timestampdiff(SECOND, last_seen, now)") > 86400).alias("expired"))


@query("A27_column_profile", """WITH u AS (SELECT 'p_size' AS name, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part)
SELECT name, min(v) AS least, max(v) AS most, round(avg(v), 4) AS mean, count(v) AS n FROM u GROUP BY name""")
def column_profile(t):
    wide = t("part").select(F.col("p_size").try_cast("double").alias("p_size"), F.col("p_retailprice").try_cast("double").alias("p_retailprice"))
    long = wide.unpivot([], ["p_size", "p_retailprice"], "name", "v")
    return long.groupBy("name").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 4).alias("mean"), F.count("v").alias("n"))


@query("A33_spatial_grid", "SELECT floor(l_extendedprice / 10000)::BIGINT AS gx, floor(l_quantity / 10)::BIGINT AS gy, l_returnflag AS type, count(*) AS n, round(avg(l_extendedprice), 4) AS x, round(avg(l_quantity), 4) AS y FROM lineitem GROUP BY ALL")
def spatial_grid(t):
    g = t("lineitem").groupBy(F.floor(F.col("l_extendedprice") / 10000).alias("gx"), F.floor(F.col("l_quantity") / 10).alias("gy"), F.col("l_returnflag").alias("type"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("x"), F.round(F.avg("l_quantity"), 4).alias("y"))


@query("A22_kb_counts", "SELECT source, count(*) AS doc_count, sum(n_chars)::BIGINT AS chars, greatest(0, count(*) - 5) AS after_delete FROM documents GROUP BY source")
def kb_counts(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("n_chars").alias("chars"), F.greatest(F.lit(0), F.count(F.lit(1)) - 5).alias("after_delete"))


@query("A23_storage_stats", "SELECT lang, count(*) AS n, round(sum(strlen(text)) / 1048576.0, 2) AS mb, count(*) FILTER (n_chars > 1000) AS long_docs FROM documents GROUP BY lang")
def storage_stats(t):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.octet_length("text")) / 1048576.0, 2).alias("mb"), F.count_if(F.col("n_chars") > 1000).alias("long_docs"))
