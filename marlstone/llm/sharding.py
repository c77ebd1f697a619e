"""Proportional stratified interleaving of rows into shards, in DataFrame and SQL functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank by its source's number
of rows. In order of fractional rank the sources interleave in proportion, so equal cuts of that order give shards that
all have the mixture of the whole and whose row counts are at most one apart. Ranks are taken in hash buckets with
counted offsets, so no task sees a whole source, and no source's share matters.

Defined cases: a null source is a source of its own; rows with null or equal ids or texts are rows like any other; null
texts have no bytes; an empty table gives an empty result. Reruns agree: the order depends on seed, id, source and text
only, and rows equal in all of these are interchangeable; many of them are spread over the order by their number. Only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._common import distributed_rank, join_lookup, materialise, null_safe, spread_equal, uniform

SHARDS = 24
ROW_OVERHEAD = 8


def interleave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 23) -> DataFrame:
    """id, source, size, text_crc32, position in the whole order, shard and slot of each row of `docs`."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_OVERHEAD
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("shard_source"), null_safe(F.col(source_col)).alias("key"), size.alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("draw"),
    )
    narrow = materialise(narrow, "rows")
    n = narrow.count()
    narrow = spread_equal(narrow, n, materialise).withColumn("_place", uniform(F.lit(1), F.col("draw")))
    counts = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n_source"))
    # Each source starts at an offset of its own into its first step, or sources of few rows would all stand together; multiples of
    # the golden ratio spread the offsets evenly. The number of sources is taken to fit one task.
    place = F.row_number().over(Window.orderBy(F.col("n_source").desc(), "key"))
    counts = counts.withColumn("offset", F.pmod(place * F.lit(0.6180339887498949), F.lit(1.0)))
    ranked = distributed_rank(narrow, ["key"], "_place", ["draw", F.col("id").asc_nulls_first(), "size"], n).drop("_place")
    fraction = (F.col("rank") - 1 + F.col("offset")) / F.col("n_source")
    placed = join_lookup(ranked, counts, "key", F.col("draw")).withColumn("_fraction", fraction)
    ordered = distributed_rank(placed, [], "_fraction", ["key", "rank"], n, name="_position")
    position = F.col("_position") - 1
    shard = F.expr(f"(_position - 1) * {shards} DIV {max(n, 1)}").cast("int")
    start = F.expr(f"(cast(shard AS bigint) * {max(n, 1)} + {shards - 1}) DIV {shards}")
    return ordered.select(F.col("id").alias(id_col), "shard_source", "size", "text_crc32", position.alias("position"), shard.alias("shard")).withColumn("slot", (F.col("position") - start).cast("long"))
