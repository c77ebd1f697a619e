"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Every document of a source is due `target / source_size` copies. Whole copies are certain; the fractional part is a
probability, and pivotal rounding turns it into 0 or 1: of two open documents one gives words to the other, in a random
direction whose odds keep both expectations, until one of the two probabilities is integral; the other stays open.
Expected words taken stay equal at each step, so a source's taken words differ from its target by less than its longest
document. Chunks of `FAN_IN` documents are rounded in parallel and leave at most one open document each; these are
chunked and rounded again: a reduction tree of logarithmic depth. A last open document of a source is drawn alone.

Defined cases: a null source is a source of its own, ordered last; null and empty texts have size 0 and take nothing,
whatever their copies; rows with equal ids are separate documents; sources of size 0 have target 0; an empty table gives
an empty result. Only the id, text and source columns are read. All draws are hashes of the seed, id and text, and of a number among many equal rows: reruns agree.
The number of sources is taken to fit one task (they are ordered by one window); no source's rows ever do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._common import Scratch, distributed_rank, join_lookup, null_safe, spread_equal, uniform, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FAN_IN = 256
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs and target of each source of `sizes` (source, size).

    The weights repeat over the sources in code point order, null last. All targets add up to all sizes. A target over
    `max_copies` times its source's size stops there, and the rest goes to the others by weight: in order of size by
    weight, the first sources are capped, and the others get the level at which what is left is used up.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.partitionBy(F.lit(0))
    # Spark compares strings by their UTF-8 bytes, which is code point order.
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * F.lit(float(max_copies))
    ordered = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", cap)
    fill = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ordered.withColumn("level", left / open_weight).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    # The first open source's level is every open source's level.
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    return levels.withColumn("_first", first).select(
        "source", "source_size", "n_docs",
        F.when(F.col("open"), F.least("cap", F.col("weight") * F.col("_first.level"))).otherwise(F.col("cap")).alias("target"),
    )


# One step of a chunk's rounding. s: the documents decided so far and the open one (index, probability, size; -1: none);
# x: the next document with its index, probability, size and random number.
_STEP = f"""
CASE
  WHEN x.p <= {EPS} THEN named_struct('done', concat(s.done, array(named_struct('i', x.i, 'take', 0))), 'ri', s.ri, 'rp', s.rp, 'rw', s.rw)
  WHEN x.p >= 1 - {EPS} THEN named_struct('done', concat(s.done, array(named_struct('i', x.i, 'take', 1))), 'ri', s.ri, 'rp', s.rp, 'rw', s.rw)
  WHEN s.ri < 0 THEN named_struct('done', s.done, 'ri', x.i, 'rp', x.p, 'rw', x.w)
  WHEN s.rp <= {EPS} OR s.rp >= 1 - {EPS} THEN
    named_struct('done', concat(s.done, array(named_struct('i', s.ri, 'take', if(s.rp > 0.5D, 1, 0)))), 'ri', x.i, 'rp', x.p, 'rw', x.w)
  WHEN x.u * (least((1 - s.rp) * s.rw, x.p * x.w) + least(s.rp * s.rw, (1 - x.p) * x.w)) < least(s.rp * s.rw, (1 - x.p) * x.w) THEN
    CASE WHEN (1 - s.rp) * s.rw <= x.p * x.w
      THEN named_struct('done', concat(s.done, array(named_struct('i', s.ri, 'take', 1))), 'ri', x.i, 'rp', x.p - (1 - s.rp) * s.rw / x.w, 'rw', x.w)
      ELSE named_struct('done', concat(s.done, array(named_struct('i', x.i, 'take', 0))), 'ri', s.ri, 'rp', s.rp + x.p * x.w / s.rw, 'rw', s.rw) END
  ELSE
    CASE WHEN s.rp * s.rw <= (1 - x.p) * x.w
      THEN named_struct('done', concat(s.done, array(named_struct('i', s.ri, 'take', 0))), 'ri', x.i, 'rp', x.p + s.rp * s.rw / x.w, 'rw', x.w)
      ELSE named_struct('done', concat(s.done, array(named_struct('i', x.i, 'take', 1))), 'ri', s.ri, 'rp', s.rp - (1 - x.p) * x.w / s.rw, 'rw', s.rw) END
END
"""
_NONE = "named_struct('done', cast(array() AS array<struct<i:int,take:int>>), 'ri', -1, 'rp', 0D, 'rw', 0D)"


def pivotal_round(rows: DataFrame, seed: int, largest: int, scratch: Scratch) -> DataFrame:
    """`rows` (key: string, place: bigint, p: double, w: double, draw: bigint, item: any) with `take`, 0 or 1, for each item.

    Within a key, places are distinct and dense from 0, at most `largest`. Returns key, item and take.
    """
    decided = []
    level = 0
    while True:
        u = uniform(F.lit(seed), F.lit(level), F.col("draw"), F.col("place"))
        chunks = (
            rows.select("key", F.floor(F.col("place") / FAN_IN).alias("place"), F.struct(F.col("place").alias("at"), "p", "w", u.alias("u"), "draw", "item").alias("x"))
            .groupBy("key", "place")
            .agg(F.collect_list("x").alias("xs"))
            .withColumn("xs", F.expr("array_sort(xs, (a, b) -> CASE WHEN a.at < b.at THEN -1 WHEN a.at > b.at THEN 1 ELSE 0 END)"))
            .withColumn("s", F.expr(f"aggregate(transform(xs, (y, k) -> named_struct('i', k, 'p', y.p, 'w', y.w, 'u', y.u)), {_NONE}, (s, x) -> {_STEP})"))
        )
        chunks = scratch.table(chunks, "pivotal")
        decided.append(chunks.select("key", F.explode("s.done").alias("d"), "xs").select("key", F.expr("xs[d.i].item").alias("item"), F.col("d.take").alias("take")))
        left = chunks.filter("s.ri >= 0").select("key", "place", F.expr("xs[s.ri]").alias("x"), F.expr("s.rp").alias("p"))
        rows = left.select("key", "place", "p", F.col("x.w").alias("w"), F.col("x.draw").alias("draw"), F.col("x.item").alias("item"))
        largest //= FAN_IN
        level += 1
        if largest == 0:
            break
    last = F.when(uniform(F.lit(seed), F.lit(-1), F.col("draw")) < F.col("p"), 1).otherwise(0)
    decided.append(rows.select("key", "item", last.alias("take")))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """size, source, source_size, target, copies and taken of each row of `docs`, after the columns in `keep` (the id, if None).

    Kept columns travel in one struct, so their names clash with nothing.
    """
    carried = keep if keep is not None else [id_col]
    narrow = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(source_col).alias("source"), null_safe(F.col(source_col)).alias("key"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
    )
    with Scratch(docs.sparkSession) as scratch:
        narrow = scratch.table(narrow, "mix")
        targets = scratch.table(source_targets(narrow, weights, max_copies), "targets")
        bounds = targets.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
        n, largest = int(bounds[0]), int(bounds[1])
        placed = spread_equal(narrow, n, scratch.table).withColumn("_place", uniform(F.col("draw")))
        placed = distributed_rank(placed, ["key"], "_place", ["draw", "size"], n, name="rank")
        lookup = targets.select(null_safe(F.col("source")).alias("key"), "source_size", "target")
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        due = join_lookup(placed, lookup, "key", F.col("draw"), scratch).withColumn("ratio", ratio)
        # A ratio that is whole but for rounding counts as whole.
        whole = F.floor(F.col("ratio") + EPS).cast("long")
        item = F.struct("row", "source", "size", "source_size", "target", whole.alias("whole"))
        rows = due.select(
            "key", (F.col("rank") - 1).cast("long").alias("place"), F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - whole)).otherwise(0.0).alias("p"),
            F.col("size").cast("double").alias("w"), "draw", item.alias("item"),
        )
        out = scratch.last(pivotal_round(rows, seed, max(0, largest - 1), scratch), "taken")
    copies = F.least(F.lit(max_copies), F.col("item.whole") + F.col("take")).cast("long")
    return out.select(*[F.col(f"item.row.`{c}`").alias(c) for c in carried], F.col("item.source").alias("mix_source"), F.col("item.size").alias("size"), F.col("item.source_size").alias("source_size"), F.col("item.target").alias("target"), copies.alias("copies"), (copies * F.col("item.size")).alias("taken"))


#: A row that is taken more often than so, and than the 5000th part of all, is written out by tasks of its own.
MANY = 4096


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` with each row repeated as often as the mix takes it (not at all, once, or up to three times).

    The mix works on narrow rows, known by a hash of 128 bits of all columns. Rows equal in all columns are one row, taken
    as often as all of them; whole rows are shuffled once, to that one row, and meet their number of copies there.
    """
    spark = docs.sparkSession
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    keyed = docs.select(F.struct([f"`{c}`" for c in docs.columns]).alias("_row"), *[F.xxhash64(F.lit(k), *plain).alias(f"_k{k}") for k in (1, 2)], *[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "_id"), (text_col, "_text"), (source_col, "_source"))])
    keys = ["_k1", "_k2"]
    with Scratch(spark) as scratch:
        mixed = mix(keyed, "_id", "_text", "_source", keep=keys, **options)
        taken = scratch.last(mixed.groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.max("size").alias("_size")).filter("_copies > 0 AND _size > 0").drop("_size"), "taken")
        sums = taken.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()
        limit = max(MANY, int(sums[0]) // 5000)
        # At most 5000 rows.
        many = scratch.last(taken.filter(F.col("_copies") > limit), "many")
    rows = keyed.select("_row", *keys)
    if many.isEmpty():
        return _repeat(rows, taken).select("_row.*")
    few = _repeat(rows.join(F.broadcast(many), keys, "left_anti"), taken.filter(F.col("_copies") <= limit))
    # Pieces of `MANY` copies go to tasks of their own.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / MANY)), lambda k: F.least(F.lit(MANY), F.col("_copies") - k * MANY))
    cut = rows.join(F.broadcast(many.select(keys)), keys, "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row")).join(F.broadcast(many), keys)
    cut = cut.select("_row", F.posexplode(pieces).alias("_piece", "_copies"), *keys).repartition("_piece", *keys)
    return few.unionByName(_copies(cut)).select("_row.*")


def _copies(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row")


def _repeat(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows in `taken`, each as often as it says."""
    once = rows.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    return _copies(once.join(taken, ["_k1", "_k2"]))
