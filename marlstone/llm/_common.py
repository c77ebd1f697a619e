"""What several corpus operators share: scratch tables, distributed ranks, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word: a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='marlstone-')}"


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors. A folder of this machine serves only where nothing else runs: in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@contextmanager
def done_with_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files removed once it stands in the shared folder: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables in the shared folder. On leaving the `with` block all go but those made by `last`, which the result reads.

    What is dropped has no reader left, so nothing that a lost executor could force to run again needs it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch_dir(spark)}/marlstone/{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        with done_with_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Write `df` once and read it back: cuts lineage, and what follows may read it many times."""
        return self._write(df, f"{self.folder}/{label}-{uuid.uuid4().hex}")

    def parted(self, df: DataFrame, label: str, by: str) -> DataFrame:
        """As table(), in folders by a column of few values: what follows may read some of them alone."""
        path = f"{self.folder}/{label}-{uuid.uuid4().hex}"
        with done_with_shuffles(self.spark):
            df.write.partitionBy(by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, label: str) -> None:
        """Drop the tables of a label, which have no reader left."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}-*")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in fs.globStatus(path) or ():
            fs.delete(found.getPath(), True)

    def last(self, df: DataFrame, label: str) -> DataFrame:
        return self._write(df, f"{self.folder}-{label}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.drop()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """One table of its own that stays, for a result that reads it."""
    return Scratch(df.sparkSession).last(df, label)


#: Rows of an Arrow batch. Spark's default of 10,000 texts makes batches of tens of MB, held several times by JVM and Python.
BATCH_ROWS = 1000


def small_batches() -> None:
    """Arrow batches of the active session get `BATCH_ROWS` rows at most."""
    conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def arrow_column(fn: Callable, schema: str) -> Callable[..., F.Column]:
    """`fn`, from batches of Arrow arrays to batches of Arrow arrays, as a column function; the session is asked for only when it is applied."""

    def apply(*cols) -> F.Column:
        small_batches()
        return F.arrow_udf(fn, schema)(*cols)

    return apply


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def null_safe(col) -> F.Column:
    """A string key that is never null and keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string") if isinstance(col, str) else col), F.lit(""))


def uniform(*cols) -> F.Column:
    """A double in [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


#: A join's key is hot if it has more rows than `SALTED_ROWS` and than the `HOT_KEYS`-th part of all; so at most HOT_KEYS keys are.
HOT_KEYS, SALTED_ROWS = 2000, 20_000


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], spread, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join of `big` with `small`, which has one row a key, where a few keys may hold most rows of `big`.

    counts: keys and n, the rows of `big` with them; counted if None. The numbers of salts of the hot keys, at most HOT_KEYS
    rows, are broadcast; rows of `big` with a hot key are dealt to its salts by `spread`, and its row of `small` is copied to
    each of them: at most 2 * HOT_KEYS copies in all. Without a hot key, this is the plain join.
    """
    counts = counts if counts is not None else big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(SALTED_ROWS, -(-int(total) // HOT_KEYS))
    if most <= limit:
        return big.join(small, keys, how)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    salted = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.hash(spread), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    copied = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


#: A table of at most so many narrow rows is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 50_000


def join_lookup(big: DataFrame, small: DataFrame, key: str, spread, scratch: Scratch | None = None) -> DataFrame:
    """Left join with a narrow table of one row a key, which is written out and counted first."""
    small = scratch.table(small, "lookup") if scratch else materialise(small, "lookup")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, "left")
    return skew_join(big, small, [key], spread, how="left")


def distributed_rank(df: DataFrame, groups: list[str], place: str, ties: list, n: int, per_bucket: int = 4096, name: str = "rank") -> DataFrame:
    """The 1-based rank of each row within `groups` by (`place`, *ties), without a task that holds a whole group.

    `place` is a double spread evenly over [0, 1). It is cut into buckets of about `per_bucket` rows; the buckets'
    counts give each bucket its offset, and rows are numbered within their bucket. `n` is the number of rows of `df`.
    """
    buckets = max(1, -(-n // per_bucket))
    dealt = df.withColumn("_bucket", F.least(F.floor(F.col(place) * buckets), F.lit(buckets - 1)).cast("long"))
    counts = dealt.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row a bucket. Without groups the constant key keeps the window's input at n / per_bucket rows.
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(place, *ties)
    ranked = dealt.withColumn("_within", F.row_number().over(within))
    return ranked.join(offsets, [*groups, "_bucket"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


#: A draw that more rows than so have, and than the 5000th part of all, is spread.
MANY = 4096


def spread_equal(rows: DataFrame, n: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`rows` with a new `draw` for each of many rows that are equal: the hash of their draw and a number among them.

    Equal rows have one draw and would stand in one bucket, however many they are. Their classes, at most 5000, are counted
    and made anew from one row each, in pieces that go to tasks of their own; so the draws depend on the rows alone, and not on
    how they lie. Rows that are fewer keep their draw."""
    limit = max(MANY, n // 5000)
    hot = keep(rows.groupBy("draw").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit), "hot")
    if hot.isEmpty():
        return rows
    hot = F.broadcast(hot.select("draw"))
    classes = rows.join(hot, "draw", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    pieces = classes.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / MANY)))).repartition("draw", "_piece")
    copies = pieces.withColumn("_copy", F.explode(F.sequence(F.col("_piece") * MANY, F.least(F.col("_n"), (F.col("_piece") + 1) * MANY) - 1)))
    spread = copies.withColumn("draw", F.xxhash64("draw", "_copy")).select(rows.columns)
    return rows.join(hot, "draw", "left_anti").select(rows.columns).unionByName(spread)
