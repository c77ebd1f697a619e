"""Training-order materialisation: sequences of token ids in fixed-stride binary shards.

Texts are encoded once, and their ids, cut into sequences of `SEQUENCE`, take two bytes each where the vocabulary allows
it. Sequences get dense numbers from counted hash buckets, and a keyed Feistel permutation with cycle-walking turns each
number into its global slot: a bijection of 0 to n - 1, known from the key alone, so a reader can find any sequence and
resume anywhere. Slots are range partitioned into shards of `SHARD_SLOTS`, and each shard is written in slot order as
files of `FILE_SLOTS` records of one stride: slot s is in file (s mod SHARD_SLOTS) div FILE_SLOTS of shard
s div SHARD_SLOTS, at byte (s mod FILE_SLOTS) * stride.

A record is doc_id (8 bytes, big-endian), the sequence's number within the document (4), its count of ids (4), the ids,
zeros up to the stride, and a line feed as a trailer; Spark's own text sink writes such records as they are, with its
commit protocol, to any file system; `stored_records` reads them through Spark, `read_records` from bytes.

Defined cases: a null or empty text has no sequence; a null id is stored as -1; rows with equal ids are separate
documents; an empty table gives an empty result. The numbers depend on ids and texts only, so a rerun gives every
sequence its old slot; rows equal in both are interchangeable, and many of them are dealt to buckets by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import bpe
from marlstone.llm._common import Scratch, arrow_column, done_with_shuffles, join_lookup, materialise, spread_equal, uniform

SEQUENCE = 512
HEADER = 16
KEY = 0x5DEECE66D
FEISTEL_ROUNDS = 6
SHARD_SLOTS = 262_144
FILE_SLOTS = 16_384
WRITE_ROUNDS = 4


def _mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _round_keys(key: int) -> list[np.uint64]:
    return [np.uint64((key * (2 * r + 3) * 0xD6E8FEB86659FD93 + r) % (1 << 64)) for r in range(FEISTEL_ROUNDS)]


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slots of numbers x, all below n (or the numbers of slots); a bijection of 0 to n - 1.

    The Feistel network permutes the least power of four that holds n. Whatever lands at n or beyond is permuted again
    until it comes back below: the cycle through x holds x itself, so the walk ends, after four steps on average at most.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return left << half | right

    out = once(x.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _slot_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for x, n, key in batches:
        yield pa.array(permute(x.to_numpy(), n[0].as_py(), key[0].as_py())) if len(x) else pa.array([], pa.int64())


slots_of = arrow_column(_slot_batches, "bigint")


def _pack_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for lists, width in batches:
        kind = f"<u{width[0].as_py()}" if len(width) else "<u4"
        yield pa.array([None if x is None else np.array(x, np.int64).astype(kind).tobytes() for x in lists.to_pylist()], pa.binary())


#: array of ids, bytes an id -> the ids' little-endian bytes.
pack = arrow_column(_pack_batches, "binary")


def token_ids(path: str):
    """text -> its ids under a vocabulary of at most 65,536 tokens, as little-endian unsigned 16-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = bpe.load(path)
        for texts in batches:
            yield pa.array([np.frombuffer(ids, "<u4").astype("<u2").tobytes() for ids in encoder.encode_many(texts.to_pylist())], pa.binary())

    if len(bpe.load(path).tokens) > 1 << 16:
        raise ValueError(f"{path} has more tokens than two bytes can tell")
    return arrow_column(run, "binary")


def sequences(docs: DataFrame, id_col: str, text_col: str, data: Callable[[str], F.Column], width: int = 1, length: int = SEQUENCE, key: int = KEY, shard_slots: int = SHARD_SLOTS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, seq, n_tokens, slot, shard, shard_offset, record and the round in which it is written, of each sequence; data: of
    a text column, the ids' bytes, `width` an id."""
    size = length * width
    stride = HEADER + size + 1
    keep = scratch.table if scratch else materialise
    raw = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text_col).alias("text")).withColumn("draw", F.xxhash64("doc_id", "text"))
    n_docs = docs.count()
    rows = spread_equal(raw, n_docs, keep).select("doc_id", "draw", data("text").alias("data"))
    n_seq = F.coalesce(F.ceil(F.octet_length("data") / size), F.lit(0)).cast("long")
    numbered, n = _numbered(rows.withColumn("n_seq", n_seq), n_docs, keep)
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_seq") - 1), lambda k: F.struct(k.cast("int").alias("seq"), F.substring("data", (k * size + 1).cast("int"), F.lit(size)).alias("ids"))))
    parts = numbered.select("doc_id", "first", cut.alias("s")).select("doc_id", (F.col("first") + F.col("s.seq")).alias("number"), "s.*")
    slot = slots_of("number", F.lit(max(n, 1)), F.lit(key))
    placed = parts.select("doc_id", "seq", "ids", slot.alias("slot")).withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("int"))
    if scratch:
        # Slots are made once. What one round of writing takes lies in one folder.
        placed = scratch.parted(placed.withColumn("round", F.pmod("shard", F.lit(WRITE_ROUNDS))), "slots", "round")
        scratch.free("ids")
    else:
        placed = materialise(placed.withColumn("round", F.pmod("shard", F.lit(WRITE_ROUNDS))), "slots")
    ranged = placed.repartitionById(max(1, -(-n // shard_slots)), "shard").sortWithinPartitions("slot")
    n_tokens = (F.octet_length("ids") / width).cast("int")
    head = F.expr("concat(unhex(lpad(hex(doc_id), 16, '0')), unhex(lpad(hex(seq), 8, '0')))")
    record = F.concat(head, F.unhex(F.lpad(F.hex(n_tokens), 8, "0")), F.rpad("ids", F.lit(size), F.lit(b"\0")))
    return ranged.select("doc_id", "seq", n_tokens.alias("n_tokens"), "slot", "shard", (F.pmod("slot", F.lit(shard_slots)) * stride).cast("long").alias("shard_offset"), record.alias("record"), "round")


def _numbered(rows: DataFrame, n_docs: int, keep: Callable[[DataFrame, str], DataFrame], per_bucket: int = 2048) -> tuple[DataFrame, int]:
    """`rows` that have sequences with `first`, the number of sequences of all rows before in the order of their hashes, and the number of all sequences.

    The ids, which are in `rows`, are made once, dealt into hash buckets and written with their place in the bucket; what
    follows reads them from the shared folder."""
    buckets = max(1, -(-n_docs // per_bucket))
    bucket = F.least(F.floor(uniform("draw") * buckets), F.lit(buckets - 1)).cast("long")
    within = Window.partitionBy("_bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = keep(rows.withColumn("_bucket", bucket).withColumn("_inside", F.coalesce(F.sum("n_seq").over(within), F.lit(0))).drop("draw"), "ids")
    sums = inside.groupBy("_bucket").agg(F.sum("n_seq").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(sums.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n"), "offsets")
    n = int(offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    placed = join_lookup(inside.filter("n_seq > 0"), offsets.drop("_n"), "_bucket", F.col("_inside"))
    return placed.select("doc_id", "data", "n_seq", (F.col("_before") + F.col("_inside")).alias("first")), n


def write_shards(placed: DataFrame, path: str, file_slots: int = FILE_SLOTS) -> None:
    """One task a shard, in slot order, as files of `file_slots` records; a lost task is run again and its files committed once.

    Shards are written in WRITE_ROUNDS jobs, so that no more than that part of all sequences lies in shuffle files at a time."""
    for r in range(WRITE_ROUNDS):
        with done_with_shuffles(placed.sparkSession):
            some = placed.filter(F.col("round") == r).select(F.col("record").cast("string").alias("value"))
            some.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", file_slots).text(path)


def stored_records(spark: SparkSession, path: str, length: int = SEQUENCE, width: int = 1, shard_slots: int = SHARD_SLOTS, file_slots: int = FILE_SLOTS) -> DataFrame:
    """doc_id, seq, n_tokens, slot, shard, shard_offset, record of every record of the shards under `path`, read from their files.

    A file's name tells its shard (the task that wrote it) and its number in it."""
    stride = HEADER + length * width + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("int")
    named = files.filter("length > 0").select(number(r"part-(\d+)-[^/]*$").alias("shard"), number(r"-c(\d+)\.[^/]*$").alias("file"), (F.col("length") / stride).cast("int").alias("n"), "content")
    each = named.select("shard", "file", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    at = (F.col("file") * file_slots + F.col("k")).cast("long")
    cut = each.select("shard", at.alias("at"), F.substring("content", F.col("k") * stride + 1, F.lit(stride - 1)).alias("record"))
    signed = lambda start, size: F.conv(F.hex(F.substring("record", start, size)), 16, -10)
    return cut.select(
        signed(1, 8).cast("long").alias("doc_id"), signed(9, 4).cast("int").alias("seq"), signed(13, 4).cast("int").alias("n_tokens"),
        (F.col("shard").cast("long") * shard_slots + F.col("at")).alias("slot"), "shard", (F.col("at") * stride).alias("shard_offset"), "record",
    )


def read_records(data: bytes, first: int, count: int, length: int = SEQUENCE, width: int = 1) -> list[tuple[int, int, bytes]]:
    """doc_id, seq and ids' bytes of `count` records of a shard's bytes from record `first` on."""
    stride = HEADER + length * width + 1
    out = []
    for k in range(first, first + count):
        r = data[k * stride : (k + 1) * stride]
        n = int.from_bytes(r[12:16], "big")
        out.append((int.from_bytes(r[:8], "big", signed=True), int.from_bytes(r[8:12], "big"), r[HEADER : HEADER + n * width]))
    return out


def text_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sequences of texts whose ids are their UTF-8 bytes."""
    return sequences(docs, id_col, text_col, lambda c: F.col(c).cast("binary"), **options)


def digest_shards(docs: DataFrame, path: str, text_col: str = "text", **options) -> DataFrame:
    """Writes the shards of texts encoded with a vocabulary file, and gives every record read back from them: its slot and
    place, and the digest of the whole record. The shards stay in the shared folder, as the result reads them."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        out = f"{scratch.folder}-shards"
        write_shards(sequences(docs, "doc_id", text_col, lambda c: token_ids(path)(F.coalesce(c, F.lit(""))), width=2, scratch=scratch, **options), out)
    found = stored_records(spark, out, width=2)
    return found.select("doc_id", "seq", "n_tokens", "slot", "shard", "shard_offset", F.octet_length("record").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
