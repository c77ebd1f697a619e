"""Vector compression: product codes whose codebooks are learnt in integers.

Components become floor(SCALE * x). Vectors are cut into equal consecutive parts; each part position has a codebook of at
most ENTRIES entries, which starts as the part of the vectors with the smallest ids. The codebooks, PARTS x ENTRIES x part
length integers, go to all tasks. In a round every Arrow batch gets all distances by |x - c|^2 = |x|^2 - 2 x.c + |c|^2 with
exact int64 matrix products, and takes the first least entry. Each task hands on one row of sums and counts for each used
entry and component; a grouped shuffle merges them, and the driver divides: its share is of the codebooks' size.

Defined cases: a row whose vector is null or holds null or non-finite components is dropped. Rows with equal ids are coded
each; for the first codebooks they rank by their components. A null id ranks last. With fewer than ENTRIES rows, codebooks
have as many entries as rows; without rows, the result is empty. Equal labels share `label_error`, null labels too. Vectors
of different lengths, of a length that PARTS does not divide, or with a component so large that int64 distances could
overflow, are an error that says so. Only the id, vector and label columns are read. A lost executor costs its tasks' sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import Scratch, arrow_column, join_lookup, null_safe, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors for which distances are held at a time.
SLICE = 4096

Books = np.ndarray  # int64, part x entry x component


def _finite(vector: str) -> F.Column:
    """Whether a vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantise(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and those as rows of integers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lists = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64(), safe=False)
    bad = ~np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], np.cumsum(bad)])
    kept = np.zeros(len(vectors), bool)
    kept[lists] = before[ends[lists]] == before[(ends - sizes)[lists]]
    if (sizes[kept] != length).any():
        raise ValueError(f"vectors of {length} and of {sizes[kept][sizes[kept] != length][0]} components")
    rows = values.to_numpy(zero_copy_only=False)[np.repeat(kept, sizes)].reshape(int(kept.sum()), length)
    whole = np.floor(rows * SCALE)
    limit = np.sqrt(2.0**62 / max(length, 1)) / 2
    if whole.size and np.abs(whole).max() > limit:
        raise ValueError(f"components beyond {limit / SCALE:.0f} would overflow exact distances")
    return kept, whole.astype(np.int64)


def assign(rows: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each part of each row, and the squared distance to it."""
    parts = len(books)
    cut = rows.reshape(len(rows), parts, rows.shape[1] // parts)
    entry = np.empty((len(rows), parts), np.int64)
    least = np.empty((len(rows), parts), np.int64)
    for at in range(0, len(rows), SLICE):
        for p, book in enumerate(books):
            x = cut[at : at + SLICE, p]
            far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
            best = far.argmin(1)
            entry[at : at + SLICE, p] = best
            least[at : at + SLICE, p] = far[np.arange(len(x)), best]
    return entry, least


def _sum_batches(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    """One row for each used entry and component of a task's vectors: the sum of the components, and their number."""
    parts, entries, width = books.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        _, rows = quantise(batch.column(0), parts * width)
        entry, _ = assign(rows, books)
        cut = rows.reshape(len(rows), parts, width)
        for p in range(parts):
            np.add.at(sums[p], entry[:, p], cut[:, p])
            counts[p] += np.bincount(entry[:, p], minlength=entries)
    p, e = np.nonzero(counts)
    each = np.arange(len(p)).repeat(width)
    columns = [p[each], e[each], np.tile(np.arange(width), len(p)), sums[p, e].ravel(), counts[p, e][each]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "total", "n"])


def learn_round(vectors: DataFrame, books: Books) -> Books:
    """The codebooks after one round over `vectors`, a table of one column."""
    sums = vectors.mapInArrow(partial(_sum_batches, books=books), "part bigint, entry bigint, place bigint, total bigint, n bigint")
    whole = F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
    out = books.copy()
    # At most PARTS * ENTRIES * part length rows, whatever the table's size.
    for r in sums.groupBy("part", "entry", "place").agg(whole, F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def first_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES) -> Books | None:
    """The codebooks to begin with, or None if no row is kept."""
    least = vectors.filter(_finite(vector_col)).orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()
    if not least:
        return None
    length = len(least[0][0])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    _, rows = quantise(pa.array([list(map(float, r[0])) for r in least], pa.list_(pa.float64())), length)
    return np.ascontiguousarray(rows.reshape(len(rows), parts, length // parts).transpose(1, 0, 2))


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> Books | None:
    """Codebooks of all vectors; None if there are none."""
    small_batches()
    books = first_books(vectors, id_col, vector_col)
    for _ in range(rounds if books is not None else 0):
        books = learn_round(vectors.select(vector_col), books)
    return books


def encoder(books: Books):
    """A column function: code (two hex digits a part) and error of a vector; null where the vector is not kept."""
    length = books.shape[0] * books.shape[2]

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            kept, rows = quantise(vectors, length)
            entry, least = assign(rows, books)
            code, error = np.full(len(kept), None, object), np.zeros(len(kept), np.int64)
            code[kept] = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            error[kept] = least.sum(1)
            yield pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(error, mask=~kept)], ["code", "error"], mask=pa.array(~kept))

    return arrow_column(encode, "struct<code:string,error:bigint>")


def decode(code: str, books: Books) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[e] for book, e in zip(books, bytes.fromhex(code))]) / SCALE


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each vector that is kept, as a table in the shared folder."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), null_safe(label_col).alias("label"))
    books = learn(named, "id", "vector")
    if books is None:
        return vectors.limit(0).select(id_col, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    with Scratch(spark) as scratch:
        coded = scratch.last(named.select("id", "label", encoder(books)("vector").alias("c")).filter("c IS NOT NULL").select("id", "label", "c.*"), "codes")
    out = join_lookup(coded, coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label", "id")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
