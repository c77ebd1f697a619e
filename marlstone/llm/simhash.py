"""Near-duplicates by SimHash, found through an index on byte positions with count filtering.

1. A text's fingerprint: the words, A-Z in lower case, give shingles of SHINGLE words, repeats included; each bit is set if
   it is set in over half of the shingles' XXH64. Equal fingerprints are one class from here on.
2. Two fingerprints of at most DISTANCE = 4 differing bits agree in at least MATCHES = 4 of their 8 bytes. Postings on one
   byte would hold a 256th of all classes each, so they are kept by three bytes at once: every four of the eight positions
   contain one of the 20 TRIPLES, so every pair that reaches the minimum meets in a posting.
3. In each posting the members meet its smallest. Pairs have their equal positional bytes tallied; those that reach the
   minimum are verified by their differing bits, and become links. The links' components are found.
4. In a posting that still holds several components, members of different ones are compared in blocks of bounded size: the
   tally of equal bytes, then the differing bits. A block gives at most one link between two components. Postings of more
   than BLOCK * BLOCK such pairs are dealt anew by a fourth equal byte, which every linked pair has; blocks do the rest.
5. Components of all links are the result. No link is lost: nothing is sampled, capped or left out.

Defined cases: a text without words, empty or null, has fingerprint zero and is linked like any other; a text of one to
three words is one shingle; each row is a node of its own, also where ids repeat; null ids count only where a component has
no other, and are null then; an empty table gives an empty result. Only the id and text columns are read. Nothing of the
documents goes to the driver but counts. Joins on postings, fingerprints and components salt the keys that hold many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import Scratch, arrow_column, skew_join
from marlstone.llm._scan import Texts, slices
from marlstone.llm.neardup import BLOCK, _open, _open_pairs, _tasks, _tasks_of, components

SHINGLE, SEED = 4, 42
DISTANCE, BYTES = 4, 8
MATCHES = BYTES - DISTANCE
#: Positions in three rings; a triple lies in one ring, or has two in one and one in the next. Any four positions contain one.
_RING = [p % 3 for p in range(BYTES)]
TRIPLES = [t for t in combinations(range(BYTES), 3) for n in [[sum(_RING[p] == r for p in t) for r in range(3)]] if 3 in n or any(n[r] == 2 and n[(r + 1) % 3] == 1 for r in range(3))]

#: Shingles whose bits are held at a time.
_BITS_AT = 1 << 14


def _shingle_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owners and XXH64 of all shingles of some texts, in order."""
    starts, ends = t.edges()
    owner = t.owner(starts)
    # The words on end, one space after each: a shingle is a range of it.
    folded = t.folded()
    size = ends - starts + 1
    at = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at + size - 1] = False
    joined[inside] = folded[~t.space]
    n = np.bincount(owner, minlength=t.n)
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner]
    begins = np.flatnonzero((place + SHINGLE <= n[owner]) | ((place == 0) & (n[owner] < SHINGLE)))
    last = begins + np.minimum(SHINGLE, n[owner[begins]]) - 1
    view = memoryview(joined.tobytes())
    a, b = at[begins].tolist(), (at + size - 1)[last].tolist()
    return owner[begins], np.array([xxhash.xxh64_intdigest(view[i:j], SEED) for i, j in zip(a, b)], np.uint64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    for at, t in slices(texts):
        owner, hashes = _shingle_hashes(t)
        ones = np.zeros((t.n, 64), np.int64)
        for k in range(0, len(owner), _BITS_AT):
            o, h = owner[k : k + _BITS_AT], hashes[k : k + _BITS_AT]
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.flatnonzero(np.diff(o, prepend=-1))
            ones[o[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        over = 2 * ones > np.bincount(owner, minlength=t.n)[:, None]
        out[at : at + t.n] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(fingerprints(texts).view(np.int64))


#: A text's fingerprint as a signed 64-bit integer.
fingerprint = arrow_column(_fingerprint_batches, "bigint")


def _byte(fp, position: int) -> F.Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def postings(classes: DataFrame) -> DataFrame:
    """rep, band (which triple) and key (its three bytes) for each class and triple; rep is the fingerprint."""
    keys = [F.struct(F.lit(k).alias("band"), sum((F.shiftleft(_byte(F.col("rep"), p), 8 * i) for i, p in enumerate(t)), F.lit(0).cast("long")).alias("key")) for k, t in enumerate(TRIPLES)]
    return classes.select("rep", F.explode(F.array(*keys)).alias("k")).select("rep", "k.*")


def _refined(members: DataFrame) -> DataFrame:
    """Postings on four bytes of members of postings on three: one for each further position."""
    outside = F.array(*[F.array(*[F.lit(p) for p in range(BYTES) if p not in t]) for t in TRIPLES])
    each = members.withColumn("p", F.explode(outside[F.col("band")]))
    byte = F.expr("shiftrightunsigned(rep, 8 * p) & 255L")
    return each.withColumn("key", F.xxhash64("key", "p", byte)).drop("p")


def tallied(a, b) -> F.Column:
    """How many positional bytes of two fingerprints are equal."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return sum(((_byte(x, p) == 0).cast("int") for p in range(BYTES)), F.lit(0))


def verified(a, b) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def _link_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows of each task, one at most between two components."""
    for rows in _tasks(batches):
        rep, comp, side = (rows.column(c).to_numpy() for c in ("rep", "comp", "side"))
        i, j = np.nonzero(_open_pairs(comp, side, rows.column("two")[0].as_py()))
        x = rep[i].view(np.uint64) ^ rep[j].view(np.uint64)
        enough = np.zeros(len(x), np.uint8)
        for p in range(BYTES):
            enough += ((x >> np.uint64(8 * p)) & np.uint64(255)) == 0
        near = np.flatnonzero(enough >= MATCHES)
        near = near[np.bitwise_count(x[near]) <= DISTANCE]
        if not len(near):
            continue
        pairs = np.sort(np.stack([comp[i[near]], comp[j[near]]]), 0)
        first = np.unique(pairs, axis=1, return_index=True)[1]
        a, b = rep[i[near[first]]], rep[j[near[first]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints (a, b) whose components are those of all linked pairs of `classes` (rep)."""
    bucket = ["band", "key"]
    posted = postings(classes)
    full = scratch.table(posted.groupBy(bucket).agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "postings")
    counts = full.select(*bucket, "n")
    members = scratch.table(skew_join(posted, full.select(*bucket, "pivot"), bucket, "rep", counts), "members")
    star = members.filter(F.col("rep") != F.col("pivot")).filter(tallied("rep", "pivot") >= MATCHES).filter(verified("rep", "pivot"))
    star = scratch.table(star.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "links")
    comps = components(star, scratch)
    known = scratch.table(members.join(comps, "rep", "left").select(*bucket, "pivot", "rep", F.coalesce("comp", "rep").alias("comp")), "known")
    main = known.filter("rep = pivot").select(*bucket, F.col("comp").alias("main"))
    open_ = scratch.table(_open(known, main, counts), "open")
    large = F.col("n0") * (F.col("n0") + F.col("n1")) > BLOCK * BLOCK
    todo = _tasks_of(known.drop("pivot"), open_.filter(~large))
    if not (crowds := scratch.table(open_.filter(large), "crowds")).isEmpty():
        sizes = crowds.select(*bucket, (F.col("n0") + F.col("n1")).alias("n"))
        again = scratch.table(_refined(skew_join(known.drop("pivot"), crowds.select(bucket), bucket, "rep", sizes)), "refined")
        met = scratch.table(again.groupBy(bucket).agg(F.min(F.struct("rep", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high"), "met")
        todo = todo.unionByName(_tasks_of(again, scratch.table(_open(again, met.select(*bucket, F.col("p.comp").alias("main")), met.select(*bucket, "n")), "open")))
    dealt = todo.repartition(F.col("task")).sortWithinPartitions("task")
    return star.unionByName(scratch.table(dealt.mapInArrow(_link_tasks, "a bigint, b bigint"), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint and component_id (smallest id reachable) of each row of `docs`, as a table in the shared folder."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(docs.select(F.col(id_col).alias("id"), fingerprint(text_col).alias("rep")), "fingerprints")
        classes = scratch.table(rows.groupBy("rep").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
        comps = scratch.table(components(_links(classes.select("rep"), scratch), scratch), "components")
        # Only classes that are linked have a row in comps; the others are components of their own.
        in_comps = skew_join(comps, comps.join(classes, "rep").groupBy("comp").agg(F.min("least").alias("reached")), ["comp"], "rep")
        known = scratch.table(classes.join(in_comps.select("rep", "reached"), "rep", "left").select("rep", "n", F.coalesce("reached", "least").alias("component_id")), "known")
        out = skew_join(rows, known.select("rep", "component_id"), ["rep"], F.monotonically_increasing_id(), known.select("rep", "n"))
        out = scratch.last(out, "simhash")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("rep"), 16, "0")).alias("fingerprint"), "component_id")
