"""Near-duplicate detection with SetSketch registers.

1. Each text's set of distinct five-word shingles (64-bit hashes) gives a set digest and M registers: exponentially
   spaced, truncated minima, K = floor(1 - log_b(h / a)) held within a byte, where h is the least exponential hash of
   the set. Registers of a union are the maxima, so sketches merge. Equal sets are one class from here on.
2. Registers are banded; classes that share a band's key share a bucket. Each bucket's members are paired with its
   smallest. A pair goes on if the joint likelihood of its registers' order (SetSketch, with both set sizes known) puts
   the similarity above `SCREEN`; it becomes a link if the full shingle sets, taken from the texts again, confirm it.
3. The links' components are found. In a bucket that still holds several components, members of different ones that
   were not paired yet are compared in blocks of bounded size: screened by likelihood, and confirmed on full sets. A pair
   is looked at in the first band it shares only. Blocks give links between components, never all pairs. Buckets with
   more than BLOCK * BLOCK such pairs (a template that many texts share without being linked) are dealt anew by exact
   prefix filtering: of two linked sets, ordered by the shingles' frequency, each has a common shingle among the rarest
   n - ceil(0.75 n) + 1 of its n; so members meet only in the buckets of those, whatever else they share.
4. Components of all links are the result. They are whole: two classes of one component need no link of their own.

A pair at the least linked similarity, 0.75, is missed by all bands with a probability of 3e-6 (48 bands of 5), and by
the screen, five standard errors away, with less. Full sets decide every link, so none is wrong.

Defined cases: a null or empty text has an empty set and is linked with nothing; a text of one to four words is one
shingle; rows with equal ids are one node of the graph; a row with a null id is its own component, null, and kept; an
empty table gives an empty result. Only the id and text columns are read. Nothing of the documents goes to the driver
but counts; id lists are broadcast up to `BROADCAST_IDS` rows, and joined by a shuffle beyond. Joins on buckets, on their
smallest members and on a component's smallest id salt the keys that hold many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import Scratch, arrow_column, materialise, skew_join
from marlstone.llm._scan import Texts, grams, mix, slices

BANDS, ROWS = 48, 5
M = BANDS * ROWS
BASE, OFFSET = 1.12, 30
LINK_NUM, LINK_DEN = 75, 100
SCREEN = 0.6
BLOCK = 1024
#: Shingles of one side of a task: texts are longer than others, and a task holds whole sets.
BLOCK_SHINGLES = 2_000_000
BROADCAST_IDS = 500_000

_seed = mix(np.arange(1, 2 * M + 1, dtype=np.uint64))
_A, _B = ((_seed[k::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for k in (0, 1))
_WHOLE = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xDB4F0B9175AE2165], np.uint64)


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owners and hashes of the distinct shingles of some texts, sorted by both."""
    owner, words = t.words(fold=True)
    n = np.bincount(owner, minlength=t.n)
    at, h = grams(owner, words)
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    few = np.flatnonzero(n[owner] < 5)
    whole = np.zeros(t.n, np.uint64)
    np.add.at(whole, owner[few], words[few] * _WHOLE[np.minimum(place[few], 3)])
    short = np.flatnonzero((n > 0) & (n < 5))
    owners = np.concatenate([owner[at], short])
    hashes = np.concatenate([h, mix(whole[short] + n[short].astype(np.uint64))])
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    return owners[new], hashes[new]


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of M bytes for each non-empty set; set i's hashes begin at starts[i]."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(starts), M), np.uint32)
    for i in range(M):
        least[:, i] = np.minimum.reduceat(low * _A[i] + high * _B[i], starts)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)) + OFFSET, 0, 255).astype(np.uint8)


def _p(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the SetSketch estimator: p_b(x) = -log_b(1 - x (b - 1) / b), and its derivative."""
    c = (BASE - 1) / BASE
    rest = 1 - np.maximum(x, 1e-9) * c
    return -np.log(rest) / np.log(BASE), c / (rest * np.log(BASE))


def likely(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: float = SCREEN) -> np.ndarray:
    """Whether the joint likelihood of registers is greatest at a similarity of `threshold` or more.

    more, less: how many registers of a are above and below b's. The log-likelihood is concave in the similarity, so
    its slope at the threshold tells. Set sizes that rule a link out do so exactly.
    """
    possible = LINK_DEN * np.minimum(n_a, n_b) >= LINK_NUM * np.maximum(n_a, n_b)
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    p, dp = _p(u - v * threshold)
    q, dq = _p(v - u * threshold)
    same = M - more - less
    slope = -more * v * dp / p - less * u * dq / q + same * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-9)
    return possible & (slope >= 0)


def linked(n_a, n_b, common):
    return LINK_DEN * common >= LINK_NUM * (n_a + n_b - common)


def _sketch_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        n = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), 2), np.uint64)
        regs = np.zeros((len(texts), M), np.uint8)
        for at, t in slices(texts):
            owners, hashes = shingle_sets(t)
            if not len(owners):
                continue
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            full = owners[starts] + at
            n[full] = np.diff(np.append(starts, len(owners)))
            sums[full, 0] = np.add.reduceat(mix(hashes), starts)
            sums[full, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
            regs[full] = registers(hashes, starts)
        digest = np.concatenate([n[:, None].view(np.uint8), sums.view(np.uint8)], 1)
        fixed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        yield pa.StructArray.from_arrays([pa.array(n), fixed(digest), fixed(regs)], ["n", "digest", "regs"])


sketch = arrow_column(_sketch_batches, "struct<n:bigint,digest:binary,regs:binary>")


def _screen_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for n_a, n_b, r_a, r_b in batches:
        a, b = (np.frombuffer(b"".join(r.to_pylist()), np.uint8).reshape(-1, M) for r in (r_a, r_b))
        yield pa.array(likely(n_a.to_numpy(), n_b.to_numpy(), (a > b).sum(1), (a < b).sum(1)))


screen = arrow_column(_screen_batches, "boolean")


def _set_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = []
        for _, t in slices(texts):
            owners, hashes = shingle_sets(t)
            cuts = np.searchsorted(owners, np.arange(t.n + 1)).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64))))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


#: A text's set of shingles.
shingle_set = arrow_column(_set_batches, "array<bigint>")


class _Sets:
    """Shingle sets of texts, each made once for a few thousand calls."""

    def __init__(self, most: int = 2000):
        self.most, self.sets = most, {}

    def of(self, texts: list[str]) -> list[np.ndarray]:
        new = [t for t in dict.fromkeys(texts) if t not in self.sets]
        if len(self.sets) + len(new) > self.most:
            self.sets = {}
            new = list(dict.fromkeys(texts))
        for at, part in slices(pa.array(new, pa.large_string())):
            owners, hashes = shingle_sets(part)
            cuts = np.searchsorted(owners, np.arange(part.n + 1))
            for k in range(part.n):
                self.sets[new[at + k]] = hashes[cuts[k] : cuts[k + 1]]
        return [self.sets[t] for t in texts]


def _confirm_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    sets = _Sets()
    for left, right in batches:
        out = []
        for at in range(0, len(left), 200):
            a, b = sets.of(left.slice(at, 200).to_pylist()), None
            b = sets.of(right.slice(at, 200).to_pylist())
            out += [bool(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))) for x, y in zip(a, b)]
        yield pa.array(out, pa.bool_())


confirm = arrow_column(_confirm_batches, "boolean")


# Comparison in blocks. A task's rows are adjacent; side 0 are queries, side 1 the bucket's largest known component.


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, from batches sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy()
        if not len(task):
            continue
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if held and not (k == 0 and held[-1].column("task")[0].as_py() == task[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(comp: np.ndarray, side: np.ndarray, only_across: bool) -> np.ndarray:
    """Which pairs (i < j) a task has to look at: of different components, and across the sides if it has two."""
    apart = np.triu(comp[:, None] != comp[None, :], 1)
    if only_across:
        across = side[:, None] != side[None, :]
        apart &= across
    return apart


def _screen_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _tasks(batches):
        regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint8).reshape(-1, M)
        comp, side, n = (rows.column(c).to_numpy() for c in ("comp", "side", "n"))
        band, two = rows.column("band")[0].as_py(), rows.column("two")[0].as_py()
        i, j = np.nonzero(_open_pairs(comp, side, two))
        hit = np.zeros(len(comp), bool)
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            # Pairs that share an earlier band are looked at there.
            if band >= 0:
                same = (regs[a] == regs[b]).reshape(-1, BANDS, ROWS).all(2)
                here = same.argmax(1) == band
                a, b = a[here], b[here]
            good = likely(n[a], n[b], (regs[a] > regs[b]).sum(1), (regs[a] < regs[b]).sum(1))
            hit[a[good]] = hit[b[good]] = True
        if hit.any():
            yield rows.select(["task", "rep", "comp", "side", "two"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]


def _confirm_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for rows in _tasks(batches):
        rep, comp, side = (rows.column(c).to_numpy() for c in ("rep", "comp", "side"))
        found = sets.of(rows.column("text").to_pylist())
        todo = _open_pairs(comp, side, rows.column("two")[0].as_py())
        sizes = np.array([len(s) for s in found])
        ids = np.unique(np.concatenate(found), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        group = {c: c for c in comp.tolist()}

        def root(c):
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        out = []
        for x in np.flatnonzero(todo.any(1)):
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            common = np.add.reduceat(mark[ids], starts, dtype=np.int64)
            mark[own] = False
            for y in np.flatnonzero(todo[x] & linked(sizes[x], sizes, common)):
                if (p := root(int(comp[x]))) != (q := root(int(comp[y]))):
                    group[p] = q
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """rep and comp, the smallest id reachable, for each id in `links` (a, b); by alternating large and small stars.

    A graph whose stars still change after `rounds` rounds, which would take a path of some 2^30 nodes, is an error."""
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        # Large star: what is above u joins the smallest that u knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = skew_join(both, least.select("u", "m"), ["u"], "v", least.select("u", "n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: what is below u, and u, join the smallest below u.
        large = scratch.table(large, "edges")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        joined = skew_join(large, least.select("u", "m"), ["u"], "v", least.select("u", "n"))
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = scratch.table(small.select("e.*").filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"the links' components aren't complete after {rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("rep"), "comp")
    return stars.unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct())


def _only(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is in `ids` (or isn't): by broadcast if those are few, so that wide rows need no shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def _with_both(pairs: DataFrame, of: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of `of` (rep, ...) for each, named with a suffix; many pairs may have one a."""
    one, two = (of.select([F.col(c).alias(side if c == "rep" else f"{c}_{side}") for c in of.columns]) for side in "ab")
    return skew_join(pairs.join(two, "b"), one, ["a"], "b", counts)


def _shared_rare(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets (band -1, key: a shingle) of `members` (rep, comp), in whose one two linked sets always meet."""
    sets = scratch.table(_only(texts, members.select("rep"), "rep").dropDuplicates(["rep"]).select("rep", shingle_set("text").alias("s")), "sets")
    each = sets.select("rep", F.explode("s").alias("s"))
    counts = scratch.table(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "shingles")
    common = counts.filter("n > 1")
    ordered = skew_join(each, common.withColumnRenamed("n", "df"), ["s"], "rep", counts).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("known"))
    # Shingles that one member has alone come first in its order and meet nothing.
    most = F.ceil(F.size("s") * LINK_NUM / LINK_DEN)
    rare = F.slice("known", 1, F.greatest(F.lit(0), F.size("known") - most + 1).cast("int"))
    meet = sets.join(ordered, "rep").select("rep", F.explode(rare).alias("k")).select("rep", F.lit(-1).alias("band"), F.col("k.s").alias("key"))
    return meet.join(members, "rep")


def _tasks_of(members: DataFrame, counts: DataFrame) -> DataFrame:
    """task, band, rep, comp, side and two: the rows of buckets (band, key) dealt into tasks that hold at most two blocks.

    counts: band, key, main (the component that isn't compared with itself), n0 and n1, the members beside it and in it, and
    s0 and s1, their sizes in sum.
    """
    g0, g1 = (F.greatest(F.lit(1), F.ceil(F.col(f"n{k}") / BLOCK), F.ceil(F.col(f"s{k}") / BLOCK_SHINGLES)).cast("int") for k in (0, 1))
    blocks = counts.select("band", "key", "main", g0.alias("g0"), g1.alias("g1"))
    dealt = skew_join(members, blocks, ["band", "key"], "rep", counts.select("band", "key", (F.col("n0") + F.col("n1")).alias("n"))).withColumn("side", F.expr("int(comp = main)"))
    # Queries of one block meet each other in the first task in which they meet the other side; those of several blocks in tasks of their own.
    tasks = F.expr("""
        CASE WHEN side = 1 THEN transform(sequence(0, g0 - 1), i -> named_struct('i', i, 'j', int(pmod(hash(rep), g1)), 'two', g0 > 1 OR int(pmod(hash(rep), g1)) > 0))
        ELSE concat(
          transform(sequence(0, g1 - 1), j -> named_struct('i', int(pmod(hash(rep), g0)), 'j', j, 'two', g0 > 1 OR j > 0)),
          if(g0 > 1, transform(sequence(0, g0 - 1), j -> named_struct('i', least(j, int(pmod(hash(rep), g0))), 'j', -1 - greatest(j, int(pmod(hash(rep), g0))), 'two', false)), array()))
        END""")
    return dealt.select("band", "key", "rep", "comp", "side", F.explode(tasks).alias("t")).select(F.xxhash64("band", "key", "t").alias("task"), "band", "rep", "comp", "side", F.col("t.two").alias("two"))


def _open(members: DataFrame, main: DataFrame, counts: DataFrame) -> DataFrame:
    """band, key, main, n0, n1, s0 and s1 of the buckets that hold several components; main: the component of the bucket's smallest
    member; s0, s1: the members' sizes (sz) in sum, 0 if they have none."""
    sized = skew_join(members, main, ["band", "key"], "rep", counts).withColumn("side", F.expr("int(comp = main)"))
    sz = F.col("sz") if "sz" in members.columns else F.lit(0)
    sums = [F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1"), F.sum(sz * (1 - F.col("side"))).alias("s0"), F.sum(sz * F.col("side")).alias("s1")]
    return sized.groupBy("band", "key", "main").agg(*sums).filter("n0 > 0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for each row of `docs`, as a table in the shared folder."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        out = scratch.last(_near_duplicates(texts, scratch), "near")
    return out.select(F.col("rep").alias(id_col), "n_shingles", "component_id", "kept")


def _near_duplicates(texts: DataFrame, scratch: Scratch) -> DataFrame:
    bucket = ["band", "key"]
    rows = scratch.table(texts.select("rep", sketch("text").alias("s")).select("rep", "s.*"), "sketch")
    full = rows.filter("n > 0 AND rep IS NOT NULL")
    classes = scratch.table(full.groupBy("digest").agg(F.min(F.struct("rep", "n", "regs")).alias("c"), F.count(F.lit(1)).alias("copies")).select("digest", "c.*", "copies"), "classes")

    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.cast("int").alias("band"), F.xxhash64(b, F.substring("regs", b * ROWS + 1, F.lit(ROWS))).alias("key")))
    bands = classes.select("rep", F.col("n").alias("sz"), F.explode(key).alias("k")).select("rep", "sz", "k.*")
    buckets = bands.groupBy(bucket).agg(F.min("rep").alias("pivot"), F.max("rep").alias("far"), F.count(F.lit(1)).alias("n")).filter("pivot < far")
    buckets = scratch.table(buckets, "buckets")
    counts = buckets.filter("n > 2").select(*bucket, "n")
    crowded = scratch.table(skew_join(bands, buckets.filter("n > 2").select(*bucket, "pivot"), bucket, "rep", counts), "crowded")
    pairs = buckets.filter("n = 2").select(F.col("pivot").alias("a"), F.col("far").alias("b")).unionByName(crowded.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))).distinct()
    pairs = scratch.table(pairs, "pairs")
    side = classes.select("rep", "n", "regs")
    per_a = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = scratch.table(_with_both(pairs, side, per_a).filter(screen("n_a", "n_b", "regs_a", "regs_b")).select("a", "b"), "pairs")
    wanted = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    chosen = scratch.table(_only(texts, wanted, "rep").dropDuplicates(["rep"]), "texts")
    per_a = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    star = scratch.table(_with_both(pairs, chosen, per_a).filter(confirm("text_a", "text_b")).select("a", "b"), "links")

    comps = components(star, scratch)
    members = scratch.table(crowded.join(comps, "rep", "left").select(*bucket, "pivot", "rep", "sz", F.coalesce("comp", "rep").alias("comp")), "members")
    main = members.filter("rep = pivot").select(*bucket, F.col("comp").alias("main"))
    open_ = scratch.table(_open(members, main, counts), "open")
    large = F.col("n0") * (F.col("n0") + F.col("n1")) > BLOCK * BLOCK
    todo = [_tasks_of(members.drop("pivot"), open_.filter(~large))]
    if not (crowds := scratch.table(open_.filter(large), "crowds")).isEmpty():
        inside = scratch.table(skew_join(members, crowds.select(bucket), bucket, "rep", crowds.select(*bucket, (F.col("n0") + F.col("n1")).alias("n"))).select("rep", "comp", "sz").distinct(), "inside")
        again = scratch.table(_shared_rare(inside, texts, scratch), "rare")
        met = scratch.table(again.groupBy(bucket).agg(F.min(F.struct("rep", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high"), "met")
        todo.append(_tasks_of(again, scratch.table(_open(again, met.select(*bucket, F.col("p.comp").alias("main")), met.select(*bucket, "n")), "open")))
    dealt = todo[0] if len(todo) == 1 else todo[0].unionByName(todo[1])
    part = F.col("task")
    known = dealt.join(side, "rep").repartition(part).sortWithinPartitions("task")
    screened = scratch.table(known.mapInArrow(_screen_tasks, "task bigint, rep bigint, comp bigint, side int, two boolean"), "screened")
    wanted = scratch.table(screened.select("rep").distinct(), "wanted")
    chosen = scratch.table(_only(texts, wanted, "rep").dropDuplicates(["rep"]), "texts")
    rest = screened.join(chosen, "rep").repartition(part).sortWithinPartitions("task").mapInArrow(_confirm_tasks, "a bigint, b bigint")
    comps = scratch.table(components(star.unionByName(rest), scratch), "components")

    classed = classes.join(comps, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"), "copies", "rep").filter("copies > 1 OR component_id <> rep")
    out = skew_join(rows.select("rep", "n", "digest"), classed.select("digest", "component_id"), ["digest"], "rep", classes.select("digest", F.col("copies").alias("n")), "left")
    component = F.when(F.col("rep").isNull() | (F.col("n") == 0), F.col("rep")).otherwise(F.coalesce("component_id", "rep"))
    return out.select("rep", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("rep")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that near_duplicates() keeps; of rows with one id and one text, one stays."""
    found = materialise(near_duplicates(docs, id_col, text_col), "found")
    dropped = materialise(found.filter("NOT kept").select(id_col).distinct(), "dropped")
    left = _only(docs, dropped, id_col, "left_anti")
    again = materialise(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "again")
    if again.isEmpty():
        return left
    return _only(left, again, id_col, "left_anti").unionByName(_only(left, again, id_col).dropDuplicates([id_col, text_col]))
