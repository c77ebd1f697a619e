"""Keyword and vector search, fusion of ranked lists, and reranking, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators._lineage import cut

K1, B, RRF_K = 1.5, 0.75, 60.0
VECTOR_WEIGHT, KEYWORD_WEIGHT, ORIGINAL_WEIGHT, BOTH_BONUS = 0.6, 0.4, 0.2, 0.1
#: A query's tokens are constants of the plan: their number is bounded by the query's length, which is checked.
MAX_QUERY_TOKENS = 10_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, token, tf and dl (all tokens of the document) of each document and token."""
    tokens = docs.filter(F.length(F.trim(text_col)) > 0).select(F.col(id_col).alias("id"), T.search_tokens(F.col(text_col)).alias("tokens"))
    return tokens.select("id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: documents with text, and their mean number of tokens."""
    sized = docs.filter(F.length(F.trim(text_col)) > 0).select(F.size(T.search_tokens(F.col(text_col))).alias("dl"))
    return sized.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, keep: list[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """id, the columns in `keep`, and the positive BM25 score (to 9 decimals, so that ties don't hang on the order of sums)
    of each document that has a token of the query.

    Texts are tokenised once, into a checkpoint of each document's length and hits; only hits are ever grouped.
    """
    if len(query) > MAX_QUERY_TOKENS:
        raise ValueError(f"a query has at most {MAX_QUERY_TOKENS} characters")
    known = docs.sparkSession.range(1).select(T.search_tokens(F.lit(query)).alias("q")).first()["q"]
    q = F.array(*map(F.lit, known)).cast("array<string>")  # a constant of the plan
    # The tokens are bound to a name, so both uses take one evaluation.
    found = F.transform(F.array(T.search_tokens(F.col(text_col))), lambda ts: F.struct(F.size(ts).alias("dl"), F.filter(ts, lambda x: x.isin(known)).alias("hits")))[0]
    rows = docs.filter(F.length(F.trim(text_col)) > 0).select(F.col(id_col).alias("id"), *keep, found.alias("f"))
    rows = cut(rows.select("id", *keep, "f.dl", "f.hits"))
    stats = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl")))
    tf = rows.select("id", *keep, "dl", F.explode("hits").alias("token")).groupBy("id", *keep, "token", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(F.broadcast(df), "token").crossJoin(stats)
    qtf = F.size(F.filter(q, lambda x: x == F.col("token")))
    part = qtf * idf(F.col("df"), F.col("n_docs")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avg_dl"), F.lit(1e-6))))
    return scored.groupBy("id", *keep).agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows, ties by id, with their 1-based rank; only k rows are ranked in one task."""
    best = scored.orderBy(F.col(score).desc(), F.col(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(tie))))


def vector_search(vectors: DataFrame, query: list[float], id_col: str, vec_col: str, threshold: float | None = None) -> DataFrame:
    """id and score (cosine) of vectors of the query's dimension, at least `threshold` if given. The query is a literal of the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), V.cosine(F.col(vec_col), q).alias("score"))
    return scored if threshold is None else scored.filter(F.col("score") >= threshold)


def search_many(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int, block: int = 2048, same_space: bool = True) -> DataFrame:
    """query, id, score and rank of the k vectors of the greatest cosine to each query vector; ties by id. same_space: the
    queries are rows of the vectors, and a row isn't found by itself.

    Every block of queries meets every block of vectors and keeps k hits of it; these are few and ranked again. A block is one
    packed row, made once, so nothing is turned into Python numbers for a pair of blocks."""
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")

    def pack(group: pa.Table) -> pa.Table:
        ids = np.ascontiguousarray(group["id"].to_numpy(), np.int64)
        values = np.ascontiguousarray(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        if len(set(map(len, group["v"]))) > 1:
            raise ValueError("vectors of different lengths")
        return pa.table({"b": group["b"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "vs": pa.array([values.tobytes()], pa.binary())})

    def packed(df: DataFrame, size: int) -> DataFrame:
        held = rows(df)
        n = max(1, -(-held.count() // size))
        return held.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("b").applyInArrow(pack, "b bigint, ids binary, vs binary")

    def unit(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, np.int64)
        x = np.frombuffer(vs, np.float64).reshape(len(ids), -1)
        return ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qv, i, iv in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vs", "ids", "vs"))):
                (mine, x), (ids, y) = unit(q, qv), unit(i, iv)
                score = np.round(x @ y.T, 9)
                if same_space:
                    score[mine[:, None] == ids[None, :]] = -np.inf
                for n, s in enumerate(score):
                    top = np.lexsort((ids, -s))[: min(k, int((s > -np.inf).sum()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), mine[n])), pa.array(ids[top]), pa.array(s[top])], ["query", "id", "score"])

    asked = packed(queries, block).select(F.col("b").alias("q"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    few = asked.join(packed(vectors, 16_384), how="cross").repartition("q", "b").mapInArrow(best, "query bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return few.withColumn("rank", place).filter(F.col("rank") <= k)


def _blocked_pairs(rows: DataFrame, kind: type, least: float, block: int, strip: int, out: Callable, schema: str) -> DataFrame:
    """What `out` makes of the pairs of rows (id, n, v) whose cosine is at least `least`: it gets a side's ids and, pair by pair, places in
    them and in the other side's ids and numbers. Rows are dealt into blocks, and every two blocks meet in one task, a strip at a
    time; both directions of a pair are found. A zero vector has no neighbours."""
    n_blocks = max(1, -(-rows.count() // block))

    def pack(group: pa.Table) -> pa.Table:
        ids, ns = (np.ascontiguousarray(group[c].to_numpy(), np.int64) for c in ("id", "n"))
        values = np.ascontiguousarray(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), kind)
        if len(values) % len(ids) or len(set(map(len, group["v"]))) > 1:
            raise ValueError("vectors of different lengths")
        return pa.table({"i": group["i"][:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", ids), ("ns", ns), ("vs", values))}})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = []
        for _, ids, ns, vs in sorted((r["i"], r["ids"], r["ns"], r["vs"]) for b in batches for r in b.to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            vs = np.frombuffer(vs, kind).reshape(len(ids), -1).astype(np.float64)
            size = np.linalg.norm(vs, axis=1, keepdims=True)
            sides.append((ids, np.frombuffer(ns, np.int64), np.divide(vs, size, out=np.zeros_like(vs), where=size > 0)))
        (a, n_a, x), (b, n_b, y) = sides[0], sides[-1]
        for at in range(0, len(a), strip):
            left, right = np.nonzero(x[at : at + strip] @ y.T >= least)
            left += at
            if len(sides) == 1:  # a block and itself: both directions are found as they are
                other = left != right
                if other.any():
                    yield out(a, left[other], b, n_b, right[other])
            elif len(left):
                yield out(a, left, b, n_b, right)
                yield out(b, right, a, n_a, left)

    packed = rows.filter("v IS NOT NULL").withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("i").applyInArrow(pack, "i int, ids binary, ns binary, vs binary")
    pairs = packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("j")
    # A block without rows leaves its partners' groups with one side.
    whole = packed.select(F.col("i").alias("other"))
    pairs = pairs.withColumn("other", F.col("lo") + F.col("hi") - F.col("i")).join(whole, "other", "left_semi").drop("other")
    return pairs.groupBy("lo", "hi").applyInArrow(meet, schema)


def _typed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, type]:
    kind = np.float32 if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind is np.float32 else "array<double>").alias("v")), kind


def vector_neighbours(vectors: DataFrame, id_col: str, vec_col: str, least: float, block: int = 16384, strip: int = 256) -> DataFrame:
    """id and neighbours of every vector: the ids of all other vectors at a cosine of at least `least`, ascending. Exact, in the time of all pairs."""
    rows, kind = _typed(vectors, id_col, vec_col)

    def lists(ids: np.ndarray, at: np.ndarray, others: np.ndarray, _, place: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(at, kind="stable")
        each, starts = np.unique(at[order], return_index=True)
        near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(others[place[order]], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(ids[each], pa.int64()), near], ["id", "near"])

    near = _blocked_pairs(rows.withColumn("n", F.lit(1).cast("long")), kind, least, block, strip, lists, "id bigint, near array<bigint>")
    found = near.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("neighbours"))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def vector_links(vectors: DataFrame, id_col: str, vec_col: str, least: float, block: int = 16384, strip: int = 256) -> DataFrame:
    """id, class_id (the least id of the vectors equal to it) and links, the number of other vectors at a cosine of at least `least`.

    Equal vectors are compared once, and links are counted where they are found, so no list of neighbours is held. Null and zero
    vectors have no links, and are a class by themselves or with their like."""
    rows, kind = _typed(vectors, id_col, vec_col)
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("long").alias("n")), "classes")

    def sums(ids: np.ndarray, at: np.ndarray, _, numbers: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        total = np.bincount(at, numbers[place], len(ids)).astype(np.int64)
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], ["id", "links"])

    beside = _blocked_pairs(classes, kind, least, block, strip, sums, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("beside"))
    filled = F.exists("v", lambda x: x != 0)
    own = F.when(F.coalesce(filled, F.lit(False)), F.col("n") - 1).otherwise(0)
    known = classes.join(beside, "id", "left").select("v", F.col("id").alias("class_id"), (own + F.coalesce("beside", F.lit(0))).alias("links"))
    # Vectors meet their class by a digest of their components, nulls by themselves.
    key = F.coalesce(F.xxhash64(F.col("v"), F.lit(1)), F.lit(0))
    known = known.withColumn("h", key).withColumnRenamed("v", "w")
    return rows.withColumn("h", key).join(known, "h").filter(F.col("v").eqNullSafe(F.col("w"))).select("id", "class_id", "links")


def _shingle_keys(text: str, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(size, key) of each window of `size` characters, once: a window's key is the least hash of its shingles of half that size, so equal windows have equal keys in any text."""
    if 0 in sizes:
        yield 0, 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    h, q = (codes + np.uint64(1)) * factor, 1
    for size in (1, 2, 4, 8, 16, 32, 64):
        if len(codes) < size:
            return
        if size > 2:
            h = (h[: len(h) - q] ^ (h[: len(h) - q] >> np.uint64(29))) * factor + h[q:]
            q *= 2
        if size in sizes:
            least = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            least ^= least >> np.uint64(32)
            # The least of q + 1 neighbours, by doubling.
            for step in [] if size == 1 else [*(1 << k for k in range(q.bit_length() - 1)), 1]:
                least = np.minimum(least[: len(least) - step], least[step:])
            for key in np.unique(least.view(np.int64)).tolist():
                yield size, key


def containing(docs: DataFrame, passages: DataFrame, doc_col: str, passage_col: str, text_col: str = "text") -> DataFrame:
    """All (doc, passage) ids of documents whose text contains a passage, as characters; both tables have a text column `text_col`.

    A passage is joined by the key of its first characters, as many as a power of two up to 64, which every text around it has."""

    def keys(first: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 200):
                    rows = ([], [], [])
                    for i, t in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist()):
                        size = min(64, 1 << len(t).bit_length() - 1) if t else 0
                        for row in _shingle_keys(t, first) if first is not None else _shingle_keys(t[:size], [size]):
                            for column, x in zip(rows, (i, *row)):
                                column.append(x)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], ["id", "size", "key"])

        return run

    rows = lambda df, i: df.filter(F.col(i).isNotNull() & F.col(text_col).isNotNull()).select(F.col(i).cast("long"), F.col(text_col))
    heads = rows(passages, passage_col).mapInArrow(keys(None), "id bigint, size int, key bigint").withColumnRenamed("id", "passage")
    sizes = [r["size"] for r in heads.select("size").distinct().collect()]  # eight at most
    found = rows(docs, doc_col).mapInArrow(keys(sizes), "id bigint, size int, key bigint").withColumnRenamed("id", "doc")
    pairs = found.join(heads, ["size", "key"]).select("doc", "passage").distinct()
    texts = rows(docs, doc_col).toDF("doc", "text").join(pairs, "doc")
    return texts.join(rows(passages, passage_col).toDF("passage", "part"), "passage").filter(F.contains("text", "part")).select("doc", "passage").distinct()


def rrf(lists: list[tuple[str, DataFrame, float]], k: float = RRF_K) -> DataFrame:
    """Fuses ranked lists (name, rows with id and rank, weight): score = sum of weight / (k + rank), and the sources sorted by name."""
    parts = None
    for name, rows, weight in lists:
        part = rows.filter(F.col("id").isNotNull()).select("id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(name).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.sum("part").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def max_norm_merge(vector: DataFrame, keyword: DataFrame, original: DataFrame) -> DataFrame:
    """Scores by their list's maximum, weighted; a bonus for ids in both lists; the original query's list adds new ids only."""

    def normed(rows: DataFrame, name: str) -> DataFrame:
        # The maximum over a ranked list, which is short: it was limited before.
        best = F.coalesce(F.nullif(F.max("score").over(Window.partitionBy()), F.lit(0.0)), F.lit(1.0))
        return rows.select("id", (F.col("score") / best).alias(name))

    both = normed(vector, "v").join(normed(keyword, "k"), "id", "full")
    score = F.coalesce(F.col("v") * VECTOR_WEIGHT, F.lit(0.0)) + F.coalesce(F.col("k") * KEYWORD_WEIGHT, F.lit(0.0)) + F.when(F.col("v").isNotNull() & F.col("k").isNotNull(), BOTH_BONUS).otherwise(0.0)
    merged = both.select("id", score.alias("score"))
    extra = normed(original, "o").join(both, "id", "left_anti").select("id", (F.col("o") * ORIGINAL_WEIGHT).alias("score"))
    return merged.unionByName(extra)


def word_search(docs: DataFrame, query: str, id_col: str, text_col: str, words=T.words, least: int = 1, position: bool = True, fall_back: bool = True) -> DataFrame:
    """id and score of texts by shared words, shared bigrams of characters, words found as they are and, with `position`, how early they stand.

    Texts that share a word of two characters or more with the query; if none does, those with a word that holds one or is
    held by one. Without `fall_back`, all texts with a score. Words shorter than `least` don't count.
    """
    q = F.array_distinct(F.filter(words(F.lit(query)), lambda w: F.length(w) >= least))
    long_words = F.filter(words(F.lit(query)), lambda w: F.length(w) >= 2)
    long_words = long_words if position else F.array_distinct(long_words)
    own = F.array_distinct(F.filter(words(F.col(text_col)), lambda w: F.length(w) >= least))
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), own.alias("ws"))
    found = F.filter(long_words, lambda w: F.contains("t", w))
    qb = T.bigrams(long_words)
    score = F.size(F.array_intersect(q, "ws")) / F.greatest(F.size(q), F.lit(1)) * 0.5 + F.size(F.array_intersect(qb, T.bigrams(F.col("ws")))) / F.greatest(F.size(qb), F.lit(1)) * 0.3
    score = score + F.least(F.size(found) * 0.1, F.lit(0.3))
    if position:
        score = score + F.least(F.aggregate(found, F.lit(0.0), lambda a, w: a + (0.1 - (F.position(w, "t") - 1) / F.greatest(F.length("t"), F.lit(1)) * 0.1)), F.lit(0.2))
    near = F.exists("ws", lambda x: F.exists(long_words, lambda w: F.contains(x, w) | F.contains(w, x)))
    scored = rows.select("id", F.arrays_overlap(long_words, "ws").alias("shares"), near.alias("near"), F.round(score, 9).alias("score")).filter("score > 0")
    if not fall_back:
        return scored.select("id", "score")
    scored = cut(scored)
    some = scored.agg(F.coalesce(F.bool_or("shares"), F.lit(False)).alias("some"))
    return scored.crossJoin(F.broadcast(some)).filter(F.when(F.col("some"), F.col("shares")).otherwise(F.col("near"))).select("id", "score")


def weighted_merge(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """id and score: each short list's scores by their maximum, weighted and summed."""
    parts = None
    for rows, weight in lists:
        best = F.coalesce(F.nullif(F.max("score").over(Window.partitionBy()), F.lit(0.0)), F.lit(1.0))
        part = rows.select("id", (F.col("score") / best * weight).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.sum("part").alias("score"))


def page_score(query: str, title: Column, content: Column, tags: Column) -> Column:
    """3 for the query in the title, 2 in the content, 1.5 for each tag that holds it."""
    q = query.lower()
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return F.when(hit(title), 3.0).otherwise(0.0) + F.when(hit(content), 2.0).otherwise(0.0) + F.size(F.filter(tags, lambda x: F.contains(F.lower(x), F.lit(q)))) * 1.5


def first_titles(lists: list[DataFrame]) -> DataFrame:
    """The rows (title, score, ...) of several short lists, in order; of rows with one title in any case the first list's best stays."""
    rows = None
    for k, part in enumerate(lists):
        part = part.withColumn("_list", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    place = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("_list", F.desc("score"), "id"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place", "_list")


def evidence_score(terms: Column, haystack: Column, title: Column) -> Column:
    """Shared terms, and twice those in the title, by the number of terms; null if the text shares none."""
    n = F.greatest(F.size(terms), F.lit(1))
    overlap = F.size(F.filter(terms, lambda w: F.contains(F.lower(haystack), w)))
    titled = F.size(F.filter(terms, lambda w: F.contains(F.lower(title), w)))
    return F.when((F.size(terms) == 0) | (overlap > 0), overlap / n + 2 * titled / n)


def rule_rerank(rows: DataFrame, query: str, content: str, title: str | None = None) -> DataFrame:
    """`rows` (with score) and rule_score: the score, bonuses for shared words, bigrams, exact and title hits, less a length penalty."""
    q = F.array_distinct(T.words(F.lit(query)))
    text = F.lower(F.coalesce(F.col(content), F.lit("")))
    c = F.array_distinct(T.words(F.col(content)))
    n = F.greatest(F.size(q), F.lit(1))
    qb = T.bigrams(q)
    long_words = F.filter(q, lambda w: F.length(w) >= 2)
    exact = F.least(F.size(F.filter(long_words, lambda w: F.contains(text, w))) * 0.05, F.lit(0.2))
    titled = F.lit(0.0) if title is None else F.least(F.size(F.filter(long_words, lambda w: F.contains(F.lower(F.col(title)), w))) * 0.1, F.lit(0.3))
    bonus = F.size(F.array_intersect(q, c)) / n * 0.3 + F.size(F.array_intersect(qb, T.bigrams(c))) / F.greatest(F.size(qb), F.lit(1)) * 0.2
    return rows.withColumn("rule_score", F.col("score") + bonus + exact + titled - F.least(F.length(text) / 500, F.lit(1.0)) * 0.05)


def rerank_features(rows: DataFrame, query: str, content: str) -> DataFrame:
    """`rows` with the content features of the composite reranker, each between 0 and 1."""
    low = query.lower()
    text = F.lower(F.coalesce(F.col(content), F.lit("")))
    all_words = T.words(F.lit(query))
    q = F.array_distinct(all_words)
    meaning = F.filter(q, lambda w: F.length(w) >= 2)
    phrases = F.filter(all_words, lambda w: F.length(w) >= 2)
    c = T.words(F.col(content))
    length = F.greatest(F.length(text), F.lit(1))
    whole = F.position(F.lit(low), text)
    found = lambda ws: F.filter(ws, lambda w: F.contains(text, w))
    chars = lambda ws: F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
    first = F.array_min(F.transform(found(meaning), lambda w: F.position(w, text)))
    density = F.aggregate(meaning, F.lit(0.0), lambda a, w: a + F.log1p(F.size(F.filter(c, lambda x: x == w)).cast("double")))
    size = F.length(text)
    return rows.withColumns({
        "exact_match": F.when(whole > 0, F.least(F.lit(1.0), 0.5 + F.lit(len(low)) / length * 10)).otherwise(F.size(found(meaning)) / F.greatest(F.size(q), F.lit(1))),
        "keyword_coverage": F.when(F.size(meaning) > 0, F.size(F.array_intersect(meaning, c)) / F.greatest(F.size(meaning), F.lit(1))).otherwise(0.0),
        "phrase_match": chars(found(phrases)) / F.greatest(chars(phrases), F.lit(1)),
        "position": F.when(whole > 0, 1 - (whole - 1) / length).otherwise(F.coalesce(1 - (first - 1) / length, F.lit(0.0))),
        "length_quality": F.when(size < 20, 0.2).when(size < 50, 0.4).when(size < 200, 0.7).when(size < 1000, 1.0).when(size < 2000, 0.8).otherwise(0.5),
        "semantic_density": F.when((F.size(meaning) > 0) & (F.size(c) > 0), density / F.greatest(F.log1p(F.size(c).cast("double")) * F.size(meaning), F.lit(1e-6))).otherwise(0.0),
    })


# Weights, block types and, in rerank_features, the bands of lengths.
#: Weights of the composite reranker; rows without headings and block types get the features' defaults.
WEIGHTS = {"base": 0.20, "exact_match": 0.15, "keyword_coverage": 0.15, "phrase_match": 0.12, "position": 0.05, "heading": 0.10, "block_type": 0.05, "length_quality": 0.08, "semantic_density": 0.10}
BLOCK_TYPES = {"title": 0.9, "heading_h1": 0.85, "heading_h2": 0.8, "heading_h3": 0.75, "paragraph": 0.6, "table": 0.7, "code_block": 0.5, "image": 0.3, "caption": 0.4, "footnote": 0.2, "abstract": 0.8, "references": 0.3}


def heading_relevance(query: str, heading: Column, level: Column) -> Column:
    q = F.array_distinct(T.words(F.lit(query)))
    bonus = F.when(level == 1, 0.3).when(level == 2, 0.2).when(level == 3, 0.1).otherwise(0.05)
    coverage = F.size(F.array_intersect(q, F.array_distinct(T.words(heading)))) / F.greatest(F.size(q), F.lit(1))
    return F.when(heading.isNull() | (heading == "") | (F.size(q) == 0), 0.3).otherwise(F.least(F.lit(1.0), coverage + bonus))


def block_type_score(block_type: Column) -> Column:
    out = F.lit(0.5)
    for name, score in BLOCK_TYPES.items():
        out = F.when(block_type == name, score).otherwise(out)
    return out


def composite_rerank(rows: DataFrame, query: str, content: str, heading: Column | None = None, level: Column | None = None, block_type: Column | None = None) -> DataFrame:
    """`rows` (with score) with the features and rerank_score, their weighted sum."""
    out = rerank_features(rows, query, content)
    out = out.withColumn("heading_score", F.lit(0.3) if heading is None else heading_relevance(query, heading, level if level is not None else F.lit(0)))
    out = out.withColumn("block_score", F.lit(0.5) if block_type is None else block_type_score(block_type))
    named = {"base": "score", "heading": "heading_score", "block_type": "block_score"}
    total = sum((F.col(named.get(k, k)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("rerank_score", total)


def calibrate(ranked: DataFrame) -> DataFrame:
    """`ranked` (rank, score, both: in both lists) with display_score between 0.35 and 0.96; the first has at least 0.86. The list is short."""
    every = Window.partitionBy()
    n = F.count(F.lit(1)).over(every)
    span = F.greatest(F.max("score").over(every) - F.min("score").over(every), F.lit(1e-9))
    normal = F.when(n > 1, (F.col("score") - F.min("score").over(every)) / span).otherwise(1.0)
    strength = F.when(n > 1, 1 - (F.col("rank") - 1) / (n - 1)).otherwise(1.0)
    raw = 0.52 + normal * 0.28 + strength * 0.15 + F.when(F.col("both"), 0.04).otherwise(0.0)
    raw = F.when(F.col("rank") == 1, F.greatest(raw, F.lit(0.86))).otherwise(raw)
    return ranked.withColumn("display_score", F.greatest(F.lit(0.35), F.least(F.lit(0.96), raw)))


def positional_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id and the sorted positions of each term in each document."""
    tokens = docs.select(F.col(id_col).alias("id"), F.posexplode(T.matches(F.lower(F.col(text_col)), "[a-z0-9]+")).alias("position", "term"))
    return tokens.groupBy("term", "id").agg(F.sort_array(F.collect_list("position")).alias("positions"))
