"""Which of many terms a text holds, which words of a vocabulary are like a query's, and where nodes stand in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators._lineage import cut
from marlstone.operators.retrieval import MAX_QUERY_TOKENS, containing

#: Terms of one automaton, which every task holds. More terms are found by keys of their first characters, joined.
AUTOMATON_TERMS, AUTOMATON_CHARS = 200_000, 4_000_000


def _automaton(terms: list[str]):
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(term, k)
    found.make_automaton()
    return found


def holding(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str = "term") -> DataFrame:
    """id and term, once each, of the texts that hold a term as characters, in any case. Null and empty terms are in no text.

    The terms, once distinct and counted, make an automaton that reads every text once, whatever their number; only a list
    beyond AUTOMATON_TERMS is joined instead, by the keys of `containing`."""
    known = cut(terms.select(F.lower(term_col).alias("term")).filter("term <> ''").distinct(), "terms")
    n, chars = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).filter("text IS NOT NULL")
    if n > AUTOMATON_TERMS or chars > AUTOMATON_CHARS:
        numbered = cut(known.withColumn("t", F.monotonically_increasing_id()), "terms")
        numbered_rows = cut(rows.withColumn("d", F.monotonically_increasing_id()), "texts")
        pairs = containing(numbered_rows.select("d", "text"), numbered.select("t", F.col("term").alias("text")), "d", "t")
        return pairs.join(numbered, F.col("passage") == F.col("t")).join(numbered_rows.select("d", "id"), F.col("doc") == F.col("d")).select("id", "term").distinct()
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r.term for r in known.collect()))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = sent.value
        automaton = _automaton(words)
        for batch in batches:
            hits = [sorted({k for _, k in automaton.iter(t)}) if words else [] for t in batch.to_pylist()]
            yield pa.array([[words[k] for k in ks] for ks in hits], pa.list_(pa.string()))

    return rows.select("id", F.explode(F.arrow_udf(find, "array<string>")("text")).alias("term")).distinct()


def first_held(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and skill of every text: the smallest id of `terms` (id, term) whose term the text holds, or null."""
    least = terms.filter("term <> ''").groupBy(F.lower("term").alias("term")).agg(F.min("id").alias("skill"))
    found = holding(texts, least, id_col, text_col).join(least, "term").groupBy("id").agg(F.min("skill").alias("skill"))
    return texts.select(F.col(id_col).alias("id")).join(found, "id", "left").select(F.col("id").alias(id_col), "skill")


def like_words(vocabulary: DataFrame, words: list[str], term_col: str = "term") -> DataFrame:
    """word and term: terms of a vocabulary that hold one of `words` or are held by it, or have its length and one other
    character, and are not the word itself; of two characters or more both. The words are a query's, so their number is bounded.

    Terms with one other character are found by keys that leave one position out, the rest by an automaton over the words and
    by the words' own parts; each is a join on equality, and texts play no part."""
    if sum(map(len, words)) > MAX_QUERY_TOKENS:
        raise ValueError(f"a query has at most {MAX_QUERY_TOKENS} characters")
    spark = vocabulary.sparkSession
    few = sorted({w for w in words if len(w) >= 2})
    known = vocabulary.select(F.col(term_col).alias("term")).filter(F.length("term") >= 2)
    asked = spark.createDataFrame([(w,) for w in few], "word string")
    holes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.struct(i.alias("i"), F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))).alias("rest")))
    sized = known.filter(F.length("term").isin(sorted({len(w) for w in few})))
    one = sized.select("term", F.explode(holes(F.col("term"))).alias("key")).join(F.broadcast(asked.select("word", F.explode(holes(F.col("word"))).alias("key"))), "key").select("word", "term")
    inside = holding(known, asked, "term", "term", "word").select(F.col("term").alias("word"), F.col("id").alias("term"))
    # A word's own parts, which are no more than its characters' square half, meet the vocabulary.
    ends = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("word") - i + 1)), lambda n: F.substring(F.col("word"), i, n)))
    parts = asked.filter(F.length("word") <= 64).select("word", F.explode(F.array_distinct(F.flatten(ends))).alias("term"))
    held = known.join(F.broadcast(parts), "term").select("word", "term")
    long = asked.filter(F.length("word") > 64)
    held = held.unionByName(known.join(F.broadcast(long), F.contains("word", "term")).select("word", "term"))
    return one.unionByName(inside).unionByName(held).filter("word <> term").distinct()


def tree_places(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", title_col: str = "title") -> DataFrame:
    """id, path (an array of titles from the root on) and depth (0 for roots) of `nodes` that hang on a root.

    Roots have a null parent. By doubling: each round a node's pointer and path reach twice as far up, so a tree of depth d takes
    log2(d) rounds. What hangs on a cycle, or on a parent that isn't there, comes to no root: such nodes are told first, by
    pointers alone, so that no path grows round a cycle, and are left out."""
    rows = cut(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.col(title_col).alias("title")), "nodes")
    n = rows.count()

    def doubled(state: DataFrame, path: bool) -> DataFrame:
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), *([F.col("path").alias("_path")] if path else []))
        joined = state.filter("up IS NOT NULL").join(above, F.col("up") == F.col("_id"), "left")
        # A parent that isn't there stays a pointer that leads nowhere.
        up = F.when(F.col("_id").isNull(), F.col("up")).otherwise(F.col("_up"))
        moved = joined.select("id", up.alias("up"), *([F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path")] if path else []))
        return moved.unionByName(state.filter("up IS NULL"))

    def rounds(state: DataFrame, path: bool) -> DataFrame:
        reach = 1
        before = None
        while reach < 2 * n:
            state = cut(doubled(state, path), "tree")
            open_ = state.filter("up IS NOT NULL").count()
            # Pointers of trees reach their roots one after the other; only those of cycles go on without end.
            if open_ == 0 or (open_ == before and reach >= n):
                break
            before, reach = open_, reach * 2
        return state

    rooted = rounds(rows.select("id", "up"), False).filter("up IS NULL").select("id")
    placed = rounds(rows.join(rooted, "id", "left_semi").select("id", "up", F.array("title").alias("path")), True)
    return placed.select("id", "path", (F.size("path") - 1).alias("depth"))
