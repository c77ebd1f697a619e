"""Quality rules at host level.

Each document is measured against rules. Rule failures are aggregated by host (here: `source`), each host's failure
rate is shrunk towards all hosts' with an empirical beta prior, and the host's verdict goes back to its documents: in a
host whose shrunken rate is over `host_limit`, the soft rules hold with their tight limits. A document without symbols
and repeated lines therefore stays, whatever its host.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; equal rows
are measured and returned each; an empty table gives an empty result. Only the id, text and host columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import arrow_column, join_lookup, materialise, null_safe
from marlstone.llm._scan import grams, slices

MIN_WORDS, MAX_REPEAT_PCT = 10, 20
#: Soft rules: symbols in a hundred words, repeated lines in a hundred lines with a word. Loose in common hosts, tight in bad ones.
LOOSE = {"symbols": 100, "lines": 60}
TIGHT = {"symbols": 20, "lines": 30}
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True


def _repeats(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each item, how many items of the same text have its key; items of a text are adjacent."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.ones(len(k), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(k), np.int64)
    out[order] = np.bincount(run, minlength=1)[run] if len(k) else 0
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rules' measures of each text; FIELDS says which."""
    out = {f: np.zeros(len(texts), np.int64) for f in FIELDS}
    for at, t in slices(texts):
        here = slice(at, at + t.n)
        owner, words = t.words(fold=False)
        out["n_words"][here] = np.bincount(owner, minlength=t.n)
        out["word_chars"][here] = t.count(~t.space & ((t.data & 0xC0) != 0x80))
        out["n_symbols"][here] = t.count(_symbol[t.data])
        line_owner, lines = t.lines()
        n_lines = np.bincount(line_owner, minlength=t.n)
        once = np.bincount(line_owner, weights=1 / np.maximum(_repeats(line_owner, lines), 1), minlength=t.n)
        out["n_lines"][here] = n_lines
        out["n_dup_lines"][here] = n_lines - np.rint(once).astype(np.int64)
        first, windows = grams(owner, words)
        again = first[_repeats(owner[first], windows) > 1]
        edge = np.zeros(len(words) + 6, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 5, -1)
        covered = np.cumsum(edge)[: len(words)] > 0
        out["n_repeat_words"][here] = np.bincount(owner[covered], minlength=t.n)
    return out


def _measure_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = measure(texts)
        yield pa.StructArray.from_arrays([pa.array(found[f]) for f in FIELDS], FIELDS)


#: A struct of FIELDS for a text column.
measures = arrow_column(_measure_batches, f"struct<{','.join(f'{f}:bigint' for f in FIELDS)}>")


def base_failed(m: str) -> F.Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{m}.n_words"))


def _beyond(limits: dict[str, int], m: str) -> F.Column:
    return (100 * F.col(f"{m}.n_symbols") > limits["symbols"] * F.col(f"{m}.n_words")) | (100 * F.col(f"{m}.n_dup_lines") > limits["lines"] * F.col(f"{m}.n_lines"))


def host_verdicts(judged: DataFrame, host: str, failed: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row a host: documents, failures, the shrunken failure rate, and whether the host is bad.

    The prior beta(mean * k, (1 - mean) * k) has the mean of the hosts' rates and, by the method of moments, their
    variance: k = mean * (1 - mean) / variance - 1, kept within 1 and 1e6; with no variance between hosts, k is 1e6.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rates = hosts.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("mean"), F.coalesce(F.var_pop(F.col("n_failed") / F.col("n_docs")), F.lit(0.0)).alias("var"))
    k = F.when(F.col("var") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1))).otherwise(F.lit(1e6))
    prior = rates.select("mean", k.alias("k"))
    # A single row of two numbers.
    return hosts.join(F.broadcast(prior)).select(
        host, "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("mean") * F.col("k")) / (F.col("n_docs") + F.col("k"))).alias("host_rate"),
    ).withColumn("host_bad", F.col("host_rate") > host_limit)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Measures, base_failed, the host's rate and verdict, and kept, for each row of `docs`.

    keep: columns of `docs` to return before these (the id alone, if None); they travel inside one struct, so their
    names may clash with nothing. The measured rows are written once to the shared folder and read for both uses.
    """
    carried = keep if keep is not None else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), null_safe(F.col(host_col)).alias("host"), F.hash(F.col(id_col)).alias("spread"), measures(F.col(text_col)).alias("m"))
    rows = rows.withColumn("base_failed", base_failed("m")).withColumn("loose", _beyond(LOOSE, "m")).withColumn("tight", _beyond(TIGHT, "m"))
    rows = materialise(rows.withColumn("failed", F.col("base_failed") | F.col("loose")), "quality")
    verdicts = host_verdicts(rows, "host", "failed").select("host", "host_rate", "host_bad")
    joined = join_lookup(rows, verdicts, "host", F.col("spread"))
    kept = ~F.col("base_failed") & ~F.when(F.col("host_bad"), F.col("tight")).otherwise(F.col("loose"))
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], *[F.col(f"m.{f}").alias(f) for f in FIELDS], "base_failed", "host_rate", "host_bad", kept.alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules and their hosts' verdicts keep, unchanged."""
    marked = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source"), keep=["doc"])
    return marked.filter("kept").select("doc.*")
