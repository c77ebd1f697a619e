"""Stored tables, long-document splits, embeds, HTML text and lookups as DataFrame operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators._lineage import cut, shared_folder

def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` committed as a table of its own in the session's shared folder, and read from there."""
    return cut(df, name)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` stored by `key`, with the partitions that `new` has overwritten by it, and read back."""
    path = f"{shared_folder(old.sparkSession)}/replaced-{uuid.uuid4().hex}"
    old.write.partitionBy(key).parquet(path)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return old.sparkSession.read.schema(old.schema).parquet(path)


def _paragraphs(text: str, size: int) -> list[str]:
    out, current = [], ""
    for p in text.split("\n\n"):
        if current and len(current) + len(p) > size:
            out.append(current.strip())
            current = p
        else:
            current = f"{current}\n\n{p}" if current else p
    return [s for s in [*out, current.strip()] if s]


def split_long(docs: DataFrame, id_col: str, text_col: str, rule: str, size: int = 3000) -> DataFrame:
    """id, part from 0 and content: by chapter (before headings of levels 1 to 3), by char_count, or by packed paragraphs."""
    rows = docs.filter(F.length(text_col) > 0)
    text = F.col(text_col)
    if rule == "chapter":
        parts = F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,3}\s)"), lambda s: F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")), lambda s: F.length(s) > 0)
    elif rule == "char_count":
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size)), lambda k: F.substring(text, (k * size + 1).cast("int"), F.lit(size)))
    elif rule == "paragraph":

        def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([_paragraphs(t, size) for t in texts.to_pylist()], pa.list_(pa.string()))

        parts = F.arrow_udf(pack, "array<string>")(text)
    else:
        raise ValueError(f"no rule {rule}")
    return rows.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("part", "content"))


def embed_chains(pages: DataFrame, most: int = 5) -> DataFrame:
    """id, chain and depth of `pages` (id, ref): what each page embeds in turn, until a page that is in the chain already, or `most` deep."""
    step = pages.select(F.col("id").alias("_id"), F.col("ref").alias("_ref"))
    live = pages.select("id", F.col("ref").alias("at"), F.array("id").alias("chain"))
    for _ in range(most - 1):
        joined = live.join(step, F.col("at") == F.col("_id"), "left")
        on = F.col("_id").isNotNull() & ~F.array_contains("chain", F.col("at"))
        live = joined.select("id", F.when(on, F.col("_ref")).alias("at"), F.when(on, F.array_append("chain", F.col("at"))).otherwise(F.col("chain")).alias("chain"))
    return live.select("id", "chain", F.size("chain").alias("depth"))


# Elements that are left out, and names of advert and share boxes.
_SKIPPED = frozenset("script style noscript nav footer header aside form svg".split())
_ADS = frozenset("advertisement advertise ads ad share comments".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    """Text of the first article, else main, else body of a page, without boxes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.parts = 0, [], {"article": [], "main": [], "body": [], "": []}
        self.seen = dict.fromkeys(self.parts, 0)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        values = {k: v or "" for k, v in attrs}
        names = set(values.get("class", "").split())
        gone = tag in _SKIPPED or bool(names & _ADS) or "advert" in values.get("class", "") or "advert" in values.get("id", "")
        self.open.append((tag, gone))
        self.skip += gone
        if tag in self.seen:
            self.seen[tag] += 1

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                name, gone = self.open.pop()
                self.skip -= gone
                if name == tag:
                    break

    def handle_data(self, data):
        if self.skip:
            return
        inside = {t for t, _ in self.open}
        self.parts[""].append(data)
        for name in ("article", "main", "body"):
            if name in inside and self.seen[name] == 1:
                self.parts[name].append(data)


def _page_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    kept = next((parser.parts[n] for n in ("article", "main", "body") if parser.seen[n]), parser.parts[""])
    return re.sub(r"\s+", " ", " ".join(kept)).strip()


def html_text(col) -> Column:
    """The text of a page's first article, main or body, in one line; null pages are empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([_page_text(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(col)
