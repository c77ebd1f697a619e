"""Cleaning of Markdown and other document text, query rewriting, redaction and small parsers, as column functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import diff


def clean_markdown(text: Column) -> Column:
    """Marks, no-break spaces, line ends, trailing blanks and runs of blank lines put in order; images become their names."""
    steps = [("^﻿", ""), (" ", " "), ("\r\n?", "\n"), (r"!\[([^\]]*)\]\([^)]*\)", "[$1]"), (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def drop_page_numbers(text: Column) -> Column:
    """Without lines that are a page number alone."""
    kept = F.filter(F.split(text, "\n", -1), lambda s: ~F.trim(s).rlike(r"^(?:[-–—]\s*)?(?:[Pp]age\s+|第\s*)?[0-9]{1,4}(?:\s*/\s*[0-9]{1,4})?(?:\s*页)?(?:\s*[-–—])?$"))
    return F.array_join(kept, "\n")


def clean_outside_code(text: Column) -> Column:
    """Blanks squeezed, but not in fenced code and table lines: every second part between fences is code."""
    parts = F.split(text, "```", -1)
    squeeze = lambda s: F.array_join(F.transform(F.split(s, "\n", -1), lambda x: F.when(F.trim(x).startswith("|"), x).otherwise(F.regexp_replace(x, r"[ \t]{2,}", " "))), "\n")
    return F.array_join(F.transform(parts, lambda s, k: F.when(k % 2 == 1, s).otherwise(squeeze(s))), "```")


def drop_adjacent_repeats(text: Column) -> Column:
    """Without lines that equal the line before them."""
    lines = F.split(text, "\n", -1)
    bound = lambda ls: F.filter(ls, lambda s, k: (k == 0) | (s != F.get(ls, k - 1)))
    return F.array_join(F.transform(F.array(lines), bound)[0], "\n")


def drop_footnote_marks(text: Column) -> Column:
    """Without circled and dotted numbers, bracketed note numbers, and lines of a number alone."""
    for pattern in ("[①-⑮⒈-⒑]", r"〔[0-9]+〕|［[0-9]+］|\([0-9]{1,3}\)", r"(?m)^[ \t]*[0-9]{1,3}[ \t]*$"):
        text = F.regexp_replace(text, pattern, "")
    return text


def drop_drawn_lines(text: Column) -> Column:
    """Without block and box drawings, and without lines that rule a table drawn in characters."""
    text = F.regexp_replace(text, r"(?m)^[ \t]*\+[-+]+\+[ \t]*$", "")
    return F.regexp_replace(text, "[\u2500-\u25ff]+", "")


def plain_characters(text: Column) -> Column:
    """Wide and repeated blanks become one, characters of no width and controls go, and four or more dots become an ellipsis."""
    for pattern, to in (("[ \u3000]+", " "), ("[\ufeff\u200b\u200c\u200d]", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"\.{4,}|·{3,}", "……")):
        text = F.regexp_replace(text, pattern, to)
    return text


def space_scripts(text: Column) -> Column:
    """A blank between Han characters, Latin letters and digits that touch."""
    for before, after in (("一-鿿", "A-Za-z0-9"), ("A-Za-z0-9", "一-鿿"), ("A-Za-z", "0-9"), ("0-9", "A-Za-z")):
        text = F.regexp_replace(text, f"(?<=[{before}])(?=[{after}])", " ")
    return text


def join_han(text: Column) -> Column:
    """Without blanks inside Han text and at its punctuation."""
    text = F.regexp_replace(text, "(?<=[一-鿿])[ \t]+(?=[一-鿿，。！？；：、）】」』])", "")
    return F.regexp_replace(text, "(?<=[（【「『])[ \t]+(?=[一-鿿])", "")


def han_punctuation(text: Column) -> Column:
    """Half-width punctuation after a Han character becomes full-width, and runs of closing marks become two."""
    text = F.regexp_replace(text, r"([。！？])\1{2,}", "$1$1")
    for mark, wide in ((",", "，"), (";", "；"), (":", "："), (r"\(", "（"), (r"\)", "）")):
        text = F.regexp_replace(text, f"(?<=[一-鿿]){mark}(?=[一-鿿])", wide)
    for mark, wide in ((r"\.", "。"), ("!", "！"), (r"\?", "？")):
        text = F.regexp_replace(text, f"(?<=[一-鿿]){mark}(?=[一-鿿\\s]|\\z)", wide)
    return text


def space_headings(text: Column) -> Column:
    """A blank line before and after each Markdown heading."""
    text = F.regexp_replace(text, r"(?m)(?<=\S)[ \t]*\n(?=[ \t]*#{1,6}[ \t])", "\n\n")
    return F.regexp_replace(text, r"(?m)^([ \t]*#{1,6}[ \t][^\n]*)\n(?=[ \t]*\S)", "$1\n\n")


def label_academic(text: Column) -> Column:
    """Abstracts become sections and keyword lines bold labels, in Chinese and English."""
    for pattern, to in (
        (r"(?m)^[ \t]*摘\s*要[ \t：:]*(\S.*)$", "## 摘要\n\n$1"), (r"(?m)^[ \t]*(?:关键词|关键字)[ \t：:]*(\S.*)$", "**关键词**：$1"),
        (r"(?m)^[ \t]*Abstract[ \t：:]*([A-Za-z].*)$", "## Abstract\n\n$1"), (r"(?m)^[ \t]*Key[ \t]*words[ \t：:]*([A-Za-z].*)$", "**Keywords**: $1"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def heading_level(line: Column) -> Column:
    """1 to 6 of a heading line by its marks or numbering; 0 of another line."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    numbers = F.size(F.split(F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)[.\s]\s*\S", 1), r"\.", -1))
    return F.when(marks > 0, marks).when(line.rlike(r"^[0-9]+(?:\.[0-9]+)*[.\s]\s*\S"), F.least(numbers, F.lit(6))).when(line.rlike("^第[一二三四五六七八九十百千0-9]+[章节]"), 1).otherwise(0)


def line_kind(line: Column) -> Column:
    """What a line of a page is, by the first pattern that fits."""
    s = F.trim(line)
    return (
        F.when(F.length(s) == 0, "blank").when(heading_level(s) > 0, "heading").when(s.rlike(r"^[-*+•]\s+|^[0-9]+[)）]"), "list_item").when(s.rlike(r"^\|.*\|$"), "table_row")
        .when(s.rlike("^```"), "code_fence").when(s.rlike("^>"), "quote").when(s.rlike(r"^(?:Figure|Table|图|表)\s*[0-9]+"), "caption").when(s.rlike(r"^\[[0-9]+\]"), "reference").otherwise("paragraph")
    )


def rewrite_query(text: Column, synonyms: dict[str, str], fillers: str = r"^(?:please|could you|can you|tell me)\s+") -> Column:
    """Lower-cased, without filler at the start and marks at the end, with synonyms put in, and a question mark."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), fillers, ""), r"[?？!！.。\s]+$", "")
    for word, to in synonyms.items():
        text = F.replace(text, F.lit(word), F.lit(to))
    return F.concat(text, F.lit("?"))


def redact_map(props: Column) -> Column:
    """Values of a map of strings: text-like keys become length and digest, secret-like keys a mark; bearer tokens are masked, long values cut."""
    def value(k: Column, v: Column) -> Column:
        key = F.lower(k)
        digest = F.concat(F.lit("len="), F.length(v).cast("string"), F.lit(" sha256="), F.substring(F.sha2(v, 256), 1, 16))
        return F.when(key.rlike("token|secret|password|api_?key|authorization"), F.lit("[REDACTED]")).when(key.rlike("text|content|query|prompt|answer"), digest).otherwise(F.substring(F.regexp_replace(v, r"(?i)bearer\s+\S+", "Bearer [REDACTED]"), 1, 2000))

    return F.transform_values(props, value)


def cron_due(cron: Column, at: Column) -> Column:
    """Whether a five-field cron line's minute and hour hold at a time; `*`, `*/n`, `a-b` and lists; the day fields are not asked."""
    def field(spec: Column, now: Column) -> Column:
        def one(part: Column) -> Column:
            step = F.regexp_extract(part, r"^\*/([0-9]+)$", 1).try_cast("int")
            low, high = (F.regexp_extract(part, r"^([0-9]+)-([0-9]+)$", k).try_cast("int") for k in (1, 2))
            return (part == "*") | F.coalesce(now % F.nullif(step, F.lit(0)) == 0, F.lit(False)) | F.coalesce(now.between(low, high), F.lit(False)) | F.coalesce(part.try_cast("int") == now, F.lit(False))

        return F.exists(F.split(spec, ",", -1), one)

    fields = F.split(F.trim(cron), r"\s+", -1)
    return field(F.get(fields, F.lit(0)), F.minute(at)) & field(F.get(fields, F.lit(1)), F.hour(at))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A unit vector that depends on the text alone: normal numbers from its digest."""
    import numpy as np

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                v = np.random.RandomState(int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:4], "big")).normal(size=size)
                out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
            yield pa.array(out, pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)


def line_diff(old: Column, new: Column) -> Column:
    """Of two texts: lines added and removed, the share of lines that stay, rounded to 4 places, and the changes (tag and line numbers from 1)."""
    change = pa.struct([("tag", pa.string()), *((c, pa.int64()) for c in ("old_start", "old_end", "new_start", "new_end"))])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b in batches:
            rows = []
            for x, y in zip(a.to_pylist(), b.to_pylist()):
                p, q = (x or "").split("\n"), (y or "").split("\n")
                found = diff.changes(p, q)
                added, removed = sum(j2 - j1 for *_, j1, j2 in found), sum(i2 - i1 for _, i1, i2, _, _ in found)
                told = [{"tag": tag, "old_start": i1 + 1, "old_end": i2, "new_start": j1 + 1, "new_end": j2} for tag, i1, i2, j1, j2 in found]
                rows.append({"added": added, "removed": removed, "ratio": round((len(p) - removed + len(q) - added) / (len(p) + len(q)), 4), "changes": told})
            yield pa.array(rows, pa.struct([("added", pa.int64()), ("removed", pa.int64()), ("ratio", pa.float64()), ("changes", pa.list_(change))]))

    return F.arrow_udf(run, "struct<added:bigint,removed:bigint,ratio:double,changes:array<struct<tag:string,old_start:bigint,old_end:bigint,new_start:bigint,new_end:bigint>>>")(old, new)


_MOJIBAKE = re.compile("[ÃÂâ][\x80-\xbf€™œ“”–—]")


def repair_mojibake(text: Column) -> Column:
    """UTF-8 once read as cp1252 or Latin-1 read right again, where that leaves fewer signs of it."""

    def fixed(t: str | None) -> str | None:
        if not t or not _MOJIBAKE.search(t):
            return t
        for charset in ("cp1252", "latin-1"):
            try:
                better = t.encode(charset).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if len(_MOJIBAKE.findall(better)) < len(_MOJIBAKE.findall(t)):
                return better
        return t

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fixed(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)
