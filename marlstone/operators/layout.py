"""Layout of texts: typed blocks by an automaton over lines, and sections of blocks for chunking.

A line has a kind by its own characters. The automaton holds at most one open block: code stays open until its fence, a formula
until its end, tables, quotes and paragraphs as long as their lines go on; every other line is a block of its own. Form feeds
divide pages; on texts of several pages, a first or last line that most pages have, but for its digits, is their header or
footer. No line is lost: blank lines, and headers, footers and page numbers where a caller leaves them out, are all that goes.

Null and blank texts have no blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.chunking import split_long

# What lines of a kind begin with, in the order in which they are asked, with the levels of headings.
HEADINGS = [
    (r"#\s+", "heading_h1", 1), (r"##\s+", "heading_h2", 2), (r"###\s+", "heading_h3", 3), (r"#{4,}\s+", "heading_h4", 4),
    (r"\d+(?:\.\d+)*\s+[、.．]\s*\S", "heading_h2", 2), (r"\d+\.\d+\s+\S", "heading_h3", 3), (r"\d+\.\d+\.\d+\s+\S", "heading_h4", 4),
    (r"第[一二三四五六七八九十百千\d]+[章回编部篇]", "heading_h1", 1), (r"第[一二三四五六七八九十百千\d]+[节条款]", "heading_h2", 2),
    (r"[一二三四五六七八九十]+[、．.]\s", "heading_h2", 2), (r"[（(]\s*[一二三四五六七八九十\d]+\s*[）)]\s", "heading_h3", 3),
]
TITLE_WORDS = "摘要 ABSTRACT 关键词 KEYWORDS 目录 CONTENTS 引言 前言 绪论 结论 结语 参考文献 REFERENCES 致谢 ACKNOWLEDGEMENT 附录 APPENDIX".split()
OTHERS = [("footnote", r"\[\^[^\]]+\]:|\[\d+\]"), ("quote", r">\s"), ("formula", r"\$\$|\\begin\{"), ("code_block", "```")]
TITLE_LENGTH, PAGE_NUMBER = 40, 4
MARGINS = ("header", "footer", "page_number")
ATOMIC = ("table", "image", "code_block", "formula")

_HEADINGS = [(re.compile(p), kind, level) for p, kind, level in HEADINGS]
_OTHERS = [(kind, re.compile(p)) for kind, p in OTHERS]
_IMAGE, _ROW = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\|.+\||\|[\s\-:]+\|")


def line_kind(line: str) -> tuple[str, int]:
    """Kind and level of a stripped line, the first that fits."""
    if not line:
        return "blank", 0
    if line.startswith("|") and _ROW.match(line):
        return "table", 0
    for kind, pattern in _OTHERS:
        if pattern.match(line):
            return kind, 0
    if _IMAGE.search(line):
        return "image", 0
    for pattern, kind, level in _HEADINGS:
        if pattern.match(line):
            return kind, level
    if len(line) < TITLE_LENGTH and line.upper().startswith(tuple(TITLE_WORDS)):
        return "title", 0
    if line.isdecimal() and len(line) <= PAGE_NUMBER:
        return "page_number", 0
    return "paragraph", 0


@dataclass
class Block:
    kind: str
    level: int
    page: int
    lines: list[str] = field(default_factory=list)

    @property
    def content(self) -> str:
        return "\n".join(self.lines)


def _margins(pages: list[list[str]]) -> tuple[set[str], set[str]]:
    """The first and last lines, digits as one sign, of more than half of at least three pages."""
    if len(pages) < 3:
        return set(), set()
    same = lambda s: re.sub(r"\d+", "#", s.strip())
    ends = [[same(s) for s in page if s.strip()] for page in pages]
    often = lambda at: {s for s, n in Counter(e[at] for e in ends if e).items() if 2 * n > len(pages)}
    return often(0), often(-1)


def blocks(text: str | None) -> list[Block]:
    """The blocks of a text, in order."""
    pages = [page.split("\n") for page in (text or "").split("\f")]
    heads, feet = _margins(pages)
    mask = lambda s: re.sub(r"\d+", "#", s)
    out: list[Block] = []
    held: Block | None = None
    for number, lines in enumerate(pages, 1):
        filled = [k for k, s in enumerate(lines) if s.strip()]
        if held and held.kind not in ("code_block", "formula"):
            held = None
        for k, line in enumerate(lines):
            s = line.strip()
            if held and held.kind == "code_block":
                held.lines.append(line)
                held = None if s == "```" else held
                continue
            if held and held.kind == "formula":
                held.lines.append(line)
                held = None if s.endswith("$$") or s.startswith("\\end{") else held
                continue
            kind, level = line_kind(s)
            if kind == "blank":
                held = None
            elif filled and k == filled[0] and mask(s) in heads:
                held = out.append(Block("header", 0, number, [s]))
            elif filled and k == filled[-1] and mask(s) in feet:
                held = out.append(Block("footer", 0, number, [s]))
            elif held and held.kind == kind and kind in ("table", "paragraph", "quote"):
                held.lines.append(s)
            else:
                block = Block(kind, level, number, [line if kind in ("code_block", "formula") else s])
                out.append(block)
                closed = kind == "formula" and len(s) > 2 and s.endswith("$$") or not (kind in ("code_block", "formula", "table", "paragraph", "quote"))
                held = None if closed else block
    return out


@dataclass
class Section:
    kind: str
    heading: str
    level: int
    page: int
    content: str


def sections(text: str | None, most: int = 2400) -> list[Section]:
    """Blocks under one heading joined up to `most` characters; tables and images stand alone; margins are left out."""
    out: list[Section] = []
    heading, level, page, held = "", 0, 0, []

    def close() -> None:
        if held:
            out.append(Section("text", heading, level, page, "\n\n".join(held)))
            held.clear()

    for b in blocks(text):
        if b.kind in MARGINS:
            continue
        if b.kind in ("table", "image"):
            close()
            out.append(Section(b.kind, heading, level, b.page, b.content))
            continue
        if b.level or b.kind == "title":
            close()
            heading, level = b.content, b.level
        elif held and sum(map(len, held)) + 2 * len(held) + len(b.content) > most:
            close()
        if not held:
            page = b.page
        held.append(b.content)
    close()
    return out


_SPLIT_OVER = 1100


def chunks(text: str | None, size: int = 1000, most: int = 2400, overlap: int = 100) -> list[tuple[str, str, int, str]]:
    """(kind, heading, page, content): sections, of which the texts over a tenth more than `size` are cut at sentences; tables and images are whole."""
    out = []
    for s in sections(text, most):
        parts = split_long(s.content, size, overlap) if s.kind == "text" and len(s.content) > size * _SPLIT_OVER // 1000 else [s.content]
        out += [(s.kind, s.heading, s.page, p) for p in parts]
    return out


_BLOCK = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("page", pa.int32()), ("content", pa.string())]))
_CHUNK = pa.list_(pa.struct([("type", pa.string()), ("heading", pa.string()), ("page", pa.int32()), ("content", pa.string())]))


def layout_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block (from 0), type, level, page and content of the blocks of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"type": b.kind, "level": b.level, "page": b.page, "content": b.content} for b in blocks(t)] for t in texts.to_pylist()], _BLOCK)

    found = F.arrow_udf(run, "array<struct<type:string,level:int,page:int,content:string>>")(text_col)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("block", "b")).select("id", "block", "b.*")


def layout_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, most: int = 2400, overlap: int = 100) -> DataFrame:
    """id, chunk_index (from 0), type, heading, page and content of the chunks of each text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk size")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("type", "heading", "page", "content")
        for texts in batches:
            yield pa.array([[dict(zip(names, c)) for c in chunks(t, size, most, overlap)] for t in texts.to_pylist()], _CHUNK)

    found = F.arrow_udf(run, "array<struct<type:string,heading:string,page:int,content:string>>")(text_col)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("chunk_index", "c")).select("id", "chunk_index", "c.*")
