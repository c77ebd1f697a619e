"""Layout: blocks keep every line, atomic blocks are whole, margins are found by repetition; chunk boundaries against a search over all places."""

import random
import re

import pytest

from marlstone.operators import chunking as C
from marlstone.operators import layout as Y

LINES = ["plain words here", "more text, of a sentence.", "# One", "## Two", "#### Four", "1.2 Numbered", "第三章 名", "（一） 项", "| a | b |", "|---|---|", "```py", "```", "x = 1", "$$", "$$ y $$", "\\\\begin{eq}", "\\\\end{eq}", "> quoted", "[^1]: note", "![i](u.png)", "", "  ", "17", "12345", "Abstract", "  indented"]


def test_every_line_stays_in_order():
    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice(LINES) + r.choice(["\n", "\n", "\n", "\f"]) for _ in range(r.randint(0, 25)))
        got = [s.strip() for b in Y.blocks(text) for s in b.lines if s.strip()]
        assert got == [s.strip() for s in re.split("[\n\f]", text) if s.strip()]


def test_kinds():
    text = "Abstract\nwords\nand more\n# H\n| a |\n|---|\n| 1 |\nafter\n```py\n# no heading\n\nx\n```\n$$\na\n\nb $$\n> q\n> r\n![x](y)\n[1] note\n7"
    assert [(b.kind, b.content) for b in Y.blocks(text)] == [
        ("title", "Abstract"), ("paragraph", "words\nand more"), ("heading_h1", "# H"), ("table", "| a |\n|---|\n| 1 |"), ("paragraph", "after"), ("code_block", "```py\n# no heading\n\nx\n```"),
        ("formula", "$$\na\n\nb $$"), ("quote", "> q\n> r"), ("image", "![x](y)"), ("footnote", "[1] note"), ("page_number", "7"),
    ]
    assert Y.blocks(None) == Y.blocks("") == Y.blocks(" \n\f") == []
    assert [(b.kind, b.content) for b in Y.blocks("```\nopen")] == [("code_block", "```\nopen")]


def test_margins_repeat_over_pages():
    pages = [f"Report {k}\nbody {'abcd'[k]}\nmore\nPage {k} of 4" for k in range(4)]
    got = Y.blocks("\f".join(pages))
    assert [b.content for b in got if b.kind == "header"] == [f"Report {k}" for k in range(4)] and [b.content for b in got if b.kind == "footer"] == [f"Page {k} of 4" for k in range(4)]
    assert [(b.page, b.content) for b in got if b.kind == "paragraph"] == [(k + 1, f"body {'abcd'[k]}\nmore") for k in range(4)]
    assert all(b.kind == "paragraph" for b in Y.blocks("\f".join(pages[:2])))


def test_atomic_blocks_are_whole():
    table = "\n".join(f"| row {k} | {'x' * 60} |" for k in range(100))
    text = f"# Head\nintro\n{table}\n" + "A sentence of some words. " * 200
    got = Y.chunks(text)
    assert [(c[0], c[3]) for c in got if c[0] == "table"] == [("table", table)] and all(c[1] == "# Head" for c in got)
    assert max(len(c[3]) for c in got if c[0] == "text") <= 1200 and sum(c[3].count("sentence") for c in got) >= 200


def test_tables_of_layout(spark):
    docs = spark.createDataFrame([(1, "# A\nb\n| c |"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.block, r.type) for r in Y.layout_blocks(docs, "id", "text").orderBy("id", "block").collect()] == [(1, 0, "heading_h1"), (1, 1, "paragraph"), (1, 2, "table")]
    assert [(r.chunk_index, r.type, r.heading, r.content) for r in Y.layout_chunks(docs, "id", "text").orderBy("chunk_index").collect()] == [(0, "text", "# A", "# A\n\nb"), (1, "table", "# A", "| c |")]
    with pytest.raises(ValueError):
        Y.layout_chunks(docs, "id", "text", 10, 20, 10)


SENTENCE, CLAUSE = "。！？；.!?;…", "，、,：:"


def places(text, low, high, marks):
    return [k + 1 for k in range(low, high) if text[k] in marks]


def test_boundaries_are_the_best_of_all_places():
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice("abcdefgh" * 9 + ".,\n。，") for _ in range(r.randint(0, 500)))
        at = r.randint(0, 520)
        want = min(at, len(text))
        for marks in (SENTENCE, CLAUSE, "\n"):
            before, after = places(text, max(0, want - 180), want, marks), places(text, want, min(len(text), want + 120), marks)
            if before or after:
                want = before[-1] if before else after[0]
                break
        assert C.boundary_near(text, at) == want
        start, end, overlap = 0, len(text), r.randint(0, 120)
        low = max(start, end - overlap)
        good = next((k for marks in (SENTENCE, CLAUSE) for k in places(text, low, end, marks) if k < end and len(text[k:end].strip()) >= min(20, max(1, overlap // 5))), low)
        assert C.overlap_start(text, start, end, overlap) == (good if overlap else end)
