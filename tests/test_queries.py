"""Every registered query of the library against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from marlstone.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 2").fetchall()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'").fetchall()
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    mine = sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert mine == sorted(str(tuple(map(plain, r))) for r in want)


def squeezed(text):
    return "".join(text.split())


def covered(text, chunks):
    """Whether chunks, in order and with overlaps, hold all of a text but for white space."""
    text, at = squeezed(text), 0
    for c in map(squeezed, chunks):
        start = text.rfind(c, 0, at + len(c))
        if start < 0 or start > at:
            return False
        at = max(at, start + len(c))
    return at == len(text)


CHUNKERS = ["C1_general_chunks", "C2_semantic_chunks", "C7_long_text_windows", "C4_novel_chunks", "C4_law_chunks", "C4_qa_chunks", "C4_book_chunks", "C4_academic_chunks", "C4_chapters", "C8_parent_child_chunks", "F46_split_by_paragraph"]


@pytest.mark.parametrize("name", CHUNKERS)
def test_chunkers_keep_all_text(spark, sf_dir, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    order = "part" if "part" in rows[0].asDict() else "chunk_index"
    by = {}
    for r in sorted(rows, key=lambda r: (r.id, r[order])):
        by.setdefault(r.id, []).append(r.content)
    for i, text in texts.items():
        assert covered(text or "", by.get(i, [])), i
    if name not in ("C4_chapters", "F46_split_by_paragraph"):
        assert max(len(r.content) for r in rows) <= 1000 + 150


def every_token(text):
    import re

    return re.findall(r"[^\s|#`-]+", text or "")


@pytest.mark.parametrize("name", ["C3_news_chunks", "C5_code_chunks", "C6_table_chunks", "C9_layout_chunks"])
def test_structured_chunkers_keep_all_words(spark, sf_dir, name):
    """Tables repeat their head and lines may go that hold a page number alone; no other word is lost."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in QUERIES[name](spark, sf_dir).collect():
        row = r.asDict()
        got.setdefault(row.get("id", row.get("doc_id")), set()).update(every_token(row.get("content", row.get("child"))))
    for i, text in texts.items():
        lost = {w for w in every_token(text) if w not in got.get(i, set())}
        joined = " ".join(got.get(i, set()))
        assert all(w in joined or w.isdigit() for w in lost), (i, lost)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows_again(spark, sf_dir, name):
    """Queries without SQL give rows, the same twice, of a schema that is known before."""
    first, again = (QUERIES[name](spark, sf_dir) for _ in range(2))
    assert first.schema == again.schema
    rows = sorted(map(str, first.collect()))
    assert rows and rows == sorted(map(str, again.collect()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_has_rows(duck, name):
    if name not in ("G4_two_hop_pairs", "U12_insert_new_ids"):  # these find nothing in the smallest tables
        assert duck.execute(SQL[name]).fetchone() is not None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
