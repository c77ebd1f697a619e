"""The inverted-file index, the readers' files, vault notes, cleaner stages and the rolling compression stream."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import clean
from marlstone.operators import ann
from marlstone.operators import retrieval as R
from marlstone.plans import registry
from marlstone.sources import formats
from marlstone.streaming import events


def test_index_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = {(r.query, r.id) for r in R.search_many(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).collect()}
    rows = registry.queries()["R5_index_search"](spark, sf_dir).collect()
    assert len({(r.query, r.id) for r in rows} & exact) >= 0.9 * len(exact)
    assert max(r["rank"] for r in rows) == 10 and all(r.query != r.id for r in rows)


def test_index_holds_every_vector_and_finds_all_with_all_cells(spark):
    """Copies that fill a cell are dealt into blocks, queries into strips; zero vectors are held, null ones are not."""
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40 + i, [float(i), 1.0]) for i in range(10)] + [(50, [0.0, 0.0]), (51, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = ann.fit_cells(e, "vec_id", "embedding", cells=3)
    held = ann.index(e, "vec_id", "embedding", model, block=8)
    assert sorted(r.id for r in held.collect()) == list(range(51))
    assert held.groupBy("cell").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] > 1
    got = {(r.query, r.id, r.score) for r in ann.search(e, held, model, "vec_id", "embedding", 5, 99, block=7).collect()}
    want = {(r.query, r.id, r.score) for r in R.search_many(e.filter("embedding IS NOT NULL"), e.filter("embedding IS NOT NULL"), "vec_id", "embedding", 5).collect()}
    assert got == want


def test_index_of_nothing(spark):
    assert ann.fit_cells(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id", "embedding") is None


def test_lines_of_json_are_a_table():
    assert formats.convert("a.json", b'{"a": 1}\n{"b": 2}\n') == "| a | b |\n| --- | --- |\n| 1 |  |\n|  | 2 |"
    with pytest.raises(ValueError):
        formats.convert("a.json", b"{not json}\n{}")


def test_vault_notes(spark):
    notes = [("v/A.md", "---\ntags: x, ,y\n---\n[[b|B]] [[C]] #t1 [[a]]"), ("v/s/b.md", None), ("v/z/B.md", "")]
    got = {r.path: r for r in formats.vault_notes(spark.createDataFrame(notes, "path string, text string")).collect()}
    assert got["v/A.md"].tags == ["x", "y"] and got["v/A.md"].body == "[B](v/s/b) [C](C) 标签:t1 [a](v/A)"
    assert got["v/s/b.md"].body == "" and got["v/s/b.md"].tags == [] and got["v/z/B.md"].title == "v/z/B"


@pytest.mark.parametrize(
    "stage, text, want",
    [
        (clean.drop_footnote_marks, "甲①乙(12)丙〔3〕\n 7 \n末", "甲乙丙\n\n末"),
        (clean.drop_drawn_lines, "+--+--+\n■x─y", "\nxy"),
        (clean.plain_characters, "a　　b​\x07.....", "a b……"),
        (clean.space_scripts, "中文abc12字", "中文 abc 12 字"),
        (clean.join_han, "中 文 字 ，好 「 字", "中文字，好 「字"),
        (clean.han_punctuation, "你,好.\n真的?是!!a。。。。", "你，好。\n真的？是!!a。。"),
        (clean.space_headings, "a\n# T\nb\n\n## U\n\nc", "a\n\n# T\n\nb\n\n## U\n\nc"),
        (clean.label_academic, "摘 要：文\n关键词: a b\nAbstract: We\nKey words x", "## 摘要\n\n文\n**关键词**：a b\n## Abstract\n\nWe\n**Keywords**: x"),
    ],
)
def test_cleaner_stages(spark, stage, text, want):
    frame = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert [r[0] for r in frame.select(stage(F.col("text"))).collect()] == [want, None, ""]


def test_rolling_compression_stream_equals_batch(spark, sf_dir, tmp_path):
    """Two files that arrive one after the other: state is carried between micro-batches."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    for k, part in enumerate((talks.filter("turn < 4"), talks.filter("turn >= 4"))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = events.rolling_compression(spark.readStream.schema(talks.schema).parquet(f"file://{tmp_path}/in"), trigger=4, keep=2, batch=2)
        events.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = sorted((r.conv_id, r.step, r.turns) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = sorted((r.conv_id, r.step, r.turns) for r in registry.queries()["X6_rolling_compression"](spark, sf_dir).collect())
    assert got == want and got


def test_rolling_compression_refuses_too_small_a_trigger(spark):
    with pytest.raises(ValueError):
        events.rolling_compression(None, trigger=5, keep=3, batch=3)
