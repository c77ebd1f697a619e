"""Stages that put extracted text in order."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import stages as S

CASES = [
    (S.drop_font_codes, "a (cid:12)(cid:3) § b 5 m²", "a b 5 m²"), (S.drop_font_codes, "no codes § here", "no codes § here"),
    (S.drop_noise_lines, "words\n~~^^##==\n| --- | :-: |\n---\n\nfine!", "words\n| --- | :-: |\n---\n\nfine!"),
    (S.drop_margin_lines, "text\n12\n- 4 -\n第 3 页 共 9 页\nPage 2 of 7\n第3卷第4期\nDOI: 10.1/x\n\n12 apples\n```\n12\n```", "text\n\n12 apples\n```\n12\n```"),
    (S.number_headings, "1.2 Title\n3 Apples fell\n1. item\n一、总则\n2.1.3.4.5.6.7 deep\n```\n1.2 code\n```\n1.5", "### 1.2 Title\n## 3 Apples fell\n1. item\n## 一、总则\n###### 2.1.3.4.5.6.7 deep\n```\n1.2 code\n```\n1.5"),
    (S.level_headings, "### a\n##### b\n### c\ntext\n```\n# code\n```", "## a\n### b\n## c\ntext\n```\n# code\n```"), (S.level_headings, "## a\n#### b", "# a\n## b"), (S.level_headings, "none", "none"),
    (S.break_before_numbers, "完。第二章 始。3、项目", "完。\n\n第二章 始。\n\n3、项目"), (S.keyword_lists, "关键词: a, b；c  d\nother: a, b", "关键词：a；b；c；d\nother: a, b"),
    (S.metric_units, "建筑面积 120.5 m，高度 3 m。容积 7 m", "建筑面积 120.5 m²，高度 3 m。容积 7 m³"), (S.metric_units, "占地宽度 5 m", "占地宽度 5 m"), (S.even_blanks, "a \t b  \r\n\r\n\r\n\r\nc", "a b\n\nc"),
]


@pytest.fixture(scope="module")
def results(spark):
    row = spark.range(1).select(*[fn(F.lit(text)).alias(f"c{k}") for k, (fn, text, _) in enumerate(CASES)], *[fn(F.lit(None).cast("string")).alias(f"n{k}") for k, fn in enumerate(S.LAYOUT_STAGES)]).first()
    return row.asDict()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_stage(results, k):
    assert results[f"c{k}"] == CASES[k][2]


def test_nulls_stay(results):
    assert all(v is None for c, v in results.items() if c.startswith("n"))
