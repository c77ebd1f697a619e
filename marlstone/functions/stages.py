"""Further stages that put extracted text in order, line by line, as column functions; `clean.py` has the character stages.

Fenced code, table lines and headings are told apart where a stage would harm them. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAN, _NUMBER = "一-鿿", "一二三四五六七八九十"
# Symbols that broken fonts leave, lines that journals print beside their articles, words before areas, volumes and lengths.
FONT_SYMBOLS = "¢ß¶•˙˜‹›¤¥¦§¨©ª«¬®¯°±´µ·¸¹º»¼½¾¿"
ISSUE = rf"(?:第\s*[{_NUMBER}百千\d]+\s*卷\s*)?第\s*[{_NUMBER}百千\d]+\s*(?:卷|期)"
MARGIN_LINES = [
    rf"#{{0,6}}\s*第\s*[\d{_NUMBER}]+\s*页(?:\s*[/／]?\s*共?\s*[\d{_NUMBER}]+\s*页)?", r"[·—-]?\s*\d{1,3}\s*[·—-]?", r"[Pp](?:age)?\s*\d+(?:\s*of\s*\d+)?", rf"[{_HAN}\d\s]{{0,10}}{ISSUE}[{_HAN}\d\s]{{0,20}}",
    r"Vol\s*\.?\s*\d+\s*,?\s*No\s*\.?\s*\d+", rf"\d{{4}}\s*年(?:\s*[\d{_NUMBER}]+\s*月)?", r"(?:作者简介|收稿日期|基金项目|中图分类号|文献标识码|文章编号|DOI|doi).*", r"\*{1,3}",
]
AREA, VOLUME, LENGTH = "面积 占地 场地", "体积 容积 库容", "宽度 距离 高度 直径 半径 长度 厚度 深度 净宽 短边"


def _lines(text: Column, fn) -> Column:
    """fn of each line outside of fenced code, null to leave a line out."""
    # The number of fences so far goes along with the lines: code is where it is odd, and the fences themselves.
    lines = F.split(text, "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("fences"))

    def step(s: Column, line: Column) -> Column:
        fence = F.ltrim(line).startswith("```")
        kept = F.when(fence | (s["fences"] % 2 == 1), line).otherwise(fn(line))
        out = F.when(kept.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(kept)))
        return F.struct(out.alias("out"), (s["fences"] + fence.cast("int")).alias("fences"))

    return F.when(text.isNotNull(), F.array_join(F.aggregate(lines, start, step)["out"], "\n"))


def drop_font_codes(text: Column) -> Column:
    """Without the codes of fonts that have no characters, `(cid:12)`, and the stray symbols that stand by them; squares and cubes of metres stay."""
    bare = F.regexp_replace(text, r"\(cid:\d+\)", "")
    return F.when(F.contains(text, F.lit("(cid:")), F.regexp_replace(bare, f"\\s*[{FONT_SYMBOLS}]+\\s*", " ")).otherwise(text)


def drop_noise_lines(text: Column) -> Column:
    """Without short lines most of whose characters are no letters, digits, marks or blanks; table rules stay."""

    def stay(line: Column) -> Column:
        s = F.trim(line)
        odd = F.length(F.regexp_replace(s, rf"[{_HAN}\p{{L}}\p{{N}}，。！？；：、“”‘’（）【】《》.,;:!?()\s]", ""))
        noise = (F.length(s) > 0) & (F.length(s) < 30) & (odd > 0.6 * F.length(s)) & ~s.rlike(r"^\|[\s:|-]+\|$") & ~s.rlike("^(?:-{3,}|[*]{3,}|_{3,})$")
        return F.when(~noise, line)

    return _lines(text, stay)


def drop_margin_lines(text: Column) -> Column:
    """Without page numbers, and the lines that journals print beside their articles."""
    pattern = "^\\s*(?:" + "|".join(MARGIN_LINES) + ")\\s*$"
    return _lines(text, lambda line: F.when((F.trim(line) == "") | ~line.rlike(pattern), line))


def number_headings(text: Column) -> Column:
    """Numbered titles (`1.2 Title`, `一、标题`) become headings as deep as their number, from the second level on."""

    def heading(line: Column) -> Column:
        s = F.trim(line)
        number, title = F.regexp_extract(s, r"^(\d+(?:\.\d+)+|\d+(?=\s+[^\d\s.、]))[.、．]?\s+(\S.*)$", 1), F.regexp_extract(s, r"^\d+(?:\.\d+)*[.、．]?\s+(\S.*)$", 1)
        level = F.least(F.lit(6), F.size(F.split(number, r"\.", -1)) + 1)
        han = F.regexp_extract(s, rf"^([{_NUMBER}]+)[、.．\s]+[{_HAN}]", 1)
        return (
            F.when((number != "") & (F.length(title) <= 60), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(" "), title))
            .when((han != "") & (F.length(s) <= 44), F.concat(F.lit("## "), han, F.lit("、"), F.regexp_extract(s, rf"^[{_NUMBER}]+[、.．\s]+(.*)$", 1))).otherwise(line)
        )

    return _lines(text, heading)


def level_headings(text: Column) -> Column:
    """Heading levels without gaps: the levels that a text has become 1, 2, 3, ... in their order."""
    marks = lambda line: F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    levels = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), marks), lambda n: n > 0)))
    # Bound to a name, so that the levels are made once for all lines.
    leveled = lambda known: _lines(text, lambda line: F.when(marks(line) > 0, F.concat(F.repeat(F.lit("#"), F.array_position(known, marks(line)).cast("int")), F.regexp_replace(line, "^#+", ""))).otherwise(line))
    return F.transform(F.array(levels), leveled)[0]


def break_before_numbers(text: Column) -> Column:
    """A blank line between the end of a sentence and the chapter or number that follows it on one line."""
    return _lines(text, lambda s: F.when(s.rlike(r"^\s*[#|]"), s).otherwise(F.regexp_replace(s, rf"(?<=[。！？；])\s*(?=第[{_NUMBER}\d]+[章节编]|\d+[、.．]\s*[{_HAN}])", "\n\n")))


def metric_units(text: Column) -> Column:
    """Metres behind a word for an area become square metres, behind one for a volume cubic metres, if no word for a length stands between."""
    for words, unit in ((AREA, "m²"), (VOLUME, "m³")):
        between = rf"(?:(?!{'|'.join(LENGTH.split())})[^。；？！\n])*?"
        text = F.regexp_replace(text, rf"((?:{'|'.join(words.split())}){between}\d+(?:\.\d+)?)\s+m(?![a-zA-Z\d²³])", f"$1 {unit}")
    return text


def keyword_lists(text: Column) -> Column:
    """Keywords of a keyword line parted by full-width semicolons."""

    def parted(line: Column) -> Column:
        rest = F.trim(F.regexp_extract(line, r"^\s*(?:关键词|关键字)\s*[：:\s]\s*(.*)$", 1))
        return F.when(rest != "", F.concat(F.regexp_extract(line, "(关键词|关键字)", 1), F.lit("："), F.regexp_replace(rest, r"[\s,，;；]+", "；"))).otherwise(line)

    return _lines(text, parted)


def even_blanks(text: Column) -> Column:
    """One kind of line end, single blanks, none at line ends, and no more than one blank line."""
    for pattern, to in (("\r\n?", "\n"), ("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return text


#: Stages of documents from page layouts, in order.
LAYOUT_STAGES = [drop_font_codes, drop_noise_lines, drop_margin_lines, break_before_numbers, number_headings, level_headings, keyword_lists, metric_units]


def clean_layout(text: Column) -> Column:
    """All stages of documents from page layouts."""
    for stage in LAYOUT_STAGES:
        text = stage(text)
    return text
