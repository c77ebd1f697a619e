"""Column functions over texts: tokenizers, quality, snippets, addresses. All but the quality score stay on the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"


def matches(text: Column, pattern: str) -> Column:
    """All whole matches of a pattern, as an array; null texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def cjk_grams(text: Column) -> Column:
    """All 1-, 2- and 3-grams inside runs of CJK characters."""
    grams = lambda run, n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(matches(text, f"[{CJK}]+"), lambda run: F.concat(*[grams(run, n) for n in (1, 2, 3)])))


def search_tokens(text: Column) -> Column:
    """Keyword-search tokens with repetition: CJK grams, ASCII words of the lower-cased text, and numbers."""
    return F.concat(cjk_grams(text), matches(F.lower(text), "[a-z][a-z0-9]*"), matches(text, r"[0-9]+(?:\.[0-9]+)?"))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, numerals and underscores, CJK runs apart, with repetition."""
    return matches(F.lower(text), rf"[{CJK}]+|[\p{{L}}\p{{N}}_&&[^{CJK}]]+")


def agent_terms(text: Column) -> Column:
    """Distinct terms of two characters or more, in the order they are first seen."""
    return F.array_distinct(matches(F.lower(text), f"[{CJK}]{{2,}}|[a-z0-9][a-z0-9_-]+"))


def bigrams(tokens: Column) -> Column:
    """Distinct character bigrams of an array of words."""
    of = lambda w: F.when(F.length(w) >= 2, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(tokens, of)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets have similarity 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


_BLANK = " \t\n\x0b\f\r"
_CJK_CHAR, _DIGIT = re.compile(f"[{CJK}]"), re.compile("[0-9]")
_SPECIAL = re.compile(rf"[^\w{_BLANK}{CJK}　-〿＀-￯.,;:!?“”‘’（）—…·-]")
_TEN_LETTERS, _LONG_WORD = re.compile("(?:[^a-zA-Z]*[a-zA-Z]){10}"), re.compile("[a-zA-Z]{20}")
_ODD_RUN = re.compile(rf"[^{CJK}\w{_BLANK}.,;:!?，。；：！？、\"'（）【】《》—…·/\\|@#$%^&*+=\[\]{{}}~`-]{{5}}")
_SENTENCE_END, _BLANKS = re.compile("[。！？\n]"), re.compile(f"[{_BLANK}]+")


def _quality(text: str | None) -> float:
    if text is None or not text.strip(" "):
        return 0.0
    total = max(1, len(text) - text.count(" ") - text.count("\n"))
    count = lambda pattern: len(pattern.findall(text))
    garbage = any(c * 5 in text for c in set(text)) or _LONG_WORD.search(text) or _ODD_RUN.search(text)
    lines = text.split("\n")
    short = sum(0 < len(s.strip(" ")) < 3 for s in lines)
    sentences = [x for x in (s.strip(" ") for s in _SENTENCE_END.split(text)) if x]
    paragraphs = [p for p in (_BLANKS.sub("", p) for p in text.split("\n\n")) if p]
    defects = [
        (not _TEN_LETTERS.match(text) and count(_CJK_CHAR) / total < 0.1, 0.3),
        (count(_DIGIT) / total > 0.6, 0.3),
        (count(_SPECIAL) / total > 0.3, 0.2),
        (bool(sentences) and sum(map(len, sentences)) / len(sentences) < 5, 0.2),
        (len(paragraphs) >= 2 and len(set(paragraphs)) < len(paragraphs), 0.2),
        (len(lines) > 5 and short / len(lines) > 0.5, 0.15),
        (bool(garbage), 0.3),
    ]
    return max(0.0, round(1.0 - sum(cost for defect, cost in defects if defect), 3))


def quality_score(text: Column) -> Column:
    """0 to 1: 1 less a penalty for each of seven defects; null and blank texts have 0. Valid from 0.4 on.

    A text is looked at by ten patterns and three splits, which take Spark's functions an array of each match; so this one
    function runs in Python, over Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_quality(t) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(text)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slashes of the path, no fragment; the query stays."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1))
    rest = F.regexp_replace(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    return F.concat(head, path, F.regexp_extract(rest, "(\\?.*)$", 1))


def snippet(text: Column, term: Column, lead: int = 50, tail: int = 100, fallback: int = 200) -> Column:
    """From `lead` characters before the first hit to `tail` beyond it; the start of the text without a hit."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - lead, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(term) + tail)).otherwise(F.substring(text, F.lit(1), F.lit(fallback)))


def highlight(text: Column, tokens: list[str], tag: str = "mark") -> Column:
    """Each token, whatever its case, in tags and lower-cased, one token after the other."""
    for t in tokens:
        quoted = "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in t)
        text = F.regexp_replace(text, f"(?i){quoted}", f"<{tag}>{t.lower()}</{tag}>")
    return text


def trim_sentence(text: Column, most: int, least: int = 0) -> Column:
    """At most `most` characters, cut behind the last sentence mark if that keeps 62 % or `least`; else an ellipsis ends it."""
    head = F.substring(text, 1, most)
    cut = F.length(F.regexp_extract(head, "(?s)^(.*[。！？.!?])", 1))
    kept = F.when(cut >= max(least, int(0.62 * most)), F.substring(head, F.lit(1), cut)).otherwise(F.concat(head, F.lit("……")))
    return F.when(F.length(text) <= most, text).otherwise(kept)


def detect_strategy(text: Column) -> Column:
    """The chunking strategy a text calls for, by the first rule that holds."""
    sample = F.substring(text, 1, 5000)
    lines = F.slice(F.split(text, "\n", -1), 1, 200)
    hits = lambda pattern: F.size(F.filter(lines, lambda s: F.trim(s).rlike(pattern)))
    numeric = hits("^[0-9]+(\\.[0-9]+)*[.\\s]\\s*\\S")
    return (
        F.when(count_of(sample, "第[一二三四五六七八九十百千0-9]+[条章节款]") >= 3, "law")
        .when(count_of(sample, "(?m)^\\s*(?:Q\\s*[:：]|问题?\\s*[:：])") >= 3, "qa")
        .when(hits("^第[一二三四五六七八九十百千0-9]+[章回]|^(?i)chapter\\s+[0-9]+") >= 2, "book")
        .when((hits("^#{1,6}\\s") + numeric >= 4) & (numeric >= 3), "academic")
        .when((count_of(sample, "[“「][^”」]+[”」]") >= 5) & (F.length(sample) / F.greatest(F.size(F.split(sample, "\\n\\s*\\n", -1)), F.lit(1)) < 200), "novel")
        .otherwise("semantic")
    )


def classify_intent(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule with a keyword in the text without white space and punctuation; else `generic`."""
    plain = F.regexp_replace(F.lower(text), "[\\s！？!，。,.、?：:]+", "")
    out = None
    for name, keys in rules:
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(plain, F.lit(k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic") if out is not None else F.lit("generic")
