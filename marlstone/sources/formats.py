"""Readers and writers of document formats. Each reader takes a path or glob that Spark opens, or a column of texts."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by reader.
TEXT = ("txt", "md", "markdown", "log")
READERS: dict[str, Callable[[bytes], str]] = {}


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, UTF-16 by its mark, then GB 18030, then Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for charset in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def markdown_table(rows: list[list[str]], most: int | None = None) -> str:
    """Rows as a Markdown table, the first the header: short rows are padded, pipes escaped; rows beyond `most`, if given, are left out."""
    rows = [[str(c).replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1 : None if most is None else most + 1])])


def csv_markdown(data: bytes) -> str:
    import csv

    return markdown_table(list(csv.reader(io.StringIO(decode(data)))))


def json_markdown(data: bytes) -> str:
    """A list of objects, or an object a line, is a table over all their keys, an object a section for each key, anything else its JSON."""
    import json

    text = decode(data)
    try:
        value = json.loads(text)
    except ValueError:
        value = [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        keys = list(dict.fromkeys(k for x in value for k in x))
        return markdown_table([keys, *[[x.get(k, "") for k in keys] for x in value]])
    if isinstance(value, dict):
        return "\n\n".join(f"## {k}\n\n{v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, indent=2)}" for k, v in value.items())
    return json.dumps(value, ensure_ascii=False, indent=2)


def xml_markdown(data: bytes) -> str:
    out = []

    def walk(e: ElementTree.Element, depth: int) -> None:
        name, text = e.tag.rpartition("}")[2], (e.text or "").strip()
        out.append(f"# {name}" if not depth else f"{'  ' * (depth - 1)}- **{name}**" + (f": {text}" if text else ""))
        for child in e:
            walk(child, depth + 1)

    walk(ElementTree.fromstring(data), 0)
    return "\n".join(out)


def svg_text(data: bytes) -> str:
    found = (" ".join("".join(e.itertext()).split()) for e in ElementTree.fromstring(data).iter() if e.tag.rpartition("}")[2] in ("title", "desc", "text"))
    return "\n".join(t for t in found if t)


_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{},&*!|>%@`-][^:#]*?|[^:\s]+?)\s*:(?=\s|$)""")
_FLOW = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s\[\]{},]|$)|(?:[^\s,:\[\]{}]|:(?![\s,\[\]{}]|$)|\s+(?![#,:\[\]{}]|$))+)""")


def _plain(s: str) -> str:
    """A scalar without its quotes."""
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1])
    return s[1:-1].replace("''", "'") if len(s) > 1 and s[0] == s[-1] == "'" else s


def _flow_items(tokens: list[str], at: int, depth: int, out: list[str]) -> int:
    """Lines of a flow collection that opens at a token; the place behind its end."""
    at += 1
    while at < len(tokens) and tokens[at] not in "]}":
        if tokens[at] == ",":
            at += 1
            continue
        key = ""
        if at + 1 < len(tokens) and tokens[at + 1] == ":":
            key, at = f"**{_plain(tokens[at])}**", at + 2
        if at < len(tokens) and tokens[at] in "[{":
            if key:
                out.append(f"{'  ' * depth}- {key}")
            at = _flow_items(tokens, at, depth + bool(key), out)
        else:
            value = _plain(tokens[at]) if at < len(tokens) and tokens[at] not in ",]}" else ""
            out.append(f"{'  ' * depth}- " + (f"{key}: {value}" if key and value else key or value))
            at += bool(value)
    return at + 1


def yaml_markdown(data: bytes) -> str:
    """YAML as nested Markdown items: maps, lists, quoted and block scalars, flow collections, anchors and their aliases of scalars; without a YAML library, by its indentation."""
    lines, out, anchors, k = decode(data).splitlines(), [], {}, 0
    while k < len(lines):
        line, k = lines[k], k + 1
        if not line.strip() or line.lstrip().startswith(("#", "%")) or line.strip() in ("---", "..."):
            continue
        indent = len(line) - len(line.lstrip())
        body = line.strip()
        item = body.startswith("- ") or body == "-"
        body = body[1:].strip() if item else body
        m = _KEY.match(body) if body[:1] not in "[{" else None
        key, value = (f"**{_plain(m[1])}**", body[m.end() :].strip()) if m else ("", body)
        value = re.sub(r"^!\S*\s*", "", value)
        anchor = re.match(r"&(\S+)\s*", value)
        value = value[anchor.end() :] if anchor else value
        if re.fullmatch(r"[|>][+-]?[0-9]?[+-]?(?:\s+#.*)?", value):
            held = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > indent):
                held.append(lines[k].strip())
                k += 1
            value = ("\n" if value[0] == "|" else " ").join(held).strip()
        elif value[:1] in ("[", "{"):
            while k < len(lines) and value.count("[") + value.count("{") > value.count("]") + value.count("}"):
                value, k = f"{value} {lines[k].strip()}", k + 1
            if key:
                out.append(f"{'  ' * (indent // 2)}- {key}")
            _flow_items(_FLOW.findall(value), 0, indent // 2 + bool(key), out)
            continue
        elif value[:1] not in ("'", '"'):
            value = re.sub(r"(?:^|\s+)#.*$", "", value)
        value = anchors.get(value[1:], value) if value.startswith("*") else _plain(value)
        if anchor:
            anchors[anchor[1]] = value
        shown = (f"{key}: {value}" if value else key) if key else value
        if shown or item:
            out.append(f"{'  ' * (indent // 2)}- {shown}".rstrip())
    return "\n".join(out)


def rtf_text(data: bytes) -> str:
    """Visible text: destinations that are no text are skipped, escapes decoded, paragraphs kept."""
    text, out, skip, depth = data.decode("latin-1"), [], [], 0
    hidden = re.compile(r"\\\*|\\(?:fonttbl|colortbl|stylesheet|info|pict|themedata|generator)\b")
    at = 0
    pattern = re.compile(r"\\u(-?\d+) ?\??|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", re.S)
    while m := pattern.match(text, at):
        at = m.end()
        if m[6] == "{":
            depth += 1
            if hidden.match(text, at):
                skip.append(depth)
        elif m[6] == "}":
            if skip and skip[-1] == depth:
                skip.pop()
            depth -= 1
        elif skip:
            continue
        elif m[1]:
            out.append(chr(int(m[1]) % 65536))
        elif m[2]:
            out.append(bytes([int(m[2], 16)]).decode("cp1252", "replace"))
        elif m[3] in ("par", "line"):
            out.append("\n")
        elif m[3] == "tab":
            out.append("\t")
        elif m[5]:
            out.append(m[5] if m[5] in "\\{}" else "")
        elif m[7]:
            out.append(m[7].replace("\r", "").replace("\n", ""))
    return "".join(out).strip()


def _blocks(data: bytes, names: tuple[str, ...]) -> list[str]:
    found = (" ".join("".join(e.itertext()).split()) for e in ElementTree.fromstring(data).iter() if e.tag.rpartition("}")[2] in names)
    return [t for t in found if t]


def odt_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(_blocks(z.read("content.xml"), ("h", "p")))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _docx_parts(body: ElementTree.Element) -> list[str]:
    """Headings by their style, paragraphs, and tables as Markdown, in the order of the document; other boxes are opened."""
    out = []
    text = lambda e: " ".join("".join(t.text or "" if _local(t) == "t" else " " if _local(t) in ("tab", "br") else "" for t in e.iter()).split())
    for e in body:
        if _local(e) == "p":
            words = text(e) or " ".join("".join(e.itertext()).split())
            style = next((v for s in e.iter() if _local(s) == "pStyle" for k, v in s.attrib.items() if k.rpartition("}")[2] == "val"), "")
            level = re.fullmatch(r"(?i)heading\s*([1-9])|([1-9])", style)
            if words:
                out.append(f"{'#' * min(6, int(level[1] or level[2]))} {words}" if level else words)
        elif _local(e) == "tbl":
            rows = [[text(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            out.append(markdown_table([r for r in rows if r]))
        elif _local(e) in ("sdt", "sdtContent", "ins"):
            out += _docx_parts(e)
    return [x for x in out if x]


def docx_text(data: bytes) -> str:
    """Headings, paragraphs and tables as Markdown."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join(_docx_parts(next((e for e in root if _local(e) == "body"), root)))


def pptx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return "\n\n".join(f"## Slide {k}\n\n" + "\n".join(_blocks(z.read(n), ("p",))) for k, n in enumerate(slides, 1))


def _column(reference: str) -> int:
    """The column of a cell reference such as C5, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[list[list[str]]]:
    """The rows of each sheet; cells that a row leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _shared(z)
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter():
                if row.tag.rpartition("}")[2] == "row":
                    cells: list[str] = []
                    for c in row:
                        at = _column(c.get("r") or "")
                        cells += [""] * (at - len(cells))
                        value = "".join(c.itertext())
                        cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() else value)
                    rows.append(cells)
            out.append(rows)
        return out


def xlsx_markdown(data: bytes) -> str:
    """Each sheet as a Markdown table."""
    return "\n\n".join(t for t in map(markdown_table, xlsx_sheets(data)) if t)


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(e.itertext()) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if e.tag.rpartition("}")[2] == "si"]


def epub_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(html_to_markdown(decode(z.read(n))) for n in sorted(z.namelist()) if n.endswith((".xhtml", ".html", ".htm")))


_SKIP = re.compile(r"<(script|style|nav|footer|aside|noscript|form|iframe)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>", re.S | re.I)


def html_to_markdown(page: str) -> str:
    """Headings, list items, table rows, links and paragraphs of a page as Markdown."""
    s = _SKIP.sub(" ", page)
    s = re.sub(r"\s+", " ", s)
    s = re.sub(r"<h([1-6])\b[^>]*>", lambda m: "\n\n" + "#" * int(m[1]) + " ", s, flags=re.I)
    s = re.sub(r"<li\b[^>]*>", "\n- ", s, flags=re.I)
    s = re.sub(r"</t[dh]>\s*(?=<t[dh])", " | ", s, flags=re.I)
    s = re.sub(r"<tr\b[^>]*>", "\n| ", s, flags=re.I)
    s = re.sub(r"</tr>", " |", s, flags=re.I)
    s = re.sub(r"<(?:br|p|div|/p|/div|/h[1-6]|/ul|/ol|/table|section|article)\b[^>]*>", "\n", s, flags=re.I)
    s = html.unescape(re.sub(r"<[^>]*>", "", s))
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in s.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


READERS.update({e: decode for e in TEXT} | {
    "csv": csv_markdown, "json": json_markdown, "xml": xml_markdown, "svg": svg_text, "yaml": yaml_markdown, "yml": yaml_markdown, "rtf": rtf_text, "odt": odt_text,
    "docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_markdown, "epub": epub_text, "html": lambda b: html_to_markdown(decode(b)), "htm": lambda b: html_to_markdown(decode(b)),
})


def convert(name: str, data: bytes) -> str:
    """A file's text by the reader of its extension; ValueError for one that has none."""
    extension = name.rpartition(".")[2].lower()
    if extension not in READERS:
        raise ValueError(f"no reader for .{extension}")
    return READERS[extension](data)


def read_files(spark: SparkSession, path: str, most_bytes: int = 200 << 20) -> DataFrame:
    """path, n_bytes, content_hash, text and error of all files below a path; a file that can't be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                try:
                    if data is None:
                        raise ValueError("the file is too large")
                    texts.append(convert(name, data))
                    errors.append(None)
                except (ValueError, KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    texts.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "n_bytes", "content_hash", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.when(F.col("length") <= most_bytes, F.col("content"))
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("content_hash"), small.alias("content")).mapInArrow(run, "path string, n_bytes bigint, content_hash string, text string, error string")


def html_markdown(page: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([None if p is None else html_to_markdown(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(page)


def frontmatter(text: Column) -> Column:
    """A struct of meta, the map of a leading `---` block's `key: value` lines, and body, the rest."""
    block = F.regexp_extract(text, "(?s)\\A---\\s*\\n(.*?)\\n---\\s*(?:\\n|\\z)", 1)
    body = F.regexp_replace(text, "(?s)\\A---\\s*\\n.*?\\n---\\s*(?:\\n|\\z)", "")
    lines = F.filter(F.split(block, "\n", -1), lambda s: F.contains(s, F.lit(":")))
    entries = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, "^[^:]*:", "")).alias("v")))
    return F.struct(F.map_from_entries(entries).alias("meta"), body.alias("body"))


def feed_items(feed: Column) -> Column:
    """Items of an RSS or Atom document: an array of title, link and published."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("title", pa.string()), ("link", pa.string()), ("published", pa.string())]))
        for feeds in batches:
            out = []
            for f in feeds.to_pylist():
                items = []
                try:
                    root = ElementTree.fromstring(f) if f else []
                except ElementTree.ParseError:
                    root = []
                for e in root.iter() if f and not isinstance(root, list) else ():
                    if e.tag.rpartition("}")[2] in ("item", "entry"):
                        kids = {c.tag.rpartition("}")[2]: c for c in reversed(list(e))}
                        text = lambda *names, kids=kids: next(((kids[n].text or kids[n].get("href") or "").strip() for n in names if n in kids), "")
                        items.append({"title": text("title"), "link": text("link"), "published": text("pubDate", "published", "updated")})
                out.append(items)
            yield pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<title:string,link:string,published:string>>")(feed)


# How a page of trending projects marks its cards, how many of them count, and paths that are no projects.
CARD, CARDS, NO_OWNERS = "Box-row", 30, "login sponsors features".split()


def trending_items(page: Column) -> Column:
    """title, link, content and stars (of the day, empty if not told) of the cards of a page of trending projects, whose links are /owner/project."""
    words = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&amp;", "&"), r"\s+", " "))
    cards = F.slice(F.regexp_extract_all(page, F.lit(rf'(?s)<article[^>]*class="[^"]*\b{CARD}\b[^"]*"[^>]*>(.*?)</article>'), F.lit(1)), 1, CARDS)

    def item(card: Column) -> Column:
        head = F.regexp_extract(card, r"(?s)<h2[^>]*>.*?(<a\b.*?</a>)", 1)
        parts = F.filter(F.split(F.regexp_extract(head, r'href="([^"]*)"', 1), "/", -1), lambda p: p != "")
        stars = F.regexp_extract(words(card), r"(?i)([0-9,]+)\s+stars? today", 1)
        good = (F.size(parts) == 2) & ~parts[0].isin(NO_OWNERS)
        return F.when(good, F.struct(words(head).alias("title"), F.concat(F.lit("https://github.com/"), F.array_join(parts, "/")).alias("link"), words(F.regexp_extract(card, r"(?s)<p\b[^>]*>(.*?)</p>", 1)).alias("content"), stars.alias("stars")))

    return F.filter(F.transform(cards, item), lambda x: x.isNotNull())


def markdown_tables(text: Column) -> Column:
    """The tables of a Markdown text: an array of arrays of rows, each a string; separator rows left out."""
    runs = F.regexp_extract_all(text, F.lit("(?m)(?:^[ \\t]*\\|.*(?:\\n|\\z)){2,}"), F.lit(0))
    return F.transform(runs, lambda r: F.filter(F.transform(F.split(r, "\n", -1), lambda x: F.trim(x)), lambda s: (F.length(s) > 0) & ~s.rlike("^[|:\\-\\s]+$")))


def vault_notes(notes: DataFrame) -> DataFrame:
    """path, title, tags and body of the Markdown notes (path, text) of a vault, unique by path.

    `[[note|shown]]` becomes a Markdown link to the note of that name, whatever its case (of two the first path), or to the
    name itself if there is none; `#tag` becomes its label; a leading `---` block goes, and its tags become a list. A null
    text gives an empty body."""
    base = notes.select("path", F.regexp_replace("path", r"\.[^./]*$", "").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    link = r"\[\[([^\]]+)\]\]"
    links = base.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(link), F.lit(1))).alias("k", "link"))
    target = F.trim(F.substring_index("link", "|", 1))
    links = links.select("path", "k", target.alias("to"), F.coalesce(F.trim(F.get(F.split("link", r"\|", -1), 1)), target).alias("shown"))
    names = base.groupBy(F.lower(F.substring_index("title", "/", -1)).alias("name")).agg(F.min("title").alias("found"))
    links = links.join(names, F.lower("to") == F.col("name"), "left").withColumn("made", F.concat(F.lit("["), "shown", F.lit("]("), F.coalesce("found", "to"), F.lit(")")))
    made = links.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "made"))).alias("made"))
    parts = F.zip_with(F.split("text", link, -1), F.col("made.made"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    linked = F.when(F.col("made").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    read = frontmatter(F.regexp_replace(linked, r"(?U)#(\w+)", "标签:$1"))
    out = base.join(made, "path", "left").withColumn("read", read)
    tags = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("read.meta", F.lit("tags")), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return out.select("path", "title", tags.alias("tags"), F.trim("read.body").alias("body"))


def write_partitioned(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of `key` that `rows` has, and leaves the others; other writers see all of a job or nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
