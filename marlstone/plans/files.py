"""Readers of files: whole tables are written by Spark in a format, and read again by the format's reader."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from marlstone.functions import clean, stages
from marlstone.operators._lineage import cut, shared_folder
from marlstone.plans._base import query
from marlstone.sources import formats, importers


def _save(rows: DataFrame, kind: str, path: str) -> None:
    out: DataFrameWriter = rows.write.mode("append")
    if kind == "xml":
        out.format("xml").option("rootTag", "rows").option("rowTag", "row").save(path)
    elif kind == "csv":
        out.option("header", "true").csv(path)
    elif kind == "yaml":  # a column of lines
        out.option("extension", "yaml").option("sep", "\x01").csv(path)
    else:
        out.format({"txt": "text"}.get(kind, kind)).save(path)


def _folder(rows: DataFrame) -> str:
    return f"{shared_folder(rows.sparkSession)}/files-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, kind: str, wanted: Column) -> DataFrame:
    """The wanted lines of the texts of all files that hold `rows`."""
    path = _folder(rows)
    _save(rows, kind, path)
    read = formats.read_files(rows.sparkSession, path).filter(F.col("path").endswith(f".{kind}"))
    return read.select(F.explode(F.split("text", "\n", -1)).alias("line")).filter(wanted)


@query("S1_format_dispatch", """WITH n AS (SELECT count(*) AS n FROM nation) SELECT e.extension, e.extension = 'parquet' AS rejected, CASE WHEN e.extension <> 'parquet' THEN n END AS n_names
FROM n, (VALUES ('csv'), ('json'), ('xml'), ('txt'), ('yaml'), ('parquet')) e(extension)""")
def format_dispatch(t):
    """The nations in six formats in one folder: five have a reader, Parquet files are rejected with an error and no text."""
    rows = t("nation").select("n_nationkey", "n_name")
    path = _folder(rows)
    for kind in ("csv", "json", "xml", "parquet"):
        _save(rows, kind, f"{path}/{kind}")
    for kind in ("txt", "yaml"):
        _save(rows.select("n_name"), kind, f"{path}/{kind}")
    read = formats.read_files(rows.sparkSession, path).withColumn("extension", F.substring_index("path", ".", -1))
    return read.groupBy("extension").agg(F.bool_or(F.col("error").isNotNull()).alias("rejected"), F.sum(F.regexp_count("text", F.lit("NATION"))).cast("long").alias("n_names"))


@query("S2_text_scan", "SELECT c_name AS line FROM customer")
def text_scan(t):
    return _lines(t("customer").select("c_name"), "txt", F.col("line") != "")


@query("S3_csv_scan", "SELECT '| ' || c_custkey || ' | ' || c_name || ' | ' || c_nationkey || ' |' AS line FROM customer")
def csv_scan(t):
    """Every file is a table of its own: the heads go, all rows stay."""
    return _lines(t("customer").select("c_custkey", "c_name", "c_nationkey"), "csv", F.col("line").rlike(r"^\| [0-9]"))


@query("S4_json_scan", "SELECT '| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |' AS line FROM part")
def json_scan(t):
    return _lines(t("part").select("p_partkey", "p_name", "p_size"), "json", F.col("line").rlike(r"^\| [0-9]"))


@query("S5_yaml_scan", "SELECT '- **' || c_name || '**: ' || c_nationkey AS line FROM customer")
def yaml_scan(t):
    return _lines(t("customer").select(F.concat_ws(": ", "c_name", F.col("c_nationkey").cast("string")).alias("v")), "yaml", F.col("line") != "")


@query("S6_xml_scan", "SELECT '  - **s_name**: ' || s_name AS line FROM supplier")
def xml_scan(t):
    return _lines(t("supplier").select("s_suppkey", "s_name"), "xml", F.contains("line", F.lit("**s_name**")))


@query("S17_vault_notes", """SELECT 'vault/' || c_custkey || '.md' AS path, 'vault/' || c_custkey AS title, ['n' || c_nationkey, 'all'] AS tags,
'Of [home](vault/nations/' || n_name || ') and [nobody](nobody), 标签:c' || c_nationkey AS body FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'vault/nations/' || n_name || '.md', 'vault/nations/' || n_name, [], 'See ![' || n_name || '](vault/nations/' || n_name || ').' FROM nation""")
def vault_notes(t):
    """A vault of a note a customer, which links to its nation's note and to a name without one, and a note a nation."""
    of = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    note = F.format_string("---\ntags: n%d, all\n---\nOf [[%s|home]] and [[nobody]], #c%d", "c_nationkey", F.lower("n_name"), "c_nationkey")
    customers = of.select(F.format_string("vault/%d.md", "c_custkey").alias("path"), note.alias("text"))
    nations = t("nation").select(F.format_string("vault/nations/%s.md", "n_name").alias("path"), F.format_string("See ![[%s]].", "n_name").alias("text"))
    return formats.vault_notes(customers.unionByName(nations))


@query("S4_json_records", """WITH f AS (SELECT 'o_orderkey' AS key, count(*) AS n_records, count(o_orderkey) AS n_values FROM orders UNION ALL SELECT 'note', count(*), count(*) FILTER (o_orderkey % 7 <> 0) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'p_partkey', count(*), count(*) FROM part UNION ALL SELECT 'p_name', count(*), count(*) FROM part WHERE p_partkey % 2 = 0) SELECT * FROM f""")
def json_records(t):
    """Orders and parts as records of JSON with keys of their own, some with nulls: all keys, with the records and values of each."""
    orders, parts = t("orders"), t("part")
    note = F.when(F.col("o_orderkey") % 3 != 0, F.lit("")).when(F.col("o_orderkey") % 7 != 0, F.format_string(',"note":"n %d"', "o_orderkey")).otherwise(F.lit(',"note":null'))
    lines = orders.select(F.concat(F.format_string('{"o_orderkey":%d', "o_orderkey"), note, F.lit("},")).alias("value"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"p_name":'), F.to_json(F.array("p_name")).substr(F.lit(2), F.length(F.to_json(F.array("p_name"))) - 2))).otherwise(F.lit(""))
    path = _folder(orders)
    _save(lines.unionByName(parts.select(F.concat(F.format_string('{"p_partkey":%d', "p_partkey"), name, F.lit("}")).alias("value"))), "txt", path)
    return importers.key_union(importers.json_records(orders.sparkSession, path))


def _archives(t) -> DataFrame:
    """path and content of archives, of two hundred customers each: a note for each in its nation's folder, and a workbook of them all."""
    of = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "n_name", F.col("c_acctbal").cast("double").alias("balance"), F.floor(F.col("c_custkey") / 200).alias("box"))

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["c_custkey"])
        sheet = "".join(f'<row r="{k}"><c r="A{k}"><v>{r["c_custkey"]}</v></c><c r="C{k}"><v>{r["balance"]}</v></c></row>' for k, r in enumerate(rows, 2))
        book, box = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(book, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<s><row r="1"><c r="A1"><v>key</v></c><c r="C1"><v>balance</v></c></row>{sheet}</s>')
        with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(f"notes/{r['n_name']}/{r['c_name']} {r['c_custkey']:032x}.md", f"# {r['c_name']}\n\nfrom {r['n_name']}")
            z.writestr("book.xlsx", book.getvalue())
            z.writestr("notes/", "")
            z.writestr("photo.raw", b"\0")
        return pa.table({"path": [f"box{rows[0]['box']}.zip"], "content": [box.getvalue()]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return cut(of.groupBy("box").applyInArrow(pack, "path string, content binary"), "archives")


@query("S17_archive_pages", """WITH c AS (SELECT 'box' || (c_custkey // 200) || '.zip' AS path, c_name AS title, 'notes/' || n_name AS parent, '# ' || c_name || chr(10) || chr(10) || 'from ' || n_name AS text FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT path, title, parent, text, false AS failed FROM c UNION ALL SELECT DISTINCT path, 'photo', '', NULL, true FROM c""")
def archive_pages(t):
    """Pages from archives, with titles and folders; members without a reader are errors of their own."""
    members = importers.archive_members(_archives(t)).filter("member <> 'book.xlsx'")
    return importers.imported_pages(members).select("path", "title", "parent", "text", F.col("error").isNotNull().alias("failed"))


@query("S17_workbook_profile", """WITH c AS (SELECT 'box' || (c_custkey // 200) || '.zip' AS path, c_custkey::DOUBLE AS k, c_acctbal::DOUBLE AS b FROM customer)
SELECT path, 'key' AS name, count(*) AS n, count(*) AS n_numbers, min(k) AS least, max(k) AS most, round(sum(k), 2) AS total FROM c GROUP BY path UNION ALL SELECT path, 'balance', count(*), count(*), min(b), max(b), round(sum(b), 2) FROM c GROUP BY path""")
def workbook_profile(t):
    """Columns of the archives' workbooks, whose second column is empty: numbers, least, most and total."""
    books = importers.archive_members(_archives(t)).filter("member = 'book.xlsx'").select("path", "content")
    return importers.column_profile(importers.sheet_cells(books)).select("path", "name", "n", "n_numbers", "least", "most", F.round(F.col("mean") * F.col("n_numbers"), 2).alias("total"))


@query("F24_cleaner_stages", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[①-⑮⒈-⒑]', '', 'g'), '〔[0-9]+〕|［[0-9]+］|\([0-9]{1,3}\)', '', 'g'), '(?m)^[ \t]*[0-9]{1,3}[ \t]*$', '', 'g'),
'[ 　]+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\.{4,}|·{3,}', '……', 'g') AS cleaned FROM documents""")
def cleaner_stages(t):
    """The stages that take characters away, over all documents; fixtures test the others."""
    return t("documents").select("doc_id", clean.plain_characters(clean.drop_footnote_marks(F.col("text"))).alias("cleaned"))


@query("F24_layout_stages", r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, '# ' || title || chr(10) || '## 1.2 ' || trim(left(title, 20), ' ') || chr(10) || '### 2.1.3 deep' || chr(10) || '```' || chr(10) || '1.2 in code' || chr(10) || '7' || chr(10) || '```' || chr(10) || '关键词：a；' || page_id || chr(10) || '总建筑面积 ' || page_id || ' m²，长度 5 m' AS cleaned FROM p""")
def layout_stages(t):
    """Each page's title in a text of headings out of step, page numbers, code, keywords and units, put in order."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("# "), title, F.lit("\n1.2 "), F.substring(title, 1, 20), F.lit("\n2.1.3 deep\n- 12 -\nPage 3 of 9\n~~~###^^^\n```\n1.2 in code\n7\n```\n第3卷第4期\n关键词: a, "), k, F.lit("\n总建筑面积 "), k, F.lit(" m，长度 5 m"))
    return t("pages").select("page_id", stages.clean_layout(text).alias("cleaned"))


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _office(names: list[str]) -> dict[str, bytes]:
    """One list of names as files of seven formats."""
    of = lambda tag, name: f"<{tag}>{name}</{tag}>"
    each = lambda tag: "".join(of(tag, n) for n in names)
    return {
        "docx": _zipped({"word/document.xml": f'<w:d xmlns:w="w"><w:body>{each("w:p")}</w:body></w:d>'}), "odt": _zipped({"content.xml": f'<o xmlns:text="t">{each("text:p")}</o>'}),
        "pptx": _zipped({f"ppt/slides/slide{k}.xml": f'<s xmlns:a="a">{of("a:p", n)}</s>' for k, n in enumerate(names, 1)}), "epub": _zipped({f"c{k:03d}.xhtml": f"<html><body><p>{n}</p></body></html>" for k, n in enumerate(names)}),
        "rtf": ("{\\rtf1{\\fonttbl{\\f0 Arial;}}" + "\\par ".join(names) + "}").encode(), "svg": f"<svg>{each('text')}</svg>".encode(), "html": f"<html><body>{each('p')}</body></html>".encode(),
    }


@query("S9_office_pages", """WITH c AS (SELECT c_custkey // 100 AS box, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS k FROM customer),
t AS (SELECT box, string_agg(c_name, chr(10) ORDER BY k) AS single, string_agg(c_name, chr(10) || chr(10) ORDER BY k) AS twice, string_agg('## Slide ' || k || chr(10) || chr(10) || c_name, chr(10) || chr(10) ORDER BY k) AS slides FROM c GROUP BY box)
SELECT box || '.' || f.kind AS path, md5(CASE f.lay WHEN 1 THEN single WHEN 2 THEN twice ELSE slides END) AS text FROM t, (VALUES ('docx', 2), ('odt', 2), ('pptx', 3), ('epub', 2), ('rtf', 1), ('svg', 1), ('html', 2)) f(kind, lay)""")
def office_pages(t):
    """The names of a hundred customers each as documents of seven formats, read by their readers."""

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["c_custkey"])
        files = _office([r["c_name"] for r in rows])
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())])
        return pa.table({"path": [f"{rows[0]['box']}.{k}" for k in files], "member": [f"a.{k}" for k in files], "content": list(files.values())}, schema=schema)

    boxes = t("customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 100).alias("box"))
    files = boxes.groupBy("box").applyInArrow(pack, "path string, member string, content binary")
    return importers.imported_pages(files).select("path", F.md5("text").alias("text"))
