"""Importers: records with any keys, read by several tasks; archives; cells by their references."""

import io
import zipfile

from marlstone.sources import formats, importers


def test_records_of_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1, "b": [1, 2]},\n{"a": null}\n]')
    (tmp_path / "b.json").write_text('[{"c": "x], y"}, \n {"c": {"d": 1}}]\nnot json\n\n{"a": 2.5}')
    rows = importers.json_records(spark, f"file://{tmp_path}")
    assert rows.count() == 5
    assert {(r.key, r.n_records, r.n_values) for r in importers.key_union(rows).collect()} == {("a", 3, 2), ("b", 1, 1), ("c", 2, 2)}
    assert {(r.key, r.value) for r in importers.record_fields(rows, ["path"]).collect()} >= {("a", "1"), ("a", None), ("c", "x], y"), ("a", "2.5")}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 1_000_000
    with open(tmp_path / "large.json", "w") as f:
        f.write("[" + ",\n".join(f'{{"id": {k}}}' for k in range(n)) + "]")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2m")
    try:
        rows = importers.json_records(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() > 4 and rows.count() == n
    finally:
        spark.conf.set(key, before)


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    good = zipped(**{"a/b/Note 0123456789abcdef0123456789abcdef.md": "# T", "a/": "", "top.txt": "x", "bad.xlsx": b"no", "c.raw": b"\0", **{f"m/{k}.txt": str(k) for k in range(200)}})
    files = spark.createDataFrame([("good.zip", good), ("bad.zip", b"not a zip"), ("none.zip", None)], "path string, content binary")
    members = importers.archive_members(files)
    rows = members.collect()
    assert sum(r.path == "good.zip" for r in rows) == 204 and {r.path for r in rows if r.error} == {"bad.zip", "none.zip"}
    pages = {r.member: r for r in importers.imported_pages(members).collect()}
    note = pages["a/b/Note 0123456789abcdef0123456789abcdef.md"]
    assert (note.title, note.parent, note.text) == ("Note", "a/b", "# T") and pages["top.txt"].parent == "" and pages["m/7.txt"].text == "7"
    assert pages["bad.xlsx"].error and pages["c.raw"].error and pages["c.raw"].text is None


def test_cells_stand_by_their_references(spark):
    sheet = '<s><row r="1"><c r="A1"><v>k</v></c><c r="AB1"><v>far</v></c></row><row r="2"><c r="B2"><v>5</v></c><c r="AB2"><v>1.5</v></c></row></s>'
    book = zipped(**{"xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet10.xml": "<s><row><c><v>a</v></c><c><v>b</v></c></row></s>", "xl/worksheets/sheet2.xml": "<s></s>"})
    assert [len(s) for s in formats.xlsx_sheets(book)] == [2, 0, 1]
    files = spark.createDataFrame([("b.xlsx", book), ("none.xlsx", None)], "path string, content binary")
    cells = importers.sheet_cells(files)
    assert {(r.sheet, r.row, r.column, r.value) for r in cells.collect()} == {(1, 0, 0, "k"), (1, 0, 27, "far"), (1, 1, 1, "5"), (1, 1, 27, "1.5"), (3, 0, 0, "a"), (3, 0, 1, "b")}
    got = {(r.sheet, r.name): (r.n, r.n_numbers, r.mean) for r in importers.column_profile(cells).collect()}
    assert got == {(1, "k"): (0, 0, None), (1, "far"): (1, 1, 1.5), (3, "a"): (0, 0, None), (3, "b"): (0, 0, None)}


def test_docx_headings_and_tables():
    p = lambda words, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{words}</w:t></w:r></w:p>' if style else f"<w:p><w:r><w:t>{words}</w:t><w:tab/><w:t>x</w:t></w:r></w:p>"
    cell = lambda words: f"<w:tc>{p(words, 'Plain')}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    page = f"<w:document xmlns:w='urn:w'><w:body>{p('Title', 'Heading1')}{p('words')}{table}<w:sdt><w:sdtContent>{p('Deep', 'heading 3')}</w:sdtContent></w:sdt><w:p/></w:body></w:document>"
    assert formats.docx_text(zipped(**{"word/document.xml": page})) == "# Title\n\nwords x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n### Deep"


def test_yaml_of_all_forms():
    page = """# c
name: x # note
"quoted: key": 'it''s'
flow: {a: 1, b: [2, three: 3], "c": "d, e"}
list:
  - one
  - key: v
    sub: w
text: |
  line one
  line two
fold: >-
  a
  b
base: &id value
ref: *id
multi: [1,
  2]
url: http://a.b/c
"""
    assert formats.yaml_markdown(page.encode()) == """- **name**: x
- **quoted: key**: it's
- **flow**
  - **a**: 1
  - **b**
    - 2
    - **three**: 3
  - **c**: d, e
- **list**
  - one
  - **key**: v
    - **sub**: w
- **text**: line one
line two
- **fold**: a b
- **base**: value
- **ref**: value
- **multi**
  - 1
  - 2
- **url**: http://a.b/c"""


def test_rtf_in_linear_time():
    import time

    began = time.process_time()
    assert formats.rtf_text(b"{\\rtf1 " + b"{\\b x}" * 200_000 + b"}") == "x" * 200_000
    assert time.process_time() - began < 10
