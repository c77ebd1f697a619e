"""Importers: records of JSON files, members of archives, cells and profiles of tables, pages of a folder.

Large files are read by many tasks: JSON by Spark's splits of lines, archives by their members, which are dealt out once the
directory is read. Records keep whatever keys they have (VARIANT), so files of different shapes make one table.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources import formats

#: Members of archives that are handed on together.
MEMBERS = 64


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """path and record (VARIANT) of the records of JSON files: a record a line, bare or as an array with a record a line.

    Spark splits the files at line ends, so a file of many records is read by many tasks. Lines that hold no JSON, such as the
    brackets of an array, have no record."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("s"))
    bare = F.regexp_replace(F.regexp_replace("s", r"^\[(?=\s*\{)", ""), r"(?<=\})\s*(?:,|\])+$", "")
    return lines.select("path", F.try_parse_json(bare).alias("record")).filter(F.col("record").isNotNull() & (F.schema_of_variant("record") != "VOID"))


def record_fields(records: DataFrame, id_cols: list[str], record_col: str = "record") -> DataFrame:
    """The id columns, key and value (as text; null for a JSON null) of every field of the records, whatever their keys."""
    fields = records.lateralJoin(records.sparkSession.tvf.variant_explode(F.col(record_col).outer()))
    return fields.filter("key IS NOT NULL").select(*id_cols, "key", F.try_variant_get("value", "$", "string").alias("value"))


def key_union(records: DataFrame, record_col: str = "record") -> DataFrame:
    """key, n_records and n_values of all keys that any record has."""
    numbered = records.select(record_col)
    fields = record_fields(numbered, [], record_col)
    return fields.groupBy("key").agg(F.count(F.lit(1)).alias("n_records"), F.count("value").alias("n_values"))


_MEMBER = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def archive_members(files: DataFrame) -> DataFrame:
    """path, member, content and error of the files in zip archives (path, content); folders are left out, in any depth.

    An archive that can't be read is one row with its error. Members leave their task as they are read, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, data: bytes) -> Iterator[dict]:
            try:
                with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield {"path": path, "member": info.filename, "content": z.read(info), "error": None}
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                yield {"path": path, "member": None, "content": None, "error": str(e)}

        for batch in batches:
            held: list[dict] = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                for row in rows(path, data.as_py()):
                    held.append(row)
                    if len(held) == MEMBERS:
                        yield pa.RecordBatch.from_pylist(held, _MEMBER)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, _MEMBER)

    found = files.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")
    return found.repartition(F.xxhash64("path", "member"))


def imported_pages(members: DataFrame) -> DataFrame:
    """path, member, title, parent (folder; '' at the top) and text of the members that have a reader, converted to Markdown; error of the others."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("error", pa.string())])
        for names, contents in batches:
            out = []
            for name, data in zip(names.to_pylist(), contents):
                try:
                    out.append({"text": formats.convert(name, data.as_py()), "error": None})
                except Exception as e:  # noqa: BLE001  a file that its format's reader refuses is an error of that file
                    out.append({"text": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, kind)

    rows = members.filter("member IS NOT NULL")
    read = F.arrow_udf(run, "struct<text:string,error:string>")("member", "content")
    name = F.substring_index("member", "/", -1)
    title = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r" [0-9a-f]{32}$", "")  # exported notes carry their id
    parent = F.regexp_extract("member", "^(.*)/[^/]*$", 1)
    return rows.select("path", "member", title.alias("title"), parent.alias("parent"), read.alias("r")).select("path", "member", "title", "parent", "r.*")


def sheet_cells(files: DataFrame) -> DataFrame:
    """path, sheet (from 1), row (from 0, the head), column (from 0) and value of the filled cells of workbooks (path, content)."""
    cell = pa.list_(pa.struct([("sheet", pa.int32()), ("row", pa.int32()), ("column", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            rows = []
            for data in contents:
                sheets = formats.xlsx_sheets(data.as_py()) if data.is_valid else []
                rows.append([{"sheet": s, "row": r, "column": c, "value": v} for s, sheet in enumerate(sheets, 1) for r, line in enumerate(sheet) for c, v in enumerate(line) if v != ""])
            yield pa.array(rows, cell)

    found = F.arrow_udf(run, "array<struct<sheet:int,row:int,column:int,value:string>>")("content")
    return files.select("path", F.inline(found)).select("path", "sheet", "row", "column", "value")


def column_profile(cells: DataFrame) -> DataFrame:
    """path, sheet, name, n, n_numbers, least, most and mean of each column of cells as sheet_cells() gives them."""
    heads = cells.filter("row = 0").select("path", "sheet", "column", F.col("value").alias("name"))
    number = F.expr("try_cast(value AS double)")
    sums = cells.filter("row > 0").groupBy("path", "sheet", "column").agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("n_numbers"), F.min(number).alias("least"), F.max(number).alias("most"), F.avg(number).alias("mean"))
    named = heads.join(sums, ["path", "sheet", "column"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.select("path", "sheet", "name", zero("n"), zero("n_numbers"), "least", "most", "mean")
