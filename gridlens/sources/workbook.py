"""Workbooks as DataFrames: one scan of the packages, then joins.

``read`` unzips each package once (a map over files) and writes what it holds, by kind, to Parquet, a struct column for
each kind; every table below reads its own kind and fields only.  A workbook's key is its whole path, so books of one name
in different folders stay apart (:func:`book_title` gives the name).  Shared strings and styles join their cells by workbook
and index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats, markdown
from ..functions.coerce import strip
from ..plans import evaluate
from ..scratch import shared_folder
from . import package
from .formulas import shift

BOOK = "workbook"
RUN = "struct<text:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean>"
STYLE = "struct<bold:boolean,italic:boolean,strike:boolean,underline:boolean>"
#: Fields of what a package holds, by kind.
KINDS = {
    "sheet": "sheet_index:int, name:string, path:string",
    "name": "name:string, formula:string, sheet:string",
    "string": f"idx:int, text:string, runs:array<{RUN}>",
    "style": "idx:int, top:boolean, bottom:boolean, left:boolean, right:boolean, num_fmt_id:int, code:string, bold:boolean, italic:boolean, strike:boolean, underline:boolean",
    "cell": f"sheet_index:int, ord:long, address:string, row:int, col:int, type:string, style:int, has_value:boolean, value:string, formula:string, formula_type:string, shared_id:string, formula_ref:string, inline:string, runs:array<{RUN}>",
    "merge": "sheet_index:int, ord:int, ref:string, start_row:int, start_col:int, end_row:int, end_col:int",
    "link": "sheet_index:int, ord:int, start_row:int, start_col:int, end_row:int, end_col:int, kind:string, target:string, location:string, tooltip:string, display:string",
    "object": "sheet_index:int, sheet:string, name:string, start:string, end:string, columns:array<string>, header_rows:int, totals_rows:int",
    "image": "sheet_index:int, no:int, anchor:string, row:int, col:int, filename:string, path:string, media:string",
    "chart": "sheet_index:int, no:int, anchor:string, row:int, col:int, path:string, title:string, type:string, series:array<struct<name:string,categories:string,values:string,axis:string>>",
    "shape": "sheet_index:int, no:int, anchor:string, name:string, kind:string, text:string, width:long, height:long, left:long, top:long, right:long, bottom:long, raw_entries:array<struct<key:string,value:string>>, svg_file:string, svg_path:string, svg:string",
    "error": "message:string",
}
ROW = "workbook string, data binary, " + ", ".join(f"`{k}` struct<{d}>" for k, d in KINDS.items())
BATCH = 20_000  # rows of a package written at a time


def contents(name: str, data: bytes, shapes: bool = True) -> list[tuple[str, dict, bytes | None]]:
    """(kind, fields, bytes) of everything in a package; a package that cannot be read has one ``error`` row."""
    try:
        return list(_contents(data, shapes))
    except package.PackageError as e:
        return [("error", {"message": str(e)}, None)]


def _contents(data: bytes, shapes: bool) -> Iterator[tuple[str, dict, bytes | None]]:
    def row(kind: str, body: dict, raw: bytes | None = None):
        return kind, body, raw

    parts = package.unzip(data)
    sheets, names = package.catalog(parts)
    yield from (row("name", n) for n in names)
    yield from (row("string", s) for s in package.shared_strings(parts))
    yield from (row("style", s) for s in package.styles(parts))
    for s in sheets:
        yield row("sheet", s)
        root = package.xml(parts.get(s["path"]))
        if root is None:
            raise package.PackageError(f"sheet XML not found: {s['path']}")
        at, rels = {"sheet_index": s["sheet_index"]}, package.relationships(parts, s["path"])
        for kind, found in (("cell", package.cell_rows(root)), ("merge", package.merge_rows(root)), ("link", package.hyperlink_rows(root, rels)), ("object", package.list_objects(parts, root, rels))):
            yield from (row(kind, at | x | ({"sheet": s["name"]} if kind == "object" else {})) for x in found)
        images, charts, drawn = package.drawings(parts, s["name"], s["path"])
        yield from (row("image", at | x, parts[x["media"]]) for x in images)
        yield from (row("chart", at | x) for x in charts)
        yield from (row("shape", at | x) for x in (drawn if shapes else ()))


def unzip(files: DataFrame) -> DataFrame:
    """Parts (workbook, path, data) of ``files(path, content)``; unreadable packages have none."""

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    parts = package.unzip(c)
                except package.PackageError:
                    continue
                yield pd.DataFrame({"workbook": p, "path": list(parts), "data": list(parts.values())})

    return files.select("path", "content").mapInPandas(run, "workbook string, path string, data binary")


def book_title(workbook: Column) -> Column:
    """A workbook's name: the last part of its path."""
    return F.regexp_extract(workbook, "([^/]*)/*$", 1)


def scan(files: DataFrame, shapes: bool = True) -> DataFrame:
    """Everything in the packages of ``files(path, content)``: workbook, kind, data and a struct for each kind, null in rows of
    other kinds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(f"kind string, {ROW}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for kind, rows in groupby(contents(path, content, shapes), key=lambda r: r[0]):
                    rows = list(rows)
                    for at in range(0, len(rows), BATCH):
                        part = rows[at : at + BATCH]
                        n = len(part)
                        given = {"workbook": pa.array([path] * n), "kind": pa.array([kind] * n), "data": pa.array([x for *_, x in part], pa.binary()), kind: pa.array([x for _, x, _ in part], arrow.field(kind).type)}
                        yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


@dataclass
class Workbooks:
    """The tables of a set of workbooks; each is read lazily from its own kind."""

    spark: SparkSession
    rows: DataFrame
    where: str = ""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written beside the scan and read back: what several outputs share is computed once, and a lost executor
        does not send them back to the packages."""
        path = f"{self.where or shared_folder(self.spark) + '/workbooks'}-{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kind(self, kind: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).select(BOOK, f"{kind}.*")

    @cached_property
    def sheets(self) -> DataFrame:
        return self.kind("sheet")

    @cached_property
    def errors(self) -> DataFrame:
        return self.kind("error")

    @cached_property
    def merges(self) -> DataFrame:
        return self.kind("merge")

    @cached_property
    def images(self) -> DataFrame:
        return self.rows.where("kind = 'image'").select(BOOK, "image.*", "data")

    @cached_property
    def charts(self) -> DataFrame:
        return self.kind("chart")

    @cached_property
    def shapes(self) -> DataFrame:
        return self.kind("shape")

    @cached_property
    def list_objects(self) -> DataFrame:
        return self.kind("object")

    @cached_property
    def defined_names(self) -> DataFrame:
        return self.kind("name")

    @cached_property
    def styles(self) -> DataFrame:
        s = self.kind("style")
        s = s.withColumn("code", F.coalesce("code", formats.builtin_code(F.col("num_fmt_id"))))
        return s.withColumn("shown", formats.shown_of(F.col("code"), F.col("num_fmt_id")))

    @cached_property
    def links(self) -> DataFrame:
        """A link for each cell that has one; later ones count."""
        k = self.kind("link")
        cells = k.withColumn("row", F.explode(F.sequence("start_row", "end_row"))).withColumn("col", F.explode(F.sequence("start_col", "end_col")))
        link = F.struct("kind", "target", "location", "tooltip", "display")
        return cells.groupBy(BOOK, "sheet_index", "row", "col").agg(F.max_by(link, "ord").alias("hyperlink"))

    @cached_property
    def parsed_cells(self) -> DataFrame:
        """Cells with their value, format and formula, formulas without a cached value unresolved."""
        c = shared_formulas(self.kind("cell"))
        c = c.withColumnRenamed("style", "style_index")
        s = self.styles.select(BOOK, F.col("idx").alias("style_index"), *[F.col(x).alias(f"s_{x}") for x in ("top", "bottom", "left", "right", "num_fmt_id", "code", "shown", "bold", "italic", "strike", "underline")])
        c = c.join(s, [BOOK, "style_index"], "left")
        index = F.when(F.col("type") == "s", F.when(F.col("value") == "", 0).otherwise(F.col("value").try_cast("int")))
        strings = self.kind("string").select(BOOK, F.col("idx").alias("string_index"), F.col("text").alias("string"), F.col("runs").alias("string_runs"))
        c = c.withColumn("string_index", index).join(strings, [BOOK, "string_index"], "left")
        c = c.join(self.links, [BOOK, "sheet_index", "row", "col"], "left").join(self.sheets.select(BOOK, "sheet_index", F.col("name").alias("sheet_name")), [BOOK, "sheet_index"])
        return extracted(c)

    @cached_property
    def cells(self) -> DataFrame:
        """Cells with formulas resolved: cached values first, then evaluation."""
        c = self.keep(self.parsed_cells, "parsed")
        pending = F.col("resolution_status") == "fallback_formula"
        # what other formulas read of a cell: text as shown, numbers raw
        as_read = F.when(F.col("formula") != "", F.coalesce(F.when(F.col("raw_value") != F.col("formula"), F.col("raw_value")), F.when(F.col("output_value") != F.col("formula"), F.col("output_value")), F.lit("")))
        as_read = as_read.otherwise(F.when(F.col("value_type").isin("s", "inlineStr", "str", "e", "b"), F.col("output_value")).otherwise(F.col("raw_value")))
        empty = F.col("cached_value_state") == "present_empty"
        facts = c.select(BOOK, "sheet_index", "sheet_name", "ord", "row", "col", "formula", F.coalesce(pending, F.lit(False)).alias("pending"), F.coalesce(empty & (F.col("resolution_status") == "resolved"), F.lit(False)).alias("empty"), as_read.alias("value"))
        found = evaluate.resolve(facts, self.defined_names, self.list_objects.select(BOOK, "sheet", "name", "start", "end", "columns", "header_rows", "totals_rows"))
        c = c.join(found, [BOOK, "sheet_index", "row", "col"], "left")
        done = F.col("resolved").isNotNull()
        shown = F.coalesce(formats.display_struct(F.col("resolved"), F.col("shown")), F.col("resolved"))
        return self.keep(c.withColumns({
            "output_value": F.when(done, shown).otherwise(F.col("output_value")), "raw_value": F.when(done, F.col("resolved")).otherwise(F.col("raw_value")),
            "resolution_status": F.when(done, "resolved").otherwise(F.col("resolution_status")), "resolution_source": F.when(done, "ast_evaluator").otherwise(F.col("resolution_source")),
        }).drop("resolved", "shown"), "cells")

    @cached_property
    def extents(self) -> DataFrame:
        """max_row and max_col of each sheet, over cells and merges."""
        both = self.kind("cell").select(BOOK, "sheet_index", "row", "col").union(self.merges.select(BOOK, "sheet_index", "end_row", "end_col"))
        return both.groupBy(BOOK, "sheet_index").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def shared_formulas(cells: DataFrame) -> DataFrame:
    """Followers of a shared formula get the latest formula before them with the same id, moved to their place."""
    text = F.when(F.col("formula") != "", F.regexp_replace("formula", "^=?", "="))
    cells = cells.withColumn("formula", F.coalesce(text, F.lit("")))
    shared = (F.col("formula_type") == "shared") & (F.col("shared_id") != "")
    base = F.when(shared & (F.col("formula") != ""), F.struct("formula", "row", "col"))
    over = Window.partitionBy(BOOK, "sheet_index", "shared_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    alone, grouped = cells.where(~shared), cells.where(shared).withColumn("base", F.last(base, ignorenulls=True).over(over))
    moved = shift(F.col("base.formula"), F.col("row") - F.col("base.row"), F.col("col") - F.col("base.col"))
    grouped = grouped.withColumn("formula", F.when(F.col("formula") != "", F.col("formula")).otherwise(F.coalesce(moved, F.lit("")))).drop("base")
    return alone.unionByName(grouped)


def extracted(c: DataFrame) -> DataFrame:
    """The value of each cell by its type, and the state of its formula: one projection."""
    style = F.struct(*[F.coalesce(F.col(f"s_{f}"), F.lit(False)).alias(f) for f in package.FLAGS])
    code, fmt = F.coalesce("s_code", F.lit("General")), F.coalesce("s_num_fmt_id", F.lit(0))
    has = F.col("formula") != ""
    external = has & F.col("formula").rlike(r"(?i)\[[^\]]+\.xlsx\]")
    shown = F.coalesce(formats.display_struct(F.col("value"), F.col("s_shown")), F.col("value"))
    kind = F.col("type")
    truth = F.when(F.col("value") == "1", "TRUE").otherwise("FALSE")
    own_text = F.when(kind == "s", F.coalesce("string", F.lit(""))).when(kind == "inlineStr", F.col("inline")).when(kind == "b", truth).when(kind.isin("str", "e"), F.col("value")).otherwise(shown)
    status: Column = F.when(external, "unsupported_external").when(has & F.col("has_value"), "resolved").when(has, "fallback_formula")
    source: Column = F.when(external, "external_unsupported").when(has & F.col("has_value"), "cached_value").when(has, "formula_text")
    output = F.when(external, F.col("formula")).when(has & F.col("has_value"), shown).when(has, F.col("formula")).otherwise(own_text)
    raw = F.when(external, F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("formula"))).when(has & F.col("has_value"), F.col("value")).when(has, F.col("formula")).when(kind == "inlineStr", F.col("inline")).otherwise(F.col("value"))
    any_style = style["bold"] | style["italic"] | style["strike"] | style["underline"]
    alone = F.when(any_style & (own_text != ""), F.array(F.struct(own_text.alias("text"), *[style[f].alias(f) for f in package.FLAGS])))
    listed = F.when(kind == "s", F.col("string_runs")).when(kind == "inlineStr", F.col("runs"))
    runs = F.when(has, F.lit(None)).when(listed.isNotNull(), markdown.merge_runs(listed, style)).otherwise(alone)
    return c.select(
        BOOK, "sheet_index", "sheet_name", "ord", "address", "row", "col", F.when(has & (kind == "") , F.lit("formula")).otherwise(kind).alias("value_type"),
        raw.alias("raw_value"), output.alias("output_value"), "formula", status.alias("resolution_status"), source.alias("resolution_source"),
        F.when(has & ~F.col("has_value"), "absent").when(has & (F.col("value") == ""), "present_empty").when(has, "present_nonempty").alias("cached_value_state"),
        "style_index", *[F.coalesce(F.col(f"s_{s}"), F.lit(False)).alias(s) for s in ("top", "bottom", "left", "right")],
        fmt.alias("num_fmt_id"), code.alias("format_code"), style.alias("text_style"), runs.alias("rich_text_runs"), "formula_type", "formula_ref", "hyperlink", F.col("s_shown").alias("shown"),
    )


def read(spark: SparkSession, path: str, shapes: bool = True, keep: str | None = None) -> Workbooks:
    """The workbooks under a path (any that Spark reads; a folder, a glob or a file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return from_files(spark, files, shapes, keep)


def from_files(spark: SparkSession, files: DataFrame, shapes: bool = True, keep: str | None = None) -> Workbooks:
    """Workbooks from ``files(path, content)``; what they hold is written by kind to ``keep`` or the shared folder."""
    where = keep or f"{shared_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    scan(files, shapes).write.partitionBy("kind").parquet(where)
    return Workbooks(spark, spark.read.schema(f"{ROW}, kind string").parquet(where), where)


def trimmed(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))
