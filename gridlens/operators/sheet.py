"""Sheets as Markdown: cells, tables, narrative, sections, charts, shapes and images put in reading order."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.address import address_of
from ..sources.package import raw_tree
from ..sources.workbook import Workbooks, book_title
from . import grid, layout, shapes
from .grid import SHEET

EMPTY_BODY = "_No extractable body content was found._"


@dataclass(frozen=True)
class Options:
    """How sheets are rendered."""

    first_row_is_header: bool = True
    trim_text: bool = True
    remove_empty_rows: bool = True
    remove_empty_columns: bool = True
    shape_details: bool = True
    output_mode: str = "display"  # display, raw, both
    formatting: str = "plain"  # plain, github
    table_detection: str = "balanced"  # balanced, border

    def __post_init__(self):
        for name, legal in (("output_mode", ("display", "raw", "both")), ("formatting", ("plain", "github")), ("table_detection", ("balanced", "border"))):
            if getattr(self, name) not in legal:
                raise ValueError(f"{name} must be one of {', '.join(legal)}")


def cell_markdown(cells: DataFrame, sheets: DataFrame, options: Options = Options()) -> DataFrame:
    """``cells`` with ``markdown``: the shown text by output mode and formatting, with its link."""
    shown, raw = markdown.compact(F.col("output_value")), markdown.compact(F.col("raw_value"))
    if options.formatting == "github":
        linked = F.col("hyperlink").isNotNull()
        plain_line = lambda s: F.struct(s["text"].alias("text"), s["bold"].alias("bold"), s["italic"].alias("italic"), s["strike"].alias("strike"), (s["underline"] & ~linked).alias("underline"))
        style = F.struct(*[F.col("text_style")[f].alias(f) for f in ("bold", "italic", "strike")], (F.col("text_style")["underline"] & ~linked).alias("underline"))
        text = markdown.github_text(F.col("output_value"), style, F.transform("rich_text_runs", plain_line))
    else:
        text = shown
    note = F.concat(F.lit("[raw="), raw, F.lit("]"))
    differs = (raw != "") & (raw != shown)
    label = {"raw": F.when(raw != "", raw).otherwise(shown), "both": F.when(differs, text).otherwise(F.when(text != "", text).otherwise(raw)), "display": text}[options.output_mode]
    names = sheets.select("workbook", F.col("name").alias("target_sheet"), F.lit(True).alias("known"))
    sheet, ref = markdown.internal_target(F.coalesce(F.nullif(F.col("hyperlink.location"), F.lit("")), F.col("hyperlink.target")), F.col("sheet_name"))
    inside = F.col("hyperlink.kind") == "internal"
    c = cells.withColumns({"label": label, "target_sheet": F.when(inside, sheet), "target_ref": F.when(inside, ref), "note": note, "differs": differs})
    c = c.join(names, ["workbook", "target_sheet"], "left")
    out: Column = F.when(F.col("hyperlink").isNull() | (F.trim("label") == ""), F.col("label"))
    out = out.when(F.col("hyperlink.kind") == "external", markdown.link(F.trim("label"), F.col("hyperlink.target")))
    out = out.otherwise(markdown.internal_link(F.trim("label"), F.col("target_sheet"), F.col("target_ref"), F.coalesce("known", F.lit(False))))
    if options.output_mode == "both":
        out = F.when(F.col("differs"), F.when(F.col("label") != "", F.concat(out, F.lit(" "), F.col("note"))).otherwise(F.col("note"))).otherwise(out)
    return c.withColumn("markdown", out).drop("label", "target_sheet", "target_ref", "note", "differs", "known")


def number3(no: Column) -> Column:
    return F.lpad(no.cast("string"), 3, "0")


def box_text(r1: str, c1: str, r2: str, c2: str) -> Column:
    return F.concat(address_of(F.col(r1), F.col(c1)), F.lit("-"), address_of(F.col(r2), F.col(c2)))


def raw_lines(entries: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(raw_tree([dict(x) for x in e])) for e in s], dtype=object)

    return run(entries)


def _list(df: DataFrame, order: Column, text: Column, name: str, sep: str = "\n\n") -> DataFrame:
    """Texts of each sheet joined in order."""
    rows = df.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("x"))
    return rows.select(*SHEET, F.array_join(F.transform("x", lambda r: r["t"]), sep).alias(name))


def image_section(images: DataFrame) -> DataFrame:
    text = F.concat(F.lit("### Image: "), number3(F.col("no")), F.lit(" ("), F.col("anchor"), F.lit(")\n- File: "), F.col("path"), F.lit("\n\n!["), F.col("filename"), F.lit("]("), F.col("path"), F.lit(")"))
    return _list(images, F.col("no"), text, "images_text")


def chart_section(charts: DataFrame) -> DataFrame:
    part = lambda label, value: F.when(value != "", F.concat(F.lit(f"    - {label}: "), value))
    line = lambda s: F.concat_ws("\n", F.concat(F.lit("  - "), s["name"]), F.when(s["axis"] == "secondary", F.lit("    - Axis: secondary")), part("categories", s["categories"]), part("values", s["values"]))
    series = F.when(F.size("series") > 0, F.concat(F.lit("- Series:\n"), F.array_join(F.transform("series", line), "\n")))
    head = F.concat(F.lit("### Chart: "), number3(F.col("no")), F.lit(" ("), F.col("anchor"), F.lit(")"))
    text = F.concat_ws("\n", head, F.concat(F.lit("- Title: "), F.when(F.col("title") != "", F.col("title")).otherwise("(none)")), F.concat(F.lit("- Type: "), F.col("type")), series)
    return _list(charts, F.col("no"), text, "charts_text")


def shape_section(drawn: DataFrame) -> DataFrame:
    number = number3(F.col("no"))
    svg = F.when(F.col("svg_path").isNotNull(), F.concat(F.lit("- SVG: "), F.col("svg_path"), F.lit("\n\n!["), F.col("svg_file"), F.lit("]("), F.col("svg_path"), F.lit(")")))
    detail = F.concat_ws("\n", F.concat(F.lit("#### Shape: "), number, F.lit(" ("), F.col("anchor"), F.lit(")")), F.nullif(raw_lines(F.col("raw_entries")), F.lit("")), svg)
    detail = drawn.select(*SHEET, "no", detail.alias("detail"))
    boxes = shapes.blocks(drawn)
    boxes = layout.numbered(boxes, SHEET, ["start_row", "start_col", F.col("shapes")[0]], "block")
    box = ("start_row", "start_col", "end_row", "end_col")
    at = boxes.withColumn("no", F.explode("shapes")).join(detail, [*SHEET, "no"])
    at = at.groupBy(*SHEET, "block", *box).agg(F.array_sort(F.collect_list(F.struct("no", "detail"))).alias("x"))
    names = F.array_join(F.transform("x", lambda s: F.concat(F.lit("Shape "), number3(s["no"]))), ", ")
    head = F.concat(F.lit("### Shape Block: "), F.col("block"), F.lit(" ("), box_text(*box), F.lit(")\n- Shapes: "), names, F.lit("\n- anchorRange: "), box_text(*box))
    text = F.concat_ws("\n\n", head, F.array_join(F.transform("x", lambda s: s["detail"]), "\n\n"))
    return _list(at, F.col("block"), text, "shapes_text")


def sheet_markdown(books: Workbooks, options: Options = Options()) -> DataFrame:
    """One row a sheet: workbook, sheet_index, sheet_name, file_name, markdown, and the counters of its summary."""
    from .. import export

    cells = books.keep(cell_markdown(books.cells, books.sheets, options), "text")
    boxes = books.cells.select(*SHEET, "ord", "row", "col", F.col("output_value").alias("value"), *grid.SIDES)
    tables = books.keep(grid.detect_tables(boxes, books.merges, options.table_detection), "tables")
    box = ("start_row", "start_col", "end_row", "end_col")
    shown = cells.select(*SHEET, "row", "col", F.col("markdown").alias("value"))
    filled = grid.matrices(tables, shown, books.merges, options.remove_empty_rows, options.remove_empty_columns)
    filled = layout.numbered(filled, SHEET, ["start_row", "start_col"], "no")
    title = F.concat(F.lit("### Table: "), F.col("no"), F.lit(" ("), box_text(*box), F.lit(")\n\n"))
    table_texts = filled.select(*SHEET, F.col("start_row").alias("sort_row"), F.col("start_col").alias("sort_col"), F.lit(1).alias("kind"), F.concat(title, markdown.table(F.col("matrix"), options.first_row_is_header)).alias("text"))
    free = layout.outside(cells.where(F.coalesce("output_value", F.lit("")) != ""), tables).select(*SHEET, "row", "col", F.col("markdown").alias("value"))
    blocks = books.keep(layout.narrative_blocks(layout.row_segments(free)), "blocks")
    block_texts = blocks.select(*SHEET, F.col("start_row").alias("sort_row"), F.col("start_col").alias("sort_col"), F.lit(0).alias("kind"), layout.narrative_text(F.col("items")).alias("text"))
    point = lambda df: df.select(*SHEET, F.col("row").alias("start_row"), F.col("col").alias("start_col"), F.col("row").alias("end_row"), F.col("col").alias("end_col"))
    anchors = blocks.select(*SHEET, *box).union(tables.select(*SHEET, *box)).union(point(books.images)).union(point(books.charts))
    sections = layout.sections(anchors)
    inside = F.col("sort_row").between(F.col("start_row"), F.col("end_row")) & F.col("sort_col").between(F.col("start_col"), F.col("end_col"))
    placed = block_texts.union(table_texts).join(sections, [*SHEET]).where(inside)
    body = placed.groupBy(*SHEET, "section").agg(F.array_sort(F.collect_list(F.struct("sort_row", "sort_col", "kind", "text"))).alias("x"))
    body = body.withColumn("text", F.rtrim(F.array_join(F.transform("x", lambda r: F.rtrim(r["text"])), "\n\n"))).where("text <> ''")
    body = _list(body, F.col("section"), F.col("text"), "body", "\n\n---\n\n")
    out = books.sheets.select(*SHEET, F.col("name").alias("sheet_name"))
    parts = [body, chart_section(books.charts), image_section(books.images)]
    if options.shape_details:
        parts.append(shape_section(books.shapes))
    for p in parts:
        out = out.join(p, [*SHEET], "left")
    if not options.shape_details:
        out = out.withColumn("shapes_text", F.lit(None).cast("string"))
    part = lambda c: F.coalesce(F.concat(F.lit("\n\n"), F.col(c)), F.lit(""))
    text = F.concat(
        F.lit("# Book: "), book_title(F.col("workbook")), F.lit("\n\n## Sheet: "), F.col("sheet_name"), F.lit("\n\n"), F.coalesce("body", F.lit(EMPTY_BODY)),
        F.lit("\n"), part("charts_text"), F.lit("\n"), part("shapes_text"), F.lit("\n"), part("images_text"),
    )
    out = out.withColumn("markdown", text).drop("body", "charts_text", "shapes_text", "images_text")
    out = out.withColumn("file_name", export.file_name(F.col("workbook"), F.col("sheet_index"), F.col("sheet_name")))
    counted = {"sections": sections, "tables": tables, "narrative_blocks": blocks, "merges": books.merges, "images": books.images, "charts": books.charts, "cells": books.cells}
    each = None  # one aggregation for all counters
    for name, df in counted.items():
        part = df.select(*SHEET, F.lit(name).alias("counter"))
        each = part if each is None else each.union(part)
    out = out.join(each.groupBy(*SHEET).agg(*[F.count_if(F.col("counter") == n).alias(n) for n in counted]), [*SHEET], "left").fillna(0, list(counted))
    diagnostics = books.cells.where((F.col("formula") != "") & F.col("resolution_status").isNotNull()).groupBy(*SHEET).agg(
        *[F.count_if(F.col("resolution_status") == s).alias(f"formula_{s}") for s in ("resolved", "fallback_formula", "unsupported_external")]
    )
    out = out.join(diagnostics, [*SHEET], "left").fillna(0, [f"formula_{s}" for s in ("resolved", "fallback_formula", "unsupported_external")])
    score = F.struct("start_row", "start_col", box_text(*box).alias("range"), "score", "reasons")
    scores = tables.groupBy(*SHEET).agg(F.array_sort(F.collect_list(score)).alias("table_scores"))
    out = out.join(scores, [*SHEET], "left")
    modes = {"output_mode": options.output_mode, "formatting_mode": options.formatting, "table_detection_mode": options.table_detection}
    return books.keep(out.withColumns({k: F.lit(v) for k, v in modes.items()}), "sheets")
