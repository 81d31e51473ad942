"""The public API: workbooks in, Markdown and archives out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import export
from .export import encode_text, mime_type, stored_zip
from .functions.address import cell as parse_cell
from .functions.address import column_number as letters_to_col
from .functions.address import letters as col_to_letters
from .functions.address import rectangle as parse_range
from .functions.address import shown as format_range
from .operators.grid import detect_tables, matrices, merge_tokens
from .operators.layout import narrative_blocks, row_segments, sections
from .operators.sheet import Options, sheet_markdown
from .sources.package import unzip as unzip_entries
from .sources.workbook import Workbooks, read


def parse_workbooks(spark: SparkSession, path: str, shapes: bool = True) -> Workbooks:
    return read(spark, path, shapes)


def convert(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """A row of Markdown and counters for each sheet of each workbook under the path."""
    return sheet_markdown(read(spark, path), options)


def convert_to_archives(spark: SparkSession, path: str, options: Options = Options(), encoding: str | None = None, bom: str | None = None) -> DataFrame:
    books = read(spark, path)
    return export.archives(export.entries(sheet_markdown(books, options), books.images, books.shapes, encoding, bom))


__all__ = [
    "Options", "Workbooks", "col_to_letters", "convert", "convert_to_archives", "detect_tables", "encode_text", "format_range",
    "letters_to_col", "matrices", "merge_tokens", "mime_type", "narrative_blocks", "parse_cell", "parse_range", "parse_workbooks",
    "row_segments", "sections", "sheet_markdown", "stored_zip", "unzip_entries",
]
