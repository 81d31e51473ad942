"""Command line: one workbook to Markdown or an archive."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import export
from .operators.sheet import Options, sheet_markdown
from .scratch import clear
from .sources.workbook import read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridlens", description="Workbook to Markdown")
    p.add_argument("input")
    p.add_argument("--out")
    p.add_argument("--zip")
    p.add_argument("--encoding", default="utf-8", choices=export.ENCODINGS)
    p.add_argument("--bom", default="off", choices=("off", "on"))
    p.add_argument("--output-mode", default="display", choices=("display", "raw", "both"))
    p.add_argument("--formatting-mode", default="plain", choices=("plain", "github"))
    p.add_argument("--table-detection-mode", default="balanced", choices=("balanced", "border", "border-priority"))
    p.add_argument("--shape-details", default="exclude", choices=("include", "exclude"))
    p.add_argument("--include-shape-details", dest="shape_details", action="store_const", const="include")
    p.add_argument("--no-header-row", action="store_true")
    p.add_argument("--no-trim-text", action="store_true")
    p.add_argument("--keep-empty-rows", action="store_true")
    p.add_argument("--keep-empty-columns", action="store_true")
    p.add_argument("--summary", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> Options:
    return Options(
        first_row_is_header=not a.no_header_row, trim_text=not a.no_trim_text, remove_empty_rows=not a.keep_empty_rows,
        remove_empty_columns=not a.keep_empty_columns, shape_details=a.shape_details == "include", output_mode=a.output_mode,
        formatting=a.formatting_mode, table_detection="border" if a.table_detection_mode.startswith("border") else "balanced",
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    name = Path(a.input).name
    given = spark
    try:
        if a.encoding == "shift_jis" and a.bom == "on":
            raise ValueError("BOM cannot be enabled for shift_jis.")
        if not Path(a.input).is_file():
            raise FileNotFoundError(a.input)
        spark = spark or SparkSession.builder.appName("gridlens").getOrCreate()
        books = read(spark, Path(a.input).resolve().as_uri())
        wrong = books.errors.first()
        if wrong:
            raise ValueError(wrong.message)
        sheets = sheet_markdown(books, options_of(a)).cache()
        if a.summary:
            for r in export.summary_text(sheets).orderBy("sheet_index").select("sheet_name", "summary").toLocalIterator():
                print(f"[{name}] {r.sheet_name}\n{r.summary}\n")
        if a.zip:
            row = export.archives(export.entries(sheets, books.images, books.shapes, a.encoding, a.bom)).first()
            _write(Path(a.zip), bytes(row.archive))
        if not a.zip or a.out:
            row = export.payload(sheets, a.encoding, a.bom).first()
            _write(Path(a.out or row.file_name), bytes(row.data))
        return 0
    except Exception as e:  # noqa: BLE001  one line for the user, whatever went wrong
        print(f"[{name}] failed: {e}", file=sys.stderr)
        return 1
    finally:
        if given is None and spark is not None:
            clear(spark)


def _write(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


if __name__ == "__main__":
    sys.exit(main())
