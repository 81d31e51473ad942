"""What leaves the engine: combined Markdown, encoded bytes, stored archives, summaries, file names."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.coerce import BLANKS
from .operators.grid import SHEET
from .sources.workbook import book_title

#: Byte order marks by encoding; Shift_JIS has none.  Fixed values.
MARKS = {"utf-8": "EFBBBF", "utf-16le": "FFFE", "utf-16be": "FEFF", "utf-32le": "FFFE0000", "utf-32be": "0000FEFF"}
ENCODINGS = (*MARKS, "shift_jis")
#: Time stamp of every entry, so that equal content gives equal archives.
STAMP = (2025, 1, 1, 0, 0, 0)


def encoding_name(value: str | None) -> str:
    name = (value or "utf-8").lower()
    if name not in ENCODINGS:
        raise ValueError(f"Unsupported encoding: {value}")
    return name


def with_mark(value: str | None) -> bool:
    mode = (value or "off").lower()
    if mode not in ("off", "on"):
        raise ValueError(f"Unsupported BOM mode: {value}")
    return mode == "on"


def mime_type(encoding: str | None = None) -> str:
    return f"text/markdown;charset={encoding_name(encoding)}"


def encode_text(text: str, encoding: str | None = None, bom: str | None = None) -> bytes:
    """A text's bytes; in Shift_JIS what it lacks becomes a question mark."""
    name, mark = encoding_name(encoding), with_mark(bom)
    if name == "shift_jis":
        if mark:
            raise ValueError("BOM cannot be enabled for shift_jis.")
        return text.encode("shift_jis", "replace")
    return (bytes.fromhex(MARKS[name]) if mark else b"") + text.encode(name, "surrogatepass")


def encoded(text: Column, encoding: str | None = None, bom: str | None = None) -> Column:
    """The same as a column: by Spark itself where it knows the encoding, else in Arrow batches."""
    name, mark = encoding_name(encoding), with_mark(bom)
    known = {"utf-8": "UTF-8", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
    if name in known:
        body = F.encode(text, known[name])
    else:
        if name == "shift_jis" and mark:
            raise ValueError("BOM cannot be enabled for shift_jis.")

        @F.pandas_udf("binary")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else encode_text(x, name) for x in s], dtype=object)

        body = run(text)
    return F.concat(F.unhex(F.lit(MARKS[name])), body) if mark else body


# ---------------------------------------------------------------- names


def _nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(text)


def safe_segment(value: Column, fallback: Column) -> Column:
    """A name that file systems take."""
    c = _nfkc(F.coalesce(value, F.lit("")))
    for pattern, new in ((r'[\\/:*?"<>|]', "_"), (f"[{BLANKS}]+", "_"), (r"[^\p{L}\p{N}._-]+", "_"), ("_+", "_"), ("^[_ .-]+|[_ .-]+$", "")):
        c = F.regexp_replace(c, pattern, new)
    return F.when(c == "", fallback).otherwise(c)


def file_name(workbook: Column, index: Column, sheet: Column) -> Column:
    """``book_001_sheet.md``."""
    book = safe_segment(F.regexp_replace(book_title(workbook), r"(?i)\.xlsx$", ""), F.lit("workbook"))
    return F.concat(book, F.lit("_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), safe_segment(sheet, F.concat(F.lit("Sheet"), index.cast("string"))), F.lit(".md"))


# ---------------------------------------------------------------- documents


def combined(sheets: DataFrame) -> DataFrame:
    """One row a workbook: file_name and content, its heading once and the sheets in order."""
    title = book_title(F.col("workbook"))
    heading = F.concat(F.lit("# Book: "), title)
    body = F.when(F.startswith(F.col("markdown"), heading), F.regexp_replace(F.substring("markdown", F.length(heading) + 1, F.length("markdown")), r"^\n+", "")).otherwise(F.col("markdown"))
    rows = sheets.select("workbook", "sheet_index", body.alias("body")).where(F.trim("body") != "")
    rows = rows.groupBy("workbook").agg(F.array_sort(F.collect_list(F.struct("sheet_index", "body"))).alias("x"))
    content = F.concat_ws("\n\n", heading, F.array_join(F.transform("x", lambda r: r["body"]), "\n\n"))
    return rows.select("workbook", F.concat(F.regexp_replace(title, r"(?i)\.xlsx$", ""), F.lit(".md")).alias("file_name"), content.alias("content"))


def payload(sheets: DataFrame, encoding: str | None = None, bom: str | None = None) -> DataFrame:
    """``combined`` with its bytes and MIME type; the text ends in a line end."""
    return combined(sheets).withColumn("data", encoded(F.concat(F.col("content"), F.lit("\n")), encoding, bom)).withColumn("mime_type", F.lit(mime_type(encoding)))


def entries(sheets: DataFrame, images: DataFrame, shapes: DataFrame, encoding: str | None = None, bom: str | None = None) -> DataFrame:
    """Files of each workbook's archive: (workbook, ord, name, data), the Markdown first, then by sheet images and drawings."""
    under = lambda c: F.concat(F.lit("output/"), F.col(c))
    order = lambda sheet, kind, no: F.struct(sheet.cast("int").alias("sheet"), F.lit(kind).alias("kind"), no.cast("int").alias("no"))
    text = payload(sheets, encoding, bom).select("workbook", order(F.lit(0), 0, F.lit(0)).alias("ord"), under("file_name").alias("name"), "data")
    pictures = images.select("workbook", order(F.col("sheet_index"), 1, F.col("no")).alias("ord"), under("path").alias("name"), "data")
    drawn = shapes.where("svg is not null").select("workbook", order(F.col("sheet_index"), 2, F.col("no")).alias("ord"), under("svg_path").alias("name"), F.encode("svg", "UTF-8").alias("data"))
    return text.unionByName(pictures).unionByName(drawn)


def stored_zip(files: Iterable[tuple[str, bytes]]) -> bytes:
    """An archive of uncompressed entries with fixed time stamps; equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, STAMP)
            info.create_system = 0
            z.writestr(info, data)
    return out.getvalue()


def archives(files: DataFrame) -> DataFrame:
    """(workbook, archive) of ``entries``: a workbook's files meet in one task, as they do in its archive."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o", key=lambda s: s.map(lambda r: (r["sheet"], r["kind"], r["no"])))
        return pd.DataFrame({"workbook": [f["workbook"].iat[0]], "archive": [stored_zip(zip(f["name"], map(bytes, f["data"]), strict=True))]})

    return files.withColumnRenamed("ord", "o").groupBy("workbook").applyInPandas(run, "workbook string, archive binary")


def summary_text(sheets: DataFrame) -> DataFrame:
    """``sheets`` (as from sheet_markdown) with ``summary``: counters, formula states, table scores."""
    fields = [
        ("Output file", "file_name"), ("Output mode", "output_mode"), ("Formatting mode", "formatting_mode"), ("Table detection mode", "table_detection_mode"),
        ("Sections", "sections"), ("Tables", "tables"), ("Narrative blocks", "narrative_blocks"), ("Merged ranges", "merges"), ("Images", "images"), ("Charts", "charts"),
        ("Analyzed cells", "cells"), *[(f"Formula {s}", f"formula_{s}") for s in ("resolved", "fallback_formula", "unsupported_external")],
    ]
    lines = [F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in fields]
    score = lambda t: F.concat(F.lit("Table candidate "), t["range"], F.lit(": score "), t["score"].cast("string"), F.lit(" / "), F.array_join(t["reasons"], ", "))
    scores = F.when(F.size("table_scores") > 0, F.array_join(F.transform("table_scores", score), "\n"))
    return sheets.withColumn("summary", F.concat_ws("\n", *lines, scores))


def formula_counts(cells: DataFrame) -> DataFrame:
    """Formulas of each sheet by state and source, the states in order of weight."""
    rank = F.when(F.col("status") == "unsupported_external", 0).when(F.col("status") == "fallback_formula", 1).otherwise(2)
    c = cells.where((F.col("formula") != "") & F.col("resolution_status").isNotNull())
    c = c.groupBy(*SHEET, F.col("resolution_status").alias("status"), F.col("resolution_source").alias("source")).agg(F.count("*").alias("n"))
    return c.orderBy(*SHEET, rank, "source")


def score_label(score: Column) -> Column:
    """strong from 7, candidate from 4, else weak."""
    return F.when(score >= 7, "strong").when(score >= 4, "candidate").otherwise("weak")


def function_histogram(formulas: DataFrame, formula: str = "formula", top: int = 12) -> DataFrame:
    """The functions that formulas call most: count down, name up."""
    from .plans.parser import function_names

    @F.pandas_udf("array<string>")
    def names(s: pd.Series) -> pd.Series:
        return s.map(lambda x: function_names(x or ""))

    return formulas.select(F.explode(names(formula)).alias("function")).groupBy("function").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "function").limit(top)
