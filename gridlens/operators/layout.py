"""Reading order: row segments, narrative blocks, sections, numbering.

Segments and sections are gaps and islands over windows.  Narrative blocks compare with the first segment of the open
block, which no lag can see: a sheet's segments stream in order through one task, which numbers the blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown
from .grid import SHEET

COLUMN_GAP, ROW_GAP, INDENT, SECTION_GAP = 4, 1, 3, 4
ITEM = "struct<row:int,col:int,text:string,values:array<string>>"


def numbered(df: DataFrame, keys: Iterable[str], order: Iterable, name: str = "no", digits: int = 3) -> DataFrame:
    """``df`` with a counter from 1 in each group, padded with zeros."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.lpad(F.row_number().over(over).cast("string"), digits, "0"))


def row_segments(cells: DataFrame, keys: Iterable[str] = SHEET, gap: int = COLUMN_GAP) -> DataFrame:
    """``cells(*keys, row, col, value)`` joined to segments: a new one where the last filled column is more than ``gap``
    behind.  One row a segment: *keys, row, start_col, values, text."""
    keys = list(keys)
    filled = cells.withColumn("value", F.trim(F.coalesce("value", F.lit("")))).where("value <> ''")
    over = Window.partitionBy(*keys, "row").orderBy("col")
    new = F.coalesce(F.col("col") - F.lag("col").over(over) > gap, F.lit(True)).cast("int")
    filled = filled.withColumn("new", new).withColumn("segment", F.sum("new").over(over))
    out = filled.groupBy(*keys, "row", "segment").agg(F.min("col").alias("start_col"), F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]).alias("values"))
    return out.withColumn("text", F.array_join("values", " ")).drop("segment")


def narrative_blocks(segments: DataFrame, keys: Iterable[str] = SHEET, row_gap: int = ROW_GAP, indent: int = INDENT) -> DataFrame:
    """Blocks of segments in reading order: a new one after a row gap, or where a segment begins more than ``indent``
    columns from the block's first.  One row a block: *keys, block, start_row, start_col, end_row, end_col, items."""
    keys = list(keys)
    rows = segments.select(*keys, F.col("row").cast("int").alias("row"), F.col("start_col").cast("int").alias("col"), "text", "values")
    added = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sheet, block, last, first = None, 0, 0, 0
        for f in frames:
            numbers = []
            for *own, row, col in zip(*[f[k] for k in keys], f["row"], f["col"], strict=True):
                if own != sheet:
                    sheet, block, last, first = own, 1, row, col
                elif row - last > row_gap or abs(col - first) > indent:
                    block, first = block + 1, col
                last = row
                numbers.append(block)
            yield f.assign(block=numbers)

    told = rows.repartition(*keys).sortWithinPartitions(*keys, "row", "col").mapInPandas(fold, added)
    told = told.select(*keys, "block", F.struct("row", "col", "text", "values").alias("item"))
    out = told.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return out.select(
        *keys, "block", F.col("items")[0]["row"].alias("start_row"), F.col("items")[0]["col"].alias("start_col"),
        F.element_at("items", -1)["row"].alias("end_row"), F.array_max(F.transform("items", lambda i: i["col"])).alias("end_col"), "items",
    )


def sections(anchors: DataFrame, keys: Iterable[str] = SHEET, gap: int = SECTION_GAP) -> DataFrame:
    """``anchors(*keys, start_row, start_col, end_row, end_col)`` grouped where the start lies more than ``gap`` rows below
    all that came before: *keys, section and its box."""
    keys = list(keys)
    over = Window.partitionBy(*keys).orderBy("start_row", "start_col", "end_row", "end_col")
    reach = F.max("end_row").over(over.rowsBetween(Window.unboundedPreceding, -1))
    a = anchors.withColumn("new", F.coalesce(F.col("start_row") - reach > gap, F.lit(True)).cast("int"))
    a = a.withColumn("section", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return a.groupBy(*keys, "section").agg(F.min("start_row").alias("start_row"), F.min("start_col").alias("start_col"), F.max("end_row").alias("end_row"), F.max("end_col").alias("end_col"))


def outside(cells: DataFrame, tables: DataFrame, keys: Iterable[str] = SHEET) -> DataFrame:
    """The cells that no table covers."""
    keys = list(keys)
    t = tables.select(*[F.col(k).alias(f"t_{k}") for k in keys], "start_row", "start_col", "end_row", "end_col")
    inside = F.col("row").between(F.col("start_row"), F.col("end_row")) & F.col("col").between(F.col("start_col"), F.col("end_col"))
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"t_{k}"))
    return cells.join(t, inside, "left_anti")


def narrative_text(items: Column) -> Column:
    """A block's Markdown: an item followed by deeper ones is a heading over their list, others are paragraphs."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("list"), F.lit(-1).alias("head"))
    at = F.transform(items, lambda x, i: F.struct(x.alias("item"), F.try_element_at(items, i + 2)["col"].alias("next")))

    def step(s: Column, x: Column) -> Column:
        item, col = x["item"], x["item"]["col"]
        under = (s["head"] >= 0) & (col > s["head"])
        line = F.concat(F.lit("- "), markdown.list_item(item["text"]))
        # a list that ends is written out before what follows
        closed = F.when((s["list"] != "") & ~under, F.concat(s["done"], F.array(s["list"]))).otherwise(s["done"])
        opens = ~under & (x["next"] > col)
        text = F.when(opens, F.concat(F.lit("### "), markdown.heading(item["text"]))).otherwise(markdown.normalize(item["text"]))
        done = F.when(under, s["done"]).otherwise(F.concat(closed, F.array(text)))
        lines = F.when(under, F.concat_ws("\n", F.nullif(s["list"], F.lit("")), line)).otherwise("")
        head = F.when(under, s["head"]).otherwise(F.when(opens, col).otherwise(F.lit(-1)))
        return F.struct(done.alias("done"), lines.alias("list"), head.cast("int").alias("head"))

    end = lambda s: F.array_join(F.when(s["list"] != "", F.concat(s["done"], F.array(s["list"]))).otherwise(s["done"]), "\n\n")
    return F.aggregate(at, state, step, end)


def is_heading_block(items: Column) -> Column:
    """Whether a block opens with a heading: its second item lies deeper than its first."""
    return F.coalesce(F.try_element_at(items, F.lit(2))["col"] > F.try_element_at(items, F.lit(1))["col"], F.lit(False))
