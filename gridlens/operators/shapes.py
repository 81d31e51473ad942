"""Shapes on sheets: neighbours within a gap, and the blocks that they form.

Boxes are dealt to squares of one gap's size by their corners' ranges, so the distance join is an equi-join on squares.
It goes by a shuffle: Spark takes boxes times squares for no larger than the boxes' file, and would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import CELL_HEIGHT, CELL_WIDTH
from .grid import SHEET

GAP_X, GAP_Y = 4 * CELL_WIDTH, 6 * CELL_HEIGHT


def gap_edges(shapes: DataFrame, keys: Iterable[str] = SHEET, gap_x: int = GAP_X, gap_y: int = GAP_Y) -> DataFrame:
    """(*keys, a, b) with a < b for shapes(*keys, no, left, top, right, bottom) no farther apart than the gaps."""
    keys = list(keys)
    square = lambda low, high, size: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    box = shapes.select(*keys, "no", "left", "top", "right", "bottom")
    own = box.withColumn("sx", square(F.col("left"), F.col("right"), gap_x)).withColumn("sy", square(F.col("top"), F.col("bottom"), gap_y))
    far = box.withColumn("sx", square(F.col("left") - gap_x, F.col("right") + gap_x, gap_x)).withColumn("sy", square(F.col("top") - gap_y, F.col("bottom") + gap_y, gap_y))
    far = far.select(*keys, "sx", "sy", *[F.col(c).alias(f"o_{c}") for c in ("no", "left", "top", "right", "bottom")])
    dx = F.greatest(F.lit(0), F.col("o_left") - F.col("right"), F.col("left") - F.col("o_right"))
    dy = F.greatest(F.lit(0), F.col("o_top") - F.col("bottom"), F.col("top") - F.col("o_bottom"))
    # a pair shares many squares: it counts in the least of them, seen from its lesser number
    first = (F.col("sx") == F.floor(F.greatest(F.col("left"), F.col("o_left") - gap_x) / gap_x)) & (F.col("sy") == F.floor(F.greatest(F.col("top"), F.col("o_top") - gap_y) / gap_y))
    near = own.join(far.hint("merge"), [*keys, "sx", "sy"]).where((F.col("no") < F.col("o_no")) & first & (dx <= gap_x) & (dy <= gap_y))
    return near.select(*keys, F.col("no").alias("a"), F.col("o_no").alias("b"))


def groups(nodes: DataFrame, edges: DataFrame, keys: Iterable[str] = SHEET, node: str = "no") -> DataFrame:
    """(*keys, node, component): least node reachable.  Keys are sheets: one task takes a sheet's nodes and edges."""
    keys = list(keys)
    both = nodes.select(*keys, F.col(node).cast("long").alias("a"), F.col(node).cast("long").alias("b")).union(edges.select(*keys, F.col("a").cast("long"), F.col("b").cast("long")))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        parent = {int(x): int(x) for x in f["a"]}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        out = pd.DataFrame({node: list(parent), "component": [root(x) for x in parent]})
        for k in keys:
            out[k] = f[k].iat[0]
        return out

    return both.groupBy(*keys).applyInPandas(run, ", ".join([f"{node} long", "component long", *[f"{k} {kinds[k]}" for k in keys]]))


def blocks(shapes: DataFrame, keys: Iterable[str] = SHEET) -> DataFrame:
    """One row a group of near shapes: *keys, its cells' box and the shapes' numbers."""
    keys = list(keys)
    own = groups(shapes, gap_edges(shapes, keys), keys)
    at = shapes.join(own.hint("merge"), [*keys, "no"])
    cell = lambda c, size: (F.floor(c / size) + 1).cast("int")
    out = at.groupBy(*keys, "component").agg(
        cell(F.min("top"), CELL_HEIGHT).alias("start_row"), cell(F.min("left"), CELL_WIDTH).alias("start_col"),
        cell(F.greatest(F.max("bottom"), F.lit(0)), CELL_HEIGHT).alias("end_row"), cell(F.greatest(F.max("right"), F.lit(0)), CELL_WIDTH).alias("end_col"),
        F.sort_array(F.collect_list("no")).alias("shapes"),
    )
    return out.drop("component")
