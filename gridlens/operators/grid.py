"""Tables on sheets: borders, components, scoring, trimming, pruning, matrices.

Per-cell and per-row work is relational (joins with neighbours, aggregates, grids from sequences).  Finding tables walks a
sheet's cells in order, so it runs on one sheet at a time, in Arrow batches: the sheet is the unit of parallelism.

Cells: workbook, sheet_index, row, col, value (the shown text), top, bottom, left, right (own borders).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHEET = ("workbook", "sheet_index")
SIDES = ("top", "bottom", "left", "right")
MERGED_LEFT, MERGED_UP = "[MERGED←]", "[MERGED↑]"
_PLAIN_NUMBER = re.compile(r"^\d+(?:\.\d+)?$", re.A)


@dataclass(frozen=True)
class Weights:
    """Scores and thresholds of a table candidate.  Fixed values."""

    min_grid: int = 2
    borders: int = 3
    dense: int = 2
    very_dense: int = 1
    header: int = 2
    many_merges: int = -1
    prose: int = -2
    accept: int = 4


def has_border(prefix: str = "") -> Column:
    return F.col(f"{prefix}top") | F.col(f"{prefix}bottom") | F.col(f"{prefix}left") | F.col(f"{prefix}right")


def normalized_borders(cells: DataFrame, keys: Iterable[str] = SHEET) -> DataFrame:
    """``cells`` with n_top, n_bottom, n_left, n_right: an edge exists if the cell or its neighbour owns it.

    Each cell lends its edges to its neighbours: one union and one aggregation by place instead of four joins.
    """
    keys = list(keys)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = cells.select(*keys, "row", "col", *[flag(s).alias(s) for s in SIDES])
    no = F.lit(False)
    lend = F.array(
        F.struct(F.col("row").alias("row"), F.col("col").alias("col"), *[F.col(s).alias(s) for s in SIDES], F.lit(True).alias("here")),
        F.struct((F.col("row") + 1).alias("row"), F.col("col").alias("col"), F.col("bottom").alias("top"), no.alias("bottom"), no.alias("left"), no.alias("right"), no.alias("here")),
        F.struct((F.col("row") - 1).alias("row"), F.col("col").alias("col"), no.alias("top"), F.col("top").alias("bottom"), no.alias("left"), no.alias("right"), no.alias("here")),
        F.struct(F.col("row").alias("row"), (F.col("col") + 1).alias("col"), no.alias("top"), no.alias("bottom"), F.col("right").alias("left"), no.alias("right"), no.alias("here")),
        F.struct(F.col("row").alias("row"), (F.col("col") - 1).alias("col"), no.alias("top"), no.alias("bottom"), no.alias("left"), F.col("left").alias("right"), no.alias("here")),
    )
    lent = own.select(*keys, F.explode(lend).alias("e")).select(*keys, "e.*")
    placed = lent.groupBy(*keys, "row", "col").agg(*[F.bool_or(s).alias(f"n_{s}") for s in SIDES], F.bool_or("here").alias("present"))
    return placed.join(cells, [*keys, "row", "col"], "left")


def edge_stats(cells: DataFrame, keys: Iterable[str] = SHEET) -> DataFrame:
    """Per sheet row: non_empty, bordered, raw_bordered, tops, bottoms, longest text."""
    keys = list(keys)
    n = normalized_borders(cells, keys)
    text = F.trim(F.coalesce("value", F.lit("")))
    raw = F.coalesce(has_border(), F.lit(False))
    return n.groupBy(*keys, "row").agg(
        F.count_if(text != "").alias("non_empty"), F.count_if(has_border("n_")).alias("bordered"), F.count_if(raw).alias("raw_bordered"),
        F.count_if(F.col("n_top")).alias("tops"), F.count_if(F.col("n_bottom")).alias("bottoms"), F.max(F.length(text)).alias("longest"),
    )


# ---------------------------------------------------------------- one sheet


@dataclass(frozen=True)
class CellBox:
    text: str
    top: bool
    bottom: bool
    left: bool
    right: bool

    @property
    def bordered(self) -> bool:
        return self.top or self.bottom or self.left or self.right


class Sheet:
    def __init__(self, cells: dict[tuple[int, int], CellBox], merges: list[tuple[int, int, int, int]], weights: Weights = Weights()):
        self.cells, self.merges, self.weights = cells, merges, weights

    @cached_property
    def lines(self) -> dict[str, dict[int, list[int]]]:
        """By what to count and by row, the sorted columns: ``filled`` and ``raw`` (cells with text, with own lines), ``tops``,
        ``bottoms``, ``lefts``, ``rights`` (places with that edge, owned by it or by its neighbour) and ``bordered`` (any)."""
        at: dict[str, set[tuple[int, int]]] = {k: set() for k in ("filled", "raw", "tops", "bottoms", "lefts", "rights")}
        for (r, c), x in self.cells.items():
            if x.text:
                at["filled"].add((r, c))
            if x.bordered:
                at["raw"].add((r, c))
            for side, own, other, place in ((x.top, "tops", "bottoms", (r - 1, c)), (x.bottom, "bottoms", "tops", (r + 1, c)), (x.left, "lefts", "rights", (r, c - 1)), (x.right, "rights", "lefts", (r, c + 1))):
                if side:
                    at[own].add((r, c))
                    at[other].add(place)
        at["bordered"] = at["tops"] | at["bottoms"] | at["lefts"] | at["rights"]
        out: dict[str, dict[int, list[int]]] = {}
        for kind, places in at.items():
            rows = out.setdefault(kind, {})
            for r, c in sorted(places):
                rows.setdefault(r, []).append(c)
        return out

    def columns(self, kind: str, r: int, c1: int, c2: int) -> list[int]:
        own = self.lines[kind].get(r, [])
        return own[bisect_left(own, c1) : bisect_right(own, c2)]

    def edge(self, r: int, c: int, side: str) -> bool:
        return bool(self.columns(f"{side}s", r, c, c))

    def joined(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether borders join two neighbours: a line that runs along both, or an edge that both own."""
        (a, b) = min(a, b), max(a, b)
        x, y = self.cells[a], self.cells[b]
        if a[0] == b[0]:
            return x.top and y.top or x.bottom and y.bottom or x.right and y.left
        return x.left and y.left or x.right and y.right or x.bottom and y.top

    def components(self, seeds: list[tuple[int, int]], by_border: bool = False) -> list[list[tuple[int, int]]]:
        """Groups of neighbours, in the order of their first seeds."""
        left, out = dict.fromkeys(seeds), []
        while left:
            first = next(iter(left))
            del left[first]
            group = [first]
            for p in group:  # grows while it is read
                for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
                    if q in left and (not by_border or self.joined(p, q)):
                        del left[q]
                        group.append(q)
            out.append(group)
        return out

    def candidate(self, group: list[tuple[int, int]], from_borders: bool):
        """(box, score, reasons) of a group that is a table, else None.  The score is that of the untrimmed box."""
        w, box = self.weights, bounds(group)
        r1, c1, r2, c2 = box
        rows, cols, size = r2 - r1 + 1, c2 - c1 + 1, area(box)
        if rows < 2 or cols < 2:
            return None
        texts = [self.cells[p].text for p in group if self.cells[p].text]
        density = len(texts) / size
        header = sum(p[0] == r1 and 0 < len(self.cells[p].text) <= 24 and not _PLAIN_NUMBER.match(self.cells[p].text) for p in group)
        merges = sum(not (m[2] < r1 or m[0] > r2 or m[3] < c1 or m[1] > c2) for m in self.merges)
        if merges >= 2 and density < 0.25 and (header < 2 if from_borders else rows <= 6 and cols >= 10):
            return None
        bordered = sum(len(self.columns("bordered", r, c1, c2)) for r in range(r1, r2 + 1))
        length = sum(map(len, texts)) / max(1, len(texts))
        tests = [
            (True, w.min_grid, "At least 2x2"),
            (bordered >= max(2, math.ceil(len(group) * 0.3)), w.borders, "Has borders"),
            (density >= 0.55, w.dense, "High density"),
            (density >= 0.8, w.very_dense, "Very high density"),
            (header >= 2, w.header, "Header-like first row"),
            (merges >= max(2, math.ceil(size * 0.08)), w.many_merges, "Many merged cells"),
            (length > 36 and density < 0.7, w.prose, "Mostly long prose"),
        ]
        score = sum(n for ok, n, _ in tests if ok)
        if score < w.accept:
            return None
        return self.trimmed(box), score, [f"{why} ({n:+d})" for ok, n, why in tests if ok]

    def row_stats(self, r: int, c1: int, c2: int) -> dict[str, int]:
        out = {k: len(self.columns(k, r, c1, c2)) for k in ("filled", "bordered", "raw", "tops", "bottoms")}
        return out | {"longest": max((len(self.cells[r, c].text) for c in self.columns("filled", r, c1, c2)), default=0)}

    def trimmed(self, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        """The box without title rows on top, what follows its last lined row, and notes below."""
        r1, c1, r2, c2 = box
        half = max(2, math.ceil((c2 - c1 + 1) * 0.5))
        stats = {}
        at = lambda r: stats.get(r) or stats.setdefault(r, self.row_stats(r, c1, c2))
        lined = lambda above, row: above["bordered"] >= half or above["bottoms"] >= half or row["tops"] >= half
        bare = lambda row: row["raw"] == 0 and row["filled"] <= 1
        while r2 > r1 and at(r1)["filled"] <= 2 and at(r1)["raw"] == 0 and at(r1 + 1)["bordered"] >= half and at(r1 + 1)["filled"] >= half:
            r1 += 1
        r2 = next((r - 1 for r in range(r1 + 1, r2 + 1) if lined(at(r - 1), at(r)) and bare(at(r))), r2)
        while r2 > r1 and bare(at(r2)) and (lined(at(r2 - 1), at(r2)) or at(r2)["longest"] >= 12 and at(r2 - 1)["filled"] >= half):
            r2 -= 1
        return r1, c1, r2, c2

    def tables(self, mode: str = "balanced") -> list[tuple[tuple[int, int, int, int], int, list[str]]]:
        """(box, score, reasons) by first row and column.  Modes: ``balanced``, or ``border`` for bordered tables alone."""
        found: dict[tuple, tuple] = {}
        boxes: list[tuple] = []  # of found, sorted

        def add(got):
            if got and got[0] not in found:
                found[got[0]] = got
                insort(boxes, got[0])

        for g in self.components([p for p, x in self.cells.items() if x.bordered], mode == "border"):
            add(self.candidate(g, True))
        if mode != "border":
            for g in self.components([p for p, x in self.cells.items() if x.bordered or x.text]):
                box = bounds(g)
                if not filled_up(box, inside(boxes, box)):
                    add(self.candidate(g, False))
        return sorted(pruned(list(found.values())), key=lambda t: t[0][:2])


def bounds(group: Iterable[tuple[int, int]]) -> tuple[int, int, int, int]:
    rows, cols = zip(*group, strict=True)
    return min(rows), min(cols), max(rows), max(cols)


def area(b: tuple[int, int, int, int]) -> int:
    return max(1, (b[2] - b[0] + 1) * (b[3] - b[1] + 1))


def within(inner, outer) -> bool:
    return inner[0] >= outer[0] and inner[1] >= outer[1] and inner[2] <= outer[2] and inner[3] <= outer[3]


def inside(boxes: list[tuple], outer: tuple) -> list[tuple]:
    """Those of the sorted boxes that lie in a box."""
    return [b for b in boxes[bisect_left(boxes, outer[:1]) : bisect_left(boxes, (outer[2] + 1,))] if within(b, outer)]


def filled_up(box: tuple, smaller: list[tuple]) -> bool:
    """Whether one box takes 40 % of another's area, or several 60 % together."""
    areas = [area(b) for b in smaller]
    return any(a >= area(box) * 0.4 for a in areas) or len(areas) >= 2 and sum(areas) >= area(box) * 0.6


def pruned(found: list[tuple]) -> list[tuple]:
    """Without the candidates that smaller ones inside fill up."""
    boxes = sorted(t[0] for t in found)
    return [t for t in found if not filled_up(t[0], [b for b in inside(boxes, t[0]) if area(b) < area(t[0])])]


TABLES = "workbook string, sheet_index int, start_row int, start_col int, end_row int, end_col int, score int, reasons array<string>"


def detect_tables(cells: DataFrame, merges: DataFrame | None = None, mode: str = "balanced", weights: Weights = Weights()) -> DataFrame:
    """One row a table: workbook, sheet_index, its box, score, reasons.  A sheet is held whole by one task."""
    rows = cells.select(*SHEET, F.col("ord").cast("long") if "ord" in cells.columns else F.lit(None).cast("long").alias("ord"), "row", "col", "value", *SIDES)
    blank = F.lit(None)
    rows = rows.withColumns({"end_row": blank.cast("int"), "end_col": blank.cast("int")})
    if merges is not None:
        no = F.lit(False)
        rows = rows.unionByName(merges.select(*SHEET, blank.cast("long").alias("ord"), F.col("start_row").alias("row"), F.col("start_col").alias("col"), blank.cast("string").alias("value"), *[no.alias(s) for s in SIDES], "end_row", "end_col"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        book, index = f["workbook"].iat[0], int(f["sheet_index"].iat[0])
        own = f[f["end_row"].isna()].sort_values(["ord", "row", "col"], kind="stable")
        m = f[f["end_row"].notna()]
        merged = [tuple(map(int, x)) for x in m[["row", "col", "end_row", "end_col"]].itertuples(index=False)]
        places = {(r.row, r.col): CellBox((r.value or "").strip(), *(bool(getattr(r, s)) for s in SIDES)) for r in own.itertuples(index=False)}
        out = [(book, index, *box, score, why) for box, score, why in Sheet(places, merged, weights).tables(mode)]
        return pd.DataFrame(out, columns=["workbook", "sheet_index", "start_row", "start_col", "end_row", "end_col", "score", "reasons"])

    return rows.groupBy(*SHEET).applyInPandas(run, TABLES)


# ---------------------------------------------------------------- matrices


def dense_grid(tables: DataFrame) -> DataFrame:
    """A row for every place of every table: the table's columns and row, col."""
    rows = tables.withColumn("row", F.explode(F.sequence("start_row", "end_row")))
    return rows.withColumn("col", F.explode(F.sequence("start_col", "end_col")))


def merge_tokens(grid: DataFrame, merges: DataFrame, keys: Iterable[str] = SHEET) -> DataFrame:
    """``grid(*keys, row, col, value)`` with the places that a merge covers marked: left in the anchor's row, else up.  Of
    overlapping merges the last (``ord``) counts.  Merges are exploded to their places: an equi-join, no range join."""
    keys = list(keys)
    place = merges.withColumn("row", F.explode(F.sequence("start_row", "end_row"))).withColumn("col", F.explode(F.sequence("start_col", "end_col")))
    place = place.where((F.col("row") != F.col("start_row")) | (F.col("col") != F.col("start_col")))
    token = F.when(F.col("row") == F.col("start_row"), MERGED_LEFT).otherwise(MERGED_UP)
    place = place.groupBy(*keys, "row", "col").agg(F.max_by(token, "ord").alias("token"))
    return grid.join(place, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("token", "value")).drop("token")


def meaningful(value: Column) -> Column:
    t = F.trim(F.coalesce(value, F.lit("")))
    return (t != "") & ~t.isin(MERGED_LEFT, MERGED_UP)


def matrices(tables: DataFrame, cells: DataFrame, merges: DataFrame, drop_empty_rows: bool = True, drop_empty_columns: bool = True) -> DataFrame:
    """``tables`` with ``matrix array<array<string>>`` of the values in cells(*SHEET, row, col, value), merges marked, empty
    rows and columns left out.  Tables without a matrix are left out."""
    box = ["start_row", "start_col", "end_row", "end_col"]
    key = [*SHEET, *box]
    grid = dense_grid(tables.select(*key)).join(cells.select(*SHEET, "row", "col", F.trim("value").alias("value")), [*SHEET, "row", "col"], "left")
    m = merges.select(*SHEET, *[F.col(b).alias(b) for b in box], "ord")
    place = m.withColumn("row", F.explode(F.sequence("start_row", "end_row"))).withColumn("col", F.explode(F.sequence("start_col", "end_col")))
    place = place.where((F.col("row") != F.col("start_row")) | (F.col("col") != F.col("start_col")))
    token = F.when(F.col("row") == F.col("start_row"), MERGED_LEFT).otherwise(MERGED_UP)
    place = place.groupBy(*SHEET, "row", "col").agg(F.max_by(token, "ord").alias("token"))
    grid = grid.join(place, [*SHEET, "row", "col"], "left").withColumn("value", F.coalesce("token", "value", F.lit("")))
    own = Window.partitionBy(*key)
    grid = grid.withColumns({"row_used": F.max(meaningful(F.col("value"))).over(own.partitionBy(*key, "row")), "col_used": F.max(meaningful(F.col("value"))).over(own.partitionBy(*key, "col"))})
    if drop_empty_rows:
        grid = grid.where("row_used")
    if drop_empty_columns:
        grid = grid.where("col_used")
    rows = grid.groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    made = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", F.transform("cells", lambda c: c["value"]).alias("cells")))).alias("rows"))
    return tables.join(made.select(*key, F.transform("rows", lambda r: r["cells"]).alias("matrix")), key)
