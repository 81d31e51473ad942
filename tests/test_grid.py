import random

import pytest
from gridlens.operators import grid, layout, shapes
from gridlens.operators.grid import CellBox, Sheet
from pyspark.sql import functions as F


def sheet(rows, borders=(), merges=()):
    """Rows of text from A1; ``borders``: addresses (row, col) with all four lines, or "all"."""
    cells = {}
    for r, row in enumerate(rows, 1):
        for c, v in enumerate(row, 1):
            lined = borders == "all" or (r, c) in borders
            if v or lined:
                cells[r, c] = CellBox(v or "", lined, lined, lined, lined)
    return Sheet(cells, list(merges))


def boxes(s, mode="balanced"):
    return [t[0] for t in s.tables(mode)]


def test_dense_block_is_a_table():
    s = sheet([["name", "qty"], ["a", "1"], ["b", "2"]])
    ((box, score, why),) = s.tables()
    assert box == (1, 1, 3, 2) and score == 7 and why == ["At least 2x2 (+2)", "High density (+2)", "Very high density (+1)", "Header-like first row (+2)"]
    assert s.tables("border") == []


def test_borders_raise_the_score():
    s = sheet([["h1", "h2"], ["", ""]], "all")
    assert s.tables()[0][1] == 2 + 3 + 0 + 2


def test_too_small_or_sparse():
    assert boxes(sheet([["a", "b", "c"]])) == [] and boxes(sheet([["1", ""], ["", "2"]])) == []


def test_title_and_note_are_trimmed():
    lined = {(r, c) for r in (2, 3, 4) for c in (1, 2, 3)}
    rows = [["Title", "", ""], ["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"], ["a note that is long", "", ""]]
    assert boxes(sheet(rows, lined)) == [(2, 1, 4, 3)]


def test_prose_and_merges_cost():
    long = "w" * 60
    rows = [["", long, ""], [long, long, long], ["", long, ""]]
    assert boxes(sheet(rows)) == []
    many = sheet([["a", "b"], ["c", "d"]], "all", [(1, 1, 1, 2), (2, 1, 2, 2)])
    assert many.tables()[0][1] == 2 + 3 + 2 + 1 + 2 - 1


def test_border_mode_needs_shared_lines():
    cells = {(r, c): CellBox("x", True, True, True, True) for r in (1, 2) for c in (1, 2)}
    cells |= {(r, c): CellBox("y", False, False, False, True) for r in (1, 2) for c in (3,)}
    assert boxes(Sheet(cells, []), "border") == [(1, 1, 2, 2)]


def test_pruning():
    t = lambda *b: (b, 5, [])
    assert grid.pruned([t(1, 1, 10, 10), t(1, 1, 10, 5)]) == [t(1, 1, 10, 5)]
    assert grid.pruned([t(1, 1, 10, 10), t(1, 1, 3, 10), t(7, 1, 9, 10)]) == [t(1, 1, 3, 10), t(7, 1, 9, 10)]
    assert len(grid.pruned([t(1, 1, 10, 10), t(1, 1, 2, 2)])) == 2


def flood(seeds):
    """Components by repeated passes over all pairs."""
    label = {p: i for i, p in enumerate(seeds)}
    changed = True
    while changed:
        changed = False
        for p in seeds:
            for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)):
                if q in label and label[p] != label[q]:
                    label[p] = label[q] = min(label[p], label[q])
                    changed = True
    return sorted(sorted(p for p in seeds if label[p] == v) for v in set(label.values()))


@pytest.mark.parametrize("seed", range(8))
def test_components_on_random_grids(seed):
    rng = random.Random(seed)
    seeds = [(r, c) for r in range(1, 12) for c in range(1, 12) if rng.random() < 0.45]
    s = Sheet({p: CellBox("x", False, False, False, False) for p in seeds}, [])
    assert sorted(sorted(g) for g in s.components(seeds)) == flood(seeds)


def cells_df(spark, seed=1, n=14):
    rng = random.Random(seed)
    rows = [("w", 1, r, c, rng.choice(["", "a", "bb", None]), *[rng.random() < 0.3 for _ in range(4)]) for r in range(1, n) for c in range(1, n) if rng.random() < 0.6]
    return rows, spark.createDataFrame(rows, "workbook string, sheet_index int, row int, col int, value string, top boolean, bottom boolean, left boolean, right boolean")


def test_relational_borders_equal_the_sheet(spark):
    rows, df = cells_df(spark)
    s = Sheet({(r[2], r[3]): CellBox((r[4] or "").strip(), *r[5:]) for r in rows}, [])
    for r in grid.normalized_borders(df).collect():
        assert [r.n_top, r.n_bottom, r.n_left, r.n_right] == [s.edge(r.row, r.col, x) for x in grid.SIDES]
        assert r.present == ((r.row, r.col) in s.cells)
    for r in grid.edge_stats(df).collect():
        want = s.row_stats(r.row, 0, 20)
        assert (r.non_empty, r.bordered, r.raw_bordered, r.tops, r.bottoms, r.longest) == (want["filled"], want["bordered"], want["raw"], want["tops"], want["bottoms"], want["longest"])


def test_detection_as_dataframe(spark):
    rows, df = cells_df(spark, 2)
    merges = spark.createDataFrame([("w", 1, 1, 1, 2, 2, 0)], "workbook string, sheet_index int, start_row int, start_col int, end_row int, end_col int, ord int")
    s = Sheet({(r[2], r[3]): CellBox((r[4] or "").strip(), *r[5:]) for r in rows}, [(1, 1, 2, 2)])
    got = sorted((r.start_row, r.start_col, r.end_row, r.end_col, r.score, r.reasons) for r in grid.detect_tables(df, merges).collect())
    assert got == sorted((*b, n, why) for b, n, why in s.tables()) and grid.detect_tables(df.limit(0), merges.limit(0)).count() == 0


def test_matrices(spark):
    tables = spark.createDataFrame([("w", 1, 1, 1, 4, 4, 5)], "workbook string, sheet_index int, start_row int, start_col int, end_row int, end_col int, score int")
    cells = spark.createDataFrame([("w", 1, 1, 1, " a "), ("w", 1, 1, 2, "b"), ("w", 1, 2, 1, "c"), ("w", 1, 4, 4, "d"), ("w", 1, 9, 9, "z")], "workbook string, sheet_index int, row int, col int, value string")
    merges = spark.createDataFrame([("w", 1, 1, 1, 2, 2, 0), ("w", 1, 2, 2, 2, 3, 1)], "workbook string, sheet_index int, start_row int, start_col int, end_row int, end_col int, ord int")
    run = lambda *a: grid.matrices(tables, cells, merges, *a).first().matrix
    assert run() == [["a", ""], ["", "d"]]
    assert run(False, False) == [["a", "[MERGED←]", "", ""], ["[MERGED↑]", "[MERGED↑]", "[MERGED←]", ""], ["", "", "", ""], ["", "", "", "d"]]


def test_segments_and_blocks(spark):
    rows = [(1, 1, "Title"), (1, 2, "more"), (1, 9, "far"), (2, 2, "child one"), (3, 2, "- child two"), (4, 1, "plain"), (7, 1, "# next"), (8, 1, " ")]
    df = spark.createDataFrame([("w", 1, *r) for r in rows], "workbook string, sheet_index int, row int, col int, value string")
    seg = layout.row_segments(df)
    assert sorted((r.row, r.start_col, r.text) for r in seg.collect()) == [(1, 1, "Title more"), (1, 9, "far"), (2, 2, "child one"), (3, 2, "- child two"), (4, 1, "plain"), (7, 1, "# next")]
    got = layout.narrative_blocks(seg).select("block", "start_row", "start_col", "end_row", "end_col", layout.narrative_text(F.col("items")).alias("t"), layout.is_heading_block(F.col("items")).alias("h")).orderBy("block").collect()
    # each segment is compared with its block's first: the far one opens a block, and so does what comes back
    assert [(r.start_row, r.start_col, r.end_row, r.end_col) for r in got] == [(1, 1, 1, 1), (1, 9, 1, 9), (2, 2, 4, 2), (7, 1, 7, 1)]
    assert [r.t for r in got] == ["Title more", "far", "child one\n\n- child two\n\nplain", "# next"] and [r.h for r in got] == [False] * 4


def narrated(items):
    """Headings over deeper items, by hand."""
    out, i = [], 0
    while i < len(items):
        j = i + 1
        while j < len(items) and items[j][0] > items[i][0]:
            j += 1
        if j > i + 1:
            out += [f"### {items[i][1]}", "\n".join(f"- {t}" for _, t in items[i + 1 : j])]
        else:
            out.append(items[i][1])
        i = j
    return "\n\n".join(out)


def test_narrative_text(spark):
    rng = random.Random(4)
    rows = [(k, [(r, rng.randint(1, 3), f"t{r}", ["x"]) for r in range(rng.randint(1, 8))]) for k in range(60)]
    df = spark.createDataFrame(rows, f"k int, items array<{layout.ITEM}>")
    for r in df.select("items", layout.narrative_text(F.col("items")).alias("t")).collect():
        assert r.t == narrated([(i.col, i.text) for i in r["items"]])


def test_sections(spark):
    a = [(1, 1, 2, 3), (4, 2, 10, 2), (5, 1, 5, 9), (14, 1, 14, 1), (20, 5, 20, 5)]
    df = spark.createDataFrame([(1, *x) for x in a], "s int, start_row int, start_col int, end_row int, end_col int")
    got = sorted(tuple(r)[2:] for r in layout.sections(df, ["s"]).collect())
    assert got == [(1, 1, 14, 9), (20, 5, 20, 5)]


def test_shape_blocks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1, 60):
        x, y = rng.randrange(0, 60_000_000), rng.randrange(0, 20_000_000)
        rows.append((1, i, x, y, x + rng.randrange(1, 3_000_000), y + rng.randrange(1, 900_000)))
    df = spark.createDataFrame(rows, "s int, no int, left long, top long, right long, bottom long")

    def near(a, b):
        dx, dy = max(0, b[2] - a[4], a[2] - b[4]), max(0, b[3] - a[5], a[3] - b[5])
        return dx <= shapes.GAP_X and dy <= shapes.GAP_Y

    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if near(a, b)}
    assert {(r.a, r.b) for r in shapes.gap_edges(df, ["s"]).collect()} == want
    blocks = shapes.blocks(df, ["s"]).collect()
    assert sorted(n for b in blocks for n in b.shapes) == list(range(1, 60)) and len(blocks) > 1
