import io
import zipfile

import pytest
from builder import DRAW, MAIN, REL, formula, number, package, rels, sheet, text
from gridlens import api, cli, export
from gridlens.operators.sheet import Options, sheet_markdown
from gridlens.sources import package as pkg
from gridlens.sources.workbook import read
from gridlens.streaming.dropfolder import convert_arriving


def main_workbook():
    strings = (
        "<si><t>name</t></si><si><r><t>Bo</t></r><r><rPr><b/></rPr><t>ld &amp; </t></r><r><rPr><b/></rPr><t>more</t></r></si>"
        "<si><t>漢字</t><rPh><t>かんじ</t></rPh></si>"
    )
    first = sheet(
        [
            text("A1", "A heading"), text("B2", "child"), ("A4", "<v>0</v>", 't="s" s="1"'), ("B4", "<v>2</v>", 't="s" s="1"'), ("A5", "<v>1</v>", 't="s" s="1"'), number("B5", "45368", 2), number("A6", "3", 1),
            formula("B6", "SUM(A6,4)", None, 1), formula("C10", "B6*2"), formula("C11", "", None, 0, 't="shared" si="0"'), formula("D10", "[other.xlsx]S!A1", "5"), formula("D11", "1+1", ""), formula("D12", "NOSUCH(1)"),
            ("E10", "<v>1</v>", 't="b"'), ("E11", "<v>#N/A</v>", 't="e"'), number("E12", "1.23456", 3), text("A20", "link", 5), text("A21", "inside"), text("A22", "nowhere"),
        ],
        f'<mergeCells><mergeCell ref="A4:A4"/><mergeCell ref="A30:B31"/></mergeCells><hyperlinks><hyperlink ref="A20" r:id="h1"/><hyperlink ref="A21" location="Other!A1"/><hyperlink ref="A22:A22" location="#Gone!B2"/></hyperlinks>'
        '<tableParts><tablePart r:id="t1"/></tableParts><drawing r:id="d1"/>',
    )
    other = sheet([text("A1", "k"), number("B1", "10"), number("B2", "20"), formula("C1", "Total"), formula("C2", "SUM(List[qty])"), formula("D1", "A1&amp;B1", None, 0, 't="shared" si="3" ref="D1:D2"'), formula("D2", "", None, 0, 't="shared" si="3"'), formula("E1", "'My Sheet'!B6+1")])
    anchor = "<xdr:from><xdr:col>{c}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{r}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>"
    drawing = (
        f'<xdr:wsDr {DRAW} xmlns:r="{REL}"><xdr:twoCellAnchor>{anchor.format(c=6, r=0)}<xdr:to><xdr:col>8</xdr:col><xdr:row>3</xdr:row></xdr:to><xdr:pic><xdr:blipFill><a:blip r:embed="i1"/></xdr:blipFill></xdr:pic></xdr:twoCellAnchor>'
        f'<xdr:twoCellAnchor>{anchor.format(c=6, r=5)}<xdr:to><xdr:col>8</xdr:col><xdr:row>9</xdr:row></xdr:to><xdr:graphicFrame><a:graphic><c:chart r:id="c1"/></a:graphic></xdr:graphicFrame></xdr:twoCellAnchor>'
        f'<xdr:oneCellAnchor>{anchor.format(c=1, r=40)}<xdr:ext cx="952500" cy="476250"/><xdr:sp><xdr:nvSpPr><xdr:cNvPr id="2" name="Box 1"/><xdr:cNvSpPr/></xdr:nvSpPr><xdr:spPr><a:prstGeom prst="rect"/><a:solidFill><a:schemeClr val="accent1"/></a:solidFill></xdr:spPr><xdr:txBody><a:t>Hi &lt;there&gt;</a:t></xdr:txBody></xdr:sp></xdr:oneCellAnchor>'
        f'<xdr:oneCellAnchor>{anchor.format(c=3, r=40)}<xdr:ext cx="952500" cy="9525"/><xdr:cxnSp><xdr:nvCxnSpPr><xdr:cNvPr id="3" name="Line"/></xdr:nvCxnSpPr><xdr:spPr><a:prstGeom prst="straightConnector1"/></xdr:spPr></xdr:cxnSp></xdr:oneCellAnchor></xdr:wsDr>'
    )
    chart = f'<c:chartSpace {DRAW}><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:f>S!$A$1</c:f><c:v>Qty</c:v></c:strRef></c:tx><c:cat><c:strRef><c:f>S!$A$2:$A$3</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>S!$B$2:$B$3</c:f></c:numRef></c:val></c:ser><c:axId val="1"/></c:barChart><c:lineChart><c:ser><c:val><c:numRef><c:f>S!$C$2:$C$3</c:f></c:numRef></c:val></c:ser><c:axId val="2"/></c:lineChart><c:valAx><c:axId val="1"/><c:axPos val="l"/></c:valAx><c:valAx><c:axId val="2"/><c:axPos val="r"/></c:valAx></c:plotArea></c:chart></c:chartSpace>'
    table = f'<table xmlns="{MAIN}" name="List" displayName="List" ref="A1:B2" headerRowCount="0"><tableColumns><tableColumn name="key"/><tableColumn name="Qty"/></tableColumns></table>'
    names = '<definedNames><definedName name="Total">Other!$B$1</definedName><definedName name="Total" localSheetId="1">Other!$B$2</definedName><definedName name="_xlnm.Print_Area">x</definedName></definedNames>'
    return package(
        {"My Sheet": first, "Other": other, "Empty": sheet([])}, strings, names,
        {
            "xl/drawings/drawing1.xml": drawing, "xl/drawings/_rels/drawing1.xml.rels": rels(("i1", "../media/image1.PNG"), ("c1", "../charts/chart1.xml")),
            "xl/media/image1.PNG": b"\x89PNG", "xl/charts/chart1.xml": chart, "xl/tables/table1.xml": table,
        },
        {1: rels(("h1", "https://example.org/x", "External"), ("d1", "../drawings/drawing1.xml"), ("t1", "../tables/missing.xml")), 2: rels(("t1", "../tables/table1.xml"))},
    )


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "main.xlsx").write_bytes(main_workbook())
    (folder / "broken.xlsx").write_bytes(b"PK no zip")
    (folder / "dtd.xlsx").write_bytes(package({"S": '<!DOCTYPE x [<!ENTITY e "e">]><worksheet/>'}))
    (folder / "no-book.xlsx").write_bytes(export.stored_zip([("a.txt", b"x")]))
    return read(spark, f"file://{folder}")


def cells(books, sheet_index):
    return {r.address: r for r in books.cells.where(f"workbook like '%/main.xlsx' and sheet_index = {sheet_index}").collect()}


def test_catalog_and_errors(books):
    assert [(r.sheet_index, r.name) for r in books.sheets.where("workbook like '%/main.xlsx'").orderBy("sheet_index").collect()] == [(1, "My Sheet"), (2, "Other"), (3, "Empty")]
    assert {r.workbook.rpartition("/")[2] for r in books.errors.collect()} == {"broken.xlsx", "dtd.xlsx", "no-book.xlsx"}
    assert {(r.name, r.sheet) for r in books.defined_names.collect()} == {("Total", None), ("Total", "Other")}


def test_values_by_type(books):
    c = cells(books, 1)
    shown = {a: c[a].output_value for a in c}
    assert shown["A4"] == "name" and shown["B4"] == "漢字" and shown["A5"] == "Bold & more" and shown["B5"] == "2024/3/17" and c["B5"].raw_value == "45368"
    assert (shown["E10"], shown["E11"], shown["E12"]) == ("TRUE", "#N/A", "1.235")
    assert [tuple(r) for r in c["A5"].rich_text_runs] == [("Bo", False, False, False, False), ("ld & more", True, False, False, False)]
    assert c["A4"].top and not c["A1"].top


def test_formulas(books):
    c, o = cells(books, 1), cells(books, 2)
    state = lambda x: (x.output_value, x.resolution_status, x.resolution_source, x.cached_value_state)
    assert state(c["B6"]) == ("7", "resolved", "ast_evaluator", "absent") and state(c["C10"]) == ("14", "resolved", "ast_evaluator", "absent")
    assert state(c["D10"]) == ("=[other.xlsx]S!A1", "unsupported_external", "external_unsupported", "present_nonempty")
    assert state(c["D11"]) == ("", "resolved", "cached_value", "present_empty")
    assert state(c["D12"]) == ("=NOSUCH(1)", "fallback_formula", "formula_text", "absent")
    assert (o["C1"].output_value, o["D1"].output_value, o["D2"].formula, o["E1"].output_value) == ("20", "k10", "=A2&B2", "8")


def test_empty_cached_values_that_are_read(spark, tmp_path):
    """Such a formula is evaluated; one that nothing reads stays empty.  Books of one name in two folders stay apart."""
    for folder, n in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        cells = [formula("A1", f"{n}+1", ""), formula("A2", "A1*10"), formula("A3", "5+5", ""), formula("B1", "B2+1"), formula("B2", "B1+1")]
        (tmp_path / folder / "book.xlsx").write_bytes(package({"S": sheet(cells)}))
    books = read(spark, f"file://{tmp_path}")
    rows = {(r.workbook.split("/")[-2], r.address): (r.output_value, r.resolution_source) for r in books.cells.collect()}
    assert len(rows) == 10
    for folder, n in (("a", 1), ("b", 2)):
        got = [rows[folder, a] for a in ("A1", "A2", "A3", "B1", "B2")]
        assert got == [(str(n + 1), "ast_evaluator"), (f"{n + 1}0", "ast_evaluator"), ("", "cached_value"), ("3", "ast_evaluator"), ("2", "ast_evaluator")]
    made = sheet_markdown(books).select("file_name", "markdown").collect()
    assert len(made) == 2 and all(r.file_name == "book_001_S.md" and r.markdown.startswith("# Book: book.xlsx\n") for r in made)


def test_assets(books):
    assert [(r.anchor, r.path, bytes(r.data)) for r in books.images.collect()] == [("G1", "assets/My Sheet/image_001.png", b"\x89PNG")]
    chart = books.charts.first()
    assert (chart.anchor, chart.title, chart.type) == ("G6", "Sales", "Bar Chart + Line Chart (Combined)")
    assert [(s.name, s["values"], s.axis) for s in chart.series] == [("Qty", "S!$B$2:$B$3", "primary"), ("S!$C$2:$C$3", "S!$C$2:$C$3", "secondary")]
    shapes = books.shapes.orderBy("no").collect()
    assert [(s.name, s.kind, s.text) for s in shapes] == [("Box 1", "Rectangle", "Hi <there>"), ("Line", "Straight Arrow Connector", "")]
    assert "Hi &lt;there&gt;" in shapes[0].svg and 'fill="#4472C4"' in shapes[0].svg and 'width="100" height="50"' in shapes[0].svg and "marker-end" in shapes[1].svg
    assert {r.max_row for r in books.extents.where("sheet_index = 1").collect()} == {31}


def test_sheet_markdown(books):
    rows = {r.sheet_index: r for r in sheet_markdown(books).collect()}
    m = rows[1].markdown
    assert m.startswith("# Book: main.xlsx\n\n## Sheet: My Sheet\n\n### A heading\n\n- child\n\n### Table: 001 (A4-B6)\n\n| name | 漢字 |\n| --- | --- |\n| Bold &amp; more | 2024/3/17 |\n| 3 | 7 |")
    assert "[link](https://example.org/x)" in m and "[inside](#other) (Other!A1)" in m and "nowhere (Gone!B2)" in m and "\n\n---\n\n" in m
    assert "### Chart: 001 (G6)\n- Title: Sales\n- Type: Bar Chart + Line Chart (Combined)\n- Series:\n  - Qty\n    - categories: S!$A$2:$A$3" in m and "    - Axis: secondary" in m
    assert "### Shape Block: 001 (B41-E43)\n- Shapes: Shape 001, Shape 002" in m and "#### Shape: 001 (B41)\n- `oneCellAnchor`" in m
    assert m.endswith("### Image: 001 (G1)\n- File: assets/My Sheet/image_001.png\n\n![image_001.png](assets/My Sheet/image_001.png)")
    assert "_No extractable body content was found._" in rows[3].markdown
    assert (rows[1].tables, rows[1].merges, rows[1].images, rows[1].charts, rows[1].cells, rows[1].formula_fallback_formula) == (2, 2, 1, 1, 19, 1)


def test_options(books):
    both = sheet_markdown(books, Options(output_mode="both", formatting="github", shape_details=False, first_row_is_header=False)).where("sheet_index = 1").first().markdown
    assert "| 2024/3/17 [raw=45368] |" in both and "Bo**ld &amp; more**" in both and "Shape Block" not in both and "|  |  |\n| --- | --- |\n| name [raw=0] |" in both
    raw = sheet_markdown(books, Options(output_mode="raw", table_detection="border")).where("sheet_index = 1").first().markdown
    assert "| 3 | 7 |" in raw
    with pytest.raises(ValueError):
        Options(output_mode="x")


def test_summary_and_counts(books):
    s = export.summary_text(sheet_markdown(books)).where("sheet_index = 1").first().summary
    assert "Tables: 2" in s and "Formula unsupported_external: 1" in s and "Table candidate A4-B6: score 10 / At least 2x2 (+2)" in s
    assert [(r.status, r.n) for r in export.formula_counts(books.cells).where("sheet_index = 1").collect()][:2] == [("unsupported_external", 1), ("fallback_formula", 1)]


def test_archives_are_reproducible(spark, books):
    sheets = sheet_markdown(books)
    run = lambda: bytes(export.archives(export.entries(sheets, books.images, books.shapes)).first().archive)
    first = run()
    with zipfile.ZipFile(io.BytesIO(first)) as z:
        assert z.namelist() == ["output/main.md", "output/assets/My Sheet/image_001.png", "output/assets/My Sheet/shape_001.svg", "output/assets/My Sheet/shape_002.svg"]
        assert {i.date_time for i in z.infolist()} == {export.STAMP} and {i.compress_type for i in z.infolist()} == {0}
        md = z.read("output/main.md").decode()
    assert first == run() and md.startswith("# Book: main.xlsx\n\n## Sheet: My Sheet") and md.count("# Book:") == 1 and md.endswith("\n")
    assert api.unzip_entries(first)["output/assets/My Sheet/image_001.png"] == b"\x89PNG"


def test_encodings(spark):
    for e in export.ENCODINGS:
        got = spark.createDataFrame([("aあ",)], "t string").select(export.encoded(export.F.col("t"), e).alias("x")).first().x
        assert bytes(got) == export.encode_text("aあ", e) == "aあ".encode(e)
        if e != "shift_jis":
            marked = spark.createDataFrame([("a",)], "t string").select(export.encoded(export.F.col("t"), e, "on").alias("x")).first().x
            assert bytes(marked) == export.encode_text("a", e, "on") == bytes.fromhex(export.MARKS[e]) + "a".encode(e)
    for bad in ({"encoding": "latin-1"}, {"bom": "maybe"}, {"encoding": "shift_jis", "bom": "on"}):
        with pytest.raises(ValueError):
            export.encode_text("a", **bad)
    assert export.mime_type("UTF-16LE") == "text/markdown;charset=utf-16le"


def test_file_names(spark):
    df = spark.createDataFrame([("My Book.xlsx", 2, "A/B:東京&大阪.01"), ("???.XLSX", 1, "  "), ("ｆｕｌｌ.xlsx", 3, "x__y")], "w string, i int, s string")
    got = [r.x for r in df.select(export.file_name(export.F.col("w"), export.F.col("i"), export.F.col("s")).alias("x")).collect()]
    assert got == ["My_Book_002_A_B_東京_大阪.01.md", "workbook_001_Sheet1.md", "full_003_x_y.md"]


def test_command_line(spark, tmp_path, capsys):
    book = tmp_path / "b.xlsx"
    book.write_bytes(main_workbook())
    assert cli.main([str(book), "--out", str(tmp_path / "o" / "x.md"), "--zip", str(tmp_path / "x.zip"), "--summary", "--encoding", "utf-16le", "--bom", "on"], spark) == 0
    assert (tmp_path / "o" / "x.md").read_bytes().startswith(b"\xff\xfe#\0") and "Tables: 2" in capsys.readouterr().out and zipfile.is_zipfile(tmp_path / "x.zip")
    for bad in ([str(tmp_path / "none.xlsx")], [str(book), "--encoding", "shift_jis", "--bom", "on"], [str(book), "--output-mode", "x"], []):
        assert cli.main(bad, spark) == 1
    (tmp_path / "bad.xlsx").write_bytes(b"x")
    assert cli.main([str(tmp_path / "bad.xlsx")], spark) == 1 and cli.main(["--help"], spark) == 0


def test_streaming(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(main_workbook())
    seen = []
    q = convert_arriving(spark, f"file://{folder}", lambda df, n: seen.append(sorted(r.sheet_name for r in df.collect())), f"file://{tmp_path}/check", once=True)
    q.awaitTermination(120)
    assert seen == [["Empty", "My Sheet", "Other"]]


def test_package_bounds(monkeypatch):
    data = main_workbook()
    monkeypatch.setattr(pkg, "MOST_PARTS", 2)
    with pytest.raises(pkg.PackageError):
        pkg.unzip(data)
    monkeypatch.setattr(pkg, "MOST_PARTS", 100)
    bomb = bytearray(package({"S": sheet([text("A1", "x" * 100_000)])}))
    monkeypatch.setattr(pkg, "MOST_BYTES", 50_000)
    at = 0
    while (at := bomb.find(b"PK\x01\x02", at)) >= 0:  # the directory says that all parts are small
        bomb[at + 24 : at + 28] = (10).to_bytes(4, "little")
        at += 4
    with pytest.raises(pkg.PackageError):
        pkg.unzip(bytes(bomb))
    assert pkg.join_path("xl/worksheets/sheet1.xml", "../media/./a.png") == "xl/media/a.png" and pkg.join_path("xl/a.xml", "/xl/b.xml") == "xl/b.xml"
    assert pkg.raw_tree([{"key": "a@x", "value": "1"}, {"key": "a/b#text", "value": "t"}, {"key": "a@x", "value": "2"}]) == ["- `a@x`: `2`", "- `a`", "    - `b#text`: `t`"]
