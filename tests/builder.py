"""Workbook packages from Python values."""

import io
import zipfile

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
DRAW = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
BORDER = '<border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border>'
STYLES = (
    f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="200" formatCode="0.000"/></numFmts><fonts><font/><font><b/></font><font><u/><i val="0"/></font></fonts>'
    f'<borders><border/>{BORDER}</borders><cellXfs><xf/><xf borderId="1"/><xf numFmtId="14"/><xf numFmtId="200"/><xf fontId="1"/><xf fontId="2"/></cellXfs></styleSheet>'
)


def rels(*targets):
    """(id, target[, mode]) tuples."""
    rows = "".join(f'<Relationship Id="{t[0]}" Type="x" Target="{t[1]}"{f" TargetMode=\"{t[2]}\"" if len(t) > 2 else ""}/>' for t in targets)
    return f'<Relationships xmlns="{PKG}">{rows}</Relationships>'


def sheet(cells, more=""):
    """Cells as XML from (address, inner XML, attributes)."""
    body = "".join(f'<c r="{a}" {attributes}>{inner}</c>' for a, inner, attributes in cells)
    return f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData><row>{body}</row></sheetData>{more}</worksheet>'


def text(a, t, style=0):
    return a, f"<is><t xml:space=\"preserve\">{t}</t></is>", f't="inlineStr" s="{style}"'


def number(a, v, style=0):
    return a, f"<v>{v}</v>", f's="{style}"'


def formula(a, f, cached=None, style=0, attributes=""):
    return a, f"<f {attributes}>{f}</f>" + ("" if cached is None else f"<v>{cached}</v>"), f's="{style}"'


def package(sheets, strings=None, names="", parts=None, sheet_rels=None):
    """sheets: name -> XML."""
    out = {
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + f"</sheets>{names}</workbook>",
        "xl/_rels/workbook.xml.rels": rels(*[(f"r{i}", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]),
        "xl/styles.xml": STYLES,
    }
    out |= {f"xl/worksheets/sheet{i}.xml": x for i, x in enumerate(sheets.values(), 1)}
    if strings:
        out["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{strings}</sst>'
    for i, r in (sheet_rels or {}).items():
        out[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = r
    out |= parts or {}
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in out.items():
            z.writestr(name, data)
    return raw.getvalue()
