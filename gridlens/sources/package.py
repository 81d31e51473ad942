"""Workbook packages: ZIP parts and their XML, one package at a time, in plain Python.

Packages are untrusted: document type declarations are refused, and the number and inflated size of parts are bounded.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

from ..functions.address import name, rectangle

MOST_PARTS = 20_000
MOST_BYTES = 1 << 30
CELL_WIDTH, CELL_HEIGHT = 609_600, 190_500  # EMU of a default cell.  Fixed values.
PIXEL = 9_525
_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Chart elements and what they are called, in this order.  Fixed values.
CHARTS = {
    "barChart": "Bar Chart", "lineChart": "Line Chart", "pieChart": "Pie Chart", "doughnutChart": "Doughnut Chart",
    "areaChart": "Area Chart", "scatterChart": "Scatter Chart", "radarChart": "Radar Chart", "bubbleChart": "Bubble Chart",
}
#: Theme colours of drawings.  Fixed values.
COLOURS = {
    "accent1": "#4472C4", "accent2": "#ED7D31", "accent3": "#A5A5A5", "accent4": "#FFC000", "accent5": "#5B9BD5",
    "accent6": "#70AD47", "tx1": "#000000", "tx2": "#44546A", "lt1": "#FFFFFF", "lt2": "#E7E6E6",
}
FLAGS = ("bold", "italic", "strike", "underline")


class PackageError(ValueError):
    """The bytes are no readable workbook package."""


def unzip(data: bytes) -> dict[str, bytes]:
    """Parts by path.  Stored and deflated entries only."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > MOST_PARTS or sum(i.file_size for i in infos) > MOST_BYTES:
                raise PackageError("the package is too large")
            if any(i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for i in infos):
                raise PackageError("only stored and deflated entries are read")
            parts, room = {}, MOST_BYTES  # what the parts really hold counts, not what the package says of them
            for i in infos:
                part = _entry(data, z, i, room)
                parts[i.filename.replace("\\", "/")] = part
                room -= len(part)
            return parts
    except (zipfile.BadZipFile, zlib.error, EOFError) as e:
        raise PackageError(str(e)) from e


def _entry(data: bytes, z: zipfile.ZipFile, info: zipfile.ZipInfo, room: int) -> bytes:
    """An entry's bytes, at most ``room`` of them, whether or not its checksum is right."""
    at = info.header_offset
    start = at + 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
    raw = data[start : start + info.compress_size]
    out = raw if info.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(raw, room + 1)
    if len(out) > room:
        raise PackageError("the package is too large")
    return out


def xml(data: bytes | None) -> ET.Element | None:
    if not data:
        return None
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise PackageError("document type declarations are refused")
    try:
        return ET.fromstring(data.lstrip(b"\xef\xbb\xbf"))
    except ET.ParseError as e:
        raise PackageError(str(e)) from e


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def below(e: ET.Element | None, *names: str) -> list[ET.Element]:
    """Descendants of these local names, in document order."""
    return [] if e is None else [x for x in e.iter() if x is not e and isinstance(x.tag, str) and local(x) in names]


def first(e: ET.Element | None, *names: str) -> ET.Element | None:
    return next(iter(below(e, *names)), None)


def child(e: ET.Element | None, name_: str) -> ET.Element | None:
    return None if e is None else next((x for x in e if isinstance(x.tag, str) and local(x) == name_), None)


def content(e: ET.Element | None) -> str:
    return "" if e is None else "".join(e.itertext()).replace("\r\n", "\n")


def attribute(e: ET.Element, name_: str) -> str:
    """An attribute without namespace or of the relationships' namespace."""
    return e.get(name_) or e.get(_NS + name_) or ""


def join_path(base: str, target: str) -> str:
    """A relationship's target from the part that has it."""
    parts = [] if target.startswith("/") else base.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def rels_path(part: str) -> str:
    folder, _, file = part.rpartition("/")
    return f"{folder}/_rels/{file}.rels"


def relationships(parts: dict[str, bytes], part: str) -> dict[str, tuple[str, str]]:
    """id -> (target, mode); external targets as they are."""
    out = {}
    for r in below(xml(parts.get(rels_path(part))), "Relationship"):
        target, mode = r.get("Target") or "", (r.get("TargetMode") or "").lower()
        if r.get("Id") and target:
            out[r.get("Id")] = (target if mode == "external" else join_path(part, target), mode)
    return out


def _on(e: ET.Element | None) -> bool:
    return e is not None and (e.get("val") or "").strip().lower() not in ("false", "0", "none")


def style_of(e: ET.Element | None) -> dict[str, bool]:
    return {f: _on(first(e, tag)) for f, tag in zip(FLAGS, ("b", "i", "strike", "u"), strict=True)}


def runs_of(item: ET.Element | None) -> list[dict] | None:
    """A string's formatted runs, None if it has none."""
    if item is None:
        return None
    out = [{"text": "".join(map(content, below(r, "t")))} | style_of(child(r, "rPr")) for r in item if isinstance(r.tag, str) and local(r) == "r"]
    return out or None


def plain_string(item: ET.Element) -> str:
    """A string's text without phonetic hints."""
    if local(item) in ("rPh", "phoneticPr"):
        return ""
    if local(item) == "t":
        return content(item)
    return "".join(plain_string(x) for x in item if isinstance(x.tag, str))


def shared_strings(parts: dict[str, bytes]) -> list[dict]:
    return [{"idx": i, "text": plain_string(x), "runs": runs_of(x)} for i, x in enumerate(below(xml(parts.get("xl/sharedStrings.xml")), "si"))]


def styles(parts: dict[str, bytes]) -> list[dict]:
    """One dict a cell format: borders, number format id, custom code or None, text style."""
    root = xml(parts.get("xl/styles.xml"))
    none = {s: False for s in ("top", "bottom", "left", "right")}
    side = lambda b, s: (lambda x: x is not None and (x.get("style") is not None or len(x) > 0))(first(b, s))
    borders = [{s: side(b, s) for s in none} for b in below(root, "border")]
    fonts = [style_of(f) for f in below(first(root, "fonts"), "font")]
    codes = {int(x.get("numFmtId") or 0): x.get("formatCode") for x in below(first(root, "numFmts"), "numFmt") if x.get("formatCode")}
    at = lambda items, i, other: items[i] if 0 <= i < len(items) else other
    out = []
    for x in below(first(root, "cellXfs"), "xf"):
        fmt = int(x.get("numFmtId") or 0)
        out.append(at(borders, int(x.get("borderId") or 0), none) | {"num_fmt_id": fmt, "code": codes.get(fmt)} | at(fonts, int(x.get("fontId") or 0), style_of(None)))
    if not out:
        alone = first(root, "cellXfs") is None
        out = [(at(borders, 0, none) if alone else none) | {"num_fmt_id": 0, "code": None} | (at(fonts, 0, style_of(None)) if alone else style_of(None))]
    return [s | {"idx": i} for i, s in enumerate(out)]


def catalog(parts: dict[str, bytes]) -> tuple[list[dict], list[dict]]:
    """(sheets in order, defined names)."""
    root = xml(parts.get("xl/workbook.xml"))
    if root is None:
        raise PackageError("xl/workbook.xml was not found")
    rels = relationships(parts, "xl/workbook.xml")
    sheets = [{"sheet_index": i, "name": s.get("name") or f"Sheet{i}", "path": rels.get(attribute(s, "id"), ("", ""))[0]} for i, s in enumerate(below(root, "sheet"), 1)]
    names = []
    for n in below(root, "definedName"):
        text, own = content(n).strip(), n.get("localSheetId") or ""
        if n.get("name") and not n.get("name").startswith("_xlnm.") and text:
            at = int(own) if own.isdigit() else -1
            names.append({"name": n.get("name"), "formula": text if text.startswith("=") else f"={text}", "sheet": sheets[at]["name"] if 0 <= at < len(sheets) else None})
    return sheets, names


def cell_rows(root: ET.Element) -> list[dict]:
    out = []
    for ord_, c in enumerate(below(first(root, "sheetData") if first(root, "sheetData") is not None else root, "c")):
        address = c.get("r") or ""
        box = rectangle(address) or (0, 0, 0, 0)
        f, v, inline = child(c, "f"), child(c, "v"), child(c, "is")
        out.append({
            "ord": ord_, "address": address, "row": box[0], "col": box[1], "type": (c.get("t") or "").strip(), "style": int(c.get("s") or 0),
            "has_value": v is not None, "value": content(v), "formula": content(f), "formula_type": f.get("t") or "" if f is not None else "",
            "shared_id": f.get("si") or "" if f is not None else "", "formula_ref": f.get("ref") or "" if f is not None else "",
            "inline": "".join(map(content, below(c, "t"))), "runs": runs_of(inline),
        })
    return out


def merge_rows(root: ET.Element) -> list[dict]:
    out = []
    for i, m in enumerate(below(root, "mergeCell")):
        ref = m.get("ref") or ""
        r1, c1, r2, c2 = rectangle(ref) or (0, 0, 0, 0)
        out.append({"ord": i, "ref": ref, "start_row": r1, "start_col": c1, "end_row": r2, "end_col": c2})
    return out


def hyperlink_rows(root: ET.Element, rels: dict[str, tuple[str, str]]) -> list[dict]:
    out = []
    for i, h in enumerate(below(root, "hyperlink")):
        target, mode = rels.get(attribute(h, "id").strip(), ("", ""))
        location, target = (h.get("location") or "").strip().removeprefix("#"), target.strip()
        inside = mode != "external" and (location or target.startswith("#"))
        to = (location or target.removeprefix("#")) if inside else target
        box = rectangle((h.get("ref") or "").strip())
        if to and box:
            out.append({"ord": i, "start_row": box[0], "start_col": box[1], "end_row": box[2], "end_col": box[3], "kind": "internal" if inside else "external", "target": to, "location": location or (to if inside else ""), "tooltip": (h.get("tooltip") or "").strip(), "display": (h.get("display") or "").strip()})
    return out


def list_objects(parts: dict[str, bytes], root: ET.Element, rels: dict[str, tuple[str, str]]) -> list[dict]:
    out = []
    for p in below(root, "tablePart"):
        t = xml(parts.get(rels.get(attribute(p, "id"), ("", ""))[0]))
        if t is not None and local(t) != "table":
            t = first(t, "table")
        box = rectangle((t.get("ref") or "") if t is not None else "")
        if box:
            count = lambda k, other: int(t.get(k) or other) or other  # noqa: E731, B023
            names = [x for x in dict.fromkeys([t.get("name") or "", t.get("displayName") or ""]) if x]
            for n in names:
                out.append({"name": n, "start": name(*box[:2]), "end": name(*box[2:]), "columns": [x for x in ((c.get("name") or "").strip() for c in below(t, "tableColumn")) if x], "header_rows": count("headerRowCount", 1), "totals_rows": count("totalsRowCount", 0)})
    return out


# ---------------------------------------------------------------- drawings


def safe_folder(sheet: str) -> str:
    return re.sub(r'[\\/:*?"<>|]+', "_", sheet).strip() or "Sheet"


def anchors(parts: dict[str, bytes], sheet_path: str):
    """(anchor, relationships of its drawing, row, column) of the anchors with a place; those to one cell come first."""
    for target, _ in relationships(parts, sheet_path).values():
        if not re.search(r"/drawings/.+\.xml$", target, re.I) or target not in parts:
            continue
        root, rels = xml(parts[target]), relationships(parts, target)
        for a in [*below(root, "oneCellAnchor"), *below(root, "twoCellAnchor")]:
            where = first(a, "from")
            row, col = (_int(first(where if where is not None else a, k)) for k in ("row", "col"))
            if row is not None and col is not None and row >= 0 and col >= 0:
                yield a, rels, row + 1, col + 1


def _int(e: ET.Element | None) -> int | None:
    """A number element; an empty one is 0."""
    t = content(e).strip()
    return 0 if not t else int(t) if re.fullmatch(r"-?\d+", t) else None


def drawings(parts: dict[str, bytes], sheet_name: str, sheet_path: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(images, charts, shapes) of a sheet."""
    folder, images, charts, shapes = f"assets/{safe_folder(sheet_name)}", [], [], []
    for a, rels, row, col in anchors(parts, sheet_path):
        at = name(row, col)
        blip, chart = first(a, "blip"), first(first(a, "graphicFrame") if first(a, "graphicFrame") is not None else a, "chart")
        media = rels.get(attribute(blip, "embed"), ("", ""))[0] if blip is not None else ""
        if media in parts:
            kind = re.search(r"\.([a-z0-9]+)$", media, re.I)
            file = f"image_{len(images) + 1:03d}.{kind[1].lower() if kind else 'bin'}"
            images.append({"no": len(images) + 1, "anchor": at, "row": row, "col": col, "filename": file, "path": f"{folder}/{file}", "media": media})
        part = rels.get(attribute(chart, "id"), ("", ""))[0] if chart is not None else ""
        if part in parts:
            root = xml(parts[part])
            charts.append({"no": len(charts) + 1, "anchor": at, "row": row, "col": col, "path": part, "title": "".join(map(content, below(root, "t"))).strip(), "type": chart_type(root), "series": chart_series(root)})
        shape = first(a, "sp", "cxnSp") if first(a, "sp") is None else first(a, "sp")
        if blip is None and first(a, "chart") is None and shape is not None:
            shapes.append(_shape(a, shape, len(shapes) + 1, at, folder))
    return images, charts, shapes


def chart_type(root: ET.Element) -> str:
    found = [label for tag, label in CHARTS.items() if first(root, tag) is not None]
    return f"{' + '.join(found)} (Combined)" if len(found) > 1 else found[0] if found else "Chart"


def chart_series(root: ET.Element) -> list[dict]:
    """Series by kind of chart; secondary if a value axis of theirs stands on the right."""
    plot = first(root, "plotArea")
    plot = root if plot is None else plot
    value = lambda e: (e.get("val") or content(e)) if e is not None else ""
    right = {value(first(x, "axId")) for x in below(plot, "valAx") if value(first(x, "axPos")) == "r"}
    out = []
    for tag in CHARTS:
        for c in below(plot, tag):
            axis = "secondary" if right & {value(x) for x in below(c, "axId") if value(x)} else "primary"
            for s in below(c, "ser"):
                tx = first(s, "tx") if first(s, "tx") is not None else s
                label = "".join(map(content, below(tx, "t"))).strip() or content(first(tx, "v")) or content(first(tx, "f")) or "Series"
                cat, val = first(s, "cat"), first(s, "val")
                out.append({"name": label, "categories": content(first(cat if cat is not None else s, "f")), "values": content(first(val if val is not None else s, "f")), "axis": axis})
    return out


def raw_entries(e: ET.Element, path: str = "") -> list[dict]:
    """Attributes and texts of an element tree by path, depth first."""
    here = f"{path}/{local(e)}" if path else local(e)
    out = [{"key": f"{here}@{k.rpartition('}')[2]}", "value": v} for k, v in e.attrib.items()]
    texts = [t.strip() for t in [e.text, *(x.tail for x in e)] if t and t.strip()]
    if texts:
        out.append({"key": f"{here}#text", "value": " ".join(texts)})
    for x in e:
        if isinstance(x.tag, str):
            out += raw_entries(x, here)
    return out


def _extent(a: ET.Element, shape: ET.Element) -> tuple[int | None, int | None]:
    ext = child(a, "ext")
    if ext is None:
        ext = child(child(child(shape, "spPr"), "xfrm"), "ext")
    get = lambda k: int(ext.get(k)) if ext is not None and re.fullmatch(r"-?\d+", ext.get(k) or "") else None
    return get("cx"), get("cy")


def _shape(a: ET.Element, shape: ET.Element, no: int, at: str, folder: str) -> dict:
    width, height = _extent(a, shape)
    start, end = first(a, "from"), first(a, "to")
    get = lambda e, k: _int(first(e, k)) or 0
    left, top = get(start, "col") * CELL_WIDTH + get(start, "colOff"), get(start, "row") * CELL_HEIGHT + get(start, "rowOff")
    if end is not None:
        right, bottom = get(end, "col") * CELL_WIDTH + get(end, "colOff"), get(end, "row") * CELL_HEIGHT + get(end, "rowOff")
    else:
        right, bottom = left + max(1, width or CELL_WIDTH), top + max(1, height or CELL_HEIGHT)
    named = first(shape, "cNvPr")
    geometry = (lambda g: (g.get("prst") or "").strip() if g is not None else "")(first(shape, "prstGeom"))
    text_box = (lambda c: c is not None and c.get("txBox") == "1")(first(shape, "cNvSpPr"))
    connector = local(shape) == "cxnSp"
    if connector:
        kind = "Straight Arrow Connector" if geometry == "straightConnector1" else f"Connector ({geometry})" if geometry else "Connector"
    else:
        kind = "Text Box" if text_box else "Rectangle" if geometry == "rect" else f"Shape ({geometry})" if geometry else "Shape"
    svg = svg_of(shape, a, connector, text_box, geometry)
    file = f"shape_{no:03d}.svg" if svg else None
    return {
        "no": no, "anchor": at, "name": ((named.get("name") if named is not None else "") or "").strip() or "Shape", "kind": kind,
        "text": "".join(map(content, below(shape, "t"))).strip(), "width": width, "height": height, "left": left, "top": top, "right": right,
        "bottom": bottom, "raw_entries": raw_entries(a), "svg_file": file, "svg_path": f"{folder}/{file}" if file else None, "svg": svg,
    }


def _colour(e: ET.Element | None) -> str | None:
    rgb, scheme = first(e, "srgbClr"), first(e, "schemeClr")
    if rgb is not None and rgb.get("val"):
        return f"#{rgb.get('val').strip()}"
    return COLOURS.get((scheme.get("val") or "").strip()) if scheme is not None else None


def svg_of(shape: ET.Element, a: ET.Element, connector: bool, text_box: bool, geometry: str) -> str | None:
    """A picture of text boxes, rectangles and connectors; None for other shapes."""
    if not (connector or text_box or geometry == "rect"):
        return None
    width, height = (max(1, int(x / PIXEL + 0.5)) if x and x > 0 else other for x, other in zip(_extent(a, shape), (160, 48), strict=True))
    properties = child(shape, "spPr")
    line = child(properties, "ln")
    stroke = _colour(line) or "#333333"
    pen = int((line.get("w") if line is not None else None) or 0)
    pen = max(1, int(pen / PIXEL + 0.5))
    if connector:
        height = max(height, 24)
        y = int(height / 2 + 0.5)
        body = [
            "  <defs>", '    <marker id="arrow" markerWidth="10" markerHeight="10" refX="8" refY="3" orient="auto" markerUnits="strokeWidth">',
            f'      <path d="M0,0 L0,6 L9,3 z" fill="{stroke}"/>', "    </marker>", "  </defs>",
            f'  <line x1="2" y1="{y}" x2="{max(2, width - 4)}" y2="{y}" stroke="{stroke}" stroke-width="{pen}" marker-end="url(#arrow)"/>',
        ]
    else:
        fill = _colour(child(properties, "solidFill")) or ("#FFFFFF" if text_box else "#F3F3F3")
        body = [f'  <rect x="1" y="1" width="{max(1, width - 2)}" height="{max(1, height - 2)}" fill="{fill}" stroke="{stroke}" stroke-width="{pen}"/>']
        text = "\n".join(t for t in (content(x).strip() for x in below(shape, "t")) if t)
        for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            text = text.replace(c, entity)
        if text:
            body.append(f'  <text x="{int(width / 2 + 0.5)}" y="{int(height / 2 + 0.5)}" text-anchor="middle" dominant-baseline="middle" font-size="14" font-family="sans-serif" fill="#000000">{text}</text>')
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', *body, "</svg>"]) + "\n"


def raw_tree(entries: list) -> list[str]:
    """Lines of raw entries as a tree, in the order in which paths are first seen; a repeated key keeps its last value."""
    root: dict = {}
    for e in entries:
        node = root
        for part in filter(None, e["key"].split("/")):
            here = node.setdefault(part, [{}, None])
            node = here[0]
        here[1] = e["value"]

    def lines(node: dict, depth: int) -> list[str]:
        out = []
        for k, (inner, value) in node.items():
            out.append("    " * depth + f"- `{k}`" + (f": `{value}`" if value is not None else ""))
            out += lines(inner, depth + 1)
        return out

    return lines(root, 0)
