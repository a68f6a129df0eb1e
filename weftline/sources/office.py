"""Writers of minimal DOCX and XLSX files; reading is in sources.files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from weftline.sources.files import cell_place, docx_paragraphs, xlsx_cells

_MAIN = "http://schemas.openxmlformats.org/"
_W, _S = f"{_MAIN}wordprocessingml/2006/main", f"{_MAIN}spreadsheetml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _bundle(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, _HEAD + body)
    return out.getvalue()


def _types(kinds: dict[str, str]) -> str:
    over = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{k}+xml"/>' for n, k in kinds.items())
    return f'<Types xmlns="{_MAIN}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{over}</Types>'


def _rels(targets: list[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="rId{i}" Type="{_MAIN}officeDocument/2006/relationships/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(targets, 1))
    return f'<Relationships xmlns="{_MAIN}package/2006/relationships">{rows}</Relationships>'


def new_docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    made = _bundle({
        "[Content_Types].xml": _types({"word/document.xml": "wordprocessingml.document.main"}),
        "_rels/.rels": _rels([("officeDocument", "word/document.xml")]),
        "word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>',
    })
    assert [t for _, _, t in docx_paragraphs(made)] == [p for p in paragraphs if p.strip()]
    return made


def literal(text: str) -> tuple[str, object]:
    """Kind and value of a cell assignment: a formula, a JSON scalar, or text."""
    if text.startswith("="):
        return "formula", text[1:]
    try:
        value = json.loads(text)
    except ValueError:
        return "text", text
    return ("boolean" if isinstance(value, bool) else "number", value) if isinstance(value, (bool, int, float)) else ("text", text if value is None else str(value))


def _cell(name: str, text: str) -> str:
    kind, value = literal(text)
    if kind == "formula":
        return f'<c r="{name}"><f>{escape(value)}</f></c>'
    if kind == "text":
        return f'<c r="{name}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f'<c r="{name}" t="{"b" if kind == "boolean" else "n"}"><v>{int(value) if kind == "boolean" else value}</v></c>'


def new_xlsx(sheets: dict[str, dict[str, str]]) -> bytes:
    """A workbook of sheets, each a map of cell to literal."""
    parts, kinds = {}, {"xl/workbook.xml": "spreadsheetml.sheet.main"}
    for i, cells in enumerate(sheets.values(), 1):
        rows: dict[int, list[str]] = {}
        for name in sorted(cells, key=cell_place):
            rows.setdefault(cell_place(name)[0], []).append(_cell(name, cells[name]))
        data = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S}"><sheetData>{data}</sheetData></worksheet>'
        kinds[f"xl/worksheets/sheet{i}.xml"] = "spreadsheetml.worksheet"
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    return _bundle({
        "[Content_Types].xml": _types(kinds),
        "_rels/.rels": _rels([("officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_MAIN}officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels([("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]),
        **parts,
    })


def checked_output(source: str | None, target: str, overwrite: bool = False) -> str:
    """The target of an edit, refused if it is the source and that isn't allowed."""
    if source is not None and source == target and not overwrite:
        raise ValueError("the original would be overwritten: use another path, or allow it")
    return target


def set_cells(raw: bytes, sheet: str, values: dict[str, str]) -> bytes:
    """A workbook with cells assigned by key over those that it has."""
    sheets: dict[str, dict[str, str]] = {}
    for title, cell, value, kind in xlsx_cells(raw):
        sheets.setdefault(title, {})[cell] = json.dumps(value) if kind == "text" and literal(value)[0] != "text" else ("true" if value == "1" else "false") if kind == "boolean" else value
    sheets.setdefault(sheet, {}).update(values)
    return new_xlsx(sheets)


def replace_text(raw: bytes, old: str, new: str) -> tuple[bytes, int]:
    """A document with every occurrence of old replaced, also where it spans runs; the first run it touches takes the new text."""
    out, done = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(raw)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in source.infolist():
            data = source.read(info)
            if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", info.filename):
                root = ElementTree.fromstring(data)
                for p in root.iter(f"{{{_W}}}p"):
                    runs = list(p.iter(f"{{{_W}}}t"))
                    whole = "".join(t.text or "" for t in runs)
                    hits = [m.start() for m in re.finditer(re.escape(old), whole)]
                    done += len(hits)
                    at = 0
                    for t in runs:
                        own, text = t.text or "", ""
                        for k in range(at, at + len(own)):
                            inside = any(h <= k < h + len(old) for h in hits)
                            text += new if k in hits else "" if inside else whole[k]
                        t.text, at = text, at + len(own)
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            target.writestr(info, data)
    return out.getvalue(), done
