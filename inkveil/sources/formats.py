"""File formats as lists of texts: what a file's units are, in order, and the file again with other texts in their place.

Only the standard library is needed, but for PDF and images, whose readers say so where they are missing. XML is written as
UTF-8; a table cell that spans others is visited once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

BOM = "﻿".encode()
_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S, _P = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EMPTY_PAGE = "（テキストが抽出できないページです）"
Mask = Callable[[str], str]


def _decoded(content: bytes) -> tuple[bytes, str]:
    return (BOM, content[len(BOM) :].decode()) if content.startswith(BOM) else (b"", content.decode())


def plain(content: bytes, mask: Mask) -> bytes:
    bom, text = _decoded(content)
    return bom + mask(text).encode()


def html(content: bytes, mask: Mask) -> bytes:
    """Text between tags; scripts and styles, attributes, and what precedes the first or follows the last tag stay."""
    bom, text = _decoded(content)
    kept: list[str] = []
    hide = lambda m: kept.append(m[0]) or f"%%SKIP{len(kept) - 1}%%"
    shown = re.sub(r"<(script|style)[^>]*>.*?</\1>", hide, text, flags=re.I | re.S)
    shown = re.sub(r"(>)([^<]+)(<)", lambda m: m[1] + mask(m[2]) + m[3], shown)
    for i, block in enumerate(kept):
        shown = shown.replace(f"%%SKIP{i}%%", block)
    return bom + shown.encode()


def _parsed(content: bytes) -> ET.Element:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(content), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(content)


def svg(content: bytes, mask: Mask) -> bytes:
    try:
        root = _parsed(content)
    except ET.ParseError as e:
        raise ValueError(f"not an SVG file: {e}") from e

    def walk(node: ET.Element) -> None:
        if isinstance(node.tag, str) and node.tag.split("}")[-1] in {"text", "tspan", "title", "desc", "textPath"}:
            node.text = mask(node.text) if node.text and node.text.strip() else node.text
            node.tail = mask(node.tail) if node.tail and node.tail.strip() else node.tail
        for child in node:
            walk(child)

    walk(root)
    declared = content.removeprefix(BOM).lstrip().startswith(b"<?xml")
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' * declared + ET.tostring(root, encoding="unicode").encode()


def _paragraph(p: ET.Element, ns: str, mask: Mask) -> None:
    """A paragraph's runs are one text; a changed one goes into the first run."""
    runs = [(r, [t for t in r if t.tag in (ns + "t", ns + "tab", ns + "br")]) for r in p if r.tag == ns + "r"]
    text = "".join({"tab": "\t", "br": "\n"}.get(t.tag.removeprefix(ns), t.text or "") for _, parts in runs for t in parts)
    if not text.strip() or (new := mask(text)) == text:
        return
    for i, (run, parts) in enumerate(runs):
        for t in parts:
            run.remove(t)
        if i == 0:
            t = ET.SubElement(run, ns + "t")
            t.text = new
            if ns == _W:
                t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _word_block(block: ET.Element, mask: Mask) -> None:
    for p in block.findall(_W + "p"):
        _paragraph(p, _W, mask)
    for table in block.findall(_W + "tbl"):
        for cell in table.findall(f"{_W}tr/{_W}tc"):
            _word_block(cell, mask)


def _zipped(content: bytes, changed: dict[str, ET.Element]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            data = ET.tostring(changed[item.filename], encoding="utf-8", xml_declaration=True) if item.filename in changed else old.read(item)
            new.writestr(item, data)
    return out.getvalue()


def _number(name: str) -> int:
    return int(re.sub(r"\D", "", name.rsplit("/", 1)[-1]) or 0)


def docx(content: bytes, mask: Mask) -> bytes:
    """Body paragraphs, tables, headers and footers, then text boxes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = ["word/document.xml", *sorted((n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)), key=lambda n: (_number(n), n))]
        parts = {n: _parsed(z.read(n)) for n in names}
    for name, root in parts.items():
        _word_block(root.find(_W + "body") if name == names[0] else root, mask)
    for box in parts[names[0]].iter(_W + "txbxContent"):
        for p in box.iter(_W + "p"):
            _paragraph(p, _W, mask)
    return _zipped(content, parts)


def pptx(content: bytes, mask: Mask) -> bytes:
    """Slide by slide: text frames and tables of its shapes, and the text frames one level into groups; then its notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        parts, order = {}, []
        for name in slides:
            order.append(name)
            rels = f"ppt/slides/_rels/{name.rsplit('/', 1)[-1]}.rels"
            if rels in z.namelist():
                order += [f"ppt/notesSlides/{m}" for m in re.findall(r"notesSlides/(notesSlide\d+\.xml)", z.read(rels).decode())]
        for name in order:
            parts[name] = _parsed(z.read(name))

    def frame(shape: ET.Element) -> None:
        for p in shape.findall(f"{_P}txBody/{_A}p"):
            _paragraph(p, _A, mask)

    for root in parts.values():
        for shape in root.findall(f"{_P}cSld/{_P}spTree/*"):
            frame(shape)
            for p in shape.findall(f".//{_A}tbl/{_A}tr/{_A}tc/{_A}txBody/{_A}p") if shape.tag == _P + "graphicFrame" else ():
                _paragraph(p, _A, mask)
            for child in shape if shape.tag == _P + "grpSp" else ():
                frame(child)
    return _zipped(content, parts)


def xlsx(content: bytes, mask: Mask) -> bytes:
    """The cells that hold text (a formula is one), sheet by sheet and row by row; a changed one becomes an inline text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [
            "".join(t.text or "" for t in si.iter(_S + "t")) for si in (_parsed(z.read("xl/sharedStrings.xml")).findall(_S + "si") if "xl/sharedStrings.xml" in z.namelist() else ())
        ]
        targets = {rel.get("Id"): rel.get("Target") for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = [f"xl/{targets[s.get(_R + 'id')].removeprefix('/xl/')}" for s in _parsed(z.read("xl/workbook.xml")).iter(_S + "sheet")]
        parts = {n: _parsed(z.read(n)) for n in names}
    for root in parts.values():
        for cell in root.iter(_S + "c"):
            formula, value = cell.find(_S + "f"), cell.find(_S + "v")
            if formula is not None and formula.text:
                text = "=" + formula.text
            elif cell.get("t") == "s" and value is not None:
                text = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(_S + "t"))
            else:
                continue
            text = text.strip()
            if not text or (new := mask(text)) == text:
                continue
            for child in list(cell):
                cell.remove(child)
            cell.set("t", "inlineStr")
            ET.SubElement(ET.SubElement(cell, _S + "is"), _S + "t").text = new
    return _zipped(content, parts)


def pdf(content: bytes, mask: Mask) -> bytes:
    """Pages as Markdown; a page without text says so."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("PDF files need the library pdfplumber") from e
    with pdfplumber.open(io.BytesIO(content)) as file:
        pages = [page.extract_text(layout=True) or EMPTY_PAGE for page in file.pages]
    if not pages:
        raise ValueError("a PDF file without pages")
    return markdown([mask(p) for p in pages]).encode()


def markdown(pages: list[str]) -> str:
    return "\n\n---\n\n".join(f"# ページ {i}\n\n{page.strip()}" for i, page in enumerate(pages, 1))


def image(content: bytes, mask: Mask) -> bytes:
    try:
        import easyocr
    except ImportError as e:
        raise RuntimeError("images need the library easyocr") from e
    return mask("\n".join(easyocr.Reader(["ja", "en"]).readtext(content, detail=0))).encode()


#: By extension: how to rewrite, and the extension of what comes out.
FORMATS = {
    ".txt": (plain, ".txt"), ".html": (html, ".html"), ".htm": (html, ".htm"), ".svg": (svg, ".svg"), ".docx": (docx, ".docx"), ".pptx": (pptx, ".pptx"), ".xlsx": (xlsx, ".xlsx"),
    ".pdf": (pdf, ".md"), ".jpg": (image, ".txt"), ".jpeg": (image, ".txt"), ".png": (image, ".txt"),
}
RESTORABLE = (".txt", ".html", ".htm", ".svg", ".md", ".docx", ".pptx", ".xlsx")


def units(extension: str, content: bytes) -> list[str]:
    """The texts of a file, in order."""
    found: list[str] = []
    FORMATS[extension][0](content, lambda text: found.append(text) or text)
    return found


def rebuilt(extension: str, content: bytes, texts: list[str]) -> bytes:
    """The file with other texts for its units, in their order."""
    rest: Iterator[str] = iter(texts)
    return FORMATS[extension][0](content, lambda _: next(rest))


_TOKEN = re.compile(r"【[^【】]+】")


def _members(content: bytes) -> Iterator[tuple[zipfile.ZipInfo, bytes, str | None]]:
    """The members of an office file, and their text if they are XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        for item in file.infolist():
            data = file.read(item)
            yield item, data, data.decode() if item.filename.endswith((".xml", ".rels")) else None


def zip_tokens(content: bytes) -> set[str]:
    """The tokens in an office file's XML members."""
    return {t for _, _, text in _members(content) if text is not None for t in _TOKEN.findall(text)}


def restored_zip(content: bytes, known: dict[str, str]) -> bytes:
    """An office file with the tokens in its XML members replaced by what is known of them, escaped as XML wants it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item, data, text in _members(content):
            put = lambda m: escape(known[m[0]], {'"': "&quot;", "'": "&apos;"}) if m[0] in known else m[0]
            new.writestr(item, data if text is None else _TOKEN.sub(put, text).encode())
    return out.getvalue()
