"""Text and properties of Office files (docx, xlsx, pptx), read from their XML parts."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node, name: str):
    return (x for x in node.iter() if _local(x.tag) == name)


def _attribute(node, name: str) -> str | None:
    """An attribute by its local name; one of a namespace before a plain one."""
    found = {k: v for k, v in node.attrib.items() if _local(k) == name}
    return next((v for k, v in found.items() if k != name), found.get(name))


class Package:
    """The parts of an Office file."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())

    def xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def targets(self, part: str) -> dict[str, str]:
        """What a part's relations point to, by their ids."""
        folder, file = posixpath.split(part)
        rels = self.xml(f"{folder}/_rels/{file}.rels")
        out = {}
        for r in _all(rels, "Relationship") if rels is not None else ():
            to = r.attrib["Target"]
            out[r.attrib["Id"]] = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))
        return out

    def core(self) -> dict[str, str]:
        """Title, author and times from the core properties, if they say so."""
        root = self.xml("docProps/core.xml")
        names = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
        found = {names[_local(x.tag)]: (x.text or "").strip() for x in (() if root is None else root) if _local(x.tag) in names}
        return {k: v for k, v in found.items() if v}


def _text(node) -> str:
    parts = []
    for x in node.iter():
        kind = _local(x.tag)
        parts.append((x.text or "") if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "")
    return "".join(parts).strip()


def table(rows: list[list[str]]) -> str:
    """Rows as Markdown lines, the first one as the head."""
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(c.replace("\n", " ").replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if width else ""


def word(raw: bytes) -> tuple[str, dict]:
    """Paragraphs (headings as Markdown) and tables in order; properties and the number of paragraphs."""
    package = Package(raw)
    body = next(_all(package.xml("word/document.xml"), "body"))
    out, n = [], 0
    for x in body:
        kind = _local(x.tag)
        if kind == "p":
            n += 1
            style = next((_attribute(s, "val") or "" for s in _all(x, "pStyle")), "")
            level = re.fullmatch(r"(?i)heading\s?([1-6])", style)
            text = _text(x)
            out.append(f"{'#' * int(level[1])} {text}" if level and text else text)
        elif kind == "tbl":
            out.append(table([[_text(c) for c in r if _local(c.tag) == "tc"] for r in _all(x, "tr")]))
    return "\n\n".join(t for t in out if t), package.core() | {"paragraph_count": n}


def _place(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a cell's name."""
    letters = re.match("[A-Z]+", reference)[0]
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(reference[len(letters) :]), column


def sheets(raw: bytes) -> tuple[str, dict]:
    """Every sheet as a table under its name; each sheet's name and extent."""
    package = Package(raw)
    targets = package.targets("xl/workbook.xml")
    strings = package.xml("xl/sharedStrings.xml")
    known = [_text(s) for s in _all(strings, "si")] if strings is not None else []
    parts, about = [], []
    for s in _all(package.xml("xl/workbook.xml"), "sheet"):
        cells: dict[int, dict[int, str]] = {}
        for c in _all(package.xml(targets[_attribute(s, "id")]), "c"):
            row, column = _place(c.attrib["r"])
            value = next(_all(c, "v"), None)
            text = _text(c) if c.attrib.get("t") == "inlineStr" else "" if value is None else value.text or ""
            cells.setdefault(row, {})[column] = known[int(text)] if c.attrib.get("t") == "s" and text else text
        last, width = max(cells, default=0), max((max(r) for r in cells.values()), default=0)
        rows = [[cells.get(i, {}).get(j, "") for j in range(1, width + 1)] for i in range(1, last + 1)]
        name = s.attrib["name"]
        parts.append(f"## {name}\n\n{table(rows)}".strip())
        about.append({"name": name, "max_row": last, "max_column": width})
    return "\n\n".join(parts), package.core() | {"sheets": about, "sheet_count": len(about)}


def slides(raw: bytes) -> tuple[list[str], dict]:
    """Each slide's paragraphs, in the order of the presentation."""
    package = Package(raw)
    targets = package.targets("ppt/presentation.xml")
    order = [targets[_attribute(s, "id")] for s in _all(package.xml("ppt/presentation.xml"), "sldId")]
    pages = ["\n".join(t for p in _all(package.xml(name), "p") if (t := _text(p))) for name in order]
    return pages, package.core() | {"slide_count": len(pages)}
