"""Parsing scanned files into documents; what fails becomes a row that says why."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SUFFIXES
from . import ooxml

#: Tried in this order.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "latin-1")
#: A PDF page of less text is taken for a picture.
PAGE_LEAST, PAGE_DPI = 20, 144

DOCUMENT_DDL = "path string, title string, doc_type string, mime_type string, metadata string, content string, pages array<struct<number:int,content:string,image:binary>>, html string, parse_engine string, mtime_ns long"


def decoded(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def kind_of(path: str) -> str:
    end = PurePosixPath(path).suffix.lower()
    return next((k for k, known in SUFFIXES.items() if end in known), "unknown")


def heading_title(path: str, text: str) -> str:
    heads = [line.strip()[2:].strip() for line in text.split("\n")[:20] if line.strip().startswith("# ")]
    return heads[0] if heads else re.sub("[_-]", " ", PurePosixPath(path).stem)


class _Visible(HTMLParser):
    """The visible text of a page, and its title."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden, self.title, self.in_title = [], 0, "", False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.in_title = tag == "title"
        if m := re.fullmatch("h([1-6])", tag):
            self.parts.append("\n\n" + "#" * int(m[1]) + " ")
        elif tag in ("p", "div", "section", "article", "tr", "li", "ul", "ol", "table", "br"):
            self.parts.append("\n" if tag in ("br", "li", "tr") else "\n\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.in_title = False
        if re.fullmatch("h[1-6]|p|div|section|article|table", tag):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def converted(text: str) -> tuple[str, str]:
    """Text and title of an HTML page, its headings as Markdown."""
    page = _Visible()
    page.feed(text)
    lines = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(page.parts))
    return re.sub(r"\n{3,}", "\n\n", lines).strip(), page.title.strip()


def _text(path: str, raw: bytes, see) -> dict:
    text = decoded(raw)
    return {"title": heading_title(path, text), "content": text, "parse_engine": "text"}


def _generic(path: str, raw: bytes, see) -> dict:
    """What no suffix names: Office files and HTML by what they are, else text."""
    for read, name in ((_word, "word/document.xml"), (_sheet, "xl/workbook.xml"), (_slides, "ppt/presentation.xml")):
        if raw[:2] == b"PK" and name.encode() in raw:
            return read(path, raw, see)
    text = decoded(raw)
    if re.match(r"(?is)\s*(<!doctype html|<html|<\?xml[^>]*>\s*<html)", text):
        content, title = converted(text)
        return {"title": title or heading_title(path, content), "content": content, "parse_engine": "html"}
    return _text(path, raw, see)


def pdf_pages(raw: bytes) -> tuple[dict, list[tuple[str, bytes | None]]]:
    """A PDF's own properties, and text and rendered image of each page, by whatever library is there."""
    try:
        import fitz  # optional
    except ImportError:
        import pypdf  # optional

        book = pypdf.PdfReader(io.BytesIO(raw))
        return {k.lstrip("/").lower(): str(v) for k, v in (book.metadata or {}).items()}, [(p.extract_text() or "", None) for p in book.pages]
    with fitz.open(stream=raw, filetype="pdf") as book:
        return dict(book.metadata or {}), [(p.get_text("text", sort=True), p.get_pixmap(dpi=PAGE_DPI, alpha=False).tobytes("png")) for p in book]


def of_pages(about: dict, found: list[tuple[str, bytes | None]], see) -> dict:
    """A document of pages: those of little text are seen, if someone can; counts of both in metadata."""
    pages, poor, seen = [], 0, 0
    for n, (text, image) in enumerate(found, 1):
        text = text.strip()
        if len(text) < PAGE_LEAST:
            poor += 1
            other = see(image, n) if see and image else ""
            seen += bool(other)
            text = other or text
        pages.append({"number": n, "content": text, "image": image})
    shown = [f'<div class="page" data-page="{p["number"]}"><div class="text">{escape(p["content"])}</div></div>' for p in pages]
    return {
        "title": about.get("title") or None,
        "pages": pages,
        "content": headed(pages),
        "html": "\n".join(shown),
        "about": {f"pdf_{k}": str(v) for k, v in about.items() if v} | {"page_count": len(pages), "text_poor_pages": poor, "seen_pages": seen},
    }


def headed(pages: list[dict]) -> str:
    return "\n\n".join(f"## Page {p['number']}\n\n{p['content']}" for p in pages)


def _pdf(path: str, raw: bytes, see) -> dict:
    return of_pages(*pdf_pages(raw), see) | {"parse_engine": "pdf"}


def _word(path: str, raw: bytes, see) -> dict:
    content, about = ooxml.word(raw)
    return {"title": about.get("title"), "content": content, "about": about, "parse_engine": "docx"}


def _sheet(path: str, raw: bytes, see) -> dict:
    content, about = ooxml.sheets(raw)
    return {"title": about.get("title"), "content": content, "about": about, "parse_engine": "xlsx"}


def _slides(path: str, raw: bytes, see) -> dict:
    texts, about = ooxml.slides(raw)
    pages = [{"number": n, "content": t, "image": None} for n, t in enumerate(texts, 1)]
    return {"title": about.get("title"), "pages": pages, "content": headed(pages), "about": about, "parse_engine": "pptx"}


def _image(path: str, raw: bytes, see) -> dict:
    if not see:
        raise ValueError("no image provider")
    text = see(raw, None)
    first = text.split("\n")[0].strip()
    return {"title": first if 0 < len(first) < 100 and not first.startswith("[") else None, "content": text, "parse_engine": "vision"}


Parser = Callable[[str, bytes, Callable | None], dict]
PARSERS: dict[str, Parser] = {"text": _text, "unknown": _generic, "pdf": _pdf, "docx": _word, "xlsx": _sheet, "pptx": _slides, "image": _image}


def parse_one(path: str, raw: bytes, see: Callable | None = None, parsers: dict[str, Parser] | None = None) -> dict:
    """A document as a dict of DOCUMENT_DDL's columns; doc_type `error` if its parser fails."""
    import mimetypes

    kind = kind_of(path)
    out = dict.fromkeys(("title", "html", "pages", "content", "parse_engine"))
    about = {"ext": PurePosixPath(path).suffix, "size": len(raw)}
    try:
        out |= (parsers or PARSERS)[kind](path, raw, see)
        about |= out.pop("about", {})
    except Exception as e:  # any parser's failure is this row's result
        kind = "error"
        out |= {"content": f"[Parse error] {str(e)[:300]}", "parse_engine": "error"}
        about["error"] = f"{type(e).__name__}: {e}"[:300]
    out["title"] = out["title"] or re.sub("[_-]", " ", PurePosixPath(path).stem)
    return out | {"path": path, "doc_type": kind, "mime_type": mimetypes.guess_type(path)[0] or "application/octet-stream", "metadata": json.dumps(about, ensure_ascii=False)}


def parse(files: DataFrame, *, see: Callable | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Documents of scanned files, one row each; no shuffle."""
    names = [c.split()[0] for c in re.sub("<.*?>+", "", DOCUMENT_DDL).split(", ")]

    def run(batches):
        for b in batches:
            rows = [parse_one(p, bytes(c), see, parsers) | {"mtime_ns": m} for p, c, m in zip(b["path"], b["content"], b["mtime_ns"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "mtime_ns").mapInPandas(run, DOCUMENT_DDL)


def failures(documents: DataFrame) -> DataFrame:
    """path and error of what could not be parsed."""
    return documents.where("doc_type = 'error'").select("path", F.get_json_object("metadata", "$.error").alias("error"))


def record_metadata() -> Column:
    """What every chunk of a document (path, doc_type, title, metadata) says of it: path, type, title,
    source, and the metadata's plain values."""

    @F.pandas_udf("string")
    def run(path: pd.Series, doc_type: pd.Series, title: pd.Series, metadata: pd.Series) -> pd.Series:
        out = []
        for p, k, t, m in zip(path, doc_type, title, metadata, strict=True):
            own = {a: v for a, v in (json.loads(m) if m else {}).items() if isinstance(v, (str, int, float, bool))}
            out.append(json.dumps(own | {"path": p, "doc_type": k, "title": t, "source": p}, ensure_ascii=False, sort_keys=True))
        return pd.Series(out, dtype=object)

    return run("path", "doc_type", "title", "metadata")
