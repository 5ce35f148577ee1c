"""Structure-aware chunking of Markdown, with a hard bound on characters and UTF-8 bytes.

Sections begin at headings. A section beyond the soft bound is packed from its paragraphs;
paragraphs that are code or tables stand alone; a packed chunk begins with the last paragraphs
before it. Small chunks join the one before. Every chunk is then cut at the hard bounds, without
loss. All of it is a fold over one document, so documents spread over tasks without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import spread

MAX_CHARS, MIN_CHARS, OVERLAP, MAX_BYTES = 1200, 100, 1, 1800

# A heading line, and a table's line.
HEADING = r"^(#{1,6})\s+(.+)$"
TABLE_LINE = r"\|.*\|"
_heading = re.compile(HEADING, re.MULTILINE)


@dataclass
class Chunk:
    text: str
    start: int
    end: int
    heading_path: list[str]
    section_title: str | None = None
    content_type: str | None = None
    chunk_id: str = ""
    parent: str | None = None
    part: int | None = None
    index: int | None = None
    extra: dict = field(default_factory=dict)


def sections(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """(start, stripped text with its heading, heading path) of all that is not blank.

    A section starts at its unstripped place; a heading in a code fence counts.
    """
    stack: list[tuple[int, str]] = []
    marks = [(0, None), *((m.start(), m) for m in _heading.finditer(text)), (len(text), None)]
    for (at, m), (end, _) in zip(marks, marks[1:], strict=False):
        if m:
            stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
        if body := text[at:end].strip():
            yield at, body, [name for _, name in stack]


def protected(paragraph: str) -> str | None:
    """'code' or 'table' for a paragraph that must stay whole."""
    if paragraph.count("```") > 1 or paragraph.lstrip().startswith("```"):
        return "code"
    lines = paragraph.strip().splitlines()
    rows = sum(bool(re.fullmatch(TABLE_LINE, line.strip())) for line in lines)
    return "table" if len(lines) > 1 and rows > 0.7 * len(lines) else None


class _Section:
    """Packs one section; `window` holds the paragraphs of the chunk in the making.

    Places advance by a paragraph's length and two, whatever stood between them.
    """

    def __init__(self, start: int, path: list[str], paragraphs: list[str], overlap: int):
        self.start, self.path, self.paragraphs, self.overlap = start, path, paragraphs, overlap
        self.window: list[str] = []
        self.opened = self.at = 0

    def close(self) -> Iterator[Chunk]:
        if self.window:
            yield Chunk("\n\n".join(self.window), self.start + self.opened, self.start + self.at, self.path, self.path[-1] if self.path else "")

    def renew(self, before: int) -> None:
        """Begin anew with the paragraphs before one."""
        self.window = self.paragraphs[max(0, before - self.overlap) : before] if self.overlap > 0 else []
        self.opened = self.at

    def pack(self, most: int) -> Iterator[Chunk]:
        for i, p in enumerate(self.paragraphs):
            kind = protected(p)
            if self.window and (kind or sum(map(len, self.window)) + len(p) > most):
                yield from self.close()
                self.renew(i)
            if kind:
                yield Chunk(p, self.start + self.at, self.start + self.at + len(p), self.path, content_type=kind)
            else:
                self.window.append(p)
            self.at += len(p) + 2
        yield from self.close()


def markdown_chunks(text: str, most: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks of a Markdown text, numbered; none of a blank one."""
    out: list[Chunk] = []
    for start, body, path in sections(text):
        if len(body) <= most:
            made: Iterator[Chunk] = iter([Chunk(body, start, start + len(body), path, path[-1] if path else "")])
        else:
            made = _Section(start, path, [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()], overlap).pack(most)
        out.extend(made)
    joined: list[Chunk] = []
    for c in out:
        if joined and len(c.text) < least and len(out) > 1:
            last = joined[-1]
            last.text, last.end, last.heading_path = f"{last.text}\n\n{c.text}", c.end, c.heading_path
            last.section_title = last.section_title if c.section_title is None else c.section_title
            last.content_type = c.content_type or last.content_type
        else:
            joined.append(c)
    for i, c in enumerate(joined):
        c.chunk_id, c.index = f"chunk-{i:04d}", i
    return joined


def bounded(text: str, most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Greedy cuts of a text at `most` characters and `most_bytes` UTF-8 bytes."""
    n = len(text)
    if text.isascii():
        step = min(most, most_bytes)
        yield from ((i, min(i + step, n)) for i in range(0, n, step))
        return
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))))
    start = 0
    while start < n:
        end = min(start + most, int(np.searchsorted(size, size[start] + most_bytes, side="right")) - 1)
        yield start, end
        start = end


def document_chunks(text: str, doc_type: str = "text", most: int = MAX_CHARS, most_bytes: int = MAX_BYTES) -> list[Chunk]:
    """A document's chunks within the hard bounds; an image's short description is one chunk."""
    if most < 1 or most_bytes < 4:
        raise ValueError("max_chars must be positive and max_bytes 4 at least")
    whole = [Chunk(text, 0, len(text), [], chunk_id="chunk-0000")] if doc_type == "image" and len(text) <= most and text.strip() else markdown_chunks(text, most)
    return [
        Chunk(c.text[s:e], c.start + s, c.start + e, c.heading_path, c.section_title, c.content_type, f"{c.chunk_id}-part-{k:04d}", c.chunk_id, k, c.index)
        for c in whole
        for k, (s, e) in enumerate(bounded(c.text, most, most_bytes))
    ]


CHUNKS_DDL = "path string, chunk_id string, text string, doc_type string, heading_path array<string>, section_title string, content_type string, parent_chunk_id string, part int, start_pos long, end_pos long"


def chunk_documents(docs: DataFrame, *, most: int = MAX_CHARS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Chunks of every row of path, doc_type and content; blank and null contents have none.

    A document is one task's work, so no shuffle; only a table too small to fill the cores is dealt out.
    """
    names = [c.split()[0] for c in CHUNKS_DDL.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for path, kind, content in zip(b["path"], b["doc_type"], b["content"], strict=True):
                for c in document_chunks(content or "", kind or "text", most, most_bytes):
                    rows.append((path, c.chunk_id, c.text, kind, c.heading_path, c.section_title or "", c.content_type, c.parent, c.part, c.start, c.end))
            yield pd.DataFrame(rows, columns=names)

    return spread(docs.select("path", "doc_type", "content")).mapInPandas(run, CHUNKS_DDL)


# --- parts of the above that Catalyst can do alone ----------------------------------------------


def section_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each section, by the split before heading lines: pos and section, stripped."""
    parts = F.split(F.col(text), r"(?m)(?=^#{1,6}\s+.+$)")
    return docs.select("*", F.posexplode(F.filter(F.transform(parts, strip), lambda s: s != "")).alias("pos", "section"))


def hard_parts(text: Column, most: int = MAX_CHARS) -> Column:
    """The hard split of a text in which the byte bound cannot bind (under 1.5 bytes a character); an
    empty text has no part."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most)), lambda i: F.substr(text, (i * most + 1).cast("int"), F.lit(most)))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))
