"""Text expressions: file types, titles, keys, tokens, chunk predicates, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes by document type.
TEXT_SUFFIXES = [
    ".md", ".markdown", ".txt", ".text", ".log", ".ini", ".cfg", ".conf", ".py", ".js", ".jsx", ".ts", ".tsx",
    ".css", ".scss", ".less", ".json", ".yaml", ".yml", ".toml", ".xml", ".html", ".htm", ".csv", ".sql", ".sh",
    ".bat", ".ps1", ".r", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".env", ".gitignore", ".dockerfile", ".vue",
    ".svelte", ".php", ".rb",
]
SUFFIXES = {
    "text": TEXT_SUFFIXES,
    "pdf": [".pdf"],
    "docx": [".docx", ".doc"],
    "xlsx": [".xlsx", ".xls", ".xlsm"],
    "pptx": [".pptx", ".ppt"],
    "image": [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".tiff", ".tif"],
}
# A token is a word of two or more ASCII word characters, or one CJK character.
TOKEN = r"([A-Za-z0-9_]{2,}|[一-鿿])"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def doc_type(path: Column) -> Column:
    found = F.lit("unknown")
    for kind, known in SUFFIXES.items():
        found = F.when(suffix(path).isin(known), F.lit(kind)).otherwise(found)
    return found


def title(content: Column, path: Column) -> Column:
    """The first of the first 20 lines that is a level-one heading; else the file's name in words."""
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 20), strip)
    heads = F.filter(lines, lambda line: line.startswith("# "))
    named = F.translate(F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", ""), "_-", "  ")
    return F.when(F.size(heads) > 0, strip(F.substring(F.element_at(heads, 1), 3, 1 << 20))).otherwise(named)


def page_text(pages: Column) -> Column:
    """Pages (number, content) under a heading each."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("## Page "), p["number"].cast("string"), F.lit("\n\n"), p["content"])), "\n\n")


def dedup_key(path: Column, chunk_id: Column, text: Column) -> Column:
    """path and chunk id; without an id, path and 16 hex digits of the text's sha-256."""
    by_id = F.concat(path, F.char(F.lit(0)), chunk_id)
    return F.when(F.coalesce(chunk_id, F.lit("")) != "", by_id).otherwise(F.concat(path, F.lit("#"), F.substring(F.sha2(text, 256), 1, 16)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def has_code(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("```")) >= 2) | strip(text).startswith("```")


def has_table(text: Column) -> Column:
    """Two lines at least, over 70 % of them between pipes."""
    lines = F.split(strip(text), "\n")
    rows = F.filter(lines, lambda line: strip(line).rlike(r"^\|.*\|$"))
    return (F.size(lines) >= 2) & (F.size(rows) / F.size(lines) > 0.7)


def preview(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)


def truncated(text: Column, length: int = 4000, mark: str = "\n...[truncated]") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def html_text(html: Column) -> Column:
    """A page's visible text: scripts, styles and tags become spaces, white space is squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))
