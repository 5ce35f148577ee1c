"""Personal data by expressions, and by contexts learned from what they find.

Base spans come from four expressions. Each is an instance; the words around it are patterns.
Patterns and instances form a graph, over which Spark scores patterns by how many distinct
known instances of one kind they introduce among all identifier-like tokens, and instances by
the patterns that introduce them; an instance that scores high is known in the next round. The
final high-confidence patterns mark identifiers that no expression found.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Bitmap, Scratch, batch, free, slices, trimmed

KINDS = ("email", "ip", "card", "phone")
LEARNED = tuple(f"ctx_{k}" for k in KINDS)

_domain = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(rb"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(rb"[0-9]{4,}")
_edge = b"\"'()[]{}<>,;:!?*#$%&|=."

_LOCAL = bytes(1 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "._%+-") else 0 for c in range(256))
_SPACE = b" \t\n\r\x0b\x0c"

#: Digits as 0, letters and _ and - as a, brackets as ( and ), what separates as it is, all else as a space:
#: a text whose folding holds none of HINTS holds nothing that _hint finds.
_FOLD = bytes(48 if 48 <= c <= 57 else 97 if chr(c).isascii() and chr(c).isalpha() or c in b"_-" else 40 if c in b"[({<" else 41 if c in b"])}>" else c if c in b"@.:" else 32 for c in range(256))
HINTS = (b"0000", b"@", b"(aa)", b"a.a", b"0.a", b"0.0", b"a.0", b"a:a", b"0:0", b"a:0", b"0:a", b"::")


def emails(raw: bytes):
    """Leftmost non-overlapping addresses: around each @, whose left side is searched once."""
    after, at = 0, -1
    while (at := raw.find(b"@", at + 1)) >= 0:
        start = at
        while start > after and _LOCAL[raw[start - 1]]:
            start -= 1
        if start < at and (m := _domain.match(raw, at)):
            yield start, m.end()
            after = m.end()
            at = after - 1
        elif start < at or at >= after:
            after = max(after, at)  # no address holds two @: the next one's left side begins here


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; raw has one byte for each code point."""
    out, folded = [("email", s, e) for s, e in emails(raw)], raw.translate(_FOLD)
    if b"0.0" in folded:
        for m in _ip.finditer(raw):
            if all(len(p.lstrip(b"0")) < 4 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
                out.append(("ip", *m.span()))
    for m in _card.finditer(raw) if folded.count(b"0") >= 13 else ():
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(b" ", b"").replace(b"-", b"")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if b"+" in raw:
        for m in _phone.finditer(raw):
            if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def single_bytes(text: str) -> bytes:
    return text.encode("latin-1", "replace")


#: A longer token is no identifier (a mail address has no more characters); a longer word of a
#: context stands in patterns as LONG_WORD, whatever it is.
LONGEST, LONG_WORD = 254, "<long>"

#: Where a token may be an identifier: four digits in a row, or what addresses have.
_hint = re.compile(rb"[0-9]{4}|@|[\[({<]at[\])}>]|[A-Za-z0-9_-]\.[A-Za-z]{2}|[0-9A-Fa-f][.:][0-9A-Fa-f]|::", re.I)
_mail = re.compile(rb"[^\s@]@[^\s@]|\S[\[({<]at[\])}>]\S|[A-Za-z0-9_-]\.[A-Za-z]{2}", re.I)
_numeric = re.compile(rb"[0-9 \t\xa0().+/-]+\Z")
_groups = re.compile(rb"\+?(?:\([0-9]++\)|[0-9]++)(?:[ \t\xa0./-]{0,3}+(?:\([0-9]++\)|[0-9]++))*+")
_address = re.compile(rb"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}\Z|[0-9A-Fa-f:]*::[0-9A-Fa-f:.]*\Z")


def may_be(token: bytes) -> list[str]:
    """The kinds that an identifier without expression may have: all with four digits in a row, else by shape."""
    if _digits.search(token):
        return list(KINDS)
    n = sum(48 <= c <= 57 for c in token) if _numeric.match(token) else 0
    like = {"email": _mail.search(token), "ip": _address.match(token) and re.search(rb"[0-9]", token), "card": 12 <= n <= 19, "phone": 6 <= n <= 15}
    return [k for k in KINDS if like[k]]


def runs(raw: bytes):
    """Adjacent groups of digits, 6 to 19 in all, as one; to whitespace on both sides but for punctuation, or behind a cue."""
    for m in _groups.finditer(raw):
        if m.end() - m.start() < 6 or not 6 <= sum(48 <= c <= 57 for c in m[0]) <= 19:
            continue
        s, e = m.span()
        before, behind = raw[max(0, s - 8) : s].rstrip(_edge), raw[e : e + 8].lstrip(_edge)
        if (not before or before[-1] in _SPACE or raw[s - 1] in b":=#") and (not behind or behind[0] in _SPACE):
            yield s, e


def identifiers(raw: bytes, base) -> list[tuple[int, int]]:
    """Runs of digit groups, and other tokens that may_be() of some kind; none longer than LONGEST or touched by a base span."""
    folded = raw.translate(_FOLD)
    numbers, hinted = folded.count(b"0") >= 6, any(h in folded for h in HINTS)
    if not numbers and not hinted:
        return []
    free = bytearray(raw)
    for _, s, e in base:
        free[s:e] = bytes(e - s)
    raw = bytes(free)
    out = [(s, e) for s, e in runs(raw)] if numbers else []
    for s, e in out:
        free[s:e] = bytes(e - s)
    raw, after = bytes(free), 0
    for m in _hint.finditer(raw) if hinted else ():
        if m.start() < after:
            continue
        left, right = raw[max(0, m.start() - LONGEST) : m.start()], raw[m.end() : m.end() + LONGEST]
        a = b"" if not left or left[-1] in _SPACE else left.split()[-1]
        b = re.match(rb"\S*", right)[0]
        start, end = m.start() - len(a), m.end() + len(b)
        token, after = raw[start:end], end
        start += len(token) - len(token.lstrip(_edge))
        end -= len(token) - len(token.rstrip(_edge))
        if 0 < end - start <= LONGEST and 0 not in (token := raw[start:end]) and may_be(token):
            out.append((start, end))
    return sorted(out)


def beside(text: str, start: int, end: int) -> tuple[list[str], str | None]:
    """The two words before a span and the one behind it, lower-cased, of a word that the span stands
    in what lies outside; each is read to its end, however far that is."""

    def word(w: str) -> str:
        return w.lower() if len(w) <= LONGEST else LONG_WORD

    reach = 48
    while len(before := text[max(0, start - reach) : start].split()) < 3 and reach < start:
        reach *= 4
    reach = 48
    while len(behind := text[end : end + reach].split(None, 1)) < 2 and end + reach < len(text):
        reach *= 4
    return [word(w) for w in before[-2:]], word(behind[0].rstrip()) if behind else None


def patterns(text: str, start: int, end: int) -> list[str]:
    """What stands around a span: two words before; a word on each side; a cue ending in : = or #."""
    before, behind = beside(text, start, end)
    out = []
    if len(before) >= 2:
        out.append(f"{before[-2]} {before[-1]} _")
    if before and behind:
        out.append(f"{before[-1]} _ {behind}")
    if before and before[-1][-1] in ":=#":
        out.append(f"{before[-1]} _")
    return out


def occurrences(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str | None, int, int, str, list[str], list[str]]]]:
    """Base spans; and (kind or None, start, end, instance, patterns, what it may be) of them and of other identifier-like tokens."""
    if not text:
        return [], []
    raw = single_bytes(text)
    base = base_spans(raw)
    rest = identifiers(raw, base)
    return base, [(k, s, e, text[s:e], patterns(text, s, e), [k] if k else may_be(raw[s:e])) for k, s, e in [*base, *((None, s, e) for s, e in rest)]]


SCAN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("digest", pa.binary()),
        ("base", pa.string()),
        ("seen", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("may", pa.list_(pa.string()))]))),
    ]
)
SCAN_DDL = "doc_id long, digest binary, base string, seen array<struct<kind:string,start:bigint,end:bigint,instance:string,patterns:array<string>,may:array<string>>>"


def digest(text: str | None) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() if text else b""


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of doc_id and text: the text's digest, base spans and occurrences; no shuffle."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            found = [occurrences(t) for t in texts]
            yield batch(
                SCAN,
                b.column(0),
                [digest(t) for t in texts],
                [",".join(f"{k}:{s}:{e}" for k, s, e in f[0]) for f in found],
                [[dict(zip(("kind", "start", "end", "instance", "patterns", "may"), o, strict=True)) for o in f[1]] for f in found],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCAN_DDL)


def discover(scanned: DataFrame, scratch: Scratch, *, least_seeds: int = 3, confident: float = 0.8) -> DataFrame:
    """digest, found (learned spans as kind:start:end in order): one row for each text that has any.

    A pattern's score for a kind is the share of that kind's known instances among all distinct
    instances that it introduces, if they are `least_seeds` at least; a round makes an instance
    known whose best pattern reaches `confident`, if it may be of that kind by its shape. What is
    known stays so, and rounds go on until one makes nothing known. Counts are over distinct
    instances of the whole corpus, so copies of a text add no weight. Edges are pre-aggregated
    before each shuffle.
    """
    seen = scanned.where(F.size("seen") > 0).select("digest", F.explode("seen").alias("o")).select("digest", "o.*")
    edges = scratch.cut(
        seen.select("kind", "instance", "may", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.min("may").alias("may")),
        "edges",
    )
    fits = F.array_contains("may", F.col("learned"))
    known = scratch.cut(edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("known")), "known0")
    step = 0
    while True:
        scored = (
            edges.join(known, "instance", "left")
            .groupBy("pattern")
            .agg(F.count("*").alias("n"), *(F.count(F.when(F.col("known") == k, 1)).alias(k) for k in KINDS))
            .withColumn("best", F.greatest(*KINDS))
            .where((F.col("best") >= least_seeds) & (F.col("best") >= confident * F.col("n")))
            .select("pattern", F.coalesce(*(F.when(F.col(k) == F.col("best"), F.lit(k)) for k in KINDS)).alias("learned"), (F.col("best") / F.col("n")).alias("confidence"))
        )
        scored = scratch.cut(scored, f"patterns{step}")
        new = edges.where("kind is null").join(scored, "pattern").where(fits).groupBy("instance").agg(F.max_by("learned", F.struct("confidence", "learned")).alias("known"))
        new = scratch.cut(new.join(known, "instance", "left_anti"), f"new{step}")
        if new.isEmpty():
            break
        step += 1
        known = scratch.cut(known.unionByName(new), f"known{step}")
        scratch.drop(f"known{step - 1}", f"new{step - 1}", f"patterns{step - 1}")
    marks = (
        seen.where("kind is null")
        .select("digest", "start", "end", "may", F.explode("patterns").alias("pattern"))
        .join(scored, "pattern")
        .where(fits)
        .groupBy("digest", "start", "end")
        .agg(F.max_by("learned", F.struct("confidence", "learned")).alias("learned"))
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("learned")).alias("k"), "start", "end", "learned")))
    return marks.groupBy("digest").agg(F.concat_ws(",", F.transform(ordered, lambda x: F.concat(F.lit("ctx_"), x["learned"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))).alias("found"))


#: Rows of one text meet its learned spans in so many tasks, so that no task gets all copies.
SALTS = 32


def find(docs: DataFrame, scratch: Scratch, **learning) -> DataFrame:
    """doc_id, base (spans by expression) and found (learned spans) of every row of doc_id and text.

    A learned span is a token of LONGEST characters at most, or a run of digit groups. Null and
    empty texts have no spans; null ids and repeated rows come back as they are. Rows without an
    identifier-like token take no part in a shuffle, and those of one text are dealt out.
    """
    scanned = scratch.cut(scan(docs), "scan")
    learned = discover(scanned, scratch, **learning)
    open_ = F.exists("seen", lambda o: o["kind"].isNull())
    salted = learned.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = scanned.where(open_).select("doc_id", "digest", "base", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    met = met.join(salted, ["digest", "salt"], "left").select("doc_id", "base", F.coalesce("found", F.lit("")).alias("found"))
    return met.unionByName(scanned.where(~open_).select("doc_id", "base", F.lit("").alias("found")))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{k.removeprefix('ctx_').upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def parsed(spans: str | None) -> list[tuple[str, int, int]]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))] if spans else []


def redact(docs: DataFrame, scratch: Scratch, **learning) -> DataFrame:
    """`docs` with every span of personal data in text replaced by its kind; other columns stay.

    Learned spans join by the text's hash, so copies get them all, dealt out over SALTS tasks; base
    spans are found where the text is rewritten. A fixed-size bitmap of the texts that have learned
    spans keeps all others out of the shuffle. Null and empty texts stay.
    """
    learned = scratch.cut(discover(scratch.cut(scan(docs), "scan"), scratch, **learning).withColumn("t", F.xxhash64("digest")), "learned")
    scratch.drop("scan")

    @F.pandas_udf("string")
    def rewrite(texts, found):
        return pd.Series([masked(t, [*base_spans(single_bytes(t)), *parsed(f)]) if t else t for t, f in zip(texts, found, strict=True)], dtype=object)

    key, salt, marks = free(docs, "_digest"), free(docs, "_salt"), free(docs, "_found")
    known = Bitmap(learned, "t", scratch, "known")
    keyed = docs.withColumn(key, F.when(F.length("text") > 0, F.unhex(F.md5(F.col("text").cast("binary")))).otherwise(F.lit(b"")))
    salted = learned.select(F.col("digest").alias(key), F.col("found").alias(marks), F.explode(F.array(*map(F.lit, range(SALTS)))).alias(salt))
    hashed = F.xxhash64(key)
    met = known.split(keyed, hashed, maybe=True).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [key, salt], "left")
    rest = known.split(keyed, hashed, maybe=False).withColumn(marks, F.lit(""))
    return met.select(*docs.columns, marks).unionByName(rest.select(*docs.columns, marks)).withColumn("text", rewrite("text", marks)).select(*docs.columns)
