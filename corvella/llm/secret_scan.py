"""Secret scan: keyword prefilter, anchored expressions near hits, embedded checksums.

An Aho-Corasick automaton finds keywords in one pass over a text; an expression is then tried
only where a keyword stands. Runs of hex digits have no keyword: the text's characters are
folded to their class and a run of the least length serves as one. Tokens that carry a checksum
of their own are accepted only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import batch

KINDS = ("assign", "access", "hex", "checked", "jwt")
BASE = KINDS[:3]

# Keywords, and prefixes of tokens that end in six base-62 digits of their crc32.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
JWT_WORD = "eyj"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_assign = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile(rb"AKIA[A-Z0-9]+")
_hex = re.compile(rb"[0-9a-f]+")
_checked = re.compile(rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_jwt = re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
_run = re.compile(rb"[A-Za-z0-9_-]++")

#: Lower-cases A-Z; and folds hex digits to one byte, all else to another.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
HEX_LEAST, ASSIGN_LEAST, ACCESS_LEAST = 24, 6, 20

_machine = None


def machine():
    """The automaton: each keyword's length and what to try where it stands."""
    global _machine
    if _machine is None:
        import ahocorasick

        m = ahocorasick.Automaton()
        for what, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,)), ("checked", CHECKED_WORDS), ("jwt", (JWT_WORD,))):
            for w in words:
                m.add_word(w, (len(w), what))
        m.make_automaton()
        _machine = m
    return _machine


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def checksum_holds(body: bytes, check: bytes) -> bool:
    return base62(zlib.crc32(body), 6).encode() == check


def jwt_holds(head: bytes) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError, RecursionError):
        return False


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets, by start, then kind as in KINDS; code points, end exclusive.

    Within a kind leftmost and non-overlapping: a match that fails its length or its checksum
    still uses up its characters, as a search that goes on behind it does.
    """
    if not text:
        return []
    raw = text.encode("latin-1", "replace")  # one byte for each code point; no expression wants more than ASCII
    out, after = [], dict.fromkeys(KINDS, 0)
    for last, (n, what) in machine().iter(raw.translate(_LOWER).decode("latin-1")):
        at = last - n + 1
        if at < after[what]:
            continue
        if what == "assign" and (m := _assign.match(raw, at)):
            after[what] = m.end()
            if len(m[1]) >= ASSIGN_LEAST:
                out.append((at, what, m.end()))
        elif what == "access" and (m := _access.match(raw, at)):
            after[what] = m.end()
            if m.end() - at >= ACCESS_LEAST:
                out.append((at, what, m.end()))
        elif what == "checked" and (m := _checked.match(raw, at)):
            after[what] = m.end()
            if checksum_holds(m[2], m[3]):
                out.append((at, what, m.end()))
        elif what == "jwt":
            m = _jwt.match(raw, at)
            # no token begins further on in a run that begins none: what follows the run is the same
            after[what] = m.end() if m else _run.match(raw, at).end() if raw.startswith(b"eyJ", at) else at + 1
            if m and jwt_holds(m[1]):
                out.append((at, what, m.end()))
    folded, run, at = raw.translate(_FOLD), b"x" * HEX_LEAST, 0
    while (at := folded.find(run, at)) >= 0:
        end = _hex.match(raw, at).end()
        out.append((at, "hex", end))
        at = end
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def masked(text: str, found, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by `mark`."""
    out, at = [], 0
    for start, _, end in sorted(found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, base_sha256 and spans of every row of doc_id and text; no shuffle.

    A text of any length is searched whole, in time that grows with its length. Null and empty texts have no spans (the hash is that of nothing); null ids and repeated rows
    come back as they are.
    """

    def run(batches):
        for b in batches:
            found = [spans(t) for t in b.column(1).to_pylist()]
            yield batch(
                SCHEMA,
                b.column(0),
                *([sum(s[1] == k for s in f) for f in found] for k in KINDS),
                [hashlib.sha256(joined(s for s in f if s[1] in BASE).encode()).hexdigest() for f in found],
                [joined(f) for f in found],
            )

    ddl = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
