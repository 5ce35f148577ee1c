"""Benchmark decontamination with a generalised suffix automaton.

Automata of all normalised test items are built once, in tasks, and read by every task. A document's
words stream through it; after each word it holds the longest run of words, ending there, that
also stands in some item. Where that run reaches a window's length the window is contaminated.
Runs of words that are no two neighbours of any item cannot reach it and are skipped in bulk.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, batch, free, slices, utf8

#: Lower-cases A-Z and turns every byte that is no word's into a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_word = re.compile(rb"[^\x20]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """A generalised suffix automaton over word numbers; `window` is the length that contaminates.

    An item shorter than the window, but not empty, is one window of its own length.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = 10):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if ws]
        for _, ids in coded:
            at = 0
            for c in ids:
                at = self._extend(at, c)
        self.windows: dict[int, set] = {}  # items by state, of windows of full length
        own: dict[int, list[tuple[int, int]]] = {}
        for item, ids in coded:
            at = 0
            for k, c in enumerate(ids):
                at = self.next[at][c]
                if k + 1 >= window:
                    self.windows.setdefault(self.cut(at), set()).add(item)
            if len(ids) < window:
                own.setdefault(at, []).append((len(ids), item))
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]  # short items that end a state's string
        if own:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.short[s] = [*self.short[self.link[s]], *own.get(s, [])]
        self.least = min([window, *(n for ends in own.values() for n, _ in ends)])
        size = len(self.number)
        pairs = {a * size + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def cut(self, state: int) -> int:
        """The state of the last `window` words of a state's string."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def packed(self) -> Packed:
        return Packed(self)


class Packed:
    """An automaton as arrays, some 60 bytes a word: what tasks hold and read."""

    def __init__(self, made: Automaton):
        self.window, self.least, self.pairs = made.window, made.least, made.pairs
        self.number, self.size = made.number, max(1, len(made.number))
        states = [s for s, n in enumerate(made.next) for _ in n]
        words_ = [c for n in made.next for c in n]
        keys = np.array(states, dtype=np.int64) * self.size + np.array(words_, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([t for n in made.next for t in n.values()], dtype=np.int32)[order]
        self.link, self.length = np.array(made.link, dtype=np.int32), np.array(made.length, dtype=np.int32)
        self.full = np.array([made.cut(s) if n >= made.window else -1 for s, n in enumerate(made.length)], dtype=np.int32)
        self.windows, self.short = made.windows, {s: ends for s, ends in enumerate(made.short) if ends}

    def step(self, state: int, word: int) -> int:
        """The state behind a word, -1 if there is none."""
        key = state * self.size + word
        k = int(np.searchsorted(self.keys, key))
        return int(self.to[k]) if k < len(self.keys) and self.keys[k] == key else -1

    def runs(self, ws: list[bytes]):
        """Stretches of words in which every two neighbours are neighbours in some item."""
        ids = np.fromiter(map(self.number.get, ws, [-1] * len(ws)), dtype=np.int64, count=len(ws))
        known = ids >= 0
        if self.least == 1:
            joined = known[:-1] & known[1:]
            starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
            ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        else:
            at = np.flatnonzero(known[:-1] & known[1:])
            if not len(at) or not len(self.pairs):
                return ids, ()
            code = ids[at] * len(self.number) + ids[at + 1]
            k = np.searchsorted(self.pairs, code)
            at = at[self.pairs[np.minimum(k, len(self.pairs) - 1)] == code]
            if not len(at):
                return ids, ()
            gap = np.flatnonzero(np.diff(at) > 1)
            starts, ends = at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))] + 2
        keep = ends - starts >= self.least
        return ids, zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Contaminated word spans (merged, end exclusive) and the items whose windows occur."""
        found: list[tuple[int, int]] = []
        items: set = set()
        if len(ws) < self.least or not self.number:
            return found, items
        ids, stretches = self.runs(ws)
        for start, end in stretches:
            state = matched = 0
            for i in range(start, end):
                c = int(ids[i])
                to = self.step(state, c)
                while state and to < 0:
                    state = int(self.link[state])
                    matched = int(self.length[state])
                    to = self.step(state, c)
                if to >= 0:
                    state, matched = to, matched + 1
                longest = 0
                if matched >= self.window:
                    longest = self.window
                    items |= self.windows.get(int(self.full[state]), set())
                for n, item in self.short.get(state, ()):
                    if n <= matched:
                        items.add(item)
                        longest = max(longest, n)
                if longest:
                    a = i + 1 - longest
                    while found and a <= found[-1][1]:
                        a = min(a, found.pop()[0])
                    found.append((a, i + 1))
        return found, items


#: Bytes of item text in an automaton, and of packed automata that a task holds at a time.
PART_BYTES, HELD_BYTES = 3_000_000, 256_000_000


def automata(items: DataFrame, *, window: int = 10, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES):
    """Lists of pickled automata, together of all items (item_id, text): each list of at most
    `held_bytes`, or of one automaton; each automaton of about `part_bytes` of text, or of one item.

    They are built in tasks. The driver holds one list at a time and sends it out: a broadcast of
    that size at most. Null and empty texts have no words; a null item_id is an item of no name.
    """
    rows = items.select(F.col("item_id").alias("item"), utf8().alias("t")).where("length(t) > 0")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))

    def build(pdf):
        made = Automaton([(None if pd.isna(i) else i, words(t)) for i, t in zip(pdf["item"].astype(object), pdf["t"], strict=True)], window)
        return pd.DataFrame({"made": [pickle.dumps(made.packed(), protocol=pickle.HIGHEST_PROTOCOL)]})

    part = F.pmod(F.xxhash64("item", "t"), F.lit(parts))
    held, size = [], 0
    for r in rows.groupBy(part.alias("part")).applyInPandas(build, "made binary").toLocalIterator():
        raw = bytes(r["made"])
        if held and size + len(raw) > held_bytes:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    yield held


def single(items: DataFrame, **how) -> list[bytes] | None:
    """The list of automata, if there is but one."""
    lists = automata(items, **how)
    first = next(lists)
    return first if next(lists, None) is None else None


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_opened: dict = {}


def opened(sent) -> list[Packed]:
    """A broadcast's automata; a worker keeps those of the last one."""
    if sent.value is not _opened.get("raw"):
        _opened.update(raw=sent.value, made=[pickle.loads(x) for x in sent.value])
    return _opened["made"]


def looked(ws: list[bytes], parts) -> tuple[list[tuple[int, int]], set]:
    """Hit spans and items of a text's words, over all automata."""
    spans, items = [], set()
    for p in parts:
        s, i = p.hits(ws)
        spans += s
        items |= i
    return merged(spans), items


def named(items) -> list[str]:
    """Items as sorted strings; one of no name is not among them."""
    return sorted(str(i) for i in items if i is not None)


HITS = pa.schema([("spans", pa.binary()), ("items", pa.list_(pa.string()))])
HITS_DDL = "struct<spans:binary,items:array<string>>"


def hits(rows: DataFrame, items: DataFrame, column: str, scratch: Scratch, **how) -> DataFrame:
    """`rows` with `column`: spans (pairs of 32-bit word numbers) and items (their names) of the text.

    Where the automata exceed what a task may hold, there are several passes over the rows, which
    are written in between.
    """
    for step, held in enumerate(automata(items, **how)):
        sent = rows.sparkSession.sparkContext.broadcast(held)

        @F.pandas_udf(HITS_DDL)
        def look(texts, before, sent=sent):
            parts, out = opened(sent), []
            for text, old in zip(texts, before["spans"], strict=True):
                spans, found = looked(words(text or b""), parts)
                out.append((spans, found, old))
            spans = [np.array(merged([*s, *(map(tuple, np.frombuffer(o, dtype=np.int32).reshape(-1, 2).tolist()) if o else ())]), dtype=np.int32).tobytes() for s, _, o in out]
            names = [sorted({*named(f), *(i if i is not None else ())}) for (_, f, _), i in zip(out, before["items"], strict=True)]
            return pd.DataFrame({"spans": pd.Series(spans, dtype=object), "items": pd.Series(names, dtype=object)})

        if step:
            rows = scratch.cut(rows, f"pass{step}")
        nothing = F.struct(F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"))
        rows = rows.withColumn(column, look.asNondeterministic()(utf8(), F.col(column) if step else nothing))
    return rows


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def report(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of doc_id and text; no shuffle.

    Null and empty texts have no words and no hits; the hash is then that of nothing. An item of
    null id is hit as any other, and neither counted nor named.
    """
    if (only := single(items, **how)) is not None:
        sent = docs.sparkSession.sparkContext.broadcast(only)

        def run(batches):
            parts = opened(sent)
            for b in slices(batches):
                rows = []
                for text in b.column(1).to_pylist():
                    ws = words(text or b"")
                    spans, found = looked(ws, parts)
                    ids = named(found)
                    rows.append((len(ws), sum(e - s for s, e in spans), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(spans)))
                if rows:
                    yield batch(SCHEMA, b.column(0), *(list(c) for c in zip(*rows, strict=True)))

        return docs.select("doc_id", utf8().alias("t")).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    found = hits(docs.select("doc_id", "text"), items, "_hits", scratch or Scratch(docs.sparkSession, "decontam"), **how)

    def count(batches):
        for b in slices(batches):
            rows = []
            for text, hit in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = np.frombuffer(hit["spans"], dtype=np.int32).reshape(-1, 2)
                rows.append((len(words(text or b"")), int((spans[:, 1] - spans[:, 0]).sum()), len(hit["items"]), hashlib.sha256(",".join(hit["items"]).encode()).hexdigest(), bool(len(spans))))
            if rows:
                yield batch(SCHEMA, b.column(0), *(list(c) for c in zip(*rows, strict=True)))

    return found.select("doc_id", utf8().alias("t"), "_hits").mapInArrow(count, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def kept_words(ws: list[bytes], spans, parts, window: int) -> np.ndarray:
    """Which words stay: all but the spans', and but what then stands in a window across the places
    where text has closed up. Only the words around those places are looked at again."""
    there = np.ones(len(ws), dtype=bool)
    seams = []
    for s, e in spans:
        there[s:e] = False
        seams.append(s)
    while seams and parts:
        left = np.flatnonzero(there)
        again = []
        for s in seams:
            k = int(np.searchsorted(left, s))
            near = left[max(0, k - window + 1) : k + window - 1]
            again += [near[a:b] for a, b in looked([ws[i] for i in near], parts)[0]]
        for gone in again:
            there[gone] = False
        seams = [int(gone[0]) for gone in again]
    return there


def without(text: bytes, spans, parts, *, most_coverage: float, window: int) -> bytes | None:
    """The text without its contaminated spans of words, or None if they cover more than
    `most_coverage` of its words."""
    if not len(spans):
        return text
    at = [m.span() for m in _word.finditer(text.translate(_WORDS))]
    if at and sum(e - s for s, e in spans) > most_coverage * len(at):
        return None
    there = kept_words(words(text), spans, parts, window)
    gone = np.flatnonzero(~there)
    if not len(gone):
        return text
    out, last = [], 0
    edges = np.flatnonzero(np.diff(gone) > 1)
    for a, b in zip(gone[np.concatenate(([0], edges + 1))].tolist(), gone[np.concatenate((edges, [len(gone) - 1]))].tolist(), strict=True):
        out.append(text[last : at[a][0]])
        last = at[b][1]
    return b"".join([*out, text[last:]])


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, *, most_coverage: float = 0.5, window: int = 10, **how) -> DataFrame:
    """`docs` without contaminated spans of text, and without documents of which they cover more
    than `most_coverage`; all other columns stay. No shuffle. Null and empty texts stay.

    What closes up around a removed span is looked at again, until nothing is hit.
    """
    made = free(docs, "_made")
    if (only := single(items, window=window, **how)) is not None:
        sent = docs.sparkSession.sparkContext.broadcast(only)

        @F.pandas_udf("struct<gone:boolean,text:binary>")
        def strip(texts):
            parts = opened(sent)
            done = [without(t, looked(words(t), parts)[0], parts, most_coverage=most_coverage, window=window) if t else t for t in texts]
            return pd.DataFrame({"gone": [bool(t) and m is None for t, m in zip(texts, done, strict=True)], "text": pd.Series(done, dtype=object)})

        # taken for one that may answer otherwise each time, it is asked once a row, not once for each use
        kept = docs.withColumn(made, strip.asNondeterministic()(utf8())).where(~F.col(f"{made}.gone"))
        return kept.withColumn("text", F.col(f"{made}.text").cast("string")).select(*docs.columns)

    # more than a task may hold: all passes find, one step removes, and rows that changed go through all again
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    found = free(docs, "_hits")

    @F.pandas_udf("struct<gone:boolean,text:binary>")
    def take(texts, spans, first):
        done = [without(t, np.frombuffer(s, dtype=np.int32).reshape(-1, 2).tolist(), (), most_coverage=most_coverage if f else 1.0, window=window) if t else t for t, s, f in zip(texts, spans, first, strict=True)]
        return pd.DataFrame({"gone": [bool(t) and m is None for t, m in zip(texts, done, strict=True)], "text": pd.Series(done, dtype=object)})

    out, rows, step = None, docs, 0
    while True:
        looked_at = scratch.cut(hits(rows, items, found, Scratch(docs.sparkSession, "decontam"), window=window, **how), f"hits{step}")
        hit = F.length(F.col(f"{found}.spans")) > 0
        still = looked_at.where(~hit).select(*docs.columns)
        out = still if out is None else out.unionByName(still)
        if looked_at.where(hit).isEmpty():
            return out
        cleaned = looked_at.where(hit).withColumn(made, take.asNondeterministic()(utf8(), F.col(f"{found}.spans"), F.lit(step == 0))).where(~F.col(f"{made}.gone"))
        rows = scratch.cut(cleaned.withColumn("text", F.col(f"{made}.text").cast("string")).select(*docs.columns), f"rows{step}")
        step += 1
