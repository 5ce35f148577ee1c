"""Sum-of-squares online packing of token sequences into windows.

What a document has beyond whole windows goes to the open window whose choice makes the sum of
squared counts of windows by fill level smallest; an array over fill levels holds the counts.
Documents may be cut, so no fill is wasted: windows that are open at the end of a partition are
poured together, and what then remains fills sequences whose lengths are powers of two, which
need no padding. The more documents a partition has, the fewer of its windows are left open.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import batch, slices, trimmed
from .tokenise import REMEMBERED, encoder

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs one stream of documents. A piece is (doc_id, start, ids, doc_tokens); a finished
    sequence is a list of pieces whose lengths add up to the window or to a power of two."""

    def __init__(self, window: int = 2048):
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)  # open windows by fill
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """The fill level to put `size` tokens on: 0 opens a window; ties go to the fullest."""
        fits = np.flatnonzero(self.level[1 : self.window - size + 1]) + 1
        if not len(fits):
            return 0
        to = fits + size
        change = np.where(to == self.window, 1 - 2 * self.level[fits], 2 * (self.level[to] - self.level[fits]) + 2)
        k = len(fits) - 1 - int(np.argmin(change[::-1]))
        return int(fits[k]) if change[k] <= 2 * self.level[size] + 1 else 0

    def add(self, doc_id, ids: np.ndarray):
        """Place a document; yields sequences that it fills."""
        n, at = len(ids), 0
        while n - at >= self.window:
            yield [(doc_id, at, ids[at : at + self.window], n)]
            at += self.window
        if at == n:
            return
        piece, fill = (doc_id, at, ids[at:].copy(), n), self.choose(n - at)
        held = self.open[fill].pop() if fill else []
        self.level[fill] -= bool(fill)
        held.append(piece)
        fill += n - at
        if fill == self.window:
            yield held
            return
        self.level[fill] += 1
        self.open[fill].append(held)

    def cut(self, pieces, size: int | None = None):
        """Full sequences of the pieces in order; returns the pieces that are left."""
        size = size or self.window
        held, room = [], size
        for doc_id, start, ids, n in pieces:
            at = 0
            while at < len(ids):
                part = ids[at : at + room]
                held.append((doc_id, start + at, part, n))
                at, room = at + len(part), room - len(part)
                if not room:
                    yield held
                    held, room = [], size
        return held

    def finish(self):
        """Empty all open windows, the fullest first."""
        rest = yield from self.cut([p for fill in range(self.window, 0, -1) for held in self.open[fill] for p in held])
        left = sum(len(p[2]) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            full, more = self.split(rest, size)
            yield full
            rest, left = more, left - size
        self.__init__(self.window)

    @staticmethod
    def split(pieces, size: int):
        full, more = [], []
        for doc_id, start, ids, n in pieces:
            take = min(size, len(ids))
            if take:
                full.append((doc_id, start, ids[:take], n))
            if take < len(ids):
                more.append((doc_id, start + take, ids[take:], n))
            size -= take
        return full, more


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, window: int = 2048, with_ids: bool = False, remembered: int = REMEMBERED, least_rows: int = 8192) -> DataFrame:
    """One row for each piece of every document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids if asked for. No shuffle: each partition packs its own
    documents, and sequences never cross partitions. All are full or of a power of two, so none is padded.

    Partitions of few rows are read together, so that one has about `least_rows` or more: a task
    holds the windows that are open, its partition's tokens at most. A null or empty text is its
    end id alone. Null ids and repeated rows are documents like any
    other. sequence_id holds the partition above bit 40; it is unique, not gapless.
    """
    schema = SCHEMA if with_ids else pa.schema(list(SCHEMA)[:-1])

    def run(batches):
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer, remembered), Packer(window)
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def emit(held):
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, n in held:
                row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            sequence += 1

        def out():
            made = batch(schema, *zip(*rows, strict=True))
            rows.clear()
            return made

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for held in packer.add(doc_id, np.append(encode(text), np.array([end_id], dtype=encode.dtype))):
                    emit(held)
                if len(rows) >= 4096:
                    yield out()
        for held in packer.finish():
            emit(held)
        if rows:
            yield out()

    rows = docs.select("doc_id", "text")
    return rows.coalesce(max(1, rows.count() // least_rows)).mapInArrow(trimmed(run), DDL + ", ids array<int>" * with_ids)
