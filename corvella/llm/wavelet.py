"""Token ids as wavelet matrices: one compressed file for each shard.

A shard's ids are numbered densely; the numbers' bits, from the highest, form planes, between
which the ids are parted stably into zeros and ones. Rank directories over the planes answer
which id stands at a place, how often an id occurs before a place, and where its k-th
occurrence stands, in as many steps as there are planes. Files hold whole documents in
ascending order of doc_id with their lengths, and files follow each other in that order.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, batch, slices, trimmed
from .tokenise import encoder

MAGIC = b"CRVWM002"
#: Bits for each entry of a rank directory, and for each part of a plane that is compressed by itself.
BLOCK, PART = 512, 1 << 19
_WORDS = BLOCK // 64


def _planes(codes: np.ndarray, depth: int):
    """The bit-planes from the highest, each as bits and how many zeros it has."""
    for k in range(depth - 1, -1, -1):
        bit = (codes & codes.dtype.type(1 << k)).astype(np.bool_)
        ones = np.flatnonzero(bit)
        yield np.packbits(bit, bitorder="little"), len(codes) - len(ones)
        if k:
            codes = np.concatenate((codes[np.flatnonzero(~bit)], codes[ones]))


def encode(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """A file's bytes: ids of whole documents, whose ids (or None) and lengths are given.

    A plane's parts hold their rank directory (ones before each block, within the part) and their
    bits; the head says how many ones stand before each part, and where everything lies.
    """
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, dtype=np.int64)
    code = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, dtype=np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    depth = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    press = zstandard.ZstdCompressor(level=1).compress
    sections = [
        alphabet.astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array(lengths, dtype="<u4").tobytes(),
    ]
    pressed, zeros, before = list(map(press, sections)), [], []
    for plane, z in _planes(code[ids], depth):
        zeros.append(z)
        total, own = 0, []
        for at in range(0, len(plane), PART // 8):
            bits = plane[at : at + PART // 8]
            bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
            ones = np.bitwise_count(bits.view("<u8")).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint32)
            directory = np.cumsum(ones, dtype=np.uint32) - ones
            own.append(total)
            total += int(ones.sum())
            pressed.append(press(directory.astype("<u4").tobytes() + bits.tobytes()))
        before.append(own)
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "zeros": zeros, "before": before, "sizes": list(map(len, sections)), "sections": list(map(len, pressed))}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *pressed])


class WaveletMatrix:
    """An opened file: only its head is read, and of the rest what a question needs is inflated."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", raw, 8)
        head = json.loads(raw[12 : 12 + size])
        self._raw, self._sizes = raw, head["sizes"]
        self._at = np.concatenate(([0], np.cumsum(head["sections"]))) + 12 + size
        self.n, self.zeros, self.depth = head["n"], head["zeros"], len(head["zeros"])
        self.before = [np.array(x, dtype=np.int64) for x in head["before"]]
        self.parts = -(-self.n // PART)
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._known: dict[int, bytes] = {}

    def _section(self, i: int) -> bytes:
        if i not in self._known:
            full = self._sizes[i]
            self._known[i] = zstandard.ZstdDecompressor().decompress(self._raw[self._at[i] : self._at[i + 1]], max_output_size=full) if full else b""
        return self._known[i]

    @property
    def alphabet(self) -> np.ndarray:
        return np.frombuffer(self._section(0), dtype="<u4")

    @property
    def doc_ids(self) -> list:
        ids, none = np.frombuffer(self._section(1), dtype="<i8"), np.frombuffer(self._section(2), dtype=np.uint8)
        return [None if x else int(d) for d, x in zip(ids, none, strict=True)]

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._section(3), dtype="<u4")

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))

    def part(self, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Directory and 64-bit words of a part of a plane."""
        if (k, p) not in self._open:
            i = 4 + k * self.parts + p
            bits = min(PART, self.n - p * PART)
            blocks = -(-bits // BLOCK)
            made = zstandard.ZstdDecompressor().decompress(self._raw[self._at[i] : self._at[i + 1]], max_output_size=blocks * (4 + BLOCK // 8))
            self._open[k, p] = np.frombuffer(made, dtype="<u4", count=blocks), np.frombuffer(made, dtype="<u8", offset=4 * blocks)
        return self._open[k, p]

    def ones(self, k: int, places: np.ndarray) -> np.ndarray:
        """Ones of plane k before each of many places: the part's number, the directory's, and a block's rest."""
        out = np.zeros(len(places), dtype=np.int64)
        part = np.minimum(places // PART, max(0, self.parts - 1))
        for p in np.unique(part).tolist():
            directory, words = self.part(k, p)
            at = np.flatnonzero(part == p)
            i = places[at] - p * PART
            block = np.minimum(i // BLOCK, len(directory) - 1)
            total = self.before[k][p] + directory[block].astype(np.int64)
            left = i - block * BLOCK
            for w in range(_WORDS):
                bits = np.clip(left - 64 * w, 0, 64).astype(np.uint64)
                mask = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
                total += np.bitwise_count(words[block * _WORDS + w] & mask)
            out[at] = total
        return out

    def bits(self, k: int, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), dtype=np.int64)
        part = places // PART
        for p in np.unique(part).tolist():
            _, words = self.part(k, p)
            at = np.flatnonzero(part == p)
            i = places[at] - p * PART
            out[at] = (words[i // 64] >> (i % 64).astype(np.uint64)) & np.uint64(1)
        return out

    def access_many(self, places) -> np.ndarray:
        """The ids at many places."""
        i = np.array(places, dtype=np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError(places)
        code = np.zeros(len(i), dtype=np.int64)
        for k in range(self.depth):
            bit, ones = self.bits(k, i), self.ones(k, i)
            code = code << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return self.alphabet[code] if len(i) else np.empty(0, dtype="<u4")

    def access(self, i: int) -> int:
        """The id at place i."""
        return int(self.access_many([i])[0])

    def _code(self, token: int) -> int | None:
        c = int(np.searchsorted(self.alphabet, token))
        return c if c < len(self.alphabet) and self.alphabet[c] == token else None

    def _ranges(self, code: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(self.depth):
            a, b = self.ones(k, lo), self.ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if code >> (self.depth - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count_many(self, token: int, lo, hi) -> np.ndarray:
        """How often an id occurs in each of many ranges of places, ends exclusive."""
        lo, hi = (np.clip(np.array(x, dtype=np.int64), 0, self.n) for x in (lo, hi))
        code = self._code(token)
        if code is None or not self.n:
            return np.zeros(len(lo), dtype=np.int64)
        a, b = self._ranges(code, lo, hi)
        return np.maximum(0, b - a)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return int(self.count_many(token, [lo], [self.n if hi is None else hi])[0])

    def _select_in(self, k: int, bit: int, j: int) -> int:
        """Where the j-th (from 0) one or zero of plane k stands."""
        firsts = self.before[k] if bit else np.arange(self.parts, dtype=np.int64) * PART - self.before[k]
        p = int(np.searchsorted(firsts, j, side="right")) - 1
        directory, words = self.part(k, p)
        inner = directory if bit else np.arange(len(directory), dtype=np.int64) * BLOCK - directory
        j -= int(firsts[p])
        block = int(np.searchsorted(inner, j, side="right")) - 1
        bits = np.unpackbits(words[block * _WORDS : (block + 1) * _WORDS].view(np.uint8), bitorder="little")
        return p * PART + block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(inner[block])])

    def select(self, token: int, j: int) -> int:
        """The place of an id's j-th occurrence, from 0."""
        code = self._code(token)
        lo, hi = (0, 0) if code is None else (int(x[0]) for x in self._ranges(code, np.array([0]), np.array([self.n])))
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.depth - 1, -1, -1):
            bit = code >> (self.depth - 1 - k) & 1
            i = self._select_in(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest, each parting put back."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        codes = np.zeros(self.n, dtype=kind)
        for k in range(self.depth - 1, -1, -1):
            words = np.concatenate([self.part(k, p)[1] for p in range(self.parts)]) if self.parts else np.empty(0, dtype="<u8")
            bit = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(np.bool_)
            if k == self.depth - 1:
                codes = bit.astype(kind)
                continue
            out, z = np.empty(self.n, dtype=kind), self.zeros[k]
            out[np.flatnonzero(~bit)] = codes[:z]
            out[np.flatnonzero(bit)] = codes[z:] | kind(1 << (self.depth - 1 - k))
            codes = out
        return self.alphabet[codes] if self.n else np.empty(0, dtype="<u4")


MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file under its final name in one step, on any file system that pyarrow opens."""
    import uuid

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    draft = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, f"{at}/{name}")


def write(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Write every document's ids, its end id appended, to files below `folder`; returns the manifest's frame.

    A null text is empty: its end id alone. Rows are dealt by ranges of (doc_id, hash of text) and
    sorted, null ids first, equal ids by text: order is total but for equal rows, between which it makes no difference. A file takes
    documents until it has `shard_tokens`. File names follow from partition and place, contents
    from the rows, so a task that runs again writes the same files. Running the frame writes.
    """
    dealt = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")

    def run(batches):
        from pyspark import TaskContext

        to_ids, part, piece = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=to_ids.dtype).tobytes()
        ids, doc_ids, lengths, total = [], [], [], 0

        def flush():
            nonlocal piece, total
            name = f"shard-{part:08d}-{piece:06d}.crvwm"
            put(folder, name, encode(np.frombuffer(b"".join(ids), dtype=to_ids.dtype), doc_ids, lengths))
            row = batch(MANIFEST, [name], [part], [piece], [len(doc_ids)], [total])
            piece, total = piece + 1, 0
            for x in (ids, doc_ids, lengths):
                x.clear()
            return row

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = to_ids(text)
                ids += (made.tobytes(), end)
                doc_ids.append(doc_id)
                lengths.append(len(made) + 1)
                total += len(made) + 1
                if total >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    return dealt.select("doc_id", "text").mapInArrow(trimmed(run), "file string, part long, piece long, n_docs long, n_tokens long")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("first_id", pa.int64()), ("n_end", pa.int64())])
READ_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_end long"


def get(folder: str, name: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{at}/{name}") as f:
        return f.read()


def read(folder: str, manifest: DataFrame, *, end_id: int = 2) -> DataFrame:
    """Of every document, from the files: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 (of the decoded ids), first_id (by access) and n_end (how often `end_id` stands in
    it, by rank).

    Files that the manifest names are opened by name, and no folder is listed. A file's first id's
    place comes from a running sum over the manifest, which has one row for a file.
    """

    def run(batches):
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = WaveletMatrix(get(folder, name))
                ids, starts = m.decode().astype("<u4"), m.starts
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                heads, ends = m.access_many(starts[:-1]).astype(np.int64), m.count_many(end_id, starts[:-1], starts[1:])
                yield batch(READ, m.doc_ids, starts[:-1] + first, m.lengths.astype(np.int64), crc, heads, ends)

    # two levels: files within their partition, then one row for a partition
    within = manifest.withColumn("inner", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("piece")) - F.col("n_tokens"))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    outer = parts.withColumn("outer", F.sum("t").over(Window.orderBy("part")) - F.col("t")).select("part", "outer")
    first = within.join(outer, "part").select("file", (F.col("inner") + F.col("outer")).alias("first"))
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return first.repartition(tasks, "file").mapInArrow(trimmed(run), READ_DDL)


def round_trip(docs: DataFrame, scratch: Scratch, *, end_id: int = 2, **how) -> DataFrame:
    """Write `docs` and read the files back. An empty table gives no rows."""
    folder = scratch.path("shards")
    manifest = scratch.cut(write(docs, folder, end_id=end_id, **how), "manifest")
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], READ_DDL)
    return read(folder, manifest, end_id=end_id)
