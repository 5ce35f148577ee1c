"""Counting character n-grams of many texts at once, by sorting, in blocks of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: So many characters make a block, or one longer text: what a task holds at a time.
BLOCK = 1 << 20


def blocks(batches, same: bool = False, most: int = BLOCK) -> Iterator[tuple[list, list[str], list[int]]]:
    """Rows of Arrow batches (path, chunk_id, text, more) in blocks: the rows, their texts and the
    number of each within the block. With `same`, following rows of one path and chunk_id have one number."""
    rows, texts, numbers, size, last = [], [], [], 0, None
    for b in batches:
        for at in range(0, b.num_rows, 512):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 512).columns), strict=True):
                again = same and rows and row[:2] == last
                if size >= most and not again:
                    yield rows, texts, numbers
                    rows, texts, numbers, size, again = [], [], [], 0, False
                numbers.append(numbers[-1] + (not again) if numbers else 0)
                rows.append((*row[:2], *row[3:]))
                texts.append(row[2] or "")
                size += len(texts[-1])
                last = row[:2]
        del b
    if rows:
        yield rows, texts, numbers
    rows = texts = numbers = None
    pa.default_memory_pool().release_unused()  # a Python worker lives on, and holds what it has beside the next stage
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def counts(texts: list[str], numbers: list[int], sizes) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of grams: the distinct grams in order, where each one's rows begin (and the end),
    and the number of a text and how often it holds the gram, by gram and number.

    A gram is a number to the base of the block's letters. Where that would leave 64 bits, grams are
    renumbered by rank.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    there = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
    there[codes] = True
    letters, place = np.flatnonzero(there), np.cumsum(there) - 1
    letter = place[codes]
    base, docs = max(1, len(letters)), (max(numbers) if numbers else 0) + 1
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc = np.repeat(np.asarray(numbers, dtype=np.int32), length)
    left = (np.repeat(np.cumsum(length), length) - np.arange(len(codes))).astype(np.int32 if len(codes) < 1 << 31 else np.int64)
    code, bound, ranks = letter, base, [None]
    for n in range(2, max(sizes) + 1):
        code = code[:-1] * base + letter[n - 1 :]
        bound *= base
        ranks.append(None)
        if bound * max(base, docs) >= 1 << 62:
            ranks[-1], code = np.unique(code, return_inverse=True)
            bound = max(1, len(ranks[-1]))
        if n not in sizes:
            continue
        whole = left[: len(code)] >= n
        key = code[whole] * docs + doc[: len(code)][whole]
        key.sort()
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        times = np.diff(np.append(heads, len(key)))
        gram, number = np.divmod(key[heads], docs)
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), dtype=bool), gram[1:] != gram[:-1])))
        yield spelled(gram[begins], ranks, letters, base), np.append(begins, len(gram)), number, times


def spelled(code: np.ndarray, ranks: list, letters: np.ndarray, base: int) -> list[str]:
    """Grams as texts."""
    n, points = len(ranks), np.empty((len(code), len(ranks)), dtype="<u4")
    for k in range(n - 1, 0, -1):
        code = code if ranks[k] is None else ranks[k][code]
        code, last = np.divmod(code, base)
        points[:, k] = letters[last]
    points[:, 0] = letters[code] if len(letters) else 0
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + n] for i in range(0, len(text), n)]


def packed(values: np.ndarray, begins: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers in seven bits a byte, the lowest first, the last byte below 128; and where the bytes of
    each run of numbers begin, and the end."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(7, 63, 7):
        more = values >= 1 << k
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        out[(ends - size)[on] + k] = (values[on] >> 7 * k & 127) | (128 * (size[on] > k + 1)).astype(np.int64)
    return out.tobytes(), np.append(0, ends)[begins]


def unpacked(raw: bytes) -> np.ndarray:
    """The numbers that `packed` packed."""
    at = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    ends = np.flatnonzero(at < 128)
    if not len(ends):
        return np.empty(0, dtype=np.int64)
    begins = np.append(0, ends[:-1] + 1)
    place = np.arange(len(at)) - np.repeat(begins, ends + 1 - begins)
    return np.add.reduceat((at & 127) << 7 * place, begins)
