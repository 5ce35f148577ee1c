"""Tokens, packing and wavelet files: exact round trips."""

import random
import zlib

import numpy as np
import pytest

from corvella.llm import packing, tokenise, wavelet
from corvella.llm._shared import Scratch

NAME = "word_bpe_49k.json"
pytest.importorskip("public_tokenizers")


def test_words_give_the_whole_texts_ids():
    e = tokenise.Encoder(NAME, remembered=50)
    assert e.by_word
    rng = random.Random(0)
    parts = ["a", "b", "'s", "'", " ", "\n", ".", "...", "23", "é", "é", "ß", "Σ", "ΑΣ", "İ", "中", "😀", "\x1c", "\xa0", "Hello", "don't", "<|endoftext|>", "ſ", "K", "ﬁ", "\t", "\r\n"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e(t).tobytes() == e.whole(t), t


@pytest.mark.parametrize(("n", "v"), [(0, 5), (1, 5), (1000, 3), (5000, 49408), (3000, 1)])
def test_wavelet_queries(n, v):
    ids = np.random.default_rng(n).integers(0, v, n).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.encode(ids, [None, 5], [n // 2, n - n // 2]))
    assert (m.decode() == ids).all() and m.doc_ids == [None, 5] and m.lengths.sum() == n
    assert all(m.access(i) == ids[i] for i in range(0, n, 97))
    for t in [*map(int, ids[:5]), 7]:
        at = np.flatnonzero(ids == t).tolist()
        assert m.occurrences(t) == at and m.count(t, 10, n // 2) == sum(10 <= x < n // 2 for x in at)
    with pytest.raises(IndexError):
        m.access(n)


def test_wavelet_inflates_what_it_needs(monkeypatch):
    """Small parts and blocks: many places at once, over all seams; a question opens a part of each plane, not all."""
    monkeypatch.setattr(wavelet, "PART", 1024)
    ids = np.random.default_rng(3).integers(0, 300, 20_000).astype(np.uint16)
    raw = wavelet.encode(ids, list(range(20)), [1000] * 20)
    m = wavelet.WaveletMatrix(raw)
    assert m.access(12_345) == ids[12_345] and 0 < len(m._open) <= m.depth < m.parts * m.depth
    places = np.arange(0, 20_000, 7)
    assert (m.access_many(places) == ids[places]).all()
    lo, hi = np.arange(0, 20_000, 1000), np.arange(1000, 21_000, 1000)
    for t in (0, 17, 299, 5000):
        assert (m.count_many(t, lo, hi) == [(ids[a:b] == t).sum() for a, b in zip(lo, hi, strict=True)]).all()
    assert m.occurrences(17) == np.flatnonzero(ids == 17).tolist() and (wavelet.WaveletMatrix(raw).decode() == ids).all()


def test_packer_loses_nothing_and_pads_nothing():
    rng = random.Random(1)
    docs = [(i, np.arange(rng.choice([1, 5, 33, 40, 64, 63, 200, 40]), dtype=np.uint16)) for i in range(2000)]
    p, got = packing.Packer(64), []
    for d, ids in docs:
        got += p.add(d, ids)
    poured = sum(map(len, p.open))
    assert poured < len(got)  # most windows were filled before the end
    got += p.finish()
    sizes = [sum(len(x[2]) for x in s) for s in got]
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(n < 64 for n in sizes) <= 6
    by = {}
    for s in got:
        for d, start, ids, n in s:
            by.setdefault(d, []).append((start, ids))
            assert n == len(docs[d][1])
    for d, ids in docs:
        assert (np.concatenate([x for _, x in sorted(by[d], key=lambda z: z[0])]) == ids).all()


def test_packer_chooses_the_smallest_sum_of_squares():
    rng = random.Random(2)
    p = packing.Packer(16)
    for i in range(500):
        size = rng.randint(1, 15)
        level = p.level.copy()

        def total(fill):
            after = level.copy()  # noqa: B023
            after[fill] -= bool(fill)
            if fill + size < 16:  # noqa: B023
                after[fill + size] += 1  # noqa: B023
            return (after[1:16] ** 2).sum()

        fits = [f for f in range(0, 17 - size) if f == 0 or level[f]]
        assert total(p.choose(size)) == min(map(total, fits))
        list(p.add(i, np.zeros(size, dtype=np.uint16)))


def test_tables(spark, edges, empty):
    e = tokenise.Encoder(NAME)
    rows = sorted(((r.doc_id, r.text) for r in edges.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = wavelet.round_trip(edges, Scratch(spark, "t"), tokenizer=NAME, shard_tokens=5000).orderBy("start").collect()
    start = 0
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = np.append(e(text), [2]).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        assert (r.first_id, r.n_end) == (ids[0], (ids == 2).sum())
        start += len(ids)
    assert wavelet.round_trip(empty, Scratch(spark, "t"), tokenizer=NAME).count() == 0
    packed = packing.pack(edges, tokenizer=NAME).collect()
    assert sum(r.length for r in packed) == start
    offsets = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == offsets.get(r.sequence_id, 0)
        offsets[r.sequence_id] = r.offset + r.length
    assert packing.pack(empty, tokenizer=NAME).count() == 0
