"""Every opN_ query, as it is registered, over the smallest tables: its contract by brute force."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from corvella.llm import queries as registered

from . import test_set_operators as sets
from . import test_text_operators as texts

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows(spark, name):
    return registered.queries()[name](spark, SMALL).collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, docs):
    got = rows(spark, "op1_quality")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert not pairs or np.mean(pairs) > 0.8


def test_op2_and_op9(spark, docs):
    from corvella.llm import tokenise

    encode = tokenise.Encoder(registered.TOKENIZER)
    ids = {i: np.array(encode.library.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4") for i, r in docs.items()}
    start = 0
    for r in sorted(rows(spark, "op2_wavelet"), key=lambda r: r.start):
        mine = np.append(ids[r.doc_id], [2]).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(mine), zlib.crc32(mine.tobytes()))
        start += len(mine)
    pieces, length = {}, {}
    for r in rows(spark, "op9_packing"):
        mine = np.append(ids[r.doc_id], [1]).astype("<u4")
        assert r.doc_tokens == len(mine) and r.ids_crc32 == zlib.crc32(mine[r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        length.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, found in pieces.items():
        assert sum(n for _, n in found) == len(ids[i]) + 1 and all(a + n == b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:], strict=False))
    totals = [sum(n for _, n in found) for found in length.values()]
    assert all(t <= 2048 and t & (t - 1) == 0 for t in totals) and set(pieces) == set(docs)
    assert all(a + n == b for found in length.values() for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:], strict=False))


def test_op3(spark, docs):
    for r in rows(spark, "op3_secrets"):
        t = docs[r.doc_id].text or ""
        want = [(m.start(), "assign", m.end()) for m in texts.ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in ("assign", "access", "hex")]
        assert {f"{k}:{s}:{e}" for s, k, e in want} <= set(r.spans.split(","))


def test_op4(spark, docs):
    want = sets.brute_components([(i, r.text) for i, r in docs.items()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op4_ngram_jaccard")} == want


def test_op5(spark, docs):
    digits = lambda s: re.sub("[^0-9]", "", s)
    for r in rows(spark, "op5_pii"):
        t = docs[r.doc_id].text or ""
        want = [("email", *m.span()) for m in texts.EMAIL.finditer(t)]
        want += [("ip", *m.span()) for m in texts.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in texts.CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and texts.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in texts.PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]


def test_op6(spark, docs):
    got, by = rows(spark, "op6_minimax_shards"), {}
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(16)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and len(got) == len(docs)
    group = {}
    for r in got:
        group.setdefault(docs[r.doc_id].text, set()).add(r.shard)
    assert all(len(s) == 1 for s in group.values()) and max(sum(r.size for r in x) for x in by.values()) <= got[0].capacity


def test_op7(spark):
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    got, hit, n = {}, 0, 0
    for r in rows(spark, "op7_cross_polytope"):
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(np.cumsum(vectors[q] * v)[-1]), i) for i, v in vectors.items() if i != q))[:20]
        assert sorted(found) == list(range(1, len(want) + 1)) and all(s == float(np.cumsum(vectors[q] * vectors[i])[-1]) for i, s in found.values())
        hit += len({i for i, _ in found.values()} & {i for _, i in want})
        n += len(want)
    assert hit >= 0.9 * n


def test_op10(spark, docs):
    got = rows(spark, "op10_language")
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got) and len(got) == len(docs)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean(held) > 0.9
