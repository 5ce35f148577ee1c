"""N-gram join, decontamination, sharding and nearest neighbours: against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import ann, decontam, ngram_join, sharding
from corvella.llm._shared import Scratch


def brute_components(rows):
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]

    def changed(ws, k):
        ws = list(ws)
        for _ in range(k):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        return ws

    line, passage, big = ([rng.choice(words) for _ in range(n)] for n in (9, 60, 100))
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([6, 20, 60, 150]))]
        base += line if rng.random() < 0.3 else passage if rng.random() < 0.2 else []
        out += [changed(base, rng.choice([0, 0, 1, 2, 3, 5, 8])) for _ in range(rng.choice([1, 1, 2, 3, 8]))]
    out += [line + [rng.choice(words) for _ in range(rng.randint(0, 4))] for _ in range(40)]
    out += [passage + [rng.choice(words) for _ in range(rng.randint(0, 20))] + (line if rng.random() < 0.4 else []) for _ in range(40)]
    out += [changed(big, rng.choice([1, 2, 3, 4, 5, 6])) for _ in range(60)]
    texts = [" ".join(x) for x in out] + ["", "  ", None, "a b", "A  b", "a b", "a b c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("blocks, how", [("1", {}), ("7", {}), ("3", {"tile_rows": 7}), ("3", {"tile_entries": 600})])
def test_components_by_brute_force(spark, table, blocks, how):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        rows = near_texts()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.component_ids(table(rows, "doc_id long, text string"), Scratch(spark, "t"), **how).collect()}
        assert got == brute_components(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components_do_not_depend_on_places(spark, table):
    """Each read may deal rows into other partitions, as when executors come and go."""
    rows = near_texts()
    want, docs = brute_components(rows), table(rows, "doc_id long, text string", 5)

    class Moving:
        """A table that every read finds in other partitions."""

        sparkSession, reads = spark, 0

        def select(self, *columns):
            self.reads += 1
            return docs.repartition(self.reads + 1, F.crc32("text")).select(*columns)

    moving = Moving()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.component_ids(moving, Scratch(spark, "t")).collect()}
    assert got == want and moving.reads >= 2


def test_product_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        m, universe = int(rng.integers(2, 40)), int(rng.integers(4, 60))
        base = rng.random(universe) < 0.7
        rows = [np.flatnonzero(base ^ (rng.random(universe) < rng.choice([0.02, 0.08, 0.3]))).astype(np.uint64) * 977 for _ in range(m)]
        n = np.array([len(r) + int(rng.integers(0, 2)) for r in rows])
        label = np.arange(m)
        for a in range(m):
            for b in range(a):
                o = len(np.intersect1d(rows[a], rows[b]))
                if n[a] and n[b] and 100 * o >= 75 * (n[a] + n[b] - o) and label[a] != label[b]:
                    label[label == max(label[a], label[b])] = min(label[a], label[b])
        if n.min() > 0:
            for centre in (None, int(rng.integers(0, m))):
                got = ngram_join.product(n, [r.tobytes() for r in rows], np.arange(m), 75, centre)
                assert len(set(zip(got.tolist(), label.tolist(), strict=True))) == len(set(label.tolist())) == len(set(got.tolist()))


def test_components_of_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    above = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            above[a] = above[b] = min(above[a], above[b])
    got = {tuple(r) for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "l").collect()}
    assert got == {(a, b) for a, b in above.items() if a != b} and (460, 400) in got


def test_join_edges(spark, edges, empty):
    got = ngram_join.component_ids(edges, Scratch(spark, "t")).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.doc_id is None} == {None}
    kept = ngram_join.one_of_each(edges, Scratch(spark, "t"))
    assert kept.columns == edges.columns and kept.count() == 7 and {r["_key"] for r in kept.collect()} == {"own"}
    assert ngram_join.one_of_each(empty, Scratch(spark, "t")).count() == 0
    assert ngram_join.component_ids(empty, Scratch(spark, "t")).count() == 0


def test_automaton_by_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        alphabet = [bytes([97 + k]) for k in range(rng.choice([1, 2, 3, 6]))]
        window = rng.choice([3, 4, 10])
        items = [(i, [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 20]))]) for i in range(rng.randint(0, 6))]
        ws = [rng.choice([*alphabet, b"zz"]) for _ in range(rng.randint(0, 40))]
        if items:
            ws[5:5] = rng.choice(items)[1]
        hit, found = set(), set()
        for i, x in items:
            for w in [x[k : k + window] for k in range(len(x) - window + 1)] if len(x) >= window else [x] if x else []:
                for p in range(len(ws) - len(w) + 1):
                    if ws[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        found.add(i)
        spans, got = decontam.Automaton(items, window).packed().hits(ws)
        assert {i for s, e in spans for i in range(s, e)} == hit and got == found


def test_decontamination(spark, table, edges, empty):
    item = "the quick brown fox jumps over the lazy dog and runs far away home"
    items = table([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    docs = table([(1, f"before text here. {item.upper()}! after it all is well and more words follow to be long enough for it to stay here"), (2, item), (3, "a Tiny, item in a longer clean text"), (4, "clean"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.report(docs, items).collect()}
    assert [got[i].n_hit for i in range(1, 6)] == [14, 14, 2, 0, 0] and got[1].n_items == 1
    for how in ({"part_bytes": 1}, {"part_bytes": 1, "held_bytes": 1}):
        assert {r.doc_id: r for r in decontam.report(docs, items, **how).collect()} == got
        assert sorted(decontam.clean(docs, items, **how).collect()) == sorted(decontam.clean(docs, items).collect())
    nameless = table([(None, "tiny item")], "item_id long, text string")
    assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(docs, nameless).collect()} >= {(3, 2, 0, True), (4, 0, 0, False)}
    kept = {r.doc_id: r.text for r in decontam.clean(docs, items).collect()}
    assert set(kept) == {1, 3, 4, 5} and "FOX" not in kept[1] and kept[4] == "clean" and kept[5] is None
    assert not [r for r in decontam.report(decontam.clean(docs, items), items).collect() if r.contaminated]
    assert decontam.report(edges, items).count() == 8 and decontam.report(empty, items).count() == 0
    assert decontam.clean(edges, items.limit(0)).count() == 8


def test_removal_by_brute_force():
    """What is left after looking at seams only is what looking at the whole text again leaves."""
    rng = random.Random(11)
    for _ in range(600):
        alphabet = [bytes([97 + k]) for k in range(rng.choice([2, 3]))]
        window = rng.choice([2, 3, 4])
        items = [(i, [rng.choice(alphabet) for _ in range(rng.randint(1, 6))]) for i in range(rng.randint(1, 3))]
        parts = [decontam.Automaton(items, window).packed()]
        text = b" ".join(rng.choice([*alphabet, b"zz"]) for _ in range(rng.randint(0, 30)))
        want = text
        while spans := decontam.looked(decontam.words(want), parts)[0]:
            ws = decontam.words(want)
            want = b" ".join(w for i, w in enumerate(ws) if not any(s <= i < e for s, e in spans))
        got = decontam.without(text, decontam.looked(decontam.words(text), parts)[0], parts, most_coverage=1.0, window=window)
        assert decontam.words(got) == decontam.words(want)


def test_smallest_capacity_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        ids = sorted({f"{rng.randrange(16**8):08x}" for _ in range(rng.randint(1, 300))})
        sizes = [rng.choice([1, 5, 100, 3000 if rng.random() < 0.05 else 7]) for _ in ids]
        n = rng.choice([2, 5, 16])

        def sums(prefix, digits):
            out = {}
            for k, v in zip(ids, sizes, strict=True):  # noqa: B023
                if k.startswith(prefix):
                    s = out.setdefault(k[:digits], [0, 0])
                    s[0] += v
                    s[1] += 1
            return [sharding.Segment(k, *v) for k, v in out.items()]

        segments = sorted(sums("", 1))
        while True:
            low, high, split = sharding.bracket(segments, n)
            if low == high:
                break
            segments = sorted([s for i, s in enumerate(segments) if i not in split] + [x for i in split for x in sums(segments[i].prefix, len(segments[i].prefix) + 1)])
        want = sharding.smallest(max([*sizes, math.ceil(sum(sizes) / n)]), sum(sizes), lambda c: len(sharding.atomic_cuts(sizes, c)) <= n)  # noqa: B023
        assert high == want
        cuts = [0, *sharding.balanced([s.size for s in segments], high, n), len(segments)]
        assert max(sum(s.size for s in segments[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) <= high


def test_shards(spark, table, edges, empty):
    rng = random.Random(1)
    rows = [(i, "copy" * 50 if i % 5 == 0 else "t" * rng.randint(0, 400) + str(i)) for i in range(1000)]
    got = sharding.shard(table(rows, "doc_id long, text string"), Scratch(spark, "t"), shards=8, slot_rows=30).collect()
    by, place = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        place.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(got) == 1000 and all(len(s) == 1 for s in place.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert max(sum(r.size for r in rs) for rs in by.values()) <= got[0].capacity
    assert sharding.shard(empty, Scratch(spark, "t")).count() == 0
    got = sharding.shard(edges, Scratch(spark, "t"), shards=3, slot_rows=2).collect()
    assert len(got) == 8 and [(r.size, r.text_crc32) for r in got if r.doc_id in (3, 4)] == [(1, 0), (1, 0)]
    assert len({r.shard for r in got if r.doc_id in (3, 4)}) == len({r.shard for r in got if r.doc_id == 1}) == 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(3))
    many = sharding.shard(table([(None, "")] * 500 + [(1, "x")], "doc_id long, text string"), Scratch(spark, "t"), shards=2, slot_rows=50).collect()
    assert sorted((r.shard, r.slot) for r in many) == [(s, i) for s in (0, 1) for i in range(sum(r.shard == s for r in many))]


def search(spark, rows, k, query="vec_id % 20 = 0"):
    return ann.search(rows, F.expr(query), Scratch(spark, "t"), k=k)


def test_nearest_neighbours(spark, table):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[::3] = x[0]  # a hot vector
    x[1::2] *= 3.0
    x[2::40] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2001, None), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, []), (2020, [1.0, 2.0]), (None, x[5].tolist()), (7, x[7].tolist())]
    got = {}
    for r in search(spark, table(rows, "vec_id long, embedding array<float>"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    there = [i for i in range(900) if np.any(x[i])]
    total = hit = 0
    for q in [i for i in there if i % 20 == 0]:
        scores = ann.exact(np.broadcast_to(x[q], (len(there), 24)), x[there])
        want = sorted((-s, i) for s, i in zip(scores.tolist(), there, strict=True) if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == ann.exact(x[q][None], x[i][None])[0] for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in want})
        total += 10
    assert hit / total >= 0.9 and 2020 not in got


def test_vectors_of_doubles(spark, table):
    """Differences that floats cannot hold decide; large components count; an id has one vector."""
    ddl = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 1.0]), *((i, [1 + i * 1e-9, 1.0]) for i in range(1, 40)), (50, [-1e300, 1e300]), (7, [9.0, 9.0, 9.0])]
    got = sorted(search(spark, table(rows, ddl), 3).where("query_id = 0").collect(), key=lambda r: r.rank)
    assert [(r.vec_id, r.score) for r in got] == [(i, 1 + i * 1e-9 + 1.0) for i in (39, 38, 37)]
    assert {r.query_id for r in search(spark, table(rows, ddl), 3).collect()} == {0, 20}


def test_share_of_points_that_are_looked_at_falls():
    at = [ann.probes_for(n, 16384) for n in (100, 900, 10**4, 10**5, 10**6, 10**7, 10**9)]
    assert at[0] == 16384 and at == sorted(at, reverse=True) and at[-1] < at[2] / 10


def test_points_far_from_all_queries_change_nothing(spark, table):
    """Where a query looks follows from its own scores, so no number of points that it isn't near matters."""
    rng = np.random.default_rng(4)
    g = rng.normal(size=(10_000, 23))
    g /= np.linalg.norm(g, axis=1)[:, None]
    x = np.concatenate((np.full((len(g), 1), 0.35), g * math.sqrt(1 - 0.35**2)), axis=1)
    x[2000:] = np.concatenate((np.full((8000, 1), -0.99), g[2000:] * math.sqrt(1 - 0.99**2)), axis=1)
    ddl, rows = "vec_id long, embedding array<double>", [(i if i < 2000 else 20 * i + 1, v.tolist()) for i, v in enumerate(x)]
    few, many = (sorted(map(tuple, search(spark, table(r, ddl), 10).collect())) for r in (rows[:2000], rows))
    assert few == many and len(few) == 1000
    scores = x[:2000:20] @ x[:2000].T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -9
    want = {(20 * q, int(i)) for q, near in enumerate(np.argsort(-scores, axis=1)[:, :10]) for i in near}
    assert len({(q, i) for q, _, i, _ in many} & want) >= 900


def test_looks_reach_what_they_promise():
    """Fresh pairs of a cosine meet in some table as often as promised; unknown or low ones ask for all."""
    rng, hashes, reached = np.random.default_rng(5), ann.CrossPolytope(64, 12, [64, 64]), ann.reach(64, 12)
    q, z = rng.normal(size=(2, 400, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    z -= (z * q).sum(axis=1)[:, None] * q
    z /= np.linalg.norm(z, axis=1)[:, None]
    for c in (0.4, 0.6, 0.9):
        x, met = c * q + math.sqrt(1 - c * c) * z, np.zeros(400, dtype=bool)
        for t in range(12):
            met |= [b in set(w.tolist()) for b, w in zip(hashes.buckets(x, t).tolist(), hashes.within(q, t, ann.looks(np.full(400, c), reached)), strict=True)]
        assert met.mean() >= ann.SURE - 0.05
    far = ann.looks(np.array([np.nan, -1.0, 0.0, 0.3, 0.6, 1.0]), reached)
    assert np.isinf(far[:3]).all() and far[3] > far[4] > far[5] >= 0


def test_few_vectors(spark, table):
    ddl = "vec_id long, embedding array<float>"
    got = search(spark, table([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.5])], ddl), 20).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert search(spark, table([], ddl), 20).count() == 0
