"""N-gram Jaccard join by blocked sparse products.

Documents are rows and word shingles columns of a sparse incidence matrix. Its columns are dealt
into blocks by hash; a block's task counts how many rows meet in each column. Those counts bound
every overlap: a row whose shared columns are too few for its size is discarded, rows with the
same shared columns and size collapse into one node, and the rarest of a node's shared columns, as
many as its size allows to differ and one more, are its signature: nodes that link have a column
of their signatures in common. Nodes that share such a column belong to the column's centre, which
is the node of most shared columns among them; so the many columns of one family of near copies
name one centre, and a node has few centres, however many columns it has.

A centre's nodes are cut into tiles of bounded size. A tile is a block of the product of the matrix
with its transpose: overlaps with the centre are added up first and join most of the tile in one
component; what remains is multiplied with the tile, pairs below the bounds of their sizes being
left out before and while overlaps accumulate. Pairs inside one component are never multiplied.
A tile gives a row for each node that it joins, never a row for each pair.

Nodes are named by what they contain, never by a place in a file, so that rows may be read in other
partitions each time. Shingles are 64-bit hashes of exact word sequences, sets 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Bitmap, Scratch, batch, free, slices, trimmed, utf8

#: Lower-cases A-Z; white space is what bytes.split() takes for it: 09-0D and 20.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A packed row holds about so many shingles.
PACKED = 1 << 19
#: A process remembers the hashes of so many words; then the memory starts anew.
REMEMBERED = 250_000
#: A tile has two blocks of about so many rows, or of so many shingles, at most.
TILE_ROWS, TILE_ENTRIES = 1024, 1 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of fewer words, the whole sequence's."""
    ws = text.translate(_LOWER).split() if text else []
    if not ws:
        return np.empty(0, dtype=np.uint64)
    if len(ws) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(ws))], dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))
    n = len(ws) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h ^= h >> np.uint64(31)
        h *= _K1
        h += w[k : k + n]
    h ^= h >> np.uint64(29)
    h *= _K2
    h ^= h >> np.uint64(32)
    return np.unique(h)


def digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def least_overlap(n, percent: int = 75):
    """The smallest overlap that a set of n can have with a partner."""
    return -(-n * percent // 100)


def lead(n):
    """How many common columns must stand in both prefixes, for sets of n."""
    return n // 8 + 1


def blocks_of(spark) -> int:
    """Blocks of columns: twice the session's shuffle partitions, which the deployment sizes."""
    return 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_block(h: np.ndarray, blocks: int):
    """(block, slice) over sorted hashes: a block is a range of hashes."""
    of = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    edges = np.searchsorted(of, np.arange(blocks + 1, dtype=np.uint64))
    return [(b, slice(int(edges[b]), int(edges[b + 1]))) for b in np.flatnonzero(np.diff(edges)).tolist()]


def starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, dtype=np.int64)


def joined_arrays(values, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=dtype)


# --- which documents can have a partner at all -------------------------------------------------

#: What goes to and comes from blocks. block: of columns, or -1 for what a packed row says of itself.
SEEN = pa.schema([("block", pa.int32()), ("flush", pa.int64()), ("owners", pa.binary()), ("values", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()), ("texts", pa.binary()), ("ids", pa.list_(pa.int64()))])
SEEN_DDL = "block int, flush long, owners binary, values binary, sizes binary, digests binary, texts binary, ids array<bigint>"
SETS_DDL = "doc_id long, t long, n long, digest binary, alive boolean"


def first_flush() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def candidates(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, t (a hash of the text), n, digest, alive of every row of doc_id and text.

    A prefix has a set's smallest hashes: as many as may be missing from a partner, and lead(n).
    Of two sets that link, the first lead() common columns stand in both prefixes, so a row is
    alive only if enough of its prefix stands in other rows' prefixes, too. A column that repeats
    within a packed row is counted there and sent once, so a frequent shingle stays small.
    """
    blocks = blocks_of(docs.sparkSession)

    def split(batches):
        flush, got, held = first_flush(), [], 0  # got: doc_id, t, n, digest, prefix

        def out():
            nonlocal flush, held
            flush, held = flush + 1, 0
            ids, texts, sizes, digests, prefixes = zip(*got, strict=True)
            got.clear()
            h, owner = np.concatenate(prefixes), np.repeat(np.arange(len(ids), dtype=np.int32), [len(p) for p in prefixes])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            at = starts(h)
            times = np.diff(np.append(at, len(h)))
            counted = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(ids)).astype(np.int32)
            single = np.where(times > 1, np.int32(-1), owner[at])
            h = h[at]
            rows = [(b, flush, single[s].tobytes(), h[s].tobytes(), b"", b"", b"", None) for b, s in by_block(h, blocks)]
            rows.append((-1, flush, b"", counted.tobytes(), np.array(sizes, dtype=np.int64).tobytes(), b"".join(digests), np.array(texts, dtype=np.int64).tobytes(), list(ids)))
            return batch(SEEN, *zip(*rows, strict=True))

        for b in slices(batches):
            for doc_id, t, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = shingles(text)
                n = len(h)
                take = n - least_overlap(n, percent) + lead(n) if n else 0
                got.append((doc_id, t, n, digest(h), h[:take].copy()))
                held += take + 16
                if held >= PACKED:
                    yield out()
        if got:
            yield out()
        _hashes.clear()

    def count(key, pdf):
        if key[0] < 0:
            return pdf
        owner, h = joined_arrays(pdf["owners"], np.int32), joined_arrays(pdf["values"], np.uint64)
        of = np.repeat(np.arange(len(pdf), dtype=np.int32), [len(x) // 4 for x in pdf["owners"]])
        order = np.argsort(h, kind="stable")
        h, owner, of = h[order], owner[order], of[order]
        at = starts(h)
        times = np.diff(np.append(at, len(h)))
        common = np.repeat((times > 1) | np.logical_or.reduceat(owner < 0, at), times) & (owner >= 0)
        owner, of = owner[common], of[common]
        flushes, rows = pdf["flush"].to_numpy(), []
        order = np.argsort(of, kind="stable")
        owner, of = owner[order], of[order]
        at = np.append(starts(of), len(of))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows.append((0, int(flushes[of[i]]), owner[i:j].tobytes(), b"", b"", b"", b"", None))
        return pd.DataFrame(rows, columns=SEEN.names)

    def decide(pdf):
        own = pdf["block"].to_numpy() < 0
        d = pdf[own].iloc[0]
        n = np.frombuffer(d["sizes"], dtype=np.int64)
        total = np.frombuffer(d["values"], dtype=np.int32) + np.bincount(joined_arrays(pdf["owners"], np.int32), minlength=len(n))
        return pd.DataFrame(
            {
                "doc_id": pd.array(list(d["ids"]), dtype="Int64"),
                "t": np.frombuffer(d["texts"], dtype=np.int64),
                "n": n,
                "digest": [d["digests"][i : i + 16] for i in range(0, len(d["digests"]), 16)],
                "alive": (n > 0) & (total >= lead(least_overlap(n, percent))),
            }
        )

    packed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), utf8().alias("text")).mapInArrow(trimmed(split), SEEN_DDL)
    return packed.groupBy("block", F.when(F.col("block") < 0, F.col("flush")).alias("own")).applyInPandas(count, SEEN_DDL).groupBy("flush").applyInPandas(decide, SETS_DDL)


def sets_of(docs: DataFrame, wanted: DataFrame, known: Bitmap) -> DataFrame:
    """digest, n, set (hashes' bytes) of the texts whose digests are `wanted`.

    `known` keeps the rows whose texts' hashes may be wanted; sets are made of those only, each
    once in a task, and what is then shuffled are sets, one of each task's copies.
    """

    def run(batches):
        seen = set()
        for b in slices(batches):
            out = []
            for t, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t in seen:
                    continue
                seen.add(t)
                h = shingles(text)
                out.append((digest(h), len(h), h.tobytes()))
            if out:
                yield batch(pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("set", pa.binary())]), *zip(*out, strict=True))
        _hashes.clear()

    texts = docs.select(F.xxhash64("text").alias("t"), utf8().alias("text")).where("text is not null")
    made = known.split(texts, F.col("t"), maybe=True).mapInArrow(trimmed(run), "digest binary, n long, set binary")
    return made.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("n").alias("n"), F.first("set").alias("set"))


# --- counts of the rows that meet in each column -----------------------------------------------

NODE = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("common", pa.binary()), ("set", pa.binary()), ("rarest", pa.list_(pa.int64()))])
NODE_DDL = "digest binary, n long, common binary, set binary, rarest array<bigint>"
COLUMNS = pa.schema([("block", pa.int32()), ("flush", pa.int64()), ("owners", pa.binary()), ("values", pa.binary()), ("ranks", pa.binary()), ("digests", pa.binary())])
COLUMNS_DDL = "block int, flush long, owners binary, values binary, ranks binary, digests binary"


def shared_columns(sets: DataFrame, percent: int) -> DataFrame:
    """digest, n, common (a hash of the shared columns), set (the shared columns) and rarest (its
    signature) of the sets that have enough columns in common with others.

    A column goes to its block once for each set that has it, and only if several have it comes
    back, with its rank: the logarithm of their number. Equal ranks are in order of the hash.
    """
    blocks = blocks_of(sets.sparkSession)

    def split(batches):
        flush, got, held = first_flush(), [], 0

        def out():
            nonlocal flush, held
            flush, held = flush + 1, 0
            names, sizes, sets = zip(*got, strict=True)
            got.clear()
            lengths = np.array([len(s) // 8 for s in sets], dtype=np.int64)
            h, owner = joined_arrays(sets, np.uint64), np.repeat(np.arange(len(names), dtype=np.int32), lengths)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            rows = [(b, flush, owner[s].tobytes(), h[s].tobytes(), b"", b"") for b, s in by_block(h, blocks)]
            rows.append((-1, flush, b"", np.array(sizes, dtype=np.int64).tobytes(), b"", b"".join(names)))
            return batch(COLUMNS, *zip(*rows, strict=True))

        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.append(row)
                held += len(row[2]) // 8
                if held >= PACKED:
                    yield out()
        if got:
            yield out()

    def count(key, pdf):
        if key[0] < 0:
            return pdf
        owner, h = joined_arrays(pdf["owners"], np.int32), joined_arrays(pdf["values"], np.uint64)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.ceil(4 * np.log2(times)).astype(np.uint8)[back]
        rows, at = [], 0
        for flush, raw in zip(pdf["flush"].tolist(), pdf["owners"], strict=True):
            end = at + len(raw) // 4
            keep = np.flatnonzero(rank[at:end]) + at
            if len(keep):
                rows.append((0, flush, owner[keep].tobytes(), h[keep].tobytes(), rank[keep].tobytes(), b""))
            at = end
        return pd.DataFrame(rows, columns=COLUMNS.names)

    def gather(pdf):
        own = pdf["block"].to_numpy() < 0
        d = pdf[own].iloc[0]
        sizes, names, pdf = np.frombuffer(d["values"], dtype=np.int64), d["digests"], pdf[~own]
        owner, h, rank = joined_arrays(pdf["owners"], np.int32), joined_arrays(pdf["values"], np.uint64), joined_arrays(pdf["ranks"], np.uint8)
        order = np.lexsort((h, rank, owner))
        owner, h = owner[order], h[order]
        ends, at, rows = np.cumsum(np.bincount(owner, minlength=len(sizes))).tolist(), 0, []
        for i, (n, end) in enumerate(zip(sizes.tolist(), ends, strict=True)):
            spare = end - at - least_overlap(n, percent)
            if spare >= 0:
                s = np.sort(h[at:end])
                rows.append((names[16 * i : 16 * i + 16], n, digest(s), s.tobytes(), h[at : at + spare + 1].view(np.int64).tolist()))
            at = end
        return pd.DataFrame(rows, columns=NODE.names)

    packed = sets.select("digest", "n", "set").mapInArrow(trimmed(split), COLUMNS_DDL)
    return packed.groupBy("block", F.when(F.col("block") < 0, F.col("flush")).alias("own")).applyInPandas(count, COLUMNS_DDL).groupBy("flush").applyInPandas(gather, NODE_DDL)


# --- components --------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): for every node a but the smallest of a component, its smallest node b.

    Large-star and small-star steps, which are joins and minima, alternate until only stars are left.
    """

    def unfinished(e):
        """Whether some node still has two others, or one that has one itself."""
        several = e.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        return not several.where("lo < hi").isEmpty() or not e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()

    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    i = 0
    while unfinished(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select("a", F.col("m").alias("b")).unionByName(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        i += 1
        e = scratch.cut(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
    return e


# --- products ----------------------------------------------------------------------------------


def overlaps(rows: np.ndarray, h: np.ndarray, owner: np.ndarray, m: int):
    """(slice of `rows`, overlap of each with each of the m sets), block of rows by block.

    h: column of each entry, sorted; owner: its set. Columns that an eighth of the sets share or
    more are a dense block, and its product is one of matrices; of the others, each entry of
    `rows` adds one to every set of its column.
    """
    at = starts(h)
    times = np.diff(np.append(at, len(h)))
    column = np.repeat(np.arange(len(at)), times)
    dense = times * 8 >= m
    place = np.cumsum(dense) - 1
    thick = dense[column]
    block = np.zeros((m, int(dense.sum())), dtype=np.float32)
    block[owner[thick], place[column[thick]]] = 1
    # the other entries by set
    thin = np.flatnonzero(~thick)
    thin = thin[np.argsort(owner[thin], kind="stable")]
    of, col = owner[thin], column[thin]
    first = np.searchsorted(of, np.arange(m + 1))
    work = np.concatenate(([0], np.cumsum(times[col])))
    step = max(1, min(256, (1 << 22) // max(1, m)))
    begin = 0
    while begin < len(rows):
        end = min(len(rows), begin + step)
        mine = rows[begin:end]
        got = np.rint(block[mine] @ block.T).astype(np.int64)
        for k, r in enumerate(mine.tolist()):
            i, j = int(first[r]), int(first[r + 1])
            if i < j:
                c = col[i:j]
                total = int(work[j] - work[i])
                ends = np.cumsum(times[c])
                take = np.arange(total) + np.repeat(at[c] - (ends - times[c]), times[c])
                got[k] += np.bincount(owner[take], minlength=m)
        yield slice(begin, end), got
        begin = end


def product(n: np.ndarray, sets: list[bytes], label: np.ndarray, percent: int, centre: int | None = None) -> np.ndarray:
    """Labels after joining all sets of different labels whose Jaccard similarity is `percent` or
    more; label: of each set, small integers. A joined label is the smallest of those joined."""
    m, label = len(n), label.copy()
    s = np.array([len(x) // 8 for x in sets], dtype=np.int64)
    h, owner = joined_arrays(sets, np.uint64), np.repeat(np.arange(m, dtype=np.int32), s)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    times = np.diff(np.append(starts(h), len(h)))
    several = np.repeat(times > 1, times)  # a column of one set alone adds to no overlap
    h, owner = h[several], owner[several]

    def join(row: int, linked: np.ndarray):
        labels = np.unique(label[linked])
        if len(labels) > 1 or (len(labels) and labels[0] != label[row]):
            labels = np.union1d(labels, label[row : row + 1])
            label[np.isin(label, labels)] = labels[0]

    def multiply(rows):
        for part, got in overlaps(rows, h, owner, m):
            for row, o in zip(rows[part].tolist(), got, strict=True):
                linked = 100 * o >= percent * (n[row] + n - o)
                linked[row] = False
                join(row, np.flatnonzero(linked))

    if centre is not None:
        multiply(np.array([centre]))
    each, back, size = np.unique(label, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(back != np.argmax(size))
    if len(rest):
        # of the rest, those that the sizes leave a partner of another label
        room = [r for r in rest.tolist() if np.any((100 * np.minimum(s[r], s) >= percent * (n[r] + n - np.minimum(s[r], s))) & (label != label[r]))]
        multiply(np.array(room, dtype=np.int64))
    return label


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links, as few as join what belongs together, among the rows of each tile.

    rows: centre, i, j (which name the tile), key, label, n, set. Labels are joined; where a tile
    has its centre among its rows and i = j, that one is multiplied first.
    """

    def solve(centre, key, label, n, sets):
        names, small = np.unique(np.array(label, dtype=np.int64), return_inverse=True)
        got = product(np.array(n, dtype=np.int64), sets, small, percent, key.index(centre) if centre in key else None)
        first = {}  # the smallest label of each component
        for old, new in zip(small.tolist(), got.tolist(), strict=True):
            first[new] = min(first.get(new, old), old)
        return {(int(names[o]), int(names[first[g]])) for o, g in zip(small.tolist(), got.tolist(), strict=True) if first[g] != o}

    def run(batches):
        now, held = None, []
        for b in slices(batches):
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        out += solve(now[0], *zip(*held, strict=True))
                    now, held = row[:3], []
                held.append(row[3:])
            if out:
                yield batch(EDGE, *zip(*out, strict=True))
        if len(held) > 1 and (out := solve(now[0], *zip(*held, strict=True))):
            yield batch(EDGE, *zip(*out, strict=True))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("centre", "i", "j", "key", "label", "n", "set").repartition(parts, "centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    return dealt.mapInArrow(trimmed(run), "a long, b long")


def link(nodes: DataFrame, scratch: Scratch, percent: int, tile_rows: int, tile_entries: int) -> DataFrame:
    """(key, label) of the nodes (key, n, s, set, rarest) that link; label: the component's smallest key.

    A centre's nodes are dealt into blocks by hash. At first each block is multiplied with the
    centre and with itself; then, where a centre has several blocks and they still hold several
    components, each pair of blocks.
    """
    entries = nodes.select("key", "s", F.explode("rarest").alias("column"))
    centres = entries.groupBy("column").agg(F.max(F.struct("s", "key")).alias("c"), F.count("*").alias("m")).where("m > 1").select("column", F.col("c.key").alias("centre"))
    member = entries.join(centres, "column").groupBy("centre", "key").agg(F.first("s").alias("s"))
    member = scratch.cut(member, "member")
    blocks = F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("s") / tile_entries)).cast("int")
    sized = scratch.cut(member.groupBy("centre").agg(blocks.alias("blocks")), "sized")
    member = member.join(sized, "centre").select("centre", "key", "blocks", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("i"))
    # the centre stands in each block
    also = sized.where("blocks > 1").select("centre", F.col("centre").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    first = member.select("centre", "key", "i").unionByName(also).distinct()
    sets = nodes.select("key", "n", "set")
    edges = scratch.cut(tiles(first.join(sets, "key").select("centre", "i", F.col("i").alias("j"), "key", F.col("key").alias("label"), "n", "set"), percent), "edges")
    roots = components(edges, scratch, "root")

    large = sized.where("blocks > 1")
    if not large.isEmpty():
        at = member.join(large.select("centre"), "centre", "left_semi").join(roots.toDF("key", "root"), "key", "left").select("centre", "key", "blocks", "i", F.coalesce("root", "key").alias("label"))
        at = scratch.cut(at, "blocks")
        mixed = at.groupBy("centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("centre")
        other = at.join(mixed, "centre", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> other")
        second = other.select("centre", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), "key", "label")
        more = scratch.cut(tiles(second.join(sets, "key"), percent), "more")
        edges = scratch.cut(edges.unionByName(more), "edges-all")
        roots = components(edges, scratch, "root-all")
    ends = roots.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct()
    return roots.toDF("key", "label").unionByName(ends)


def classes(docs: DataFrame, scratch: Scratch, *, percent: int = 75, tile_rows: int = TILE_ROWS, tile_entries: int = TILE_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, t, n, digest, alive of every row of `docs` (doc_id, text), and digest,
    label of the sets of alive rows that link with other sets.

    Rows with one label, and alive rows with one digest, are one component: reachable by links of
    Jaccard similarity of `percent` or more between their sets of five-word shingles. Rows without
    words (null and empty texts too) are alone; equal sets, such as repeated rows', link. t is a
    hash of the text. `docs` must give the same rows whenever it is read; their places may differ.
    """
    rows = scratch.cut(candidates(docs, percent), "rows")
    reps = scratch.cut(rows.where("alive").groupBy("digest").agg(F.min("t").alias("t")), "reps")
    sets = scratch.cut(sets_of(docs, reps.select("digest"), Bitmap(reps, "t", scratch, "texts")), "sets")
    shared = scratch.cut(shared_columns(sets, percent), "shared")
    scratch.drop("sets")
    # rows of the same shared columns and size have the same partners
    same = shared.groupBy("common", "n").agg(F.count("*").alias("copies"), F.first("set").alias("set"), F.first("rarest").alias("rarest"))
    same = same.withColumn("s", (F.length("set") / 8).cast("int")).withColumn("key", F.monotonically_increasing_id())
    nodes = scratch.cut(same, "nodes")
    label = link(nodes, scratch, percent, tile_rows, tile_entries)
    # copies of one node link with each other directly, or through a partner
    alone = nodes.where(f"copies > 1 and 100 * s >= {percent} * (2 * n - s)").select("key", F.col("key").alias("label"))
    label = scratch.cut(label.unionByName(alone).groupBy("key").agg(F.min("label").alias("label")), "label")
    found = shared.select("digest", "common", "n").join(nodes.select("common", "n", "key"), ["common", "n"]).join(label, "key").select("digest", "label")
    found = scratch.cut(found, "found")
    scratch.drop("shared", "nodes", "member", "sized", "edges", "blocks", "more", "edges-all", "label")
    return rows, found


def component_ids(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component, null if none has
    one) of every row."""
    rows, found = classes(docs, scratch, **how)
    alive = rows.where("alive")
    of_set = alive.groupBy("digest").agg(F.min("doc_id").alias("low")).join(found, "digest", "left")
    of_set = scratch.cut(of_set, "low")
    of_label = of_set.where("label is not null").groupBy("label").agg(F.min("low").alias("least"))
    lowest = of_set.join(of_label, "label", "left").select("digest", F.coalesce("least", "low").alias("component_id"))
    linked = alive.join(lowest, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("not alive").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """`docs` with one row of each component: that of smallest doc_id (nulls last), then of smallest
    hash of its text, then of smallest hash of its row. Columns stay.

    Most rows are alone: a fixed-size bitmap of the hashes of the others' texts tells, without a
    shuffle, which rows surely stay; only the others meet the list of rows that go.
    """
    rows, found = classes(docs, scratch, **how)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    at = rows.where("alive").groupBy("digest", "doc_id", "t").agg(F.count("*").alias("times"))
    at = scratch.cut(at.join(found, "digest", "left"), "members")
    of_set = at.groupBy("digest", "label").agg(F.min(own).alias("first"))
    of_label = of_set.where("label is not null").groupBy("label").agg(F.min("first").alias("of_label"))
    first = of_set.join(of_label, "label", "left").select("digest", F.coalesce("of_label", "first").alias("first"))
    verdict = at.join(first, "digest").select("doc_id", "t", "times", (own == F.col("first")).alias("stays"))
    verdict = scratch.cut(verdict.where("not stays or times > 1"), "verdict")
    repeated = not verdict.where("stays").isEmpty()

    known, t, stays, row = Bitmap(verdict, "t", scratch, "named"), *(free(docs, c) for c in ("_t", "_stays", "_row"))
    keyed = docs.withColumn(t, F.xxhash64("text"))
    sure = known.split(keyed, F.col(t), maybe=False).select(*docs.columns)
    list_ = verdict.select(F.col("doc_id").alias("_v_id"), F.col("t").alias("_v_t"), F.col("stays").alias(stays))
    met = known.split(keyed, F.col(t), maybe=True).join(list_, (F.col(t) == F.col("_v_t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_v_id")), "left")
    rest = met.where(F.col(stays).isNull()).select(*docs.columns)
    if repeated:  # rows that agree in doc_id and text: the one of smallest hash of all columns
        twice = met.where(F.col(stays)).select("_v_id", "_v_t", F.struct(*docs.columns).alias(row))
        twice = twice.groupBy("_v_id", "_v_t").agg(F.min_by(row, F.xxhash64(row)).alias(row)).select(f"{row}.*")
        rest = rest.unionByName(twice)
    return sure.unionByName(rest)
