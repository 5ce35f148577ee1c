"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate unit vectors; a vector's hash
is the nearest signed axis. Each of many tables has two rotations of its own, and a bucket is a
pair of axes. A query looks at a few pairs of a few tables first; the k-th best of what it finds
there says how near its neighbours are at least, and from that alone follows how far from its
nearest pairs it must look in all tables. What stands there is ranked by exact inner products of
the original vectors.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, batch, trimmed


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    """Tables of hashes for vectors of one dimension.

    `widths` are the axes that each chained hash looks at; a bucket is the mixed
    number of its signed axes. Rotations follow from `seed`, so every task makes the same.
    """

    def __init__(self, dim: int, tables: int, widths: list[int], seed: int = 7):
        self.n, self.tables, self.widths = 1 << max(1, (dim - 1).bit_length()), tables, widths
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, len(widths), 3, self.n))

    def rotated(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        y = np.zeros((len(x), self.n))
        y[:, : x.shape[1]] = x
        for s in self.signs[table, k]:
            y = hadamard(y * s)
        return y[:, : self.widths[k]]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for k, w in enumerate(self.widths):
            y = self.rotated(x, table, k)
            axis = np.abs(y).argmax(axis=1)
            code = code * (2 * w) + 2 * axis + (y[np.arange(len(x)), axis] > 0)
        return code

    def directions(self, x: np.ndarray, table: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row all signed axes of a chained hash, nearest first, and what each falls short of the first."""
        y, w = self.rotated(x, table, k), self.widths[k]
        both = np.concatenate((-y, y), axis=1)  # the negative, then the positive directions
        near = np.argsort(-both, axis=1, kind="stable")
        value = np.take_along_axis(both, near, axis=1)
        return 2 * (near % w) + near // w, value[:, :1] - value

    def within(self, x: np.ndarray, table: int, most: np.ndarray):
        """For each row the buckets whose signed axes fall short of the nearest by its own `most` at most, in sum."""
        sides = [self.directions(x, table, k) for k in range(len(self.widths))]
        for r, limit in enumerate(most):
            code, loss = np.zeros(1, dtype=np.int64), np.zeros(1)
            for w, (own, short) in zip(self.widths, sides, strict=True):
                n = np.searchsorted(short[r], limit - loss, "right")
                i = np.repeat(np.arange(len(loss)), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                code, loss = code[i] * (2 * w) + own[r, j], loss[i] + short[r, j]
            yield code

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The `most` buckets (or all) whose signed axes are nearest, for each row: the sum over the
        chained hashes of what an axis falls short of the nearest one decides.

        Of two lists in order, the i-th and the j-th together have i * j pairs before them, so only
        pairs of places whose product is `most` at most are formed.
        """
        code, loss = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for k, w in enumerate(self.widths):
            take = min(most, 2 * w)
            own, short = (a[:, :take] for a in self.directions(x, table, k))
            i, j = np.nonzero(np.arange(1, code.shape[1] + 1)[:, None] * np.arange(1, take + 1)[None] <= most)
            code, loss = code[:, i] * (2 * w) + own[:, j], loss[:, i] + short[:, j]
            keep = np.argsort(loss, axis=1, kind="stable")[:, :most]
            code, loss = np.take_along_axis(code, keep, axis=1), np.take_along_axis(loss, keep, axis=1)
        return code


#: Where a query looks first: so many of the nearest pairs in so many tables, whatever the table's size.
FIRST_PROBES, FIRST_TABLES = 64, 4
#: Of vectors that are just as near as the k-th that a query found first, it meets this share in some table.
SURE = 0.95


@functools.cache
def reach(dim: int, tables: int, pairs: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, rising, and how far a query must look to meet a vector of that cosine as often as SURE.

    Distances are what buckets fall short by (`within`). They are measured on random pairs of
    vectors, which the rotations make of any pair, so they depend on nothing in the table. They are
    infinite where looking so far would take a query through more pairs than one table has.
    """
    n = 1 << max(1, (dim - 1).bit_length())
    hashes, (q, z) = CrossPolytope(dim, tables, [n, n]), np.random.default_rng([11, dim]).normal(size=(2, pairs, dim))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    z -= (z * q).sum(axis=1, keepdims=True) * q
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    cosines, at = np.linspace(0, 1, 41), np.arange(pairs)
    least = np.full((len(cosines), pairs), np.inf)
    for t in range(tables):
        loss = np.zeros((len(cosines), pairs))
        for k in range(2):
            y, other = hashes.rotated(q, t, k), hashes.rotated(z, t, k)
            top = np.abs(y).max(axis=1)
            for i, c in enumerate(cosines):
                v = c * y + math.sqrt(1 - c * c) * other
                axis = np.abs(v).argmax(axis=1)
                loss[i] += top - y[at, axis] * np.where(v[at, axis] > 0, 1, -1)
        least = np.minimum(least, loss)
    far = np.maximum.accumulate(np.quantile(least, SURE, axis=1)[::-1])[::-1]
    first, second = (hashes.directions(q[:64], 0, k)[1] for k in range(2))
    seen = np.array([np.mean([np.searchsorted(b, f - a, "right").sum() for a, b in zip(first, second, strict=True)]) for f in far])
    return cosines, np.where(tables * seen < 4 * n**2, far, np.inf)


def looks(cosines: np.ndarray, reached: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How far queries look (`reach`) for neighbours of their cosines: infinitely where these are unknown or too low."""
    at, far = (a[np.isfinite(reached[1])] for a in reached)
    if not len(at):
        return np.full(len(cosines), np.inf)
    some = np.isfinite(cosines)
    known = np.where(some, cosines, 0)
    return np.where(some & (known >= at[0]), np.interp(known, at, far), np.inf)


def probes_for(rows: int, buckets: int) -> int:
    """An estimate for planning, which the search doesn't use: pairs of so many that find about 0.94
    of 20 neighbours among so many uniformly random directions in 64 dimensions.
    """
    share = 0.011 * (51_282 / max(1, rows)) ** 0.27 + (500 / max(1, rows)) ** 2
    return max(1, min(buckets, math.ceil(buckets * share)))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in order of the components."""
    return np.cumsum(q.astype(np.float64) * x.astype(np.float64), axis=-1)[..., -1]


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query its k nearest of x: ids and exact scores, nearest first, ties to the smaller id."""
    rough = q.astype(np.float64) @ x.astype(np.float64).T
    take = min(len(ids), k + 4)
    part = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
    score = exact(q[:, None, :], x[part])
    order = np.lexsort((ids[part], -score), axis=1)[:, :k]
    return np.take_along_axis(ids[part], order, axis=1), np.take_along_axis(score, order, axis=1)


def matrix(rows: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one dimension, little-endian and in their own precision, as a matrix."""
    return np.frombuffer(b"".join(rows), dtype="<f4" if not rows or len(rows[0]) == 4 * dim else "<f8").reshape(len(rows), dim)


VEC = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("norm", pa.float64())])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vec (bytes) and norm of the vectors that take part; null ids don't either.

    Doubles stay doubles, all else is read as floats. Of an id with several vectors the one of
    smallest dimension, then of smallest bytes, takes part.
    """
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() == "double"

    def run(batches):
        for b in batches:
            rows = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v, dtype="<f8" if wide else "<f4")
                most = float(np.abs(x).max())
                norm = most * float(np.sqrt(((x.astype(np.float64) / most) ** 2).sum())) if most > 0 else 0.0
                if np.isfinite(norm) and norm > 0:
                    rows.append((i, len(x), x.tobytes(), norm))
            if rows:
                yield batch(VEC, *zip(*rows, strict=True))

    sound = "vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{'double' if wide else 'float'}>").alias("embedding")).where(sound)
    rows = rows.mapInArrow(run, "vec_id long, dim int, vec binary, norm double")
    return rows.groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "norm")).alias("v")).select("vec_id", "v.*")


#: A table's pairs of axes are dealt into so many buckets; within one, a point is where its pair is.
SLICES = 8
INDEX = pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("inner", pa.int32()), ("rep", pa.int64()), ("vec", pa.binary())])
INDEX_DDL = "dim int, bucket long, inner int, rep long, vec binary"
PROBE = pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("wanted", pa.binary()), ("rep", pa.int64()), ("vec", pa.binary())])
PROBE_DDL = "dim int, bucket long, wanted binary, rep long, vec binary"
FOUND = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
FOUND_DDL = "q long, ids array<long>, scores array<double>"


def by_dimension(batches, shape: dict, tables: int):
    """For each batch and dimension: the dimension, its hashes, reps, vectors' bytes, vectors, norms and further numbers."""
    made: dict = {}
    for b in batches:
        dims = np.array(b.column(1).to_pylist())
        for d in np.unique(dims).tolist():
            part = b.take(pa.array(np.flatnonzero(dims == d)))
            if d not in made:
                n = 1 << max(1, (d + shape[d]["uneven"] - 1).bit_length())
                made[d] = CrossPolytope(d + shape[d]["uneven"], tables, [n, n])
            raw = part.column(2).to_pylist()
            rest = [np.array(c.to_pylist(), dtype=np.float64) for c in part.columns[3:]]
            yield d, made[d], np.array(part.column(0).to_pylist(), dtype=np.int64), raw, matrix(raw, d).astype(np.float64), *rest


def indexed(rows: DataFrame, shape: dict, tables: int) -> DataFrame:
    """A row for each table of every point: the bucket (table and slice of its pairs), the pair's place
    in it, the point and its vector.

    shape: of each dimension the largest norm, whether norms differ, and how far queries look. Vectors are hashed as unit
    vectors; where norms differ, points get one more component that makes them so after division
    by the largest norm, and the nearest direction is then the largest inner product.
    """

    def run(batches):
        for d, hashes, reps, raw, x, norm in by_dimension(batches, shape, tables):
            u = x / norm[:, None]
            if shape[d]["uneven"]:
                rest = np.sqrt(np.maximum(0, 1 - (norm / shape[d]["top"]) ** 2))
                u = np.concatenate((x / shape[d]["top"], rest[:, None]), axis=1)
            each = 4 * hashes.n**2 // min(SLICES, 2 * hashes.n)
            for t in range(tables):
                code = hashes.buckets(u, t)
                yield batch(INDEX, np.full(len(x), d, dtype=np.int32), code // each + t * SLICES, (code % each).astype(np.int32), reps, raw)

    return rows.select("rep", "dim", "vec", "norm").mapInArrow(trimmed(run), INDEX_DDL)


def probed(rows: DataFrame, shape: dict, tables: int) -> DataFrame:
    """A row for each bucket that a query looks into: the pairs' places that it wants of it, none for all.

    Without a column `far` these are its nearest pairs in the first tables; else what lies near enough
    to hold vectors of that inner product. If that would be more than all pairs of one table, or `far`
    is null, it is one table as a whole, where every point stands once.
    """
    again = "far" in rows.columns

    def of(d, hashes, u, norm, far):
        """Table, row and codes (None: all) of what each row looks at."""
        if far is None:
            for t in range(min(tables, FIRST_TABLES)):
                for begin in range(0, len(u), 128):
                    yield from ((t, i, c) for i, c in enumerate(hashes.probes(u[begin : begin + 128], t, FIRST_PROBES), begin))
            return
        most = looks(far / norm / shape[d]["top"], shape[d]["reach"])
        yield from ((0, i, None) for i in np.flatnonzero(np.isinf(most)).tolist())
        some = np.flatnonzero(np.isfinite(most))
        for t in range(tables):
            for begin in range(0, len(some), 128):
                rows = some[begin : begin + 128]
                yield from ((t, i, c) for i, c in zip(rows.tolist(), hashes.within(u[rows], t, most[rows]), strict=True))

    def run(batches):
        for d, hashes, reps, raw, x, norm, *far in by_dimension(batches, shape, tables):
            slices = min(SLICES, 2 * hashes.n)
            each, out, size = 4 * hashes.n**2 // slices, [], 0
            for t, i, code in of(d, hashes, x / norm[:, None], norm, far[0] if far else None):
                if code is None:
                    out += [(d, s + t * SLICES, b"", reps[i], raw[i]) for s in range(slices)]
                else:
                    code = np.sort(code)
                    part = code // each
                    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(code)], strict=True):
                        out.append((d, int(part[s]) + t * SLICES, (code[s:e] % each).astype("<u4").tobytes(), reps[i], raw[i]))
                    size += 4 * len(code)
                if len(out) >= 1024 or size > 1 << 23:
                    yield batch(PROBE, *zip(*out, strict=True))
                    out, size = [], 0
            if out:
                yield batch(PROBE, *zip(*out, strict=True))

    return rows.select("rep", "dim", "vec", "norm", *(["far"] if again else [])).mapInArrow(trimmed(run), PROBE_DDL)


def look(a: pd.DataFrame, b: pd.DataFrame, k: int, block: int = 1 << 18) -> pd.DataFrame:
    """q, ids, scores: of a bucket's points (a) those at the places that queries (b) want, the k nearest.

    A query that wants no place in particular wants all of them.
    """
    nothing = pd.DataFrame({"q": [], "ids": [], "scores": []}, dtype=object)
    if not len(a) or not len(b):
        return nothing
    d, inner = int(a["dim"].iloc[0]), a["inner"].to_numpy()
    order = np.argsort(inner, kind="stable")
    x, reps, inner = matrix(list(a["vec"]), d).astype(np.float64)[order], a["rep"].to_numpy()[order], inner[order]
    q = matrix(list(b["vec"]), d).astype(np.float64)
    wanted, out = [np.frombuffer(s, dtype="<u4") for s in b["wanted"]], []
    whole, step = np.flatnonzero([not len(w) for w in wanted]), max(1, min(16 * block // len(x), 8 * block // ((k + 4) * d)))
    for rows in (whole[s : s + step] for s in range(0, len(whole), step)):
        out += zip(b["rep"].to_numpy()[rows], *map(list, best(q[rows], reps, x, k)), strict=True)
    owner = np.repeat(np.arange(len(b)), [len(w) for w in wanted])
    wanted = np.concatenate(wanted).astype(np.int64)
    lo, hi = np.searchsorted(inner, wanted, "left"), np.searchsorted(inner, wanted, "right")
    there = hi > lo
    owner, lo, n = owner[there], lo[there], (hi - lo)[there]
    begin, total = 0, np.cumsum(n)
    while begin < len(owner):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + block, "right")))
        size = n[begin:end]
        row = np.repeat(owner[begin:end], size)
        at = np.arange(int(size.sum())) + np.repeat(lo[begin:end] - (np.cumsum(size) - size), size)
        order = np.lexsort((reps[at], -np.einsum("ij,ij->i", q[row], x[at]), row))
        row, at = row[order], at[order]
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        row, at = row[place < k + 4], at[place < k + 4]
        score = exact(q[row], x[at])
        order = np.lexsort((reps[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(row)], strict=True):
            e = min(e, s + k)
            out.append((b["rep"].iat[int(row[s])], reps[at[s:e]], score[s:e]))
        begin = end
    return pd.DataFrame(out, columns=["q", "ids", "scores"]) if out else nothing


def merge(rows: DataFrame, k: int) -> DataFrame:
    """The k best of all lists of each query; a query's lists are streamed, sorted by query."""

    def run(batches):
        q, have, out = None, {}, []

        def top():
            order = sorted(have.items(), key=lambda x: (-x[1], x[0]))[:k]
            return (q, [i for i, _ in order], [s for _, s in order])

        for b in batches:
            for i, ids, scores in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != q and q is not None:
                    out.append(top())
                    have = {}
                q = i
                have.update(zip(ids, scores, strict=True))
                if len(have) > 64 * k:
                    have = dict(sorted(have.items(), key=lambda x: (-x[1], x[0]))[:k])
            if out:
                yield batch(FOUND, *zip(*out, strict=True))
                out = []
        if q is not None:
            yield batch(FOUND, *zip(*[top()], strict=True))

    return rows.select("q", "ids", "scores").repartition("q").sortWithinPartitions("q").mapInArrow(run, FOUND_DDL)


def search(vectors: DataFrame, is_query, scratch: Scratch, *, k: int = 20, tables: int = 12, chunk: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query (vec_id, embedding).

    `is_query` is a condition on vec_id. Nearest is the largest inner product, ties to the smaller
    vec_id; the query's own id is no candidate. Vectors that are null, zero, or hold null or
    non-finite components take no part; vectors of other dimensions than a query's aren't its
    candidates; a repeated row counts once, and of an id with several vectors one takes part.
    Vectors of doubles are compared as doubles.

    Equal vectors are one point of the index: of each the k + 1 smallest ids are kept, as no more
    can be among a query's k nearest, so a third of all rows being one vector costs no more than
    one. Points and queries meet in the buckets, where only the pairs that a query wants are
    compared. Buckets of very many points or queries are dealt out in chunks. They meet twice: the
    k-th best score of the first time, and no number of rows, says where a query looks the second
    time. So points that are far from a query change nothing in what it finds. A query that found
    fewer than k the first time, or only far ones, is compared with all points.
    """
    spark = vectors.sparkSession
    rows = scratch.cut(valid(vectors).withColumn("_d", F.md5("vec")), "rows")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("dim", "_d").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    few = scratch.cut(few.withColumn("rep", F.min("vec_id").over(Window.partitionBy("dim", "_d"))), "few")
    points = few.where("_n = 1").select("rep", "dim", "vec", "norm")
    asked = scratch.cut(rows.where(is_query).select("vec_id", "dim", "_d").join(few.where("_n = 1").select("dim", "_d", "rep"), ["dim", "_d"]).select("vec_id", "dim", "rep"), "asked")
    shape = {}
    for r in points.groupBy("dim").agg(F.max("norm").alias("top"), F.min("norm").alias("low")).collect():
        uneven = int(r["low"] < r["top"] * (1 - 1e-5))
        shape[r["dim"]] = {"top": r["top"], "uneven": uneven, "reach": reach(r["dim"] + uneven, tables)}
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = points.join(asked.select("dim", "rep").distinct(), ["dim", "rep"], "left_semi")

    index = scratch.cut(indexed(points, shape, tables), "index")

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))

    def met(index: DataFrame, queries: DataFrame, name: str) -> DataFrame:
        """Of each query the lists of what it finds in the buckets that it looks into."""
        probe = scratch.cut(probed(queries, shape, tables), f"probe{name}")
        grid = scratch.cut(parts(index, "n_i").join(parts(probe, "n_q"), ["dim", "bucket"]), f"grid{name}")

        def deal(side: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
            rest = [c for c in side.columns if c not in ("dim", "bucket")]
            return (
                side.join(grid, ["dim", "bucket"])
                .withColumn(own_part, F.pmod(F.xxhash64("rep"), F.col(own)))
                .withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .select("dim", "bucket", F.col("i").cast("long"), F.col("j").cast("long"), *rest)
            )

        key = ["dim", "bucket", "i", "j"]
        left, right = deal(index, "n_i", "n_q", "i", "j"), deal(probe, "n_q", "n_i", "j", "i")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: look(a, b, k + 1), FOUND_DDL)

    first = scratch.cut(merge(met(index.where(F.col("bucket") < FIRST_TABLES * SLICES), queries, "0"), k + 1), "first")
    scratch.drop("probe0")
    far = first.select(F.col("q").alias("rep"), F.get("scores", F.lit(k)).alias("far"))
    found = scratch.cut(merge(met(index, queries.join(far, "rep", "left"), "1").unionByName(first), k + 1), "found")
    scratch.drop("index", "probe1")

    near = found.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("q", F.col("x.ids").alias("rep"), F.col("x.scores").alias("score"))
    each = near.join(few.select("rep", "vec_id"), "rep")
    top = each.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("l"))
    full = asked.join(lists, asked["rep"] == lists["q"]).select(asked["vec_id"].alias("query_id"), F.slice(F.expr("filter(l, x -> x.vec_id <> vec_id)"), 1, k).alias("l"))
    return full.select("query_id", F.posexplode("l").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
