"""Nearest-neighbour search over chunk tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import closeness, literal, squared_l2

#: The order of equally distant rows.
TIES = ("path", "chunk_id")


def filtered(chunks: DataFrame, path_filter: str | None = None, doc_type: str | None = None) -> DataFrame:
    """Literal substring of path, and document type; both before any ranking or limit."""
    if path_filter:
        chunks = chunks.where(F.col("path").contains(path_filter))
    return chunks.where(F.col("doc_type") == doc_type) if doc_type else chunks


def nearest(chunks: DataFrame, vector, k: int = 8, *, path_filter: str | None = None, doc_type: str | None = None, ties=TIES) -> DataFrame:
    """The k rows of least squared L2 distance, with `distance` and `score`; the vector stays behind."""
    near = filtered(chunks, path_filter, doc_type).withColumn("distance", squared_l2(F.col("vector"), literal(vector)))
    return near.orderBy("distance", *ties).limit(k).drop("vector").withColumn("score", closeness(F.col("distance")))


def nearest_each(chunks: DataFrame, queries: DataFrame, k: int = 8, *, path_filter: str | None = None, doc_type: str | None = None, ties=TIES, block: int = 1024, probed=None) -> DataFrame:
    """For every query (query_id, vector) its k nearest rows: query_id, rank, the ties' columns, distance, score.

    Queries are a stated set: they go out in blocks of bounded size. Every batch of rows keeps only
    its k best of each query, so what is shuffled grows with queries and batches, not with pairs.
    `probed`, for chunks with a `cell`, makes of a block's matrix the cells (query x cell, boolean) that each query reads.
    """
    rows = filtered(chunks, path_filter, doc_type).select(*ties, "vector", *(["cell"] if probed else []))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"{t} {rows.schema[t].dataType.simpleString()}" for t in ties) + ", distance double"
    parts, held = [], []

    def against(asked: list):
        ids, matrix = [r["query_id"] for r in asked], np.array([r["vector"] for r in asked], dtype=np.float64)
        reads = probed(matrix) if probed else None

        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["vector"].to_numpy()).astype(np.float64)
                d = np.maximum((matrix**2).sum(1)[:, None] - 2 * matrix @ x.T + (x**2).sum(1)[None], 0)
                if reads is not None:
                    d[~reads[:, b["cell"].to_numpy()]] = np.inf
                take = min(len(b), k + 8)
                near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(b) else np.broadcast_to(np.arange(len(b)), d.shape)
                exact = ((matrix[:, None, :] - x[near]) ** 2).sum(axis=2)
                out = b[list(ties)].iloc[near.ravel()].reset_index(drop=True)
                out.insert(0, "query_id", np.repeat(np.array(ids, dtype=object), take))
                out["distance"] = exact.ravel()
                if reads is not None:
                    out = out[np.isfinite(np.take_along_axis(d, near, axis=1)).ravel()]
                yield out.sort_values(["query_id", "distance", *ties]).groupby("query_id", sort=False).head(k)

        own = rows if reads is None else rows.where(F.col("cell").isin(np.flatnonzero(reads.any(axis=0)).tolist()))
        return own.mapInPandas(run, schema)

    for r in queries.select("query_id", "vector").toLocalIterator():
        held.append(r)
        if len(held) == block:
            parts.append(against(held))
            held = []
    if held or not parts:
        parts.append(against(held) if held else rows.limit(0).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *ties, F.lit(0.0).alias("distance")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", *ties)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", closeness(F.col("distance")))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """recall and n of two results of nearest_each: the share of n exact rows that have a found one.

    A found row counts by its distance, so that rows as far as the last exact one stand for each other.
    """
    last = exact.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").where("distance <= last").groupBy("query_id").agg(F.count("*").alias("hits"))
    every = last.join(hits, "query_id", "left").agg(F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return every.select((F.col("hits") / F.when(F.col("n") > 0, F.col("n"))).alias("recall"), "n")


def ann_partitions(rows: int) -> int:
    """How many cells an index over so many rows has: one for 500 rows, 1 to 256."""
    return max(1, min(256, rows // 500))


def ann_probes(cells: int) -> int:
    """How many of so many cells a search reads: half of them and two more.

    Vectors without structure are the hard case: their neighbours stand in many cells, so a fixed
    number of probes loses ever more of them as cells grow.
    """
    return min(cells, -(-cells // 2) + 2)


class CellIndex:
    """Inverted-file index: rows are stored by the cell of their nearest centroid, and a search
    reads the cells nearest to the query only, by partition pruning.

    Built for 200 rows or more; stale when the table has outgrown it by half.
    """

    LEAST_ROWS, OUTGROWN = 200, 1.5

    def __init__(self, path: str, centroids: np.ndarray, rows_at_build: int):
        self.path, self.centroids, self.rows_at_build = path, centroids, rows_at_build

    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, cells: int | None = None, seed: int = 11, sample_rows: int = 20_000) -> CellIndex | None:
        """Centroids come from at most `sample_rows` rows; every row is stored in its cell. None below LEAST_ROWS."""
        n = chunks.count()
        if n < cls.LEAST_ROWS:
            return None
        centroids = cls.centres(chunks, n, cells=cells, seed=seed, sample_rows=sample_rows)
        cell = F.pandas_udf(cell_of(centroids), "int")
        chunks.withColumn("cell", cell("vector")).write.mode("overwrite").partitionBy("cell").parquet(path)
        return cls(path, centroids, n)

    @staticmethod
    def centres(chunks: DataFrame, n: int, *, cells: int | None = None, seed: int = 11, sample_rows: int = 20_000) -> np.ndarray:
        """The cells' centroids, of at most about `sample_rows` of the n rows."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        points = chunks.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        fit = points if n <= sample_rows else points.sample(sample_rows / n, seed=seed)
        wanted = cells or ann_partitions(n)  # KMeans takes two or more; one cell has any centre
        return np.array(KMeans(k=wanted, seed=seed, maxIter=10).fit(fit).clusterCenters() if wanted > 1 else [points.first()[0].toArray()])

    def stale(self, rows: int) -> bool:
        return rows > self.OUTGROWN * self.rows_at_build

    def status(self) -> dict:
        return {"built": True, "rows_at_build": self.rows_at_build}

    def probed(self, matrix: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Query x cell: whether the cell is among the `probes` nearest to the query."""
        order = np.argsort((self.centroids**2).sum(axis=1)[None] - 2 * matrix @ self.centroids.T, axis=1, kind="stable")
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order[:, : probes or ann_probes(len(self.centroids))], True, axis=1)
        return out

    def search(self, spark, vector, k: int = 8, *, probes: int | None = None, **how) -> DataFrame:
        near = np.flatnonzero(self.probed(np.asarray(vector, dtype=np.float64)[None], probes)[0])
        return nearest(spark.read.parquet(self.path).where(F.col("cell").isin(near.tolist())), vector, k, **how)

    def search_each(self, spark, queries: DataFrame, k: int = 8, *, probes: int | None = None, **how) -> DataFrame:
        """As nearest_each, every query over its own cells."""
        return nearest_each(spark.read.parquet(self.path), queries, k, probed=lambda matrix: self.probed(matrix, probes), **how)


def cell_of(centroids: np.ndarray):
    """Each vector's nearest centroid; null of null."""

    def of(vectors: pd.Series) -> pd.Series:
        there = vectors.notna().to_numpy()
        out = pd.array([None] * len(vectors), dtype="Int32")
        if there.any():
            x = np.stack(vectors[there].to_numpy()).astype(np.float64)
            out[there] = (-2 * x @ centroids.T + (centroids**2).sum(axis=1)).argmin(axis=1)
        return pd.Series(out)

    of.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return of
