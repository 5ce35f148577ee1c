"""Versioned chunk tables: Parquet files in partitions by path, and a manifest for each version.

A row belongs to the partition that the hash of its path names. A write makes new files for the
partitions that it touches and a manifest that names, for every partition, the folder that holds
it; files of other partitions are neither read nor written. manifest-<n> is made only if there is
none yet, so of two writers that began from one version one fails, and tries again on the other's.
Readers see the files that the newest manifest named when they began.
"""

from __future__ import annotations

import json
import os
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vector import checked
from .operators import knn
from .operators.keyword import KeywordIndex

CHUNK_DDL = "path string, chunk_id string, text string, doc_type string, heading_path array<string>, section_title string, start_line int, end_line int, mtime_ns long, model string, metadata string, vector array<float>, cell int"
IMAGE_DDL = "path string, image_id string, page_num int, description string, doc_type string, mtime_ns long, model string, metadata string, vector array<float>, cell int"
TEXT_DIM, IMAGE_DIM = 1024, 2048
KEEP_SECONDS = 7 * 86400
PARTITIONS = 16
#: Text tables get an index beyond so many rows, image tables from the least that an index takes.
INDEX_FROM = 5000


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


class ChunkStore:
    """One table of chunks (or page images) with replace-by-path writes."""

    def __init__(self, spark: SparkSession, path: str, *, dim: int = TEXT_DIM, ddl: str = CHUNK_DDL, partitions: int = PARTITIONS, index_from: int | None = None):
        self.spark, self.path, self.dim, self.ddl, self.partitions = spark, path.rstrip("/"), dim, ddl, partitions
        self.images = "image_id" in ddl
        self.index_from = index_from if index_from is not None else knn.CellIndex.LEAST_ROWS if self.images else INDEX_FROM
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._words: tuple[int, KeywordIndex | None] | None = None

    # --- files --------------------------------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list:
        return [s for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def _load(self, name: str):
        f = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def _write(self, name: str, value) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def version(self) -> int | None:
        numbers = [int(n[9:]) for s in self._names() if (n := s.getPath().getName()).startswith("manifest-") and n[9:].isdigit()]
        return max(numbers, default=None)

    def manifest(self, version: int | None) -> dict:
        """parts: the folder of each partition that has one; cells: the index's file, or None."""
        return self._load(f"manifest-{version}") if version else {"partitions": self.partitions, "parts": {}, "cells": None, "rows_at_build": 0}

    def _commit(self, before: int | None, manifest: dict) -> int:
        """Make the next manifest; a Conflict if there is one."""
        n = (before or 0) + 1
        draft, target = f".draft-{uuid.uuid4().hex}", self._at(f"manifest-{n}")
        self._write(draft, manifest)
        try:
            if str(self._fs.getScheme()) == "file":  # a link is made or fails, in one step
                plain = [self._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString() for p in (self._at(draft), target)]
                os.link(*plain)
                self._fs.delete(self._at(draft), False)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(context.makeQualified(self._at(draft)), context.makeQualified(target), never)
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"{self.path} has moved on from version {before}") from e
            raise
        return n

    # --- reading ------------------------------------------------------------------------------

    def _rows(self, parts: dict) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*(f"{self.path}/{folder}" for folder in parts.values()))

    def read(self) -> DataFrame:
        """The newest version; an empty frame before the first write."""
        return self._rows(self.manifest(self.version())["parts"])

    def near(self, vector, *, probes: int | None = None) -> DataFrame:
        """The rows that a search for `vector` must compare: all, or with an index those of the cells
        nearest to it. Files are sorted by cell, so row groups of other cells stay unread."""
        manifest = self.manifest(self.version())
        rows = self._rows(manifest["parts"])
        if not manifest["cells"]:
            return rows
        index = knn.CellIndex("", np.array(self._load(manifest["cells"])), manifest["rows_at_build"])
        cells = np.flatnonzero(index.probed(np.asarray(vector, dtype=np.float64)[None], probes)[0])
        return rows.where(F.col("cell").isin(cells.tolist()) | F.col("cell").isNull())

    def words(self) -> KeywordIndex | None:
        """The keyword index of the newest version, built when first asked for; None where that fails,
        and search then scans."""
        n = self.version()
        if n is None or self.images:
            return None
        if self._words is None or self._words[0] != n:
            at = f"{self.path}/words-{n}"
            try:
                made = KeywordIndex(self.spark, at) if self._fs.exists(self._at(f"words-{n}/totals/_SUCCESS")) else KeywordIndex.build(self.read(), at)
            except Exception:  # an index is a help, not a need
                made = None
            self._words = (n, made)
        return self._words[1]

    # --- writing ------------------------------------------------------------------------------

    def _part(self, partitions: int):
        return F.pmod(F.xxhash64("path"), F.lit(partitions)).cast("int")

    def _save(self, rows: DataFrame, manifest: dict, touched: set[int]) -> dict:
        """New files of the touched partitions; the manifest that names them."""
        folder = f"data-{uuid.uuid4().hex}"
        order = ["cell", "path", "image_id" if self.images else "chunk_id"]
        placed = rows.withColumn("part", self._part(manifest["partitions"])).repartition(len(touched) or 1, "part").sortWithinPartitions("part", *order)
        placed.write.partitionBy("part").parquet(f"{self.path}/{folder}")
        made = {int(s.getPath().getName()[5:]) for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part=")}
        parts = {k: v for k, v in manifest["parts"].items() if int(k) not in touched} | {str(k): f"{folder}/part={k}" for k in sorted(made)}
        return manifest | {"parts": parts}

    def conform(self, rows: DataFrame, manifest: dict | None = None) -> DataFrame:
        """Rows in the table's schema: absent columns null, every vector's dimension checked, its cell by the index."""
        schema = self.spark.createDataFrame([], self.ddl).schema
        out = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        out = out.withColumn("vector", F.when(F.col("vector").isNotNull(), checked(F.col("vector"), self.dim)))
        if not (manifest and manifest["cells"]):
            return out.withColumn("cell", F.lit(None).cast("int"))
        cell = F.pandas_udf(knn.cell_of(np.array(self._load(manifest["cells"]))), "int")
        return out.withColumn("cell", cell("vector"))

    def _change(self, paths: DataFrame, new: DataFrame | None, tries: int) -> tuple[int, int]:
        """Replace all rows of `paths` by `new`: how many paths and rows there were."""
        for left in range(tries - 1, -1, -1):
            before = self.version()
            manifest = self.manifest(before)
            part = self._part(manifest["partitions"])
            touched = {r[0] for r in paths.select(part.alias("p")).distinct().collect()}  # a number for each partition at most
            old = self._rows({k: v for k, v in manifest["parts"].items() if int(k) in touched})
            gone = old.select("path").join(paths, "path", "left_semi").agg(F.countDistinct("path").alias("p"), F.count("*").alias("n")).first()
            if new is None and not gone["n"]:
                return 0, 0
            rows = old.join(paths, "path", "left_anti").select(*old.columns)
            rows = rows if new is None else rows.unionByName(self.conform(new, manifest))
            try:
                self._commit(before, self._save(rows, manifest, touched))
                return gone["p"], gone["n"]
            except Conflict:
                if not left:
                    raise
        raise AssertionError("no tries")

    def upsert(self, rows: DataFrame, *, touched: DataFrame | None = None, tries: int = 3) -> dict:
        """Replace all rows of the paths in `touched` (by default those of `rows`) by `rows`.

        Only the partitions of touched paths are read and written. A touched path without rows ends
        up empty. Counts inserted rows, and replaced paths and rows.
        """
        paths = (touched if touched is not None else rows).select("path").distinct()
        gone_paths, gone_rows = self._change(paths, rows, tries)
        self.index()
        return {"inserted": self.read().join(paths, "path", "left_semi").count(), "deleted_paths": gone_paths, "deleted_rows": gone_rows}

    def delete(self, paths: DataFrame, *, tries: int = 3) -> int:
        """Delete all rows of the given paths; how many there were."""
        return self._change(paths.select("path").distinct(), None, tries)[1] if self.version() else 0

    def prune(self, present: DataFrame) -> int:
        """Delete the rows of paths that are not present; how many paths."""
        orphans = self.read().select("path").distinct().join(present.select("path"), "path", "left_anti")
        n = orphans.count()
        if n:
            self.delete(orphans)
        return n

    # --- upkeep -------------------------------------------------------------------------------

    def index(self, *, force: bool = False) -> bool:
        """Make the vector index, if there are enough rows and none yet, or the table has outgrown it;
        the table is then rewritten by cell. Whether it was made."""
        before = self.version()
        manifest, n = self.manifest(before), self.read().count()
        due = n > self.index_from and (not manifest["cells"] or n > knn.CellIndex.OUTGROWN * manifest["rows_at_build"])
        if not (force or due) or n < knn.CellIndex.LEAST_ROWS:
            return False
        centroids = knn.CellIndex.centres(self.read().where(F.col("vector").isNotNull()), n)
        name = f"cells-{uuid.uuid4().hex}"
        self._write(name, centroids.tolist())
        made = manifest | {"cells": name, "rows_at_build": n}
        self._commit(before, self._save(self.conform(self.read().drop("cell"), made), made, set(range(manifest["partitions"]))))
        return True

    def optimize(self, *, file_rows: int = 1_000_000, keep_seconds: int = KEEP_SECONDS) -> dict:
        """Rewrite the partitions that have several files into files of about `file_rows`; delete versions
        older than `keep_seconds`, and what only they name."""
        before = self.version()
        if before is None:
            return {"version": None, "rewritten": 0, "removed": 0}
        manifest = self.manifest(before)
        files = {int(k): sum(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._at(v))) for k, v in manifest["parts"].items()}
        loose = {k for k, n in files.items() if n > 1}
        n = before
        if loose:
            rows = self._rows({k: v for k, v in manifest["parts"].items() if int(k) in loose})
            with_limit = rows.sparkSession.conf.get("spark.sql.files.maxRecordsPerFile")
            rows.sparkSession.conf.set("spark.sql.files.maxRecordsPerFile", file_rows)
            try:
                n = self._commit(before, self._save(rows, manifest, loose))
            finally:
                rows.sparkSession.conf.set("spark.sql.files.maxRecordsPerFile", with_limit)
        now = time.time() * 1000
        status = {s.getPath().getName(): s for s in self._names()}
        old = {name for name, s in status.items() if now - s.getModificationTime() >= keep_seconds * 1000}
        gone = {name for name in old if name.startswith("manifest-") and name != f"manifest-{n}"}
        used = {f"words-{n}"}
        for name in status:
            if name.startswith("manifest-") and name not in gone:
                kept = self._load(name)
                used |= {v.split("/")[0] for v in kept["parts"].values()} | {kept["cells"]}
        gone |= {name for name in old if name.startswith(("data-", "cells-", "words-", ".draft-")) and name not in used}
        for name in gone:
            self._fs.delete(status[name].getPath(), True)
        return {"version": n, "rewritten": len(loose), "removed": len(gone)}

    def stats(self) -> dict:
        """Rows, paths, counts by document type, dimension, model and the index; the vectors stay unread."""
        rows, manifest = self.read(), self.manifest(self.version())
        one = rows.agg(F.count("*").alias("n"), F.countDistinct("path").alias("p"), F.max("model").alias("m")).first()
        kinds = {r["doc_type"]: r["count"] for r in rows.groupBy("doc_type").count().collect()}
        ann = {"built": bool(manifest["cells"]), "rows_at_build": manifest["rows_at_build"]}
        return {"total_chunks": one["n"], "unique_files": one["p"], "doc_types": kinds, "dimensions": self.dim, "model": one["m"], "ann_index": ann}

    def mtimes(self) -> DataFrame:
        """path and its latest mtime_ns."""
        return max_mtime(self.read())

    def last_indexed(self):
        return self.mtimes().agg(F.timestamp_micros((F.max("mtime_ns") / 1000).cast("long"))).first()[0]


def max_mtime(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.max("mtime_ns").alias("mtime_ns"))


def changed(disk: DataFrame, indexed: DataFrame, *, force: bool = False) -> DataFrame:
    """Files (path, mtime_ns) whose mtime is not the indexed one; all if forced."""
    return disk if force else disk.join(indexed.select("path", "mtime_ns"), ["path", "mtime_ns"], "left_anti")


def freshness(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """path and status: new, deleted, modified (indexed before it changed), older, fresh."""
    both = disk.select("path", F.col("mtime_ns").alias("d")).join(indexed.select("path", F.col("mtime_ns").alias("i")), "path", "full_outer")
    status = F.when(F.col("i").isNull(), "new").when(F.col("d").isNull(), "deleted").when(F.col("i") < F.col("d"), "modified").when(F.col("i") > F.col("d"), "older").otherwise("fresh")
    return both.select("path", status.alias("status"))


def open_store(spark: SparkSession, path: str, *, backend: str = "snapshot", **how) -> ChunkStore:
    if backend != "snapshot":
        raise ValueError(f"unknown vector backend: {backend}")
    return ChunkStore(spark, path, **how)
