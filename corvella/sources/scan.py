"""Recursive file scans as DataFrames."""

from __future__ import annotations

import fnmatch
import itertools
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, doc_type

MAX_FILES, MAX_BYTES = 10_000, 5_000_000
CONTENTS_DDL = "path string, mtime_ns long, length long, content binary"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path's last part matches any glob, whatever its case."""
    if not patterns:
        return F.lit(True)
    one = "|".join(re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"(?:\1)", fnmatch.translate(p.lower())) for p in patterns)
    return F.lower(base_name(path)).rlike(f"(?s)^(?:{one})$")


def local(root: str) -> str | None:
    """The plain path of a root on the file system that all machines share; None on any other store."""
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    return root if root.startswith("/") else None


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime (ns) and length of the files below `root`, as Spark's reader names them.

    Below a plain path a task walks the folders and the driver holds no names; any other store is
    listed by Spark's reader, in the driver.
    """
    at = local(root)
    if at is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return files.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "length")
    if not os.path.exists(at):
        raise FileNotFoundError(root)

    def walk(_):
        def below(folder):
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_"):
                        continue
                    if e.is_dir():
                        yield from below(e.path)
                    else:
                        found = e.stat()
                        yield f"file:{e.path}", found.st_mtime_ns // 1_000_000 * 1_000_000, found.st_size

        names = below(at) if os.path.isdir(at) else iter([(f"file:{at}", os.stat(at).st_mtime_ns // 1_000_000 * 1_000_000, os.stat(at).st_size)])
        while part := list(itertools.islice(names, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "mtime_ns", "length"])

    return spark.range(1, numPartitions=1).mapInArrow(walk, "path string, mtime_ns long, length long").repartition("path")


def scan(spark: SparkSession, root: str, *, patterns: list[str] | None = None, path_filter: str | None = None, max_bytes: int = MAX_BYTES, max_files: int | None = None) -> DataFrame:
    """path, mtime (ns) and length of the files below `root` that pass the filters.

    With `max_files` the first by path are taken. A missing root is an error.
    """
    files = listed(spark, root).where(F.col("length") <= max_bytes).where(matches(F.col("path"), patterns or []))
    if path_filter:
        files = files.where(F.col("path").contains(path_filter))
    return files if max_files is None else files.orderBy("path").limit(max_files)


def contents(files: DataFrame, root: str) -> DataFrame:
    """path, mtime (ns), length and content of listed files; no other file is opened.

    Below a plain path tasks open the files, and neither names nor contents meet in the driver. Of any
    other store the names do, for Spark's reader.
    """
    if local(root) is None:
        spark, paths = files.sparkSession, [r["path"] for r in files.select("path").collect()]
        if not paths:
            return spark.createDataFrame([], CONTENTS_DDL)
        read = spark.read.format("binaryFile").load([re.sub(r"([\\\[\]{}?*])", r"\\\1", p) for p in paths])
        return read.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "length", "content")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 16):  # so many files are held at a time
                part = b.slice(at, 16)
                raw = []
                for path in part.column(0).to_pylist():
                    with open(path.removeprefix("file:"), "rb") as f:
                        raw.append(f.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, type=pa.binary())], names=["path", "mtime_ns", "length", "content"])

    return files.select("path", "mtime_ns", "length").mapInArrow(run, CONTENTS_DDL)


def file_metadata(files: DataFrame) -> DataFrame:
    """path, size, mtime_ns, type and sha-256 of scanned files."""
    return files.select("path", F.col("length").alias("size"), "mtime_ns", doc_type(F.col("path")).alias("doc_type"), F.sha2("content", 256).alias("sha256"))
