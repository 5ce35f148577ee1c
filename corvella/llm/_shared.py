"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where the session names none (tests, a local master) a temporary folder is made
    and kept for the session; a session on several machines must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run, written below the shared folder.

    `cut` writes a frame as Parquet and rereads it: the lineage ends there, the work behind
    it is done once, and a lost executor takes nothing with it. `drop` deletes tables that no
    later step reads. What the returned frame still reads is left for the caller's session.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/corvella/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def cut(self, df: DataFrame, name: str, *, light: bool = False) -> DataFrame:
        """`light`: rows are a few numbers, so a sixteenth of the partitions serves."""
        if light:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def utf8(col: str = "text"):
    """A text column as UTF-8 bytes; what Python then reads needs no decoding."""
    return F.col(col).cast("binary")


def free(df: DataFrame, name: str) -> str:
    """`name`, or what is first free of name1, name2, ... among the frame's columns."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of few rows, so that only a part's texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: A bitmap has so many bits at most: a million words; of very many values it tells less, and stays right.
MOST_BITS = 1 << 26


class Bitmap:
    """Which longs may stand in a column: a table of 64-bit words, of bounded size whatever the column holds.

    It is made on the executors and goes out as a broadcast of at most MOST_BITS / 64 rows. Of a
    value that is not in it, it is certain that the column does not hold it.
    """

    def __init__(self, rows: DataFrame, column: str, scratch: Scratch, name: str):
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (16 * rows.count()).bit_length()))
        at = rows.where(F.col(column).isNotNull()).select(F.col(column).bitwiseAND(self.bits - 1).alias("b"))
        one = F.expr("shiftleft(1L, cast(b & 63 as int))")
        self.words = scratch.cut(at.groupBy(F.shiftright("b", 6).cast("int").alias("_word")).agg(F.bit_or(one).alias("_mask")), name)

    def split(self, rows: DataFrame, value, *, maybe: bool) -> DataFrame:
        """The rows whose value may stand in the column, or those whose value surely does not."""
        b = value.bitwiseAND(self.bits - 1)
        words = F.broadcast(self.words)
        there = (F.shiftright(b, 6).cast("int") == words["_word"]) & (F.getbit(words["_mask"], b.bitwiseAND(63).cast("int")) == 1)
        return rows.join(words, there, "left_semi" if maybe else "left_anti")


def trimmed(run):
    """`run`, a function over Arrow batches, that gives memory back at its end: a Python worker lives on,
    and what it holds then stands beside the next stage's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def crc_mod(column: str, n: int):
    """crc32 of a column's text form modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


def is_local(uri: str) -> str | None:
    """The plain path of a file:// URI or a path without a scheme."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None
