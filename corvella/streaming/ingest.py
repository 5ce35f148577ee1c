"""Continuous ingestion: new files go through the same parse, chunk and upsert as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunk_documents
from ..providers import Embedder, embed_column
from ..sources.parse import parse, record_metadata
from ..store import ChunkStore

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, root: str, store: ChunkStore, embedder: Embedder, checkpoint: str, *, glob: str = "*") -> StreamingQuery:
    """Upsert files as they appear below `root`; a batch that is replayed replaces what it wrote."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)

    def write(batch: DataFrame, _: int) -> None:
        documents = parse(batch.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")).where("doc_type <> 'error'").persist()
        try:
            if not documents.isEmpty():
                rows = chunk_documents(documents).join(documents.select("path", "mtime_ns", record_metadata().alias("metadata")), "path")
                store.upsert(rows.withColumn("vector", embed_column(embedder, "text")), touched=documents)
        finally:
            documents.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, *, time: str = "ts", by: str = "event_type", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by window and type of a stream (or a table) of events, with a watermark for late ones."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
