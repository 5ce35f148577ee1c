"""Incremental indexing: scan, parse, chunk, embed and replace by path, in one plan a run."""

from __future__ import annotations

import json
import os
import socket
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PERFORMANCE, KBConfig
from .operators.chunk import chunk_documents
from .providers import Embedder, embed_column
from .sources.parse import failures, parse, record_metadata
from .sources.scan import contents, scan
from .store import IMAGE_DDL, IMAGE_DIM, ChunkStore, changed, freshness, open_store


class Locked(RuntimeError):
    pass


@contextmanager
def locked(spark: SparkSession, path: str):
    """A lock file on the file system that `path` names, so that it holds for all machines that share it.

    It tells host and process; one whose process on this host is gone is taken over.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mine = {"host": socket.gethostname(), "pid": os.getpid()}
    for _ in range(2):
        try:
            f = fs.create(at, False)
            f.write(bytearray(json.dumps(mine).encode()))
            f.close()
            break
        except Exception as e:
            if not fs.exists(at):
                raise
            held = _holder(jvm, fs, at)
            if held.get("host") != mine["host"] or _alive(held.get("pid", 0)):
                raise Locked(path) from e
            fs.delete(at, False)
    else:
        raise Locked(path)
    try:
        yield
    finally:
        fs.delete(at, False)


def _holder(jvm, fs, at) -> dict:
    f = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
    except ValueError:
        return {"host": socket.gethostname(), "pid": 0}
    finally:
        f.close()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid or -1, 0)
    except PermissionError:
        return True  # another user's
    except (ProcessLookupError, ValueError, OverflowError):
        return False
    return bool(pid)


class Indexer:
    """`see` reads text from images, `image_embedder` makes vectors of page images; both may be absent."""

    def __init__(self, spark: SparkSession, kb: KBConfig, store_root: str, embedder: Embedder, *, see=None, image_embedder=None, parsers=None, performance: dict | None = None):
        self.spark, self.kb, self.embedder, self.see, self.image_embedder, self.parsers = spark, kb, embedder, see, image_embedder, parsers
        self.performance = PERFORMANCE | (performance or {})
        self.store: ChunkStore = open_store(spark, f"{store_root}/kb_{kb.name}", backend=kb.vector_backend, dim=embedder.dim)
        self.images = ChunkStore(spark, f"{store_root}/kb_{kb.name}_images", dim=getattr(image_embedder, "dim", IMAGE_DIM), ddl=IMAGE_DDL)
        self.lock = f"{store_root}/kb_{kb.name}.lock"

    def disk(self) -> DataFrame:
        """One file more than max_files is listed, so that a cut listing shows."""
        most = None if self.kb.max_files is None else self.kb.max_files + 1
        return scan(self.spark, self.kb.root, patterns=list(self.kb.patterns), path_filter=self.kb.path_filter, max_bytes=self.kb.max_file_bytes, max_files=most)

    def warm_up(self) -> bool:
        """One tiny request, so that the model is loaded when the work begins; its failure stops nothing."""
        if not self.performance["warmup_on_index"]:
            return False
        try:
            self.embedder.embed(["warm up"])
            return True
        except Exception:  # the run itself will tell
            return False

    def records(self, documents: DataFrame) -> DataFrame:
        """The chunk table's rows of parsed documents."""
        about = documents.select("path", "mtime_ns", record_metadata().alias("metadata"))
        rows = chunk_documents(documents).join(about, "path")
        return rows.withColumn("vector", embed_column(self.embedder, "text", self.performance["embed_batch_size"])).withColumn("model", F.lit(self.kb.embed_model))

    def page_images(self, documents: DataFrame) -> DataFrame:
        """The image table's rows of parsed documents: a row for each page that has an image."""
        return page_records(documents, embed_column(self.image_embedder, "image", self.performance["image_batch_size"]), self.kb.extra.get("image_model", ""))

    def index(self, *, force: bool = False, prune: bool = True) -> dict:
        """Bring the tables up to date; a report of counts, seconds and the first errors.

        A file that fails to parse keeps what is indexed of it. One that now has no chunks ends
        up empty. Pruning is skipped if the listing was cut at max_files: what is missing from it
        may well be there. That page images fail to embed stops nothing and is reported.
        """
        began = time.time()
        with locked(self.spark, self.lock):
            warm = self.warm_up()
            listed = self.disk().persist()  # one listing for all that follows
            most = self.kb.max_files
            cut = most is not None and listed.count() > most
            names = listed.orderBy("path").limit(most) if cut else listed  # names alone are ranked; contents follow
            wanted = changed(names, self.store.mtimes(), force=force)
            documents = parse(contents(wanted, self.kb.root), see=self.see, parsers=self.parsers).persist()
            images_error = None
            try:
                errors = failures(documents)
                good = documents.where("doc_type <> 'error'")
                n_good, failed = good.count(), errors.limit(10).collect()
                done = self.store.upsert(self.records(good), touched=good) if n_good else {"inserted": 0, "deleted_paths": 0, "deleted_rows": 0}
                n_failed = errors.count() if failed else 0
                n_images = 0
                if self.image_embedder and n_good:
                    try:
                        n_images = self.images.upsert(self.page_images(good), touched=good)["inserted"]
                    except Exception as e:
                        images_error = f"{type(e).__name__}: {e}"[:300]
            finally:
                documents.unpersist()
            pruned = self.store.prune(names) if prune and not cut and self.store.version() is not None else 0
            if pruned and self.images.version() is not None:
                self.images.prune(names)
            optimized, n_names = self.store.optimize(), names.count()
            listed.unpersist()
            return {
                "files_indexed": n_good,
                "files_failed": n_failed,
                "files_skipped": n_names - n_good - n_failed,
                "chunks_inserted": done["inserted"],
                "images_inserted": n_images,
                "images_error": images_error,
                "deleted_paths": done["deleted_paths"],
                "deleted_rows": done["deleted_rows"],
                "files_pruned": pruned,
                "prune_skipped_truncated": bool(prune and cut),
                "warmed_up": warm,
                "optimized": optimized,
                "elapsed_s": round(time.time() - began, 3),
                "errors": [{"path": r["path"], "error": r["error"]} for r in failed],
            }

    def freshness(self) -> dict:
        """Counts by status, and the first 20 modified or new paths."""
        rows = freshness(self.disk().select("path", "mtime_ns"), self.store.mtimes())
        counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
        stale = rows.where("status in ('modified', 'new')").orderBy(F.col("status"), "path").limit(20)
        return {
            **{k: counts.get(k, 0) for k in ("new", "modified", "older", "deleted", "fresh")},
            "is_fresh": not any(counts.get(k, 0) for k in ("new", "modified", "deleted")),
            "stale_files": [r["path"] for r in stale.collect()],
            "last_index_time": str(self.store.last_indexed()),
        }


def page_records(documents: DataFrame, vector, model: str = "", longest: int = 500) -> DataFrame:
    """Page-image rows of documents: image_id path:page_<n>, the page's first characters, its vector.

    A page without an image has no row.
    """
    pages = documents.where("doc_type = 'pdf'").select("path", "mtime_ns", F.explode("pages").alias("p")).where("p.image is not null")
    rows = pages.select("path", "mtime_ns", F.col("p.number").alias("page_num"), F.substring("p.content", 1, longest).alias("description"), F.col("p.image").alias("image"))
    return rows.select(
        "path",
        F.format_string("%s:page_%03d", "path", "page_num").alias("image_id"),
        "page_num",
        "description",
        F.lit("pdf_page").alias("doc_type"),
        "mtime_ns",
        F.lit(model).alias("model"),
        F.lit("{}").alias("metadata"),
        vector.alias("vector"),
    )
