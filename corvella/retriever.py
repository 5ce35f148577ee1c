"""Retrieval: recall, fusion, truncation, rerank, diversity and shape, as one plan a query."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import dedup_key, preview
from .operators import fusion, keyword, knn, rerank
from .providers import INSTRUCTION, Chat, Embedder, expansions, rewrite
from .store import ChunkStore

TOP_K, RECALL, MOST_QUERIES, EXPAND = 8, 24, 3, 500
PAYLOAD = ["path", "chunk_id", "text", "doc_type", "heading_path", "section_title", "metadata"]


class Retriever:
    """Over a chunk table, or over a store, whose indexes then serve. `score` makes the reranker's
    column from a query and a text column."""

    def __init__(self, chunks: DataFrame | ChunkStore, embedder: Embedder | None = None, *, score=rerank.lexical_score, chat: Chat | None = None, instruct: bool = False, prompts: str | None = None):
        self.store = chunks if isinstance(chunks, ChunkStore) else None
        self.chunks = chunks.read() if isinstance(chunks, ChunkStore) else chunks
        self.embedder, self.score, self.chat, self.instruct, self.prompts = embedder, score, chat, instruct, prompts

    def _semantic(self, query: str, k: int, path_filter, doc_type, instruct) -> DataFrame:
        use = self.instruct if instruct is None else instruct
        (vector,) = self.embedder.embed([INSTRUCTION + query if use else query])
        near = knn.nearest(self.store.near(vector) if self.store else self.chunks, vector, k, path_filter=path_filter, doc_type=doc_type).withColumn("dedup", dedup_key(F.col("path"), F.col("chunk_id"), F.col("text")))
        once = fusion.keep_first(near, ["dedup"], [F.col("distance"), F.col("path"), F.col("chunk_id")])
        return fusion.top(once, k, [F.col("distance"), F.col("path"), F.col("chunk_id")], name="sem_rank")

    def _keyword(self, query: str, k: int, path_filter, doc_type) -> DataFrame:
        rows = self.chunks.where(F.col("doc_type") == doc_type) if doc_type else self.chunks
        # an index's statistics are the whole table's: a stricter corpus is scanned
        return keyword.keyword_recall(rows, query, k, path_filter=path_filter, index=self.store.words() if self.store and not doc_type else None)

    def recall(self, query: str, mode: str = "hybrid", *, k: int = RECALL, path_filter: str | None = None, doc_type: str | None = None, strict_filters: bool = False, instruct: bool | None = None) -> DataFrame:
        """Fused candidates. The keyword list ignores doc_type unless filters are strict."""
        have = [c for c in PAYLOAD if c in self.chunks.columns]
        empty = self.chunks.limit(0).withColumn("dedup", F.lit(""))
        semantic = empty.withColumn("sem_rank", F.lit(0)).withColumn("distance", F.lit(0.0)) if mode == "keyword" else self._semantic(query, k, path_filter, doc_type, instruct)
        words = empty.withColumn("kw_rank", F.lit(0)) if mode == "semantic" else self._keyword(query, k, path_filter, doc_type if strict_filters else None)
        weight = F.lit({"semantic": 1.0, "keyword": 0.0}.get(mode)) if mode != "hybrid" else fusion.semantic_weight(F.lit(query))
        rows = fusion.rrf(semantic.withColumn("score", knn.closeness(F.col("distance"))), words.withColumn("score", F.lit(0.0)), ["dedup"], weight, [*have, "score"])
        return rows.withColumn("semantic_weight", weight.cast("double")).withColumn("query", F.lit(query))

    def retrieve(
        self,
        query: str,
        *,
        mode: str = "hybrid",
        top_k: int = TOP_K,
        recall_size: int = RECALL,
        use_rerank: bool = True,
        mmr: bool = False,
        mmr_lambda: float = 0.5,
        use_rewrite: bool = False,
        expand: bool = False,
        context: str = "",
        documents: DataFrame | None = None,
        **filters,
    ) -> DataFrame:
        """Results by rank: payload, score, ranked_by, source, rank, rrf columns and explain.

        `documents` (path, content) adds `context`: what stands around a result in its document.
        """
        if not query or not query.strip():
            raise ValueError("the query is empty")
        if mode not in ("hybrid", "semantic", "keyword"):
            raise ValueError(f"unknown mode: {mode}")
        if context.strip():
            spark = self.chunks.sparkSession
            query = spark.range(1).select(fusion.disambiguated(F.lit(query), F.lit(context))).first()[0]
        asked = [query]
        if use_rewrite or expand:
            made = rewrite(query, self.chat, context, self.prompts)
            asked = expansions(made["rewritten"] if use_rewrite else query, made)[:MOST_QUERIES]
        rows = None
        for i, q in enumerate(asked):
            part = self.recall(q, mode, k=recall_size, **filters).withColumn("query_pos", F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        if len(asked) > 1:
            rows = fusion.merge_queries(rows, ["dedup"], "rrf_score", "query_pos")
        wanted = 2 * top_k if mmr else top_k
        rows = rows.withColumn("query_id", F.lit(0))
        if use_rerank and mode != "keyword":
            few = fusion.top(rows, recall_size, fusion.order(), name="_place").drop("_place")
            out = rerank.rerank(few, self.score(F.lit(query), F.col("text")), wanted, by=["query_id"], recall_order=fusion.order())
        else:
            out = fusion.top(rows, wanted, fusion.order()).withColumn("rerank_score", F.lit(None).cast("double"))
            out = out.withColumn("ranked_by", F.when(F.col("source") == "keyword", "keyword").otherwise("embedding"))
        if mmr:
            out = rerank.mmr(out.withColumn("_by", F.coalesce("rerank_score", "rrf_score")), top_k, weight=mmr_lambda, score="_by").drop("_by")
        if documents is not None:
            out = expanded(out, documents)
        return out.withColumn("explain", rerank.explain())

    def retrieve_each(self, queries: DataFrame, *, top_k: int = TOP_K, path_filter: str | None = None, doc_type: str | None = None) -> DataFrame:
        """Semantic results for a frame of queries (query_id, vector)."""
        return knn.nearest_each(self.chunks, queries, top_k, path_filter=path_filter, doc_type=doc_type)

    def trace(self, query: str, *, top_k: int = TOP_K, use_rerank: bool = True, **how) -> DataFrame:
        """The stages of a retrieval in long form: stage, rank, path, chunk_id, value, preview.

        A stage without rows of its own has one, of rank 1: the query as it was asked, how many
        candidates were left after deduplication, and the milliseconds that all took.
        """
        began = time.perf_counter()
        filters = {k: v for k, v in how.items() if k in ("path_filter", "doc_type", "strict_filters", "instruct")}
        # a recall has two lists of RECALL rows at most
        recall = self.recall(query, how.get("mode", "hybrid"), **filters).select("path", "chunk_id", "sem_rank", "kw_rank", "score", "rrf_score", preview(F.col("text")).alias("preview")).collect()
        final = self.retrieve(query, top_k=top_k, use_rerank=use_rerank, **how).orderBy("rank").select("path", "chunk_id", "score", "rank", preview(F.col("text")).alias("preview")).collect()
        fused = sorted(recall, key=lambda r: (-r["rrf_score"], r["sem_rank"] or len(recall) + 1, r["kw_rank"] or len(recall) + 1))

        def stage(name, rows, rank, value):
            return [(name, rank(r, i), r["path"], r["chunk_id"], value(r), r["preview"]) for i, r in enumerate(rows, 1)]

        def one(name, value, text=None):
            return [(name, 1, None, None, value, text)]

        out = one("query_processing", None, query)
        out += stage("semantic_recall", [r for r in recall if r["sem_rank"]], lambda r, _: r["sem_rank"], lambda r: r["score"])
        out += stage("keyword_recall", [r for r in recall if r["kw_rank"]], lambda r, _: r["kw_rank"], lambda _: None)
        out += stage("rrf_fusion", fused[:RECALL], lambda _, i: i, lambda r: r["rrf_score"])
        out += one("deduplication", float(len(recall)))
        out += stage("rerank", final, lambda r, _: r["rank"], lambda r: r["score"]) if use_rerank and how.get("mode") != "keyword" else []
        out += stage("final_results", final, lambda r, _: r["rank"], lambda r: r["score"])
        out += one("total_time_ms", (time.perf_counter() - began) * 1000)
        return self.chunks.sparkSession.createDataFrame(out, "stage string, rank int, path string, chunk_id string, value double, preview string")


class ResultCache:
    """Results of retrievals, as Parquet below `folder`: kept while the store stays at its version, and
    for `ttl` seconds at most. A failing cache is no cache."""

    def __init__(self, folder: str, store: ChunkStore, *, name: str = "", ttl: float = 3600.0):
        self.folder, self.store, self.name, self.ttl = folder.rstrip("/"), store, name, ttl

    def key(self, query: str, **how) -> str:
        return hashlib.sha256(json.dumps([self.name, query, sorted(how.items())], default=str).encode()).hexdigest()

    def retrieve(self, retriever: Retriever, query: str, **how) -> DataFrame:
        """As the retriever's, from the cache if it is there and fresh."""
        spark = self.store.spark
        at = f"{self.folder}/{self.key(query, **how)}-{self.store.version()}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 <= self.ttl:
            return spark.read.parquet(at)
        rows = retriever.retrieve(query, **how)
        try:
            rows.coalesce(1).write.mode("overwrite").parquet(at)  # top_k rows
            return spark.read.parquet(at)
        except Exception:
            return rows


def retrieve(spark: SparkSession, kb: str, query: str, *, registry: str, db: str, embedder: Embedder, **how) -> DataFrame:
    """Results of one registered knowledge base, by its name."""
    from . import config
    from .store import open_store

    found = config.pick(config.load(registry)[0], kb)
    store = open_store(spark, f"{db}/kb_{found.name}", backend=found.vector_backend, dim=embedder.dim)
    return Retriever(store, embedder).retrieve(query, **how)


def expanded(results: DataFrame, documents: DataFrame, around: int = EXPAND, anchor: int = 120) -> DataFrame:
    """`context`: the chunk with `around` characters of its document on each side, found by its beginning."""
    joined = results.join(documents.select("path", F.col("content").alias("_doc")), "path", "left")
    at = F.expr(f"locate(substring(text, 1, {anchor}), _doc)")
    start = F.greatest(F.lit(1), at - around)
    return joined.withColumn("context", F.when(at > 0, F.substr(F.col("_doc"), start, (at - start) + F.length("text") + around)).otherwise(F.col("text"))).drop("_doc")


def multi_query(retrieve_fn, queries: list[str], k: int, most: int = MOST_QUERIES, key_chars: int = 100) -> DataFrame:
    """Results of several distinct queries one after the other, each path and beginning of text once."""
    out = None
    for i, q in enumerate(list(dict.fromkeys(queries))[:most]):
        part = retrieve_fn(q).withColumn("query_pos", F.lit(i))
        out = part if out is None else out.unionByName(part)
    first = fusion.keep_first(out.withColumn("_key", F.concat("path", F.substring("text", 1, key_chars))), ["_key"], [F.col("query_pos"), F.col("rank")]).drop("_key")
    return fusion.top(first, k, [F.col("query_pos"), F.col("rank")], name="place")
