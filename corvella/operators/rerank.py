"""Reranking, diversity and the shape of results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens


def lexical_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: Jaccard similarity of token sets, to six places."""
    return F.round(jaccard(tokens(query), tokens(text)), 6)


def rerank(candidates: DataFrame, score: Column, k: int, *, by: list[str], recall_order) -> DataFrame:
    """Each group's k best by the reranker's score; ranked_by tells what ordered it.

    A null score is a failed call: its whole group then keeps the recall order and rrf_score.
    """
    group = Window.partitionBy(*by)
    rated = candidates.withColumn("rerank_score", score).withColumn("_failed", F.max(F.col("rerank_score").isNull()).over(group))
    shown = F.when(F.col("_failed"), F.col("rrf_score")).otherwise(F.col("rerank_score"))
    ordered = group.orderBy(F.when(~F.col("_failed"), -F.col("rerank_score")).asc_nulls_last(), *recall_order)
    return (
        rated.withColumn("score", shown)
        .withColumn("ranked_by", F.when(~F.col("_failed"), "rerank").when(F.col("source") == "keyword", "keyword").otherwise("embedding"))
        .withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= k)
        .drop("_failed")
    )


def similarity(a: str, b: str) -> float:
    import re

    x, y = (set(re.findall("[a-z0-9_]{2,}|[一-鿿]", t.lower())) for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def mmr_order(scores: list[float], alike, k: int, weight: float = 0.5) -> list[int]:
    """Places in order of marginal relevance: weight * relevance - (1 - weight) * largest likeness
    to what is chosen. Relevance is the score stretched to [0, 1], or 0.5 if all are equal; ties go
    to the earlier place. `alike(i, j)` is called once for each new choice and remaining place."""
    weight = min(1.0, max(0.0, weight))
    low, span = min(scores, default=0.0), max(scores, default=0.0) - min(scores, default=0.0)
    relevance = [(s - low) / span if span > 1e-9 else 0.5 for s in scores]
    nearest, left, chosen = [0.0] * len(scores), list(range(len(scores))), []
    while left and len(chosen) < k:
        pick = max(left, key=lambda i: (weight * relevance[i] - (1 - weight) * nearest[i], -i))
        left.remove(pick)
        chosen.append(pick)
        for i in left:
            nearest[i] = max(nearest[i], alike(pick, i))
    return chosen


def mmr(results: DataFrame, k: int = 8, *, weight: float = 0.5, by: str = "query_id", score: str = "score") -> DataFrame:
    """Diversified results: of each group's 2k first (by rank) the k of largest marginal relevance, renumbered.

    Likeness is the cosine of vectors if rows have them, else the Jaccard similarity of tokens.
    """
    pool = results.where(F.col("rank") <= 2 * k)

    def reorder(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        vectors = list(pdf["vector"]) if "vector" in pdf else [None] * len(pdf)

        def alike(i, j):
            a, b = vectors[i], vectors[j]
            if a is None or b is None:
                return similarity(pdf["text"][i], pdf["text"][j])
            norm = float(np.linalg.norm(a) * np.linalg.norm(b))
            return min(1.0, max(0.0, float(np.dot(a, b)) / norm)) if norm and len(a) == len(b) else 0.0

        out = pdf.iloc[mmr_order(pdf[score].astype(float).tolist(), alike, k, weight)].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return pool.groupBy(by).applyInPandas(reorder, pool.schema)


def explain() -> Column:
    """What went into a row's place, as a map without nulls."""
    parts = {"source": "source", "ranked_by": "ranked_by", "semantic_score": "rrf_semantic", "keyword_score": "rrf_keyword", "rrf_score": "rrf_score", "rerank_score": "rerank_score"}
    return F.map_filter(F.create_map(*(x for k, c in parts.items() for x in (F.lit(k), F.col(c).cast("string")))), lambda _, v: v.isNotNull())


def agent_text() -> Column:
    """A result for an agent to read: place, title, path, score, and the indented text."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("    "), line)), "\n")
    head = F.format_string("[%d] %s > %s (score=%.4f, %s)", F.col("rank"), F.coalesce("section_title", F.lit("")), F.col("path"), F.col("score"), F.col("ranked_by"))
    return F.concat(head, F.lit("\n"), body)


def for_agent(results: DataFrame) -> str:
    """All results as one text."""
    rows = results.orderBy("rank").select(agent_text().alias("t")).collect()
    return "\n\n".join(r["t"] for r in rows) or "(no results)"


def as_json(results: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in results.orderBy("rank").collect()], ensure_ascii=False, default=str)
