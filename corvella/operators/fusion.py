"""Reciprocal rank fusion, query weights, deduplication and merging of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60

# What marks a query as asking for a fact, as quoting, and as a question.
FACT = r"\d{4}\s*年|\d{1,2}\s*月|\d+\s*[%％]|(?<![\p{L}\p{N}_])\d{2,}(?![\p{L}\p{N}_])|[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)+"
QUOTE = "[\"'“”‘’「」『』]"
QUESTION = "什么是|如何|为什么|怎么|怎样|哪些|解释|介绍|区别|原理|定义|谈谈|分析"
CJK = "[一-鿿]"
PRONOUNS = ("它", "他", "她", "这个", "那个", "这些", "那些", "其", "该")
PHRASE_ENDS = r"(?U)[，。！？；：、,.!?;:\s]+"


def is_fact(query: Column) -> Column:
    return query.rlike("(?U)" + FACT)


def is_question(query: Column) -> Column:
    return query.rlike(QUESTION)


def query_units(query: Column) -> Column:
    """The larger of the numbers of CJK characters and of white-space parts."""
    parts = F.filter(F.split(query, r"(?U)\s+"), lambda x: x != "")
    return F.greatest(F.regexp_count(query, F.lit(CJK)), F.size(parts))


def semantic_weight(query: Column) -> Column:
    """The semantic list's weight; the keyword list's is 1 less it."""
    n = query_units(query)
    return F.when(is_fact(query) | query.rlike(QUOTE), 0.2).when(is_question(query), 0.6).when(n < 5, 0.4).when(n > 15, 0.7).otherwise(0.5)


def route(query: Column) -> Column:
    return F.when(is_fact(query) & ~is_question(query), "keyword").when(is_question(query) & ~is_fact(query), "semantic").otherwise("hybrid")


def disambiguated(query: Column, context: Column) -> Column:
    """The query behind the context's last phrase, if it has a pronoun or is under three characters."""
    blank = F.coalesce(F.regexp_replace(context, r"(?U)\s+", ""), F.lit("")) == ""
    phrases = F.filter(F.split(context, PHRASE_ENDS), lambda p: F.length(p) > 1)
    bare = F.regexp_replace(context, r"(?U)^\s+|\s+$", "")
    last = F.when(F.size(phrases) > 0, F.element_at(phrases, -1)).otherwise(bare)
    return F.when(blank, query).when(query.rlike("|".join(PRONOUNS)) | (F.length(query) < 3), F.trim(F.concat(last, F.lit(" "), query))).otherwise(query)


def rrf(semantic: DataFrame, keyword: DataFrame, keys: list[str], weight: Column, payload: list[str]) -> DataFrame:
    """Fuse two ranked lists: keys, payload (the semantic row's where both have it), sem_rank, kw_rank,
    rrf_semantic, rrf_keyword, rrf_score, source.

    Lists are deduplicated and hold their ranks from 1 in sem_rank and kw_rank.
    """
    s = semantic.select(*keys, "sem_rank", *(F.col(c).alias(f"_s_{c}") for c in payload))
    k = keyword.select(*keys, "kw_rank", *(F.col(c).alias(f"_k_{c}") for c in payload))
    both = s.join(k, keys, "full_outer")
    part = {n: F.coalesce(1 / (RRF_K + F.col(f"{n}_rank")), F.lit(0.0)) for n in ("sem", "kw")}
    return both.select(
        *keys,
        *(F.when(F.col("sem_rank").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(f"_k_{c}")).alias(c) for c in payload),
        "sem_rank",
        "kw_rank",
        part["sem"].alias("rrf_semantic"),
        part["kw"].alias("rrf_keyword"),
        (weight * part["sem"] + (1 - weight) * part["kw"]).alias("rrf_score"),
        F.when(F.col("sem_rank").isNull(), "keyword").when(F.col("kw_rank").isNull(), "semantic").otherwise("hybrid").alias("source"),
    )


def order() -> tuple[Column, ...]:
    """Of fused rows: score, then the place in the semantic, then in the keyword list."""
    return F.desc("rrf_score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank")


def top(rows: DataFrame, k: int, order_by, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The k first rows in order, of each group if `by` is given, numbered from 1."""
    if by is None:
        rows, by = rows.orderBy(*order_by).limit(k), [F.lit(0)]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))).where(F.col(name) <= k)


def keep_first(rows: DataFrame, key: list[str], order) -> DataFrame:
    """The first row of each key in order; ties must be broken by it."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_queries(rows: DataFrame, key: list[str], score: str, position: str) -> DataFrame:
    """Of several queries' results, the best-scored row of each key; the earlier query's on a tie."""
    return keep_first(rows, key, [F.desc(score), F.col(position)])


def union_corpora(parts: dict[str, DataFrame], k: int, order) -> DataFrame:
    """The k best over several corpora, tagged with kb."""
    whole = None
    for name, rows in sorted(parts.items()):
        tagged = rows.withColumn("kb", F.lit(name))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    return top(whole, k, order)
