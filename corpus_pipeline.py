"""A corpus pipeline over `documents`: quality, near copies, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import decontam, ngram_join, packing, pii, quality
from corvella.llm._shared import Scratch, free, table
from corvella.llm.queries import KEEP_FROM, TOKENIZER, fold


def measured(docs: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~fold(5, 0)))
    score = free(docs, "_quality")
    return quality.score(docs, model, column=score).where(F.col(score) >= KEEP_FROM).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs, Scratch(spark, "copies"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return measured(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return measured(pii.redact(docs, Scratch(spark, "pii")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    # workers go on to other stages: they keep few words' ids
    return packing.pack(docs, tokenizer=TOKENIZER, with_ids=True, remembered=100_000)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", no_benchmark),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: SQL can train neither classifier nor tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written below the shared folder and reread by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
