"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, ngram_join, packing, pii, quality, secret_scan, sharding, wavelet
from ._shared import Scratch, crc_mod, table

TOKENIZER = "word_bpe_49k.json"
#: Scores from here on predict label 1.
KEEP_FROM = 0.3


def fold(n: int, out: int):
    """Whether crc32(doc_id) mod n is `out`; a row without doc_id is in no fold."""
    return F.coalesce(crc_mod("doc_id", n) == out, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~fold(5, 0)))
    return quality.scores(docs, model, fold(5, 0)).withColumn("predicted", F.when(F.col("score") >= KEEP_FROM, 1).otherwise(0))


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), tokenizer=TOKENIZER)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    counts = [F.regexp_count("base", F.lit(f"(^|,){k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    spans = F.concat_ws(",", *(F.when(F.col(c) != "", F.col(c)) for c in ("base", "found")))
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), shards=16)


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, Scratch(spark, "op7"), k=20)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER, end_id=1, window=2048)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.where(~fold(4, 2))), fold(4, 2))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    made = (op1_quality, op2_wavelet, op3_secrets, op4_ngram_jaccard, op5_pii, op6_minimax_shards, op7_cross_polytope, op8_decontamination, op9_packing, op10_language)
    return {f.__name__: f for f in made}


#: A text's words as op8 takes them, as a list.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP8 = rf"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) as g, least(len(w), 10) as n
  from b where len(w) > 0),
lengths as (select distinct n from windows),
places as (
  select k, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n),
hits as (
  select a.k, a.i, a.n, x.item_id from places a join d using (k) join windows x on x.n = a.n and x.g = array_to_string(d.w[a.i:a.i + a.n - 1], ' ')),
covered as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hits) group by k),
found as (
  select k, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from hits group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (k) left join found using (k)"""

#: sha256 of the empty text, which hashes no spans.
NOTHING = hashlib.sha256(b"").hexdigest()


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": OP8}
