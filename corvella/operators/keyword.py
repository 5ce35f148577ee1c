"""Keyword search: BM25 over character n-grams of two to four, with a literal fallback.

Definition: text and query are lower-cased; a row's length is its number of n-grams; idf is
ln(1 + (N - df + 0.5) / (df + 0.5)), k1 1.2, b 0.75. N, df and the mean length are the corpus's;
path filters apply to what is ranked. Only the query's n-grams are counted, in one scan.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_key
from ..session import spread
from .grams import blocks, counts, packed, unpacked

GRAMS, K1, B = (2, 3, 4), 1.2, 0.75
MOST_TERMS = 5


def grams(query: str) -> list[str]:
    """The query's distinct n-grams in order of length and place."""
    q = query.lower()
    return list(dict.fromkeys(q[i : i + n] for n in GRAMS for i in range(len(q) - n + 1)))


def terms(query: str, most: int = MOST_TERMS) -> list[str]:
    """White-space parts of two characters or more, the first `most`; without any, the query."""
    return [t for t in query.split() if len(t) >= 2][:most] or [query]


def occurrences(text: Column, gram: str) -> Column:
    """How often a gram stands in a text, overlaps included.

    A gram whose beginning is not also its end cannot overlap itself: what taking it out shortens
    the text by tells its number, without a pattern tried at every place.
    """
    if not any(gram.startswith(gram[-n:]) for n in range(1, len(gram))):
        return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(gram), F.lit("")))) / len(gram.encode()))
    return F.regexp_count(text, F.lit("(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in gram) + ")"))


def gram_length(text: Column) -> Column:
    return sum((F.greatest(F.length(text) - (n - 1), F.lit(0)) for n in GRAMS), F.lit(0))


def statistics(chunks: DataFrame, wanted: list[str]) -> dict:
    """N, mean length and each gram's document frequency: one row, one scan."""
    low = F.lower("text")
    row = chunks.agg(F.count("*").alias("n"), F.avg(gram_length(low)).alias("mean"), *(F.count(F.when(low.contains(g), 1)).alias(f"g{i}") for i, g in enumerate(wanted))).first()
    return {"n": row["n"], "mean": row["mean"] or 1.0, "df": {g: row[f"g{i}"] for i, g in enumerate(wanted)}}


def bm25(query: str, found: dict, tf=None, length: Column | None = None) -> Column:
    """A row's score for one query, given the corpus's statistics; of its text, or of what an index
    says: tf(gram), a column, and its length."""
    low = F.lower("text")
    norm = K1 * (1 - B + B * (gram_length(low) if length is None else length).cast("double") / F.lit(float(found["mean"])))
    total = F.lit(0.0)
    for g in grams(query):
        df, n = float(found["df"][g]), (tf(g) if tf else occurrences(low, g)).cast("double")
        total = total + F.log(F.lit(1 + (found["n"] - df + 0.5) / (df + 0.5))) * n * (K1 + 1) / (n + norm)
    return total


def ranked_terms(chunks: DataFrame, asked: list[str], k: int, *, path_filter: str | None = None, ties=("path", "chunk_id"), literal_only: bool = False, index: KeywordIndex | None = None) -> DataFrame:
    """term_pos, rank, bm25 and the row, for the k best rows of each term.

    A term without any row of positive score takes, in order of the ties, rows that contain it.
    With an index of the rows, only the postings of the query's n-grams are read, and of the rows
    only the best; a term that the index does not know is looked for in all rows.
    """
    by_term = Window.partitionBy("term_pos")
    if index is not None and not literal_only:
        best = index.top(asked, k, path_filter=path_filter)
        found = best.collect()  # k rows a term at most
        known = {r["term_pos"] for r in found}
        paths = sorted({r["path"] for r in found})
        # rows of one name are told apart by their texts, equal ones by number
        same = [*KEY, "digest"]
        there = chunks.where(F.col("path").isin(paths)).withColumn("digest", F.xxhash64("text"))
        there = there.withColumn("_same", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
        ranked = index.spark.createDataFrame(found, best.schema).withColumn("_same", F.row_number().over(Window.partitionBy("term_pos", *same).orderBy("rank")))
        top = there.join(F.broadcast(ranked), [*same, "_same"]).drop("digest", "_same")
        missing = [i for i in range(len(asked)) if i not in known]
        if not missing:
            return top
        rest = ranked_terms(chunks, [asked[i] for i in missing], k, path_filter=path_filter, ties=ties, literal_only=True)
        place = F.element_at(F.array(*map(F.lit, missing)), F.col("term_pos") + 1)
        return top.unionByName(rest.withColumn("term_pos", place))
    chunks = spread(chunks)
    found = statistics(chunks, list(dict.fromkeys(g for t in asked for g in grams(t))))
    rows = chunks.where(F.col("path").contains(path_filter)) if path_filter else chunks
    each = F.array(*(F.struct(F.lit(i).alias("term_pos"), (F.lit(0.0) if literal_only else bm25(t, found)).alias("bm25"), F.col("text").contains(t).alias("literal")) for i, t in enumerate(asked)))
    scored = rows.withColumn("_t", F.explode(each)).select("*", "_t.*").drop("_t").withColumn("tier", F.when(F.col("bm25") > 0, 0).when(F.col("literal"), 1)).where("tier is not null")
    top = scored.withColumn("rank", F.row_number().over(by_term.orderBy("tier", F.desc("bm25"), *ties))).where(F.col("rank") <= k)
    return top.withColumn("_best", F.min("tier").over(by_term)).where(F.col("tier") == F.col("_best")).drop("tier", "_best", "literal")


#: What names a chunk.
KEY = ("path", "chunk_id")


class KeywordIndex:
    """Stored postings of a chunk table's n-grams, and what BM25 must know of the corpus.

    `blocks` holds what a task made of a million characters at a time: for each n-gram of the
    block a row of its number of chunks, their places in the block as packed differences, and how often
    each holds it; and for each chunk a row (its gram is empty) of place, name and length. A block's
    grams are in order, so a query reads the pages that its own n-grams stand in. Postings are not
    shuffled. `totals` is one row. Scores are those of a scan to the last bit: terms are added up in
    the same order.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        totals = spark.read.parquet(f"{self.path}/totals").first()
        self.n, self.mean = totals["n"], totals["mean"] or 1.0

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> KeywordIndex:
        """Postings of every chunk, from one reading of the texts."""
        spark = chunks.sparkSession
        low = F.lower("text")
        rows = spread(chunks.select(*KEY, "text")).select(*KEY, low.alias("text"), gram_length(low).cast("long"), F.xxhash64("text"))
        rows.mapInArrow(indexed, BLOCKS_DDL).write.mode("overwrite").parquet(f"{path}/blocks")
        named = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/blocks").where("gram = ''")
        named.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")
        return cls(spark, path)

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS_DDL).parquet(f"{self.path}/blocks")

    def statistics(self, wanted: list[str]) -> dict:
        rows = self.blocks.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("df").alias("df")) if wanted else None
        df = {r["gram"]: r["df"] for r in rows.collect()} if wanted else {}
        return {"n": self.n, "mean": self.mean, "df": {g: df.get(g, 0) for g in wanted}}

    def top(self, asked: list[str], k: int, *, path_filter: str | None = None) -> DataFrame:
        """term_pos, path, chunk_id, digest, bm25 and rank of each term's k best chunks."""
        wanted = list(dict.fromkeys(g for t in asked for g in grams(t)))
        found = self.statistics(wanted)
        rows = self.blocks.where(F.col("gram").isin(wanted)).select("gram", "block", "places", "times").mapInArrow(opened, "gram string, block string, place int, tf long")
        times = {g: f"t{i}" for i, g in enumerate(wanted)}
        met = rows.groupBy("block", "place").agg(*(F.coalesce(F.sum(F.when(F.col("gram") == g, F.col("tf"))), F.lit(0)).alias(c) for g, c in times.items())) if wanted else rows
        named = self.blocks.where("gram = ''").select("block", "place", *KEY, "dl", "digest")
        met = met.join(named.where(F.col("path").contains(path_filter)) if path_filter else named, ["block", "place"])
        each = F.array(*(F.struct(F.lit(i).alias("term_pos"), bm25(t, found, lambda g: F.col(times[g]), F.col("dl")).alias("bm25")) for i, t in enumerate(asked)))
        scored = met.select(*KEY, "digest", F.explode(each).alias("_t")).select("_t.*", *KEY, "digest").where("bm25 > 0")
        order = Window.partitionBy("term_pos").orderBy(F.desc("bm25"), *KEY)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


BLOCKS_DDL = "gram string, block string, df int, places binary, times binary, place int, path string, chunk_id string, dl long, digest long"
BLOCKS = pa.schema([("gram", pa.string()), ("block", pa.string()), ("df", pa.int32()), ("places", pa.binary()), ("times", pa.binary()), ("place", pa.int32()), ("path", pa.string()), ("chunk_id", pa.string()), ("dl", pa.int64()), ("digest", pa.int64())])
#: Rows of a batch that a task gives back.
ROWS = 1 << 14


def indexed(batches):
    """Rows of BLOCKS of the chunks (path, chunk_id, lower-cased text, length, digest)."""
    for rows, texts, numbers in blocks(batches):
        name = uuid.uuid4().hex
        yield _rows(BLOCKS, len(rows), gram=[""] * len(rows), block=[name] * len(rows), place=numbers, **dict(zip(("path", "chunk_id", "dl", "digest"), zip(*rows, strict=True), strict=True)))
        for spelled, begins, number, times in counts(texts, numbers, GRAMS):
            step = np.diff(number, prepend=0)
            step[begins[:-1]] = number[begins[:-1]]
            (places, at), (often, of) = packed(step, begins), packed(times, begins)
            for i in range(0, len(spelled), ROWS):
                e = min(i + ROWS, len(spelled))
                yield _rows(
                    BLOCKS, e - i, gram=spelled[i:e], block=[name] * (e - i), df=np.diff(begins[i : e + 1]),
                    places=[places[a:z] for a, z in zip(at[i:e], at[i + 1 : e + 1], strict=True)], times=[often[a:z] for a, z in zip(of[i:e], of[i + 1 : e + 1], strict=True)],
                )


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of the columns given, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def opened(batches):
    """gram, block, place, tf of rows of gram, block, places, times."""
    schema = pa.schema([("gram", pa.string()), ("block", pa.string()), ("place", pa.int32()), ("tf", pa.int64())])
    for b in batches:
        for gram, block, places, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
            place = np.cumsum(unpacked(places))
            yield _rows(schema, len(place), gram=[gram] * len(place), block=[block] * len(place), place=place, tf=unpacked(times))


def keyword_search(chunks: DataFrame, query: str, k: int, **how) -> DataFrame:
    """The k best rows for the query as one term."""
    return ranked_terms(chunks, [query], k, **how).drop("term_pos")


def keyword_recall(chunks: DataFrame, query: str, k: int = 24, **how) -> DataFrame:
    """Rows by term, then rank within it, each once; kw_rank numbers them."""
    rows = ranked_terms(chunks, terms(query), k, **how).withColumn("dedup", dedup_key(F.col("path"), F.col("chunk_id"), F.col("text")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("dedup").orderBy("term_pos", "rank"))).where("_n = 1")
    # at most MOST_TERMS * k rows are left
    return first.withColumn("kw_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term_pos", "rank"))).drop("_n")


def postings(chunks: DataFrame) -> DataFrame:
    """(gram, path, chunk_id, tf): the n-gram index, for many queries over one corpus; in time linear in a chunk's length."""
    schema = pa.schema([("gram", pa.string()), ("path", pa.string()), ("chunk_id", pa.string()), ("tf", pa.int64())])

    def run(batches):
        for rows, texts, numbers in blocks(batches):
            for spelled, begins, number, times in counts(texts, numbers, GRAMS):
                gram = np.repeat(np.arange(len(spelled)), np.diff(begins))
                for i in range(0, len(gram), ROWS):
                    own = [rows[d] for d in number[i : i + ROWS]]
                    yield _rows(schema, len(own), gram=[spelled[g] for g in gram[i : i + ROWS]], path=[r[0] for r in own], chunk_id=[r[1] for r in own], tf=times[i : i + ROWS])

    each = spread(chunks.select(*KEY, F.lower("text").alias("text"))).mapInArrow(run, "gram string, path string, chunk_id string, tf long")
    return each.groupBy("gram", *KEY).agg(F.sum("tf").alias("tf"))


def gram_totals(chunks: DataFrame) -> DataFrame:
    """gram, df and cf: what `postings` come to for each n-gram. Postings are not shuffled: the texts are,
    as rows of one path and chunk_id are one chunk, and then each block's sums."""
    schema = pa.schema([("gram", pa.string()), ("df", pa.int64()), ("cf", pa.int64())])

    def run(batches):
        for _, texts, numbers in blocks(batches, same=True):
            for spelled, begins, _, times in counts(texts, numbers, GRAMS):
                cf = np.add.reduceat(times, begins[:-1]) if len(times) else times
                for i in range(0, len(spelled), ROWS):
                    e = min(i + ROWS, len(spelled))
                    yield _rows(schema, e - i, gram=spelled[i:e], df=np.diff(begins[i : e + 1]), cf=cf[i:e])

    met = chunks.select(*KEY, F.lower("text").alias("text")).repartition(*KEY).sortWithinPartitions(*KEY)
    return met.mapInArrow(run, "gram string, df long, cf long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
