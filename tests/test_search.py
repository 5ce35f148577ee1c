import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvella.operators import chunk, fusion, keyword, knn, rerank
from corvella.plans import catalogue
from corvella.providers import HashingEmbedder
from corvella.retriever import Retriever

DDL = "path string, chunk_id string, text string, doc_type string, heading_path array<string>, section_title string, metadata string, vector array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(p, c, t, k, [], "", "{}", v) for p, c, t, k, v in rows], DDL)


@pytest.fixture(scope="module")
def sample(spark):
    return frame(spark, [("/docs/facade.md", "c1", "住宅立面 facade design", "text", [0.1] * 8), ("/docs/plan.md", "c2", "户型动线 floor plan", "text", [0.2] * 8), ("/docs/index.md", "c3", "向量索引 vector index", "pdf", [0.3] * 8)]).cache()


class Fixed:
    dim = 8

    def embed(self, texts):
        return [[0.15] * 8 for _ in texts]


def test_nearest_and_filters(spark, sample):
    assert [r.path for r in knn.nearest(sample, [0.2] * 8, 1).collect()] == ["/docs/plan.md"]
    assert [r.path for r in knn.nearest(sample, [0.2] * 8, 3, doc_type="pdf").collect()] == ["/docs/index.md"]
    assert knn.nearest(sample, [0.2] * 8, 3, path_filter="%").count() == 0


def test_batch_equals_single(spark, sample):
    asked = spark.createDataFrame([(1, [0.1] * 8), (2, [0.31] * 8)], "query_id int, vector array<float>")
    got = knn.nearest_each(sample, asked, 2, block=1).orderBy("query_id", "rank").collect()
    for q, v in ((1, [0.1] * 8), (2, [0.31] * 8)):
        one = knn.nearest(sample, v, 2).collect()
        assert [(r.path, r.score) for r in got if r.query_id == q] == [(r.path, r.score) for r in one]


def unit_vectors(n, dim=64):
    x = np.random.default_rng(5).standard_normal((n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_cell_index_finds_what_brute_force_finds(spark, tmp_path):
    """Vectors without structure, at the index's own settings and with all cells read."""
    x = unit_vectors(6000)
    pq.write_table(pa.table({"path": [str(i) for i in range(len(x))], "chunk_id": ["v"] * len(x), "vector": list(x)}), tmp_path / "rows.parquet")
    rows = spark.read.parquet(f"file://{tmp_path}/rows.parquet").repartition(3)
    asked = rows.where("path % 100 = 0").select(F.col("path").cast("long").alias("query_id"), "vector")
    index = knn.CellIndex.build(rows, f"file://{tmp_path}/cells")
    assert len(index.centroids) == 12
    exact = x[::100].astype(float)
    exact = ((exact[:, None] - x[None].astype(float)) ** 2).sum(axis=2).argsort(axis=1, kind="stable")[:, :8]
    want = {(100 * i, str(j)) for i, near in enumerate(exact) for j in near}
    pairs = lambda found: {(r.query_id, r.path) for r in found.collect()}
    assert pairs(index.search_each(spark, asked, 8, probes=12)) == want
    found = index.search_each(spark, asked, 8, block=7)
    assert 0.9 <= len(pairs(found) & want) / len(want) < 1
    assert [r.path for r in index.search(spark, x[100].tolist(), 8).collect()] == [r.path for r in found.where("query_id = 100").orderBy("rank").collect()]
    measured = knn.recall(knn.nearest_each(rows, asked, 8), found).first()
    assert measured.n == len(want) and measured.recall == pytest.approx(len(pairs(found) & want) / len(want))


@pytest.mark.parametrize(("n", "least"), [(100, 1), (500, 1), (3000, 0.9)])
def test_index_query_asks_all_its_vectors(spark, tmp_path, n, least):
    """Of tables without an index, of one cell and of several."""
    x = unit_vectors(n)
    pq.write_table(pa.table({"vec_id": range(n), "embedding": list(x), "label": pa.array([0] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    measured = catalogue.queries()["vector_knn_ivf"](spark, f"file://{tmp_path}").first()
    assert measured.n == 8 * n // 100 and least <= measured.recall <= 1


def test_probes_grow_with_cells():
    probes = [knn.ann_probes(n) for n in range(1, 257)]
    assert probes == sorted(probes) and all(p <= n for n, p in enumerate(probes, 1)) and probes[0] == 1 and probes[-1] >= 128


def test_path_filter_comes_before_ranking(spark):
    noise = [(f"/docs/n{i}.md", "c", "设计方案 设计细节 设计规范", "text", [0.0] * 8) for i in range(300)]
    rows = frame(spark, [*noise, ("/special/t.md", "c", "设计 target", "text", [0.0] * 8)])
    got = keyword.keyword_search(rows, "设计", 5, path_filter="special").collect()
    assert [r.path for r in got] == ["/special/t.md"]


def test_short_terms_fall_back_to_literal_search(spark, sample):
    assert [r.path for r in keyword.keyword_search(sample, "户", 5).collect()] == ["/docs/plan.md"]


def test_overlapping_grams_count(spark):
    rows = spark.createDataFrame([("aaaa",), ("a\\Eb",)], "text string")
    assert [r[0] for r in rows.select(keyword.occurrences(F.col("text"), "aa")).collect()] == [3, 0]
    assert [r[0] for r in rows.select(keyword.occurrences(F.col("text"), "\\E")).collect()] == [0, 1]


def test_hybrid_finds_what_both_lists_have(sample):
    rows = Retriever(sample, Fixed()).retrieve("住宅立面", use_rerank=False).collect()
    assert rows[0].chunk_id == "c1" and rows[0].source == "hybrid"


def test_rerank_and_its_failure(sample):
    good = Retriever(sample, Fixed()).retrieve("facade design").collect()
    assert good[0].ranked_by == "rerank" and good[0].chunk_id == "c1"
    bad = Retriever(sample, Fixed(), score=lambda q, t: F.lit(None).cast("double")).retrieve("facade design").collect()
    assert all(r.ranked_by != "rerank" and r.score == r.rrf_score for r in bad)
    assert [r.score for r in bad] == sorted((r.score for r in bad), reverse=True)


def test_empty_queries_and_unknown_modes_are_errors(sample):
    for q, mode in ((" ", "hybrid"), ("x", "other")):
        with pytest.raises(ValueError):
            Retriever(sample, Fixed()).retrieve(q, mode=mode)


def test_same_id_in_two_paths_stays_two(spark):
    rows = frame(spark, [("/a", "c", "same words here", "text", [0.1] * 8), ("/b", "c", "same words here", "text", [0.1] * 8)])
    assert Retriever(rows, Fixed()).retrieve("same words", use_rerank=False).count() == 2


def test_weights(spark):
    asked = {"2024年报告": 0.2, "如何设计": 0.6, "ab": 0.4, "one two three four five six": 0.5, " ".join(["w"] * 16): 0.7, 'say "x"': 0.2}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", fusion.semantic_weight(F.col("q")).alias("w")).collect()
    assert {r.q: r.w for r in rows} == asked


def test_disambiguation(spark):
    rows = [("它怎么样", "住宅立面，户型设计", "户型设计 它怎么样"), ("long enough", "x y", "long enough"), ("ab", "some phrase", "phrase ab"), ("ab", " ", "ab")]
    df = spark.createDataFrame(rows, "q string, c string, want string")
    assert all(r[0] == r.want for r in df.select(fusion.disambiguated(F.col("q"), F.col("c")), "want").collect())


def test_whole_turns_are_disambiguated(spark, tmp_path):
    """A short turn, one with a pronoun and long ones; turns of others are context only."""
    talk = [("a", 1, "user", "tell me of facades and floor plans"), ("a", 2, "assistant", "which one, the north wall"), ("a", 3, "user", "它怎么样"), ("a", 4, "assistant", "good, very well"), ("a", 5, "user", "ok"), ("a", 7, "user", "a much longer question than three characters"), ("b", 1, "user", "no")]
    pq.write_table(pa.table({c: list(v) for c, v in zip(("conv_id", "turn", "role", "text"), zip(*talk))}), tmp_path / "conversations.parquet")
    got = {(r.conv_id, r.turn): r["query"] for r in catalogue.queries()["query_disambiguate_whole"](spark, f"file://{tmp_path}").collect()}
    assert got == {("a", 1): talk[0][3], ("a", 3): "wall 它怎么样", ("a", 5): "well ok", ("a", 7): talk[5][3], ("b", 1): "no"}


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """A folder with documents of no, one and several chunks, and their texts by path."""
    at = tmp_path_factory.mktemp("documents")
    made = [None, "", "short \u00e9 text", "aaaa", *(" ".join(f"word{i * k % 977}" for i in range(k)) for k in (90, 300, 1200))]
    rows = {"doc_id": range(len(made)), "text": made, "lang": ["en"] * len(made), "source": ["s"] * len(made), "n_chars": [len(t or "") for t in made]}
    pq.write_table(pa.table(rows), at / "documents.parquet")
    return f"file://{at}", {f"s/{i}": t or "" for i, t in enumerate(made)}


def parts(made):
    """(path, chunk_id) and text of every hard-split chunk."""
    return {(p, f"part-{k:04d}"): t[i : i + chunk.MAX_CHARS] for p, t in made.items() for k, i in enumerate(range(0, len(t), chunk.MAX_CHARS))}


def test_every_chunk_gets_its_context(spark, documents):
    folder, made = documents
    want = {}
    for (p, c), t in parts(made).items():
        at = made[p].index(t[:120])
        want[p, c] = hashlib.md5(made[p][max(0, at - 50) : at + len(t) + 50].encode()).hexdigest()
    got = catalogue.queries()["parent_context_all"](spark, folder).collect()
    assert len(got) == len(want) > 6 and {(r.path, r.chunk_id): r.md5 for r in got} == want


def test_postings_of_every_chunk(spark, documents):
    folder, made = documents
    df, cf = Counter(), Counter()
    for t in parts(made).values():
        tf = Counter(t.lower()[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
        cf += tf
        df.update(tf.keys())
    got = catalogue.queries()["ngram_postings_chunks"](spark, folder).collect()
    assert {r.gram: (r.df, r.cf) for r in got} == {g: (df[g], cf[g]) for g in df} and df["aa"] == 1 and cf["aa"] == 3


def test_embedding_of_every_chunk(spark, documents):
    """By the definition: signed hashes of trigrams; and in Catalyst the same."""
    folder, made = documents
    chunks, got = parts(made), catalogue.queries()["embed_hashing_chunks"](spark, folder)
    assert got.count() == len(chunks)
    for r in got.collect():
        t, want = chunks[r.path, r.chunk_id].lower(), np.zeros(64)
        for i in range(max(1, len(t) - 2)):
            h = int(hashlib.md5(t[i : i + 3].encode()).hexdigest()[:8], 16)
            want[h % 64] += (-1) ** (h // 64 % 2)
        np.testing.assert_allclose(r.vector, want / np.linalg.norm(want))
    longest = max(chunks.values(), key=len)
    native = spark.createDataFrame([(longest,)], "t string").select(HashingEmbedder(4).column(F.col("t"))).first()[0]
    np.testing.assert_allclose(native, HashingEmbedder(4).embed([longest])[0])


def test_mmr_brute_force():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(50):
        n = 6
        scores = [rng.random() for _ in range(n)]
        like = {frozenset(p): rng.random() for p in itertools.combinations(range(n), 2)}
        alike = lambda i, j: like[frozenset((i, j))]
        low, span = min(scores), max(scores) - min(scores)
        chosen = []
        while len(chosen) < 4:
            def value(i):
                return 0.5 * (scores[i] - low) / span - 0.5 * max([alike(i, j) for j in chosen], default=0.0)

            chosen.append(max((i for i in range(n) if i not in chosen), key=value))
        assert rerank.mmr_order(scores, alike, 4) == chosen


def test_each_query_of_a_frame(spark):
    rng = random.Random(7)
    data = [(f"/{i}", "1", f"t{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    chunks = spark.createDataFrame(data, "path string, chunk_id string, text string, vector array<float>")
    queries = spark.createDataFrame([(i, data[i][3]) for i in (3, 11)], "query_id long, vector array<float>")
    got = Retriever(chunks).retrieve_each(queries, top_k=3, path_filter="1").collect()
    for q in (3, 11):
        far = lambda v, q=q: sum((a - b) ** 2 for a, b in zip(v, data[q][3], strict=True))
        want = [p for p, *_ in sorted((d for d in data if "1" in d[0]), key=lambda d: far(d[3]))[:3]]
        assert [r.path for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_spread_rows(spark):
    from corvella.session import spread

    small = spark.range(100).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(small).count() == 100
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        assert spread(small).rdd.getNumPartitions() == 1  # large for such cores: it stays where it is
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
