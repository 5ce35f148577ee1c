import json
import random

import pytest
from pyspark.sql import functions as F

from corvella import config
from corvella.indexer import Indexer, Locked, locked
from corvella.operators import keyword
from corvella.providers import HashingEmbedder, post_json
from corvella.retriever import ResultCache, Retriever
from corvella.sources import parse
from corvella.store import ChunkStore, Conflict, freshness, open_store
from corvella.streaming.ingest import ingest_stream


def rows(spark, data):
    return spark.createDataFrame([(p, c, t, [x] * 4, m) for p, c, t, x, m in data], "path string, chunk_id string, text string, vector array<float>, mtime_ns long")


def test_upsert_replaces_by_path(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", dim=4)
    assert store.read().count() == 0
    store.upsert(rows(spark, [("/a", "1", "old", 0.1, 1), ("/b", "1", "keep", 0.2, 1)]))
    assert store.upsert(rows(spark, [("/a", "2", "new", 0.3, 2)])) == {"inserted": 1, "deleted_paths": 1, "deleted_rows": 1}
    assert {(r.path, r.text) for r in store.read().collect()} == {("/a", "new"), ("/b", "keep")}
    assert store.stats()["unique_files"] == 2
    assert store.prune(spark.createDataFrame([("/a",)], "path string")) == 1
    assert store.delete(spark.createDataFrame([("/a",)], "path string")) == 1 and store.read().count() == 0
    store.upsert(rows(spark, [("/a", "1", "x", 0.1, 1)]))
    assert store.optimize(keep_seconds=0)["removed"] > 0 and store.read().count() == 1


def files(tmp_path):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}


def test_upsert_touches_its_own_partitions_only(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", dim=4, partitions=8)
    store.upsert(rows(spark, [(f"/{i}", "1", "old", 0.1, 1) for i in range(60)]))
    before, named = files(tmp_path), store.manifest(store.version())["parts"]
    store.upsert(rows(spark, [("/7", "1", "new", 0.3, 2)]))
    after, now = files(tmp_path), store.manifest(store.version())["parts"]
    assert all(after[f] == t for f, t in before.items()) and len(after) == len(before) + 1
    assert sum(named[k] != now[k] for k in named) == 1
    assert {r.path for r in store.read().where("text = 'new'").collect()} == {"/7"} and store.read().count() == 60


def test_two_writers(spark, tmp_path):
    """Of two that begin from one version the second fails, or tries again on what the first made."""
    a, b = (ChunkStore(spark, f"file://{tmp_path}/t", dim=4) for _ in range(2))
    a.upsert(rows(spark, [("/a", "1", "old", 0.1, 1)]))
    before = a.version()
    made = a._save(a.conform(rows(spark, [("/b", "1", "b", 0.1, 1)])), a.manifest(before), {0})
    assert a._commit(before, made) == before + 1
    with pytest.raises(Conflict):
        b._commit(before, made)
    began, real = [], b.version

    def late():
        began.append(real())
        if len(began) == 1:  # another writer comes between
            a.upsert(rows(spark, [("/c", "1", "c", 0.1, 1)]))
        return began[-1]

    b.version = late
    b.upsert(rows(spark, [("/d", "1", "d", 0.1, 1)]))
    b.version = real
    assert {"/c", "/d"} <= {r.path for r in b.read().collect()}


def test_vector_index_of_a_table(spark, tmp_path):
    rng = random.Random(2)
    store = ChunkStore(spark, f"file://{tmp_path}/t", dim=4, index_from=250)
    data = [(f"/{i}", "1", "t", [rng.gauss(0, 1) for _ in range(4)], 1) for i in range(1200)]
    make = lambda d: spark.createDataFrame(d, "path string, chunk_id string, text string, vector array<float>, mtime_ns long")
    store.upsert(make(data[:240]))
    assert not store.stats()["ann_index"]["built"]
    store.upsert(make(data[:1100]))
    assert store.stats()["ann_index"] == {"built": True, "rows_at_build": 1100}
    store.upsert(make(data[1100:]))  # rows that come later have their cells, too
    assert store.stats()["ann_index"]["rows_at_build"] == 1100 and store.read().where("cell is null").count() == 0
    near = store.near(data[5][3], probes=1)
    assert 0 < near.count() < 1200 and "/5" in {r.path for r in near.collect()}
    assert store.near(data[5][3], probes=2).count() == 1200 and store.read().select("cell").distinct().count() == 2


def test_keyword_index_scores_as_a_scan(spark, tmp_path):
    rng = random.Random(3)
    store = ChunkStore(spark, f"file://{tmp_path}/t", dim=4)
    assert store.words() is None
    data = [(f"/{i % 40}", str(i), " ".join(rng.choice(["aaa", "abab", "River", "stone é", "中文", "th'x"]) for _ in range(rng.randint(0, 20))), 0.1, 1) for i in range(120)]
    store.upsert(rows(spark, data))
    index = store.words()
    assert ChunkStore(spark, f"file://{tmp_path}/t", dim=4).words() is not None and store.words() is index
    for asked in ("river", "aaa abab", "中文 th'x", "nothing"):
        for path in (None, "/3"):
            got, want = ([(r.path, r.chunk_id, r.term_pos, r["rank"], r.bm25) for r in keyword.ranked_terms(store.read(), keyword.terms(asked), 5, path_filter=path, index=i).orderBy("term_pos", "rank").collect()] for i in (index, None))
            assert got == want, (asked, path)
    store.upsert(rows(spark, [("/new", "1", "river river", 0.1, 1)]))
    assert store.words() is not index  # of another version


def test_page_images_and_records(spark, tmp_path):
    """An index run with page images: pages of little text are seen, images are stored and pruned with their file."""
    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.pdf").write_bytes(b"a first page of enough text\fx")
    (root / "b.md").write_text("# B\n\ntext")

    class Images:
        dim = 3

        def embed(self, images):
            return [[float(len(i)), 0.0, 1.0] for i in images]

    def pdf(path, raw, see):
        return parse.of_pages({"title": "T"}, [(t, t.encode()) for t in raw.decode().split("\f")], see) | {"parse_engine": "pdf"}

    made = Indexer(spark, config.KBConfig("p", f"file://{root}", dimensions=8), f"file://{tmp_path}/db", HashingEmbedder(8), see=lambda image, n: f"seen {n}", image_embedder=Images(), parsers=parse.PARSERS | {"pdf": pdf})
    report = made.index()
    assert (report["files_indexed"], report["images_inserted"], report["images_error"], report["warmed_up"]) == (2, 2, None, True)
    assert {(r.page_num, r.description) for r in made.images.read().collect()} == {(1, "a first page of enough text"), (2, "seen 2")}
    about = json.loads(made.store.read().where(F.col("path").contains("a.pdf")).first().metadata)
    assert about["title"] == "T" and about["page_count"] == 2 and about["seen_pages"] == 1 and about["source"] == about["path"]
    (root / "a.pdf").unlink()
    assert made.index()["files_pruned"] == 1 and made.images.read().count() == 0


def test_results_are_kept_until_the_table_moves_on(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", dim=8)
    make = lambda t: rows(spark, [(f"/{i}", "1", f"{t} {i}", 0.1, 1) for i in range(5)]).withColumn("vector", F.array(*[F.lit(0.5)] * 8))
    store.upsert(make("river"))
    cache = ResultCache(f"file://{tmp_path}/cache", store)
    first = cache.retrieve(Retriever(store, HashingEmbedder(8)), "river", use_rerank=False).collect()
    assert cache.retrieve(None, "river", use_rerank=False).collect() == first
    with pytest.raises(AttributeError):
        cache.retrieve(None, "stone", use_rerank=False)
    with pytest.raises(AttributeError):
        ResultCache(f"file://{tmp_path}/cache", store, ttl=-1.0).retrieve(None, "river", use_rerank=False)
    store.upsert(make("stone"))
    with pytest.raises(AttributeError):
        cache.retrieve(None, "river", use_rerank=False)
    stages = {r.stage for r in Retriever(store, HashingEmbedder(8)).trace("stone").collect()}
    assert stages == {"query_processing", "semantic_recall", "keyword_recall", "rrf_fusion", "deduplication", "rerank", "final_results", "total_time_ms"}


def test_streamed_files(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    store = ChunkStore(spark, f"file://{tmp_path}/t", dim=8)
    for n in (1, 2):
        (root / f"{n}.md").write_text(f"# N{n}\n\ntext {n}")
        ingest_stream(spark, f"file://{root}", store, HashingEmbedder(8), f"file://{tmp_path}/check").awaitTermination()
        assert store.read().select("path").distinct().count() == n


def test_dimensions_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="dimension is not 5"):
        ChunkStore(spark, f"file://{tmp_path}/t", dim=5).upsert(rows(spark, [("/a", "1", "x", 0.1, 1)]))
    with pytest.raises(ValueError):
        open_store(spark, str(tmp_path), backend="other")


def test_freshness(spark):
    disk = spark.createDataFrame([("n", 1), ("m", 5), ("o", 1), ("f", 3)], "path string, mtime_ns long")
    index = spark.createDataFrame([("m", 4), ("o", 2), ("f", 3), ("d", 9)], "path string, mtime_ns long")
    assert {r.path: r.status for r in freshness(disk, index).collect()} == {"n": "new", "m": "modified", "o": "older", "f": "fresh", "d": "deleted"}


def test_index_run(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.md").write_text("# Alpha\n\nfirst text")
    (root / "b.md").write_bytes("# 标题\n\n中文内容".encode("gbk"))
    (root / "c.xlsx").write_bytes(b"no sheet")
    indexer = Indexer(spark, config.KBConfig("t", f"file://{root}", dimensions=16), f"file://{tmp_path}/db", HashingEmbedder(16))
    report = indexer.index()
    assert (report["files_indexed"], report["files_failed"]) == (2, 1)
    assert any("中文内容" in r.text for r in indexer.store.read().collect())
    assert indexer.index()["files_indexed"] == 0
    (root / "a.md").unlink()
    assert indexer.freshness()["deleted"] == 1
    assert indexer.index()["files_pruned"] == 1
    assert indexer.store.read().where(F.col("path").contains("a.md")).count() == 0


def test_lock(spark, tmp_path):
    at = f"file://{tmp_path}/lock"
    with locked(spark, at), pytest.raises(Locked), locked(spark, at):
        pass
    import socket

    for held in ('{"host": "%s", "pid": 999999999}' % socket.gethostname(), "nonsense"):
        (tmp_path / "lock").write_text(held)
        (tmp_path / ".lock.crc").unlink(missing_ok=True)
        with locked(spark, at):
            pass
    (tmp_path / "lock").write_text('{"host": "another", "pid": 1}')
    with pytest.raises(Locked), locked(spark, at):
        pass


def test_post_retries_and_gives_up():
    import io
    import urllib.error

    calls, waits = [], []

    def failing(code):
        def opener(request, timeout):
            calls.append(code)
            raise urllib.error.HTTPError("u", code, "x", {}, io.BytesIO())

        return opener

    for code, tries in ((500, 5), (400, 1)):
        calls.clear()
        waits.clear()
        with pytest.raises(RuntimeError):
            post_json("http://x", {}, sleep=waits.append, opener=failing(code))
        assert len(calls) == tries and len(waits) == tries - 1


def test_hashing_embedder_in_both_forms(spark):
    made = HashingEmbedder(16)
    got = spark.createDataFrame([("Some Text",), ("ab",), ("",)], "t string").select(made.column(F.col("t")).alias("v")).collect()
    for r, v in zip(got, made.embed(["Some Text", "ab", ""]), strict=True):
        assert r.v == pytest.approx(v)


def test_registry(tmp_path):
    (tmp_path / "r.yaml").write_text("vector_backend: snapshot\ntext_backend: {embedding: {model: m, dimensions: 8}}\nknowledge_bases: {a: {root: /x, patterns: ['*.md']}}\n")
    (tmp_path / "z.local.yaml").write_text("knowledge_bases: {a: {max_files: 3}}\n")
    kbs, performance = config.load(str(tmp_path / "r.yaml"))
    assert (kbs["a"].dimensions, kbs["a"].max_files, kbs["a"].patterns) == (8, 3, ("*.md",)) and performance["top_k"] == 8
    with pytest.raises(config.UnknownKB):
        config.pick(kbs, "b")
