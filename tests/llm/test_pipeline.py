"""The corpus pipeline: every stage against what planted rows must become, and the whole against the stages."""

import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from corvella.llm import tokenise  # noqa: E402

WORDS = ["river", "stone", "cloud", "meadow", "quiet", "morning", "garden", "window", "letter", "harbour", "lantern", "orchard"]
DDL = "doc_id long, text string, lang string, source string, n_chars int, _t string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf_dir with documents, labels and benchmark; and the texts by what they are."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ed"]) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY!!", "$$$", "%%%", "###"]) + rng.choice("QWZ") for _ in range(n))
    item = "what is the boiling point of water at the top of the highest mountain on earth"
    made = {"good": {}, "bad": {}, "copy": {}, "near": {}, "leak": {}, "mostly": {}, "private": {}}
    for i in range(240):
        made["good" if i % 3 else "bad"][i] = prose(70) if i % 3 else junk(70)
    for i in range(20):
        made["copy"][300 + i] = made["good"][1]
        made["near"][400 + i] = f"{prose(1)}{i} {made['good'][2]}"
    made["leak"][500] = f"{prose(40)} {item} {prose(40)}"
    made["mostly"][501] = f"{item} {prose(3)}"
    for i in range(12):
        made["private"][600 + i] = f"{prose(30)} please write to our mail address user{i}@mail.example.com for an answer {prose(30)}"
    made["private"][620] = f"{prose(30)} please write to our mail address jane[at]corp.com for an answer {prose(30)}"
    rows = [(i, t, "en", None, len(t), "own") for part in made.values() for i, t in part.items()] + [(700, None, None, None, None, "own"), (701, "", "en", None, 0, "own")]
    rng.shuffle(rows)
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, DDL).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i in made["good"]), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, made, item


def test_stages(spark, tables):
    at, made, item = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        out.write.parquet(f"{at}/out/{name.replace(' ', '-')}")
        before, docs = docs, spark.read.parquet(f"{at}/out/{name.replace(' ', '-')}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and {r._t for r in docs.select("_t").collect()} == {"own"}
            kept[name] = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert len(kept[name]) == docs.count()
    quality, copies, clean, private = kept.values()
    assert not set(quality) & set(made["bad"]) and set(made["good"]) <= set(quality) and {700, 701} <= set(quality)
    assert all(quality[i][0] == t for part in ("good", "copy", "near", "private") for i, t in made[part].items())
    # of the copies, and of the near copies and what they come from, the smallest id stays
    assert set(copies) == set(quality) - set(made["copy"]) - set(made["near"]) and {1, 2} <= set(copies)
    assert all(copies[i] == quality[i] for i in copies)
    assert set(clean) == set(copies) - {501}
    assert item not in clean[500][0] and clean[500][0].replace("  ", " ") == copies[500][0].replace(item + " ", "") and clean[500][1] == len(clean[500][0])
    assert all(clean[i] == copies[i] for i in clean if i != 500)
    masked = {i: re.sub(r"user\d+@mail.example.com|jane\[at\]corp.com", "[EMAIL]", clean[i][0]) for i in made["private"]}
    assert all(private[i] == (t, len(t)) for i, t in masked.items()) and all(private[i] == clean[i] for i in clean if i not in masked)
    # every id of every text that is left, in order, and its end
    encode, pieces = tokenise.Encoder("word_bpe_49k.json"), {}
    for r in docs.collect():
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in pieces.items()} == {i: [*encode(t).tolist(), 1] for i, (t, _) in private.items()}
    whole = corpus_pipeline.run(spark, at)
    assert whole.columns == docs.columns and whole.groupBy("doc_id").sum("length").orderBy("doc_id").collect() == docs.groupBy("doc_id").sum("length").orderBy("doc_id").collect()


def test_empty_tables(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('none')}"
    for name, ddl in (("documents", DDL), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
