import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corvella.operators import grams, keyword

DDL = "path string, chunk_id string, text string"


def test_counts_by_brute_force():
    rng = random.Random(1)
    for letters in ("ab", "abcdefgh é中\x00\U0001f600", [chr(c) for c in range(0x20, 0xD000)]):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(60)]
        got = {}
        for spelled, begins, number, times in grams.counts(texts, list(range(60)), (2, 3, 4)):
            raw, at = grams.packed(times, begins)
            for i, g in enumerate(spelled):
                assert np.array_equal(grams.unpacked(raw[at[i] : at[i + 1]]), times[begins[i] : begins[i + 1]])
                got |= {(g, d): n for d, n in zip(number[begins[i] : begins[i + 1]].tolist(), times[begins[i] : begins[i + 1]].tolist(), strict=True)}
        assert got == {(g, d): n for d, t in enumerate(texts) for g, n in Counter(t[i : i + k] for k in (2, 3, 4) for i in range(len(t) - k + 1)).items()}
    assert [x[0] for x in grams.counts(["", ""], [0, 1], (2, 3))] == [[], []]
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40])
    assert (grams.unpacked(grams.packed(values, np.array([0, 7]))[0]) == values).all()


def test_a_task_holds_a_block_at_a_time():
    """Postings of a batch come before all of it is read; a name's rows stay together only if asked."""
    rows = pa.table({"path": [str(i // 3) for i in range(300)], "chunk_id": ["c"] * 300, "text": ["x" * 99 + "y"] * 300})
    sizes = [len(texts) for _, texts, _ in grams.blocks(rows.to_batches(), most=1000)]
    assert sum(sizes) == 300 and max(sizes) == 10
    for _, texts, numbers in grams.blocks(rows.to_batches(), same=True, most=1000):
        assert numbers == [i // 3 for i in range(len(texts))] and len(texts) in (12, 300 % 12)


def test_index_of_repeated_names(spark, tmp_path):
    """Rows of one name are ranked as a scan ranks them, equal ones too."""
    rows = spark.createDataFrame([("a", "1", "river river"), ("a", "1", "a river"), ("a", "1", "a river"), ("b", "1", "rivers of rivers"), ("c", "1", None)], DDL)
    index = keyword.KeywordIndex.build(rows, f"file://{tmp_path}/words")
    got, want = (sorted((r["rank"], r.path, r.text, r.bm25) for r in keyword.ranked_terms(rows, ["river"], 4, index=i).collect()) for i in (index, None))
    assert [x[:1] + x[3:] for x in got] == [x[:1] + x[3:] for x in want] and sorted(x[1:] for x in got) == sorted(x[1:] for x in want) and len(got) == 4


def test_totals_of_repeated_names(spark):
    rows = spark.createDataFrame([("a", "1", "abab"), ("a", "1", "ab"), ("b", "1", "AB"), ("b", "2", None)], DDL)
    got = {r.gram: (r.df, r.cf) for r in keyword.gram_totals(rows).collect()}
    assert got == {"ab": (2, 4), "ba": (1, 1), "aba": (1, 1), "bab": (1, 1), "abab": (1, 1)}
    each = keyword.postings(rows).collect()
    assert Counter(r.gram for r in each) == {g: df for g, (df, _) in got.items()} and sum(r.tf for r in each if r.gram == "ab") == 4
