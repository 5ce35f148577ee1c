import glob
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_against_duckdb(spark):
    """A few queries of each kind against their SQL; the rest run in the driver's comparison."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    sql = entry.oracle_sql()
    for name in ("vector_knn_l2", "rrf_fusion", "chunk_sections", "freshness_diff", "dedup_key", "ngram_postings", "chunk_packing", "chunk_merge", "mmr_greedy", "keyword_index_multi_term", "hybrid_stored", "parse_sheet", "image_upsert", "index_report"):
        got = entry.queries()[name](spark, SMALL).toPandas()
        want = db.sql(sql[name]).df()
        columns = sorted(got)
        assert columns == sorted(want)
        as_rows = lambda d: sorted(tuple("" if v is None or str(v) in ("nan", "<NA>") else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))
        for a, b in zip(as_rows(got), as_rows(want), strict=True):
            assert [x.removesuffix(".000000") for x in a] == [x.removesuffix(".000000") for x in b]


def test_flagship(spark):
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() == 8
