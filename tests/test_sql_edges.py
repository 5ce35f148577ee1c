"""Queries against their SQL on rows that the test tables have few of."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvella.providers import HashingEmbedder


def same(spark, folder, name, **tables):
    """Rows of the query over these tables, which equal those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.sql(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(folder)).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got)
    assert columns == sorted(want)
    as_rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))
    assert as_rows(got) == as_rows(want)
    return got


def test_images_at_the_bound(spark, tmp_path):
    kept = ["a" * 1199, "a" * 1200, "a" * 1201, "中" * 1200, "b" * 5, "x\n\n" + "y" * 1197]
    texts = [*kept, "", " \n ", None]
    made = same(spark, tmp_path, "chunk_dispatch", documents=spark.createDataFrame([(i, t) for i, t in enumerate([t for x in texts for t in (x, x)])], "doc_id long, text string"))
    assert len(made) == 2 * len(kept) and made["whole"].sum() == len(kept) - 1


def test_references_in_titles(spark, tmp_path):
    titles = ["a &amp; b", "cut &amp", "cut &quot;x&quot", "&lt;b> &gt; &#65; &nbsp;", "&amp;lt; &amp;amp;lt; &amp;quot;", "R&D &", "  room  "]
    pages = spark.createDataFrame([(i, f"<html><head><title>{t}</title></head><body><h1>Head</h1><p>x</p></body></html>") for i, t in enumerate(titles)], "page_id long, html string")
    same(spark, tmp_path, "html_convert", pages=pages)


def test_a_text_is_hashed_once(spark):
    made = spark.range(1).select(HashingEmbedder(16).column(F.col("id").cast("string")).alias("v"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_an_index_run_takes_all_files(spark, tmp_path):
    """More files than a knowledge base's usual limit."""
    pages = spark.range(10_100).selectExpr("id as page_id", "concat('page ', id) as html")
    assert same(spark, tmp_path, "index_report", pages=pages)["paths"][0] == 10_100 - 1123
