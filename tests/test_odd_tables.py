"""Queries against their SQL on tables with what larger inputs hold: shared urls, chance terms, equal order keys."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from noticeflow.operators.platforms import resolve_platform

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def equal(spark, folder, name, *tables):
    """The query and its SQL give the same rows over the tables of ``folder``."""
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    got = Counter(map(tuple, df.collect()))
    want = Counter(duck.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


def shared_urls(spark, folder):
    """Pages in threes that share a url."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    urls = pages.select((F.col("page_id") * 3).alias("k"), F.col("url").alias("u"))
    first = F.col("page_id") - F.col("page_id") % 3
    pages.withColumn("k", first).join(urls, "k").select("page_id", F.col("u").alias("url"), "html").write.parquet(f"{folder}/pages.parquet")


def test_attachments_of_pages_that_share_a_url(spark, tmp_path):
    shared_urls(spark, tmp_path)
    equal(spark, tmp_path, "attachment_links", "pages")


def test_platforms_of_schools_that_share_a_url(spark, tmp_path):
    shared_urls(spark, tmp_path)
    equal(spark, tmp_path, "resolve_platform", "pages")


def test_equal_stored_pages_give_one_row(spark):
    known = spark.createDataFrame([("S", "http://a.it", "", "", "")], "school_code string, website string, vendor string, albo_id string, albo_url string")
    stored = spark.createDataFrame([("http://a.it", "<p>albo</p>")] * 2, "url string, html string")
    assert [r.vendor for r in resolve_platform(known, stored).collect()] == ["Generic"]


def test_crawl_past_links_with_a_term_by_chance(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    pages.withColumn("html", F.replace("html", F.lit("<nav>"), F.lit('<nav><a href="/ardo">ardo</a>'))).write.parquet(f"{tmp_path}/pages.parquet")
    equal(spark, tmp_path, "crawl_frontier", "pages")
