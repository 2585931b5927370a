"""Queries against their SQL on pages that the small tables don't have: many, or with an address twice."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import rows
from weftlake.plans import catalogue


def compare(spark, name, pages, folder):
    pages.write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    found = catalogue.queries()[name](spark, str(folder)).toPandas()
    assert rows(found) == rows(con.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("n", [3, 100_010])
def test_sitemap_of_many_pages_is_one_file(spark, tmp_path, n):
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://e.org/p&"), F.col("id") * 7 % n, F.lit("/")).alias("url"), F.lit("<p>").alias("html"))
    compare(spark, "sitemap_generate", pages, tmp_path)


def test_captures_of_one_address_are_paired_once(spark, tmp_path):
    urls = ["https://e.org/a"] * 7 + ["https://e.org/b", None, None, None]
    pages = [(i, u, "<p>") for i, u in enumerate(urls)]
    pages += pages[:5]  # whole rows again
    compare(spark, "visual_diff", spark.createDataFrame(pages, "page_id bigint, url string, html string"), tmp_path)
