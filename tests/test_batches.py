"""What a Python worker holds at once does not grow with the table."""

import sys

import pytest
from pyspark.sql import functions as F

from weftlake.operators import pages


@pytest.mark.parametrize("rows, kb", [(3_000, 1), (200, 200)])
def test_page_functions_get_small_batches(spark, rows, kb):
    held = pages._each(lambda h: sum(map(len, sys._getframe(1).f_locals["series"][0])), "bigint")
    table = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), kb * 1000).alias("html"))
    most = table.select(held("html").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 5_000_000 and most <= 128 * kb * 1000
