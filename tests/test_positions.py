"""Numbering: rows move once where no group is long, and long groups are still sliced."""

import pytest
from pyspark.sql import functions as F

from trajlake.operators.blocks import positions


def windows_and_joins(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Window"), df._jdf.queryExecution().toString().count("Join")


def test_short_groups_are_numbered_by_one_window(spark):
    rows = spark.range(100).select(F.lit("d").alias("dataset"), (F.col("id") % 7).alias("episode_index"), F.col("id").alias("at"))
    numbered = positions(rows, ["at"], F.col("at"))
    assert windows_and_joins(numbered) == (1, 0)
    assert all(r.position == r.at // 7 for r in numbered.collect())


@pytest.mark.parametrize("limit", [3, 5])
def test_long_groups_beside_short_ones(spark, limit):
    spark.conf.set("spark.trajlake.split.rows", str(limit))
    try:
        rows = spark.createDataFrame(
            [("d", e, float(i)) for e, n in ((1, 40), (2, 2), (3, limit), (4, limit + 1)) for i in range(n)],
            "dataset string, episode_index long, at double",
        )
        numbered = positions(rows, ["at"], F.col("at")).collect()
    finally:
        spark.conf.unset("spark.trajlake.split.rows")
    assert len(numbered) == 40 + 2 + limit + limit + 1
    assert all(r.position == r.at for r in numbered)
