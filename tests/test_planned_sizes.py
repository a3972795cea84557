"""Checkpoints over rounds of joins don't carry on an estimated size whose digits double each round."""

from pyspark.sql import functions as F

from lacegraph.operators import simplify
from lacegraph.session import SIZE_BITS, cut


def bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_an_estimate_stays_within_bounds_over_rounds(spark):
    at = cut(spark.range(40).select("id", (F.col("id") * 2).alias("x")))
    assert bits(at) < SIZE_BITS  # a plausible one is kept
    for _ in range(12):
        at = cut(at.join(at.select("id", F.col("x").alias("y")), "id").select("id", (F.col("x") + F.col("y") - F.col("x")).alias("x")))
        assert bits(at) <= SIZE_BITS + 2
    assert sorted(map(tuple, at.collect())) == [(i, 2 * i) for i in range(40)]


def test_places_of_a_long_path_are_planned_quickly(spark):
    n = 3000
    single = spark.range(n).select((F.col("id") * 2).alias("u"), ((F.col("id") + 1) * 2).alias("v"), F.lit(3).alias("l"))
    found = simplify.from_start(single)
    assert bits(found) <= SIZE_BITS + 2
    assert sorted(map(tuple, found.collect())) == [(2 * i, 3 * i, i) for i in range(1, n + 1)]
