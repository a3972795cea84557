"""Ranges that follow the keys' distribution, and what is computed over them."""

import random

import pytest
from pyspark.sql import functions as F

from lacegraph.operators import ordered


def keys_with_outlier(n):
    return [*range(n), 10**15]


@pytest.mark.parametrize("most", [4096, 7])
def test_far_keys_leave_the_ranges_even(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "MOST_BOUNDS", most)
    rng = random.Random(2)
    for keys in (keys_with_outlier(20_000), [-(2**62), *range(20_000), 2**62], sorted(rng.sample(range(10**9), 20_000))):
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        bucket, n = ordered.range_bucket(df, "k", 500)
        rows = df.select("k", bucket.alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("b").collect()
        assert all(a.high < b.low for a, b in zip(rows, rows[1:])) and rows[-1].b < n
        assert max(r.n for r in rows) <= (1000 if most == 4096 else len(keys) // most + 1000)


def test_range_of_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(7,)] * 50 + [(i,) for i in range(20)], "k long")
    bucket, n = ordered.range_bucket(df, "k", 4)
    got = {r.k: r.b for r in df.select("k", bucket.alias("b")).distinct().collect()}
    assert got[None] == 0 and all(got[i] <= got[i + 1] < n for i in range(19))
    assert ordered.range_bucket(df.where("k > 99"), "k", 4)[1] == 1


def test_prefix_sum_with_far_keys(spark):
    keys = keys_with_outlier(300)
    df = spark.createDataFrame([(k, i % 5) for i, k in enumerate(keys)], "k long, v int").repartition(3)
    total, expected = 0, {}
    for i, k in enumerate(keys):
        expected[k], total = total, total + i % 5
    assert {r.k: r.s for r in ordered.prefix_sum(df, "k", "v", "s", rows=16).collect()} == expected
    assert {r.k: r.n for r in ordered.ordinal(df, "k", "n").collect()} == {k: i for i, k in enumerate(keys)}


def test_blocks_are_packed_greedily(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 8)
    rng = random.Random(5)
    for most, lengths in ((10, [4, 5, 3, 9, 1]), (10, [11, 0, 12, 3, 0, 0, 7, 1, 30]), (50, [rng.choice([0, 1, 5, 20, 60]) for _ in range(300)]), (10**6, [1] * 40)):
        ids, n = [3 * i + 1 for i in range(len(lengths))], []
        for i, length in zip(ids, lengths):
            if not n or n[-1][2] + length > most:
                n.append([i, 0, 0])
            n[-1][1] += 1
            n[-1][2] += length
        df = spark.createDataFrame(list(zip(ids, lengths)), "read_id long, len int").repartition(3)
        got = sorted(tuple(r) for r in ordered.pack_blocks(df, most).select("block_id", "first_read", "n_reads").collect())
        assert got == [(i, first, count) for i, (first, count, _) in enumerate(n)]
    assert ordered.pack_blocks(df.where("read_id < 0"), 5).count() == 0
