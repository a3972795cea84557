"""What the seed join and the chains write: minimizers once, seeds once, and no stored table of either."""

import re

from lacegraph.config import Options
from lacegraph.operators import chain, seeds


def minis(spark, n=400):
    return spark.createDataFrame([(i % 20, i // 20, i % 2, i * 7 % 50, i // 20) for i in range(n)], "read_id long, pos int, strand int, hash long, j int")


def test_minimizers_are_shuffled_once(spark):
    found = seeds.seeds(minis(spark))
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    own = re.findall(r"(?<!ReusedExchange )Exchange hashpartitioning\(hash", re.sub(r"ReusedExchange.*", "", plan))
    assert len(own) == 1 and plan.count("ReusedExchange") == 3


def test_only_pairs_with_a_large_cluster_are_worked_again(spark, monkeypatch):
    rows = [(1, 2, False, 100, i, 20 * i, 20 * i) for i in range(60)] + [(1, 3, False, 100, i, 20 * i, 20 * i) for i in range(9)]
    found = spark.createDataFrame(rows, "qid long, tid long, rev boolean, diag long, j int, qpos int, rpos int")
    whole = sorted(map(tuple, chain.seed_regions(found).collect()))
    assert len(whole) == 2
    seen, real = [], chain.wide_chains.clusters
    monkeypatch.setattr(chain.wide_chains, "clusters", lambda many, *a: seen.append({r.tid for r in many.collect()}) or real(many, *a))
    assert sorted(map(tuple, chain.seed_regions(found, Options(task_seeds=20)).collect())) == whole and seen == [{2}]


def test_runs_take_more_ranges_for_more_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lacegraph.operators import ordered

    df = spark.range(900).select((F.col("id") % 3).alias("p"), F.col("id").alias("o"), F.floor(F.col("id") / 21).alias("v"))
    one = lambda: sorted(map(tuple, ordered.runs(df, ["p"], ["o"], "v").collect()))
    seen, real = [], type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *c: seen.append(n) or real(self, n, *c))
    whole = one()
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    assert one() == whole and seen[1] == 18 > seen[0] and len(whole) == 3 * 43
