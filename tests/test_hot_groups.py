"""Hubs, hot partitions and outliers against plain code."""

import random
from collections import Counter
from itertools import groupby

import pytest

from lacegraph.operators import graph, ordered, selection

ARC = "u long, v long, l int, ol int"


def plain_transitive(rows, fuzz):
    out = {}
    for u, v, l, _ in rows:
        out.setdefault(u, []).append((l, v))
    gone = set()
    for u, ways in out.items():
        near, most, mine = {v for _, v in ways}, max(ways)[0] + fuzz, set()
        for l, w in sorted(set(ways)):
            if w not in mine:
                mine |= {x for m, x in out.get(w, ()) if l + m <= most and x in near}
        gone |= {(u, v) for v in mine}
    return gone


@pytest.mark.parametrize("folded", [10_000, 0])
def test_transitive(spark, folded, monkeypatch):
    monkeypatch.setattr(graph, "FOLDED_WALKS", folded)
    rng = random.Random(1)
    rows = {(rng.randrange(40) + 100 * k, rng.randrange(40) + 100 * k): rng.randint(1, 300) for k in range(3) for _ in range(240)}
    rows = [(u, v, l, 0) for (u, v), l in rows.items()]
    got = [tuple(r) for r in graph.transitive(spark.createDataFrame(rows, ARC), 100).collect()]
    assert set(got) == plain_transitive(rows, 100) and len(got) == len(set(got)) and got


def test_transitive_at_a_hub(spark):
    """A vertex of many thousands of arcs in and out: its square is never made."""
    n = 20_000
    rows = [(1, 10 + i, 10 + i % 50, 0) for i in range(n)] + [(10 + i, 1, 20, 0) for i in range(n)] + [(10 + i, 11 + i, 5, 0) for i in range(0, n - 1, 2)]
    df = spark.createDataFrame(rows, ARC)
    assert graph.closed_walks(df).count() < 4 * n
    assert {tuple(r) for r in graph.transitive(df, 10).collect()} == plain_transitive(rows, 10)


def test_runs_of_a_hot_partition(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice("aab") if i % 500 > 60 else None, 7) for i in range(6000)]
    got = Counter(tuple(r) for r in ordered.runs(spark.createDataFrame(rows, "k int, at int, v string, n int").repartition(9), ["k"], ["at"], "v").collect())
    expected = Counter()
    for k in (1, 2, None):
        mine = [v for key, _, v, _ in rows if key == k]
        expected.update((k, i + 1, v, len(list(g))) for i, (v, g) in enumerate(groupby(mine)))
    assert got == expected
    one = ordered.runs(spark.createDataFrame([(1, i, "x") for i in range(3000)], "k int, at int, v string"), ["k"], ["at"], "v")
    assert [tuple(r) for r in one.collect()] == [(1, 1, "x", 3000)]


def test_kth_smallest_with_outliers(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_ROWS", 50)
    rng = random.Random(3)
    for values in ([*(rng.randrange(1000) for _ in range(5000)), 10**18, -(10**18)], [7] * 3000 + [8, 9, 10**18], list(range(4000))):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x long")
        for place in (0, 1, len(values) // 2, len(values) - 2, len(values) - 1):
            assert selection.kth_smallest(df, "x", place).first().value == sorted(values)[place]
        assert selection.kth_smallest(df, "x", len(values)).first().value is None
