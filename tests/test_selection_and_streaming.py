import random

from lacegraph.operators import graph, selection, sketch
from lacegraph.streaming import ingest


def test_kth_smallest(spark):
    rng = random.Random(1)
    values = [rng.randint(-50, 5000) for _ in range(900)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x long")
    for place in (0, 1, 450, 899):
        assert selection.kth_smallest(df, "x", place).first().value == sorted(values)[place]
    same = spark.createDataFrame([(7,)] * 5, "x long")
    assert selection.kth_smallest(same, "x", 3).first().value == 7
    assert selection.kth_smallest(df.where("x is null"), "x", 0).count() == 0


def test_ranges_and_samples(spark):
    assert selection.ranges(3, 10, 3) == [(3, 6), (6, 8), (8, 10)]
    assert selection.ranges(0, 2, 4) == [(0, 1), (1, 2), (2, 2), (2, 2)]
    df = spark.range(200).withColumnRenamed("id", "k")
    a, b = ({r.k for r in selection.sample_rows(df.repartition(n), "k", 20).collect()} for n in (1, 5))
    assert a == b and len(a) == 20
    assert a != {r.k for r in selection.sample_rows(df, "k", 20, seed=5).collect()}


def test_walks(spark):
    arcs = [(2 * i, 2 * i + 2, 1, 9) for i in range(6)]
    arcs += [(v ^ 1, u ^ 1, l, o) for u, v, l, o in arcs]
    got = {r.vertex: (r.last, r.steps, r.type) for r in graph.walks(spark.createDataFrame(arcs, "u long, v long, l int, ol int"), 4).collect()}
    assert got[0] == (8, 4, "MERGEABLE") and got[8] == (12, 2, "TIP") and got[12] == (12, 0, "TIP") and got[13] == (5, 4, "MERGEABLE")


def test_stream_takes_each_read_once(spark, tmp_path):
    rng = random.Random(2)
    reads = [(i, "".join(rng.choice("ACGT") for _ in range(80))) for i in range(6)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(reads, "read_id long, seq string")
    for part in (df.where("read_id < 4"), df.where("read_id >= 4")):
        part.write.mode("append").parquet(source)
        ingest.sketch_stream(ingest.read_stream(spark, source), target, str(tmp_path / "state")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, sketch.minimizers(df).collect()))
