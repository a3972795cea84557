"""A stored table's shuffle files are removed with it stored, and the setting is as before."""

from pyspark.sql import functions as F

from lacegraph.session import CLEANUP, cut


def files(spark):
    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in kept.split() if "/shuffle_" in f and f.endswith(".data")}


def test_nothing_shuffled_is_left(spark):
    before, was = files(spark), spark.conf.get(CLEANUP, "false")
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    out = cut(df.join(spark.range(900).select(F.col("id").alias("k")).repartition(3, "k").hint("merge"), "k"))
    assert not files(spark) - before and spark.conf.get(CLEANUP) == was
    assert out.agg(F.sum("n"), F.count("*")).first()[:] == (5000, 700)
    assert df.count() == 700 and cut(df).count() == 700  # the frame that was given can be read again
