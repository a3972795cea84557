"""Ordered computations over integer ids without a single-task window: prefix sums, ordinals, packing, runs, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

BUCKET_ROWS, ONE_WINDOW_ROWS = 4096, 50_000
#: Boundaries are quantiles of the key, up to so many; beyond, the ranges between them are cut into equal widths.
MOST_BOUNDS = 4096


def range_bucket(df: DataFrame, key: str, rows: int) -> tuple[Column, int]:
    """Numbers of consecutive ranges of an integer key that hold about ``rows`` rows each, and how many there are.

    The boundaries follow the keys' distribution, so that a few far keys don't leave all others in one range. A key's
    range is found by bisection; null keys go to the first.
    """
    k = F.col(key).cast("long")
    size = df.agg(F.count(k).alias("n"), F.min(k).alias("low"), F.max(k).alias("high")).first()
    wanted = max(1, -(-size.n // rows))
    if wanted == 1:
        return F.lit(0).cast("long"), 1
    parts = min(wanted, MOST_BOUNDS + 1)
    bounds = sorted(set(df.agg(F.percentile_approx(k, [i / parts for i in range(1, parts)], 8 * parts)).first()[0]))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= k, step).otherwise(0))
    cuts = -(-wanted // parts)
    if cuts == 1:
        return F.coalesce(place.cast("long"), F.lit(0)), len(bounds) + 1
    low, high = F.coalesce(F.get(table, place - 1), F.lit(size.low)).cast("double"), F.coalesce(F.get(table, place), F.lit(size.high)).cast("double")
    share = F.floor((k.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * cuts)
    return F.coalesce(place.cast("long") * cuts + F.least(F.greatest(share, F.lit(0)), F.lit(cuts - 1)).cast("long"), F.lit(0)), (len(bounds) + 1) * cuts


def prefix_sum(df: DataFrame, key: str, value: str, name: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of a smaller key (keys are unique).

    Ranges of the key are summed on their own and their totals are added up; the totals are few, and are summed the
    same way where they are not.
    """
    bucket, n = range_bucket(df, key, rows)
    own = df.withColumn("__b", bucket)
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = own.groupBy("__b").agg(F.sum(value).alias("__t"))
    if n <= ONE_WINDOW_ROWS:
        before = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    else:
        before = prefix_sum(totals, "__b", "__t", "__before", rows).select("__b", "__before")
    return own.withColumn("__in", inner).join(before, "__b").withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__b", "__in", "__before")


def ordinal(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with dense 0-based numbers in ascending order of a unique integer key."""
    return prefix_sum(df.withColumn("__one", F.lit(1)), key, "__one", name).drop("__one")


def pack_blocks(reads: DataFrame, max_bases: int, key: str = "read_id", length: str = "len") -> DataFrame:
    """(block_id, first_read, n_reads): greedy packing; a block closes when the next read would exceed ``max_bases``.

    A read that is longer than a block stands alone. Each boundary depends on the one before. For a block that would
    begin at some read, the first read of the next one is the first whose end lies more than ``max_bases`` behind its
    start: a lookup in prefix sums, sorted together in ranges. The boundaries are those reads that the first read
    reaches over these links, found by doubling: in each round the reached reads hand on to those twice as far.
    """
    rows = prefix_sum(ordinal(reads.select(F.col(key).cast("long").alias("id"), F.col(length).cast("long").alias("n")), "id", "i"), "i", "n", "start")
    rows = cut(rows.select("i", "id", "n", "start"))
    size = rows.agg(F.count("*").alias("n"), F.sum("n").alias("bases")).first()
    if not size.n:
        return reads.sparkSession.createDataFrame([], "block_id int, first_read long, n_reads int")
    # In one order, ends stand before the limits that they don't exceed; a limit's next block begins with the first end after it.
    ends = rows.select((F.col("start") + F.col("n")).alias("at"), F.lit(1).alias("kind"), F.col("i").alias("end"), F.lit(None).cast("long").alias("of"), F.col("n").alias("n"))
    limits = rows.select((F.col("start") + max_bases).alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("end"), F.col("i").alias("of"), F.col("n").alias("n"))
    events = cut(ends.unionByName(limits))
    bucket, _ = range_bucket(events, "at", max(BUCKET_ROWS, 2 * size.n // ONE_WINDOW_ROWS))
    events = cut(events.withColumn("b", bucket))
    heads = events.where("kind = 1").groupBy("b").agg(F.min("end").alias("head"))
    later = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    every = events.select("b").distinct().join(heads, "b", "left")
    following = cut(every.select("b", F.min("head").over(later).alias("after")))  # a row for each range
    order = Window.partitionBy("b").orderBy(F.desc("at"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = events.withColumn("next", F.min("end").over(order)).where("kind = 2").join(F.broadcast(following), "b")  # at most about ONE_WINDOW_ROWS rows
    links = nexts.select(F.col("of").alias("i"), F.greatest(F.col("of") + 1, F.coalesce("next", "after", F.lit(size.n))).alias("next"))
    links = cut(links.where(F.col("next") < size.n))
    reached = rows.sparkSession.createDataFrame([(0,)], "i long")
    for _ in range(64):
        more = cut(reached.join(links, "i").select(F.col("next").alias("i")).unionByName(reached).distinct())
        if more.count() == reached.count():
            break
        reached = more
        twice = links.select(F.col("i").alias("next"), F.col("next").alias("far"))
        links = cut(links.join(twice, "next").select("i", F.col("far").alias("next")))
    firsts = ordinal(reached.join(rows.select("i", "id"), "i"), "i", "block_id")
    following = firsts.select((F.col("block_id") - 1).alias("block_id"), F.col("i").alias("until"))
    return firsts.join(following, "block_id", "left").select(F.col("block_id").cast("int").alias("block_id"), F.col("id").alias("first_read"), (F.coalesce("until", F.lit(size.n)) - F.col("i")).cast("int").alias("n_reads"))


#: Rows that a range of ``runs`` holds, at least as soon as there are more ranges than Spark would make.
RANGE_ROWS = 250_000


def runs(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding: (partition..., run, value, n) of neighbouring equal values within each partition.

    Rows are sorted in ranges of (partition, order), runs are found within each range, and what a range begins with joins
    the last run of the range before: no task sees all rows of a partition, and each range gives one row for that.
    """
    names = [f"__p{i}" for i in range(len(partition))]
    keys = [*names, "__range"]
    columns = [*(F.col(p).alias(n) for p, n in zip(partition, names)), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)), F.col(value).alias("__v")]
    by = [*names, *(f"__o{i}" for i in range(len(order)))]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))  # so a task's rows don't grow with the input
    ranged = cut(df.select(*columns).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33)).repartition(parts, *keys)  # the number of the range
    w = Window.partitionBy(*keys).orderBy("__at")
    new = F.when(F.col("__v").eqNullSafe(F.lag("__v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    own = ranged.withColumn("__new", new).withColumn("__r", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    pieces = cut(own.groupBy(*keys, "__r", "__v").agg(F.count("*").alias("__n")))
    borders = pieces.groupBy(*keys).agg(F.min_by("__v", "__r").alias("__first"), F.max_by("__v", "__r").alias("__last"), F.max("__r").alias("__k"))
    along = Window.partitionBy(*names).orderBy("__range")
    joins = (F.lag("__k").over(along).isNotNull() & F.col("__first").eqNullSafe(F.lag("__last").over(along))).cast("long")
    borders = borders.withColumn("__joins", joins)
    before = F.coalesce(F.sum(F.col("__k") - F.col("__joins")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__joins")
    borders = borders.select(*(F.col(k).alias(f"{k}_") for k in keys), before.alias("__before"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    found = pieces.join(borders, same).withColumn("run", F.col("__before") + F.col("__r"))
    return found.groupBy(*names, "run", "__v").agg(F.sum("__n").alias("n")).select(*(F.col(n).alias(p) for n, p in zip(names, partition)), "run", F.col("__v").alias(value), "n")


def offset_join(points: DataFrame, reads: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """Points (gpos, ...) with the read whose bases cum_off < gpos <= cum_off + len hold them, and the place in it.

    An equi-join on bins of offsets with a range condition; a read stands in every bin that it touches.
    """
    spans = reads.select("read_id", "cum_off", (F.col("cum_off") + F.col("len")).alias("__end")).where("__end > cum_off")
    spans = spans.withColumn("__bin", F.explode(F.sequence(F.expr(f"(cum_off + 1) div {bin_size}"), F.expr(f"__end div {bin_size}"))))
    at = points.withColumn("__bin", F.expr(f"gpos div {bin_size}"))
    inside = at.join(spans, "__bin").where((F.col("gpos") > F.col("cum_off")) & (F.col("gpos") <= F.col("__end")))
    return inside.withColumn("pos", (F.col("gpos") - F.col("cum_off")).cast("int")).drop("__bin", "__end", "cum_off")


def partition_histogram(df: DataFrame, key: str, nodes: int, parts: int) -> DataFrame:
    """(node, part, n): how a two-level hash partitioning deals the rows."""
    k = F.col(key)
    return df.groupBy((k % nodes).cast("int").alias("node"), (F.expr(f"{key} div {nodes}") % parts).cast("int").alias("part")).agg(F.count("*").alias("n"))
