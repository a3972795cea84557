"""Order statistics, samples, ranges and counts of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


#: Rows among which the place is sought in one histogram, and the accuracy with which it is bracketed before.
FEW_ROWS, ACCURACY = 100_000, 10_000


def kth_smallest(df: DataFrame, column: str, place: int) -> DataFrame:
    """One row, value: the exact element at a 0-based place in ascending order.

    The place is bracketed between two approximate quantiles, what lies below is counted exactly, and so again within the
    bracket until few rows or a single value are left. Quantiles follow the ranks, so far values cost no round.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    size, before = rows.count(), 0
    if not size:
        return df.select(F.col(column).alias("value")).limit(0)
    while size > FEW_ROWS:
        at = (place - before) / size
        low, high = rows.agg(F.percentile_approx("v", [min(1.0, max(0.0, at - 2 / ACCURACY)), min(1.0, at + 2 / ACCURACY)], ACCURACY)).first()[0]
        below, within = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not before + below <= place < before + below + within or within == size:
            break
        rows, before, size = rows.where(F.col("v").between(low, high)), before + below, within
        if low == high:
            break
    through = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # of the values in the bracket
    counted = rows.groupBy("v").agg(F.count("*").alias("n")).withColumn("through", F.lit(before) + through)
    return counted.where(F.col("through") > place).agg(F.min("v").alias("value"))


def shuffled_order(df: DataFrame, key: str, seed: int = 11) -> DataFrame:
    """``df`` with a reproducible random place in [0, 1) for each key."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.withColumn("place", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / float(1 << 48))


def sample_rows(df: DataFrame, key: str, size: int, seed: int = 11) -> DataFrame:
    """``size`` rows, each set of keys as likely as any other: those with the smallest places."""
    return shuffled_order(df, key, seed).orderBy("place", key).limit(size).drop("place")


def ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """[start, end) chunks of [low, high), whose sizes differ by one at most."""
    size, extra = divmod(max(0, high - low), parts)
    starts = [low + i * size + min(i, extra) for i in range(parts + 1)]
    return list(zip(starts, starts[1:]))


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: n_reads, bases, max_len."""
    return reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bases"), F.max("len").alias("max_len"))
