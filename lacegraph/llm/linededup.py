"""Line dedup by site-relative frequency, with DataFrame functions.

For each host (the ``source`` of documents) the pages that contain a line are counted and divided by the host's pages;
a line whose share exceeds ``ratio`` is boilerplate of that host and dropped from its pages. Lines are counted by a
96-bit hash, once a page, with partial sums before the shuffle. A line on fewer than ``least_copies`` pages gives no
evidence; hosts of every size are judged by the same ratio.

A host can have at most (mean lines a page) / ratio boilerplate lines. They are sent to its pages as arrays, in which a
line is sought by its first 64 bits before the rest: by broadcast up to ``BROADCAST_ROWS`` lines of two numbers each, else by a join on the host and
a salt, as one host may hold a third of all rows.

Defined results: a null text stays null with 0 lines; an empty text is one blank line; blank lines are neither counted nor
dropped; a null host is a host of its own; a line that a page repeats counts once and all its places go; rows that share
an id count as pages of their own; very long texts are read whole; a document is kept even if all its lines go; an input
column named like one of the two counts is replaced by it, and other columns stay as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

RATIO, LEAST_COPIES = 0.08, 2  # a line on a single page is not repeated
BROADCAST_ROWS, SALTS = 200_000, 64


def _key(line) -> object:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_copies: int = LEAST_COPIES) -> DataFrame:
    """(host, a, b, pages, share): the boilerplate lines of each host, by hash."""
    rows = pages.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    lines = rows.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    counts = lines.select("host", _key(F.col("line")).alias("k")).groupBy("host", "k").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_copies)
    share = F.col("pages") / F.col("total")
    return counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(share > ratio).select("c.host", "k.a", "k.b", "pages", share.alias("share"))


def drop_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_copies: int = LEAST_COPIES) -> DataFrame:
    """``pages`` with the text's boilerplate lines dropped, and the columns n_lines and n_dropped (long)."""
    found = cut(boilerplate(pages, host_col, text_col, ratio, least_copies))
    n = found.count()
    own = [x for x in pages.columns if x not in ("n_lines", "n_dropped")]
    rows = pages.select(F.struct(*(F.col(f"`{x}`") for x in own)).alias("row"))  # no name of the input can clash
    text, host = F.col("row").getField(text_col).cast("string"), F.col("row").getField(host_col).cast("string")
    rows = rows.withColumn("host", host).withColumn("lines", F.split(text, "\n"))
    arrays = found.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("drop")).select(F.col("host").alias("its"), "drop", F.col("drop.a").alias("first"))
    same = F.col("host").eqNullSafe(F.col("its"))
    if n <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(arrays), same, "left")
    else:
        arrays = arrays.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(arrays, same & (F.col("salt") == F.col("its_salt")), "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~(F.array_contains("first", F.xxhash64(x)) & F.array_contains("drop", _key(x)))))
    rows = rows.select("row", "lines", kept.alias("kept"))
    size = lambda lines: F.when(F.col("lines").isNull(), 0).otherwise(F.size(lines)).cast("long")
    columns = [F.array_join("kept", "\n").alias(x) if x == text_col else F.col("row").getField(x).alias(x) for x in own]
    return rows.select(*columns, size("lines").alias("n_lines"), (size("lines") - size("kept")).alias("n_dropped"))
