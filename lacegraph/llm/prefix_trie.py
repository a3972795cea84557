"""Conversation prefix trie, built level by level.

A node of depth d is a distinct sequence of d first turns; it is named by its depth and its smallest conversation. In each
round the conversations that are still live are grouped by their node and their next turn, and each group takes the
smallest id as the node below. A conversation that is alone in its node leaves the rounds: the rest of its chain is known
without any grouping. So there are as many rounds as the longest prefix that two conversations share. Then leaves and
savings are rolled up from the deepest level, by one join a level.

A turn is compared by the SHA-256 digest of its role and text, so that no text is shuffled. Groups are counted before the
shuffle and joined back by (node, turn), where Spark splits skewed keys; places within a conversation are numbered in
ranges of all turns, so that no task needs a whole conversation. The conversations that end in a node are joined to texts
of bounded length in ranges; only these pieces of a node meet, and are digested one after the other.

Defined results: null roles and texts are empty ones; rows without a conversation id belong to none and are left out; rows
of one turn are ordered by role and then by digest, a null turn first, and repeated rows are turns of their own; very long
texts are digested whole; a conversation without turns ends in the root; other columns are ignored; an empty table has no
node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, map_stream

#: So many ids are joined to one text before a node's texts meet.
IDS_A_PIECE = 4096
_INDEX_BITS = 33  # of monotonically_increasing_id, below the partition's number


def places(scratch: Scratch, rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, 0-based within each key, written to the scratch folder.

    Rows are sorted in ranges of (key, order). A key that spans ranges adds up its rows in the ranges before.
    """
    ranges = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    numbered = scratch.put(ranges.withColumn("__at", F.monotonically_increasing_id()), name)
    numbered = numbered.withColumn("__range", F.shiftright("__at", _INDEX_BITS)).withColumn("__at", F.col("__at").bitwiseAND((1 << _INDEX_BITS) - 1))
    held = numbered.groupBy(key, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(key, "__range", (before - F.col("__first")).alias("__shift"))  # at most one row a range and key
    return numbered.join(held, [key, "__range"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def turns_of(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(conv, turn, key, bytes, place) of all turns of (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return places(scratch, rows, "conv", ["turn", "role", "key"], "turns").select("conv", "key", "bytes", "place")


def rebuilt(turns: DataFrame, family: int = 5, shares: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c takes the first h turns of c - c % family for its own first h.

    h is the CRC-32 of c in decimal digits, modulo ``shares``. Turns are (conv, depth, key, bytes), conversations
    (conv, n); both come from turns with places, and no conversation gets lost.
    """
    c = F.col
    taken = F.crc32(c("conv").cast("string").cast("binary")) % shares
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    base = sizes.select(c("conv").alias("base"), c("own").alias("there"))
    sizes = sizes.select("conv", "own", (c("conv") - c("conv") % family).alias("base"), taken.alias("h")).join(base, "base", "left")
    sizes = sizes.select("conv", "base", "own", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("given"))
    first = turns.where(c("place") < shares - 1).select(c("conv").alias("base"), "key", "bytes", "place").join(sizes.select("conv", "base", "given"), "base").where("place < given")
    rest = turns.join(sizes.select("conv", "h", "given"), "conv").where("place >= h")
    both = first.select("conv", (c("place") + 1).alias("depth"), "key", "bytes").unionByName(rest.select("conv", (c("place") - c("h") + c("given") + 1).alias("depth"), "key", "bytes"))
    return both, sizes.select("conv", (c("given") + F.greatest(c("own") - c("h"), F.lit(0))).alias("n"))


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are."""
    return turns.select("conv", (F.col("place") + 1).alias("depth"), "key", "bytes"), turns.groupBy("conv").agg(F.count("*").alias("n"))


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(depth, node, first, ids) of sorted (depth, node, conv)."""
    for (depth, node), group in groupby(rows, key=lambda r: r[:2]):
        ids: list[int] = []
        for *_, conv in group:
            ids.append(conv)
            if len(ids) == IDS_A_PIECE:
                yield depth, node, ids[0], ",".join(map(str, ids))
                ids = []
        if ids:
            yield depth, node, ids[0], ",".join(map(str, ids))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(depth, node, ends_sha256) of sorted pieces."""
    for (depth, node), group in groupby(rows, key=lambda r: r[:2]):
        digest = hashlib.sha256()
        for i, (*_, ids) in enumerate(group):
            digest.update(f",{ids}".encode() if i else ids.encode())
        yield depth, node, digest.hexdigest()


def ends(members: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from the conversations (depth, node, conv) that end in each node."""
    keys = ["depth", "node"]
    ranges = members.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    pieces = map_stream(ranges, _pieces, "depth long, node long, first long, ids string")
    return map_stream(pieces.repartition(*keys).sortWithinPartitions(*keys, "first"), _digests, "depth long, node long, ends_sha256 string", rows=64)


def build(spark: SparkSession, scratch: Scratch, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of turns (conv, depth, key, bytes) and conversations (conv, n); see ``prefix_trie``."""
    c = F.col
    band = F.floor(F.log2("depth")).cast("int")  # few folders, and the first levels alone in theirs
    turns.withColumn("band", band).write.partitionBy("band").parquet(f"{scratch.root}/rebuilt")
    turns = spark.read.schema("conv long, depth long, key binary, bytes long, band int").parquet(f"{scratch.root}/rebuilt")
    convs = scratch.put(convs, "convs")
    top = convs.agg(F.min("conv").alias("node"), F.count("*").alias("members")).first()
    if not top.members:
        return spark.createDataFrame([], NODES)

    level = lambda df, d: scratch.put(df.select("conv", "n", "node", "parent", "members", "bytes"), f"levels/depth={d}")
    at = level(convs.select("conv", "n", F.lit(top.node).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(top.members).cast("long").alias("members"), F.lit(0).cast("long").alias("bytes")), 0)
    levels = [at]
    while True:
        d = len(levels)
        live = at.where((c("members") > 1) & (c("n") >= d)).select("conv", "n", c("node").alias("parent"))
        if live.isEmpty():
            break
        here = turns.where((c("band") == d.bit_length() - 1) & (c("depth") == d)).select("conv", "key", "bytes")
        step = live.join(here, "conv")
        below = step.groupBy("parent", "key").agg(F.min("conv").alias("node"), F.count("*").alias("members"))
        at = level(step.join(below, ["parent", "key"]), d)
        levels.append(at)

    under = None
    for d, at in reversed(list(enumerate(levels))):
        nodes = at.where("conv = node")
        alone, more = c("members") == 1, c("n") > d
        sums = nodes if under is None else nodes.join(under.groupBy(c("parent_conv_id").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "node", "left")
        got = (lambda name: F.lit(None).cast("long")) if under is None else c  # the deepest level has nothing below that was grouped
        under = scratch.put(sums.select(
            c("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), c("parent").alias("parent_conv_id"), c("members").alias("n_convs"),
            F.when(alone, more.cast("long")).otherwise(F.coalesce(got("children"), F.lit(0))).cast("long").alias("n_children"),
            F.when(alone, 1).otherwise(F.coalesce(got("leaves"), F.lit(1))).cast("long").alias("n_leaves"),
            ((c("members") - 1) * c("bytes") + F.coalesce(got("saved"), F.lit(0))).cast("long").alias("saved_tokens"),
        ), f"rolled/level={d}")

    everyone = spark.read.schema("conv long, n long, node long, parent long, members long, bytes long, depth long").parquet(f"{scratch.root}/levels")
    rolled = spark.read.schema(", ".join(NODES.split(", ")[:-1])).parquet(f"{scratch.root}/rolled")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    closed = ends(everyone.where("n = depth").select("depth", "node", "conv")).withColumnRenamed("node", "conv_id")
    rolled = rolled.join(closed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    alone = everyone.where("members = 1 and n > depth").select("conv", "n", c("depth").alias("above"))
    chain = turns.join(alone, "conv").where("depth > above")
    own = F.when(c("n") == c("depth"), F.sha2(c("conv").cast("string").cast("binary"), 256)).otherwise(nothing)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = chain.select(c("conv").alias("conv_id"), "depth", c("conv").alias("parent_conv_id"), one.alias("n_convs"), (c("n") > c("depth")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), own.alias("ends_sha256"))
    # A chain hangs on the node where its conversation is alone, whose smallest conversation is itself.
    return scratch.put(rolled.select(*chain.columns).unionByName(chain), "nodes")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, rebuild=whole) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``conversations`` has conv_id, turn, role and text. ``rebuild`` makes (turns, conversations) of turns with places.
    saved_tokens counts the bytes of UTF-8 of the turns that a shared prefix spares. The nodes are read from a table in
    the scratch folder, which stays.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    try:
        nodes = build(spark, scratch, *rebuild(turns_of(scratch, conversations)))
    except BaseException:
        scratch.drop()
        raise
    for name in ("turns", "rebuilt", "convs", "levels", "rolled"):
        scratch.drop(name)
    return nodes
