"""Connected components of undirected links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, ship

#: Up to so many links one task joins them in memory (16 bytes a link); beyond, ranges of so many each, then their roots.
ONE_TASK_LINKS, RANGE_LINKS = 500_000, 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a task's links, each with the smallest id that these links join it to."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    ids, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(index, 2)
    label = np.arange(len(ids))
    while True:  # hook to the smaller label, then jump
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def _by_task(e: DataFrame) -> DataFrame:
    ship(e.sparkSession)
    return e.mapInArrow(_joined, "id long, component long")


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _by_stars(e: DataFrame, rounds: int) -> DataFrame:
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    e = cut(e.distinct())
    old = mark(e)
    for _ in range(rounds):
        e = cut(_small(_large(e).distinct()).distinct())
        new = mark(e)
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("components: no fixed point; raise rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task_links: int = ONE_TASK_LINKS, range_links: int = RANGE_LINKS) -> DataFrame:
    """(id, component) of every id with a link to another one; the component is the smallest id that it reaches.

    Self-links and repeated links don't matter; null ends are ignored. Large link sets are dealt in ranges of about
    ``range_links`` links between near ids. Each range joins its own; an id that two ranges join to different roots links
    these roots, and the roots' links, mostly few, are joined the same way. Where that leaves more than half of the links
    (ids that say nothing of nearness), alternating large-star and small-star steps, checkpointed, do the rest. No link
    comes to the driver.
    """
    e = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")))
    n = e.count()
    if n <= one_task_links:
        return _by_task(e.repartition(1))
    own = cut(_by_task(e.repartitionByRange(-(-n // range_links), "v", "u")))
    ids = cut(own.groupBy("id").agg(F.min("component").alias("root"), F.max("component").alias("other")))
    split = ids.where("root <> other").select("id", "root")
    left = cut(own.join(split, "id").where("component <> root").select(F.col("component").alias("u"), F.col("root").alias("v")).distinct())
    more = left.count()
    if not more:
        return ids.select("id", F.col("root").alias("component"))
    over = _by_stars(left, rounds) if 2 * more > max(n, 2 * one_task_links) else components(left, "u", "v", rounds, one_task_links, range_links)
    over = over.select(F.col("id").alias("root"), F.col("component").alias("c"))
    return ids.join(over, "root", "left").select("id", F.coalesce("c", "root").alias("component"))
