"""Tables between the phases: hits and read lengths as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def write_hits(hits: DataFrame, path: str, partitions: int | None = None) -> None:
    """Hits dealt by query, so that a later grouping by query reads neighbours together."""
    rows = hits.repartition(partitions, "qid") if partitions else hits.repartition("qid")
    rows.sortWithinPartitions("qid", "qs").write.mode("overwrite").parquet(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HITS).parquet(path)


def write_lengths(reads: DataFrame, path: str) -> None:
    reads.select("read_id", "len").write.mode("overwrite").parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("read_id BIGINT, len INT").parquet(path)


def storage_stats(spark: SparkSession, path: str, item_bytes: int) -> dict[str, float]:
    """items, blocks (files), bytes and factor (how much smaller than ``item_bytes`` an item is stored) of a written table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    sizes = [f.getLen() for f in system.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
    items = spark.read.parquet(path).count()  # from the footers
    return {"items": items, "blocks": len(sizes), "bytes": sum(sizes), "factor": items * item_bytes / max(sum(sizes), 1)}
