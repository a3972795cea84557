"""Reads that arrive as files: each micro-batch is sketched as it comes, as a block of a batch run is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Options
from ..operators.sketch import minimizers


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """(read_id, seq) from Parquet files that are added to a folder."""
    return spark.readStream.schema("read_id BIGINT, seq STRING").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sketch_stream(reads: DataFrame, target: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Append the minimizers of new reads to a Parquet table; each read is taken once, also after a restart."""
    return minimizers(reads, options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
