"""An index of minimizers that is kept and probed by other reads.

The capped minimizers of the target reads are written once as a table bucketed and sorted by hash. A probe shuffles only
the minimizers of its own reads, into the same buckets; the index is read bucket by bucket where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Options
from ..functions.scalar import diagonal, hash32
from .seeds import capped


def write_index(minis: DataFrame, table: str, options: Options = Options(), buckets: int = 64, path: str | None = None) -> None:
    """Write (hash, read_id, pos, strand) of the hashes within the cap as a bucketed table, under ``path`` if given."""
    rows = capped(minis, options).select("hash", "read_id", "pos", "strand").repartition(buckets, "hash")
    writer = rows.write.format("parquet").bucketBy(buckets, "hash").sortBy("hash").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def probe(spark: SparkSession, table: str, minis: DataFrame, same_reads: bool = False) -> DataFrame:
    """(qid, tid, rev, diag, j, qpos, rpos): shared minimizers of the given reads (with their rank j) and the indexed ones.

    With ``same_reads`` the ids are those of the index: a place isn't paired with itself, and an unordered pair is made
    once, as in ``seeds``. No hash of the index has more rows than its cap.
    """
    q = minis.select("hash", F.col("read_id").alias("qid"), F.col("pos").alias("qpos"), F.col("strand").alias("qs"), "j")
    t = spark.table(table).select("hash", F.col("read_id").alias("tid"), F.col("pos").alias("rpos"), F.col("strand").alias("ts"))
    pairs = q.join(t.hint("merge"), "hash")
    if same_reads:
        pairs = pairs.where((hash32(F.col("qid")) >= hash32(F.col("tid"))) & ~((F.col("qid") == F.col("tid")) & (F.col("qpos") == F.col("rpos"))))
    same = F.col("qs") == F.col("ts")
    return pairs.select("qid", "tid", (~same).alias("rev"), diagonal(same, F.col("qpos"), F.col("rpos")).alias("diag"), "j", "qpos", "rpos")
