"""Session and lineage helpers."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

LOG = logging.getLogger("lacegraph")


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that this engine expects; a cluster's own settings win."""
    b = SparkSession.builder.appName("lacegraph")
    b = b.master(master) if master else b
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}.items():
        b = b.config(key, value)
    for key, value in conf.items():
        b = b.config(key.replace("_", "."), value)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode (tests) where none is set."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return jsc.getCheckpointDir().get()


class Scratch:
    """Compressed intermediate tables in the shared folder, removed once they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of an estimated size beyond which it tells nothing any more.
SIZE_BITS = 62


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; it survives the loss of executors.

    A checkpoint keeps the size that Spark estimated for its plan, which of a join is the product of both sides. Over rounds of
    joins its digits double each round, until planning takes minutes; so an estimate beyond any size is left behind too.
    What was shuffled for it is removed at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made
    finally:
        spark.conf.set(CLEANUP, before)
    plan = out._jdf.queryExecution()
    try:
        if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= SIZE_BITS:
            return out
    except ValueError:  # of more digits than Python reads
        pass
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


class Counters:
    """Counts of rows as they pass, taken by ``observe`` while the job that makes them runs; nothing is computed twice."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **more: Column) -> DataFrame:
        """``df``; once a job has read it all, ``values`` holds its number of rows and what else was asked for."""
        self.seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items()))

    def values(self) -> dict[str, dict]:
        """Of each watched name; waits for jobs that still run."""
        return {name: seen.get for name, seen in self.seen.items()}

    def log(self) -> None:
        for name, got in self.values().items():
            LOG.info("%s: %s", name, ", ".join(f"{k} {v}" for k, v in got.items()))


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package from a source tree (a cluster has it installed)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
