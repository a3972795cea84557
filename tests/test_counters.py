"""Counts of rows as they pass, stored sizes, and options that act."""

import logging

from pyspark.sql import functions as F

from lacegraph.plans import pipeline
from lacegraph.session import LOG, Counters, cut
from lacegraph.sources import fasta, tables

from .test_end_to_end import OPTIONS, simulate


def test_counters_see_what_a_job_reads(spark):
    counters = Counters()
    kept = cut(counters.watch(spark.range(1000), "ids", total=F.sum("id")).where("id < 10"))
    assert kept.count() == 10 and counters.values() == {"ids": {"rows": 1000, "total": 499500}}


def test_phases_count_and_log(spark, tmp_path, caplog):
    reads = simulate(5000, 8, False)
    (tmp_path / "reads.fa").write_text("".join(f">r{i}\n{r}\n" for i, r in enumerate(reads)))
    out, old = str(tmp_path / "aligned"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    with caplog.at_level(logging.INFO, LOG.name):
        pipeline.run(spark, "align", str(tmp_path / "reads.fa"), out, OPTIONS.but(block_bases=1 << 14))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == old
    hits = tables.read_hits(spark, f"{out}/hits")
    assert f"reads: rows {len(reads)}, bases {sum(map(len, reads))}, longest {max(map(len, reads))}" in caplog.messages and f"hits: rows {hits.count()}" in caplog.messages
    stats = tables.storage_stats(spark, f"{out}/hits", 41)
    assert stats["items"] == hits.count() and stats["blocks"] >= 1 and abs(stats["factor"] * stats["bytes"] - 41 * stats["items"]) < 1
    counters = Counters()
    got = pipeline.assemble(hits, OPTIONS, counters)
    seen = counters.values()
    assert seen["arcs left"]["rows"] == got.graph.count() <= seen["arcs"]["rows"] and seen["unitigs"]["rows"] == got.unitigs.count() and seen["links"]["rows"] == got.links.count()


def test_block_size_sets_the_splits(spark, tmp_path):
    (tmp_path / "reads.fa").write_text("".join(f">r{i}\n{'acgt' * 50}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    parts = []
    for size in (1 << 14, 1 << 26):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        parts.append(spark.read.text(str(tmp_path)).rdd.getNumPartitions())
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts[0] > parts[1]
    assert fasta.read_fasta(spark, str(tmp_path)).count() == 500
