"""A simulated genome: reads of both strands must come back as one unitig of about the genome's length."""

import random

import pytest

from lacegraph.config import Options
from lacegraph.plans import pipeline
from lacegraph.sources import fasta, tables


def simulate(n, depth, circular, seed=3):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(n))
    around = genome + genome if circular else genome
    reads, step = [], 1500 // depth
    for i in range(0, n if circular else n - 1200, step):
        size = rng.randint(1200, 1800)
        r = around[i : i + size]
        reads.append(r[::-1].translate(str.maketrans("ACGT", "TGCA")) if rng.random() < 0.5 else r)
    return reads


OPTIONS = Options(min_span=300, min_match=60, min_overlap=300, max_hang=150, gap_fuzz=150)


@pytest.mark.parametrize("circular", [False, True])
def test_genome(spark, tmp_path, circular):
    reads = simulate(12000, 10, circular)
    (tmp_path / "reads.fa").write_text("".join(f">r{i}\n{r}\n" for i, r in enumerate(reads)))
    out = str(tmp_path / "aligned")
    pipeline.run(spark, "align", str(tmp_path / "reads.fa"), out, OPTIONS)
    hits = tables.read_hits(spark, f"{out}/hits").collect()
    assert {(h.qid, h.qs, h.tid, h.ts, h.rev) for h in hits} == {(h.tid, h.ts, h.qid, h.qs, h.rev) for h in hits}  # mirrored
    assert tables.read_lengths(spark, f"{out}/lengths").count() == len(reads)
    got = pipeline.assemble(tables.read_hits(spark, f"{out}/hits"), OPTIONS)
    found = got.unitigs.collect()
    assert len(found) == 1 and found[0].circ == circular
    assert abs(found[0].len - 12000) < (300 if circular else 1500)
    arcs = {(a.u, a.v) for a in got.graph.collect()}
    assert arcs == {(v ^ 1, u ^ 1) for u, v in arcs}
    lines = [r.line for r in got.lines.orderBy("section", "utg_id", "place").collect()]
    assert [x[0] for x in lines] == ["S"] + ["a"] * len(found[0].reads) + ["x"]
    assert lines[0] == f"S\tutg000001{'c' if circular else 'l'}\t*\tLN:i:{found[0].len}"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGT\n>b\nGG\n")
    got = [(r.read_id, r.header, r.seq, r.len, r.file_off, r.cum_off) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("read_id").collect()]
    assert got == [(0, ">a", "ACGT", 4, 3, 0), (1, ">b", "GG", 2, 11, 4)]
    (tmp_path / "odd.fa").write_text(">a\nACGT\n>b\n")
    with pytest.raises(Exception, match="odd number of lines"):
        fasta.read_fasta(spark, str(tmp_path / "odd.fa")).collect()


def test_partition_count_does_not_matter(spark):
    reads = spark.createDataFrame(list(enumerate(simulate(5000, 8, False))), "read_id long, seq string")
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted(map(tuple, pipeline.align(reads.repartition(n), OPTIONS).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and results[0]


def test_unknown_phase(spark):
    with pytest.raises(ValueError):
        pipeline.run(spark, "other", "a", "b")
