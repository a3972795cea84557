"""Hand-worked cases and brute force for the engine's operators."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacegraph.config import Options, next_power_of_two, size_in_bytes
from lacegraph.functions import overlap, scalar
from lacegraph.operators import chain, coverage, graph, ordered, seeds, simplify, sketch
from lacegraph.operators.components import components

HIT = "qid long, qs int, qe int, tid long, ts int, te int, rev boolean, ml int, bl int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    "ql, tl, q, t, rev, expected",
    [
        (10000, 10000, (6000, 10000), (0, 4000), False, ("ARC", 2, 4, 6000, 4000)),
        (10000, 10000, (0, 4000), (6000, 10000), False, ("ARC", 3, 5, 6000, 4000)),
        (3000, 10000, (0, 3000), (2000, 5000), False, ("QCONT", None, None, None, None)),
        (10000, 3000, (2000, 5000), (0, 3000), True, ("TCONT", None, None, None, None)),
        (10000, 10000, (3000, 6000), (3000, 6000), False, ("INT", None, None, None, None)),
        (10000, 10000, (8500, 10000), (0, 1500), False, ("SHORT", None, None, None, None)),
    ],
)
def test_classifier(spark, ql, tl, q, t, rev, expected):
    df = spark.createDataFrame([(1, q[0], q[1], 2, t[0], t[1], rev, 100, 100, ql, tl)], HIT + ", ql int, tl int")
    got = df.select(*(c.alias(n) for n, c in overlap.classify(1000, 0.8, 2000).items())).first()
    assert tuple(got) == expected


@pytest.mark.parametrize(
    "spans, expected",
    [
        ([(0, 100), (10, 90), (20, 120), (200, 300), (210, 310), (220, 330)], (220, 300, False)),
        ([(0, 50)] * 3 + [(50, 100)] * 3, (0, 100, False)),
        ([(0, 100), (10, 90)], (0, 0, True)),
    ],
)
def test_depth(spark, spans, expected):
    df = spark.createDataFrame([(1, s, e, 100 + i, 0, 10, False, 100, 100) for i, (s, e) in enumerate(spans)], HIT)
    r = coverage.depth_regions(df).first()
    assert (r.s, r.e, r["del"]) == expected


def test_depth_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(q, s, s + rng.randint(1, 60), 1000 + i, 0, 10, False, 100, 100) for q in range(40) for i, s in enumerate(rng.choices(range(200), k=rng.randint(1, 14)))]
    got = {r.read_id: (r.s, r.e) for r in coverage.depth_regions(spark.createDataFrame(data, HIT)).collect()}
    for q in range(40):
        depth = np.zeros(300, int)
        for _, s, e, *_ in (d for d in data if d[0] == q):
            depth[s:e] += 1
        best, at = (0, 0), None
        for x in range(300):
            if depth[x] >= 3:
                at = x if at is None else at
            elif at is not None:
                best, at = (at, x) if x - at > best[1] - best[0] else best, None
        assert got[q] == best


def test_cut(spark):
    df = spark.createDataFrame([(1, 400, 5000, 2, 100, 4700, False, 500, 4600)], HIT)
    subs = spark.createDataFrame([(1, 500, 9000, False), (2, 0, 8000, False)], "read_id long, s int, e int, del boolean")
    r = coverage.cut_hits(df, subs).first()
    assert (r.qs, r.qe, r.ts, r.te) == (0, 4500, 200, 4700)
    far = spark.createDataFrame([(1, 0, 3000, 2, 6000, 9000, False, 500, 3000)], HIT)
    narrow = spark.createDataFrame([(1, 0, 9000, False), (2, 0, 4000, False)], "read_id long, s int, e int, del boolean")
    assert coverage.cut_hits(far, narrow).count() == 0


@pytest.mark.parametrize("diags, kept", [([0, 100, 200, 300, 2000, 2100, 2200], [1, 1, 1, 1]), ([0, 150, 300, 450, 600], [1] * 5), ([0, 200, 400, 600, 800], [])])
def test_clusters(spark, diags, kept):
    df = spark.createDataFrame([(1, 2, False, d, i, i, i) for i, d in enumerate(diags)], "qid long, tid long, rev boolean, diag long, j int, qpos int, rpos int")
    assert [r.cluster for r in chain.clusters(df).collect()] == kept


def test_clusters_equal_union_of_windows(spark):
    rng = random.Random(2)
    data = [(q, 0, bool(q % 2), rng.randint(0, 6000), i, i, i) for q in range(60) for i in range(rng.randint(1, 25))]
    got = defaultdict(set)
    for r in chain.clusters(spark.createDataFrame(data, "qid long, tid long, rev boolean, diag long, j int, qpos int, rpos int")).collect():
        got[r.qid, r.cluster].add(r.j)
    groups = sorted((k[0], tuple(sorted(v))) for k, v in got.items())
    expected = []
    for q in range(60):
        own = [d for d in data if d[0] == q]
        sets = [s for d in own if len(s := {x[4] for x in own if d[3] <= x[3] <= d[3] + 500}) >= 4]
        merged = []
        for s in sets:
            for m in [m for m in merged if m & s]:
                merged.remove(m)
                s = s | m
            merged.append(s)
        expected += [(q, tuple(sorted(m))) for m in merged]
    assert groups == sorted(expected)


def test_longest_increasing():
    assert [[5, 1, 6, 2, 7][i] for i in chain.longest_increasing([5, 1, 6, 2, 7])] == [1, 2, 7]
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randint(0, 20) for _ in range(rng.randint(0, 30))]
        best = [0] * len(values)
        for i, v in enumerate(values):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
        got = [values[i] for i in chain.longest_increasing(values)]
        assert len(got) == max(best, default=0) and all(a < b for a, b in zip(got, got[1:]))


def test_union_length():
    rng = np.random.default_rng(3)
    for _ in range(50):
        p = rng.integers(0, 300, rng.integers(1, 30))
        assert chain.union_length(p, 15) == len({x for s in p for x in range(s, s + 15)})
    assert chain.union_length(np.array([], int), 15) == 0


def test_regions_split_at_gaps(spark):
    far = [(i, i * 20, i * 20) for i in range(6)] + [(i, 20000 + i * 20, 20000 + i * 20) for i in range(6, 12)]
    df = spark.createDataFrame([(1, 2, False, 1, j, q, r) for j, q, r in far], "qid long, tid long, rev boolean, cluster long, j int, qpos int, rpos int")
    got = sorted((r.cnt, r.qs, r.qe, r.rs, r.re) for r in chain.regions(df).collect())
    assert got == [(6, -14, 101, -14, 101), (6, 20106, 20221, 20106, 20221)]


def test_hash_inverse_and_known_value(spark):
    r = spark.createDataFrame([(1073741823,)], "x long").select(scalar.hash64(F.col("x"), 15).alias("h")).first()
    assert r.h == 140824814 == sketch.mix(np.array([1073741823]), 15)[0]
    values = np.random.default_rng(0).integers(0, 1 << 30, 500)
    got = [r.h for r in spark.createDataFrame([(int(v),) for v in values], "x long").select(scalar.hash64(F.col("x"), 15).alias("h")).collect()]
    assert got == sketch.mix(values, 15).tolist()
    assert len(set(sketch.mix(np.arange(1 << 16), 8).tolist())) == 1 << 16  # a bijection


def test_minimizers_brute_force(spark):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGTN" if i % 3 == 0 else "ACGT") for _ in range(n)) for i, n in enumerate([0, 1, 5, 8, 9, 12, 40, 120, 300])] + ["A" * 60, "AC" * 30, "N" * 20, "acgtu" * 9]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    o = Options(k=5, w=4)
    got = {(r.read_id, r.pos, r.strand, r.hash) for r in sketch.minimizers(df, o).collect()}
    code = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}
    expected = set()
    for i, s in enumerate(seqs):
        c = [code.get(b.upper(), 4) for b in s]
        k = {}
        for e in range(4, len(c)):
            w = c[e - 4 : e + 1]
            if max(w) < 4:
                f, r = (sum(x * 4 ** (4 - n) for n, x in enumerate(v)) for v in (w, [3 - x for x in w[::-1]]))
                if f != r:
                    k[e] = (int(sketch.mix(np.array([min(f, r)]), 5)[0]), int(f > r))
        for e in range(len(c)):
            window = [e + n for n in range(4)]
            if all(p in k for p in window):
                low = min(k[p][0] for p in window)
                expected |= {(i, p, k[p][1], low) for p in window if k[p][0] == low}
    assert got == expected
    both = [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in seqs if set(s) <= set("ACGT")]
    forward = {r.hash for r in sketch.minimizers(df.where(~F.col("seq").rlike("[^ACGT]")), o).collect()}
    backward = {r.hash for r in sketch.minimizers(spark.createDataFrame(list(enumerate(both)), "read_id long, seq string"), o).collect()}
    assert forward == backward


def test_occurrence_cap(spark):
    counts = [1] * 990 + [7] * 8 + [50, 60]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "hash long, occ long")
    place = int((1 - float(np.float32(0.001))) * len(counts))
    assert seeds.occurrence_cap(df).first().max_occ == sorted(counts)[place] + 1


def test_prefix_sum_ordinal_blocks(spark):
    df = spark.createDataFrame([(0, 5), (1, 3), (2, 7)], "read_id long, len int")
    assert rows(ordered.prefix_sum(df, "read_id", "len", "c").select("c")) == [(0,), (5,), (8,)]
    far = spark.createDataFrame([(i * 977, i) for i in range(300)], "read_id long, len int")
    got = {r.read_id: (r.c, r.n) for r in ordered.ordinal(ordered.prefix_sum(far, "read_id", "len", "c", rows=16), "read_id", "n").collect()}
    assert got == {i * 977: (sum(range(i)), i) for i in range(300)}
    lens = spark.createDataFrame(list(enumerate([4, 5, 3, 9, 1])), "read_id long, len int")
    assert [tuple(r)[1:] for r in ordered.pack_blocks(lens, 10).orderBy("block_id").collect()] == [(0, 2), (2, 1), (3, 2)]
    assert ordered.pack_blocks(lens.where("read_id < 0"), 10).count() == 0
    assert ordered.prefix_sum(lens.where("read_id < 0"), "read_id", "len", "c").count() == 0


def test_parallel_and_one_sided_arcs(spark):
    df = spark.createDataFrame([(0, 2, 150, 5), (0, 2, 100, 9), (3, 1, 100, 9), (4, 6, 7, 7)], "u long, v long, l int, ol int")
    assert rows(graph.first_of_parallel(df)) == [(0, 2, 100, 9), (3, 1, 100, 9), (4, 6, 7, 7)]
    assert rows(graph.symmetrised(df)) == [(0, 2, 100, 9), (3, 1, 100, 9)]


def twins(arcs):
    return list(dict.fromkeys(arcs + [(v ^ 1, u ^ 1, l, o) for u, v, l, o in arcs]))


ARC = "u long, v long, l int, ol int"


def test_transitive(spark):
    df = spark.createDataFrame(twins([(0, 2, 100, 900), (0, 4, 200, 800), (2, 4, 110, 890)]), ARC)
    assert rows(graph.transitive(df, 1000)) == [(0, 4), (5, 1)]
    rng = random.Random(4)
    arcs = {}
    for _ in range(150):
        u, v = rng.sample(range(40), 2)
        if u ^ v > 1:
            arcs[u, v] = rng.randint(100, 3000)
    data = twins([(u, v, l, 5000 - l) for (u, v), l in arcs.items()])
    best = {}
    for u, v, l, _ in data:
        best[u, v] = min(l, best.get((u, v), l))
    out = defaultdict(dict)
    for (u, v), l in best.items():
        out[u][v] = l
    expected = set()
    for u, ns in out.items():
        gone, most = set(), max(ns.values()) + 1000
        for w, l in sorted(ns.items(), key=lambda x: (x[1], x[0])):
            if w not in gone:
                gone |= {x for x, m in out[w].items() if l + m <= most and x in ns}
        expected |= {(u, x) for x in gone}
    df = spark.createDataFrame([(u, v, l, 5000 - l) for (u, v), l in best.items()], ARC)
    assert set(rows(graph.transitive(df, 1000))) == expected


def test_short_overlaps(spark):
    df = spark.createDataFrame([(0, 2, 6000, 4000), (0, 4, 7500, 2500), (0, 6, 8500, 1500)], ARC)
    assert rows(graph.short_overlaps(df, 0.5).select("ol")) == [(1500,)]
    assert rows(graph.short_overlaps(df, 0.7).select("ol")) == [(1500,), (2500,)]


def test_end_types(spark):
    df = spark.createDataFrame(twins([(0, 2, 1, 9), (0, 4, 1, 9), (6, 4, 1, 9)]), ARC)
    got = {r.vertex: r.type for r in graph.end_types(df).collect()}
    assert got == {0: "MULTI_OUT", 2: "TIP", 4: "TIP", 6: "MULTI_NEI", 1: "TIP", 3: "MULTI_NEI", 5: "MULTI_OUT", 7: "TIP"}


def chain_arcs(n, start=0):
    return [(2 * (start + i), 2 * (start + i + 1), 100, 900) for i in range(n - 1)]


def left(spark, arcs, *passes):
    return {(u, v) for u, v, *_ in rows(simplify.each_component(spark.createDataFrame(twins(arcs), ARC), *passes))}


def test_tips(spark):
    long = chain_arcs(12)
    arcs = long + [(2 * 5, 2 * 50, 100, 900), (2 * 50, 2 * 51, 100, 900)]
    assert left(spark, arcs, ("tip", 4)) == {(u, v) for u, v, *_ in twins(long)}
    branch = [(2 * 5, 2 * 50, 100, 900)] + chain_arcs(6, 50)
    assert left(spark, long + branch, ("tip", 4)) == {(u, v) for u, v, *_ in twins(long + branch)}


def test_bubbles(spark):
    arms = [(2 * 2, 2 * 10, 100, 900), (2 * 10, 2 * 11, 100, 900), (2 * 11, 2 * 4, 100, 900)]
    arcs = chain_arcs(8) + arms
    got = left(spark, arcs, ("bubble", 50000))
    assert got == {(u, v) for u, v, *_ in twins(chain_arcs(8))}  # the way through 20 and 22 is seen first and counts no reads
    assert left(spark, arcs, ("bubble", 150)) == {(u, v) for u, v, *_ in twins(arcs)}


def test_internal_and_biloop(spark):
    a, b = chain_arcs(6), chain_arcs(6, 20)
    bridge = [(2 * 2, 2 * 50, 100, 900), (2 * 50, 2 * 23, 100, 900)]
    assert left(spark, a + b + bridge, ("internal", 1)) == {(u, v) for u, v, *_ in twins(a + b)}
    # both ends of 4 -> 6 are entered from 0; the weaker way in goes, with its twin
    loop = [(2, 0, 100, 900), (0, 4, 100, 900), (4, 6, 100, 900), (0, 7, 300, 700), (6, 8, 100, 900)]
    assert left(spark, loop, ("biloop", 4)) == {(u, v) for u, v, *_ in twins([a for a in loop if a[:2] != (0, 7)])}


def test_unitigs_line_circle_and_links(spark):
    lens = spark.createDataFrame([(i, 1000) for i in range(60)], "read_id long, len int")
    line = spark.createDataFrame(twins(chain_arcs(5)), ARC)
    u = simplify.unitigs(line, lens).collect()
    assert [(r.utg_id, r.len, r.circ, r.start, r.end, [x.vertex for x in r.reads]) for r in u] == [(0, 1400, False, 0, 9, [0, 2, 4, 6, 8])]
    ring = spark.createDataFrame(twins(chain_arcs(5, 10) + [(28, 20, 100, 900)]), ARC)
    u = simplify.unitigs(ring, lens).collect()
    assert [(r.len, r.circ, r.start, len(r.reads)) for r in u] == [(500, True, None, 5)]
    fork = spark.createDataFrame(twins(chain_arcs(3) + [(4, 6, 100, 900), (4, 20, 100, 900), (6, 8, 100, 900), (20, 22, 100, 900)]), ARC)
    found = simplify.unitigs(fork, lens)
    links = rows(simplify.unitig_links(fork, found))
    assert {(u, v) for u, v, *_ in links} == {(0, 2), (0, 4), (3, 1), (5, 1)}
    assert {(v ^ 1, u ^ 1) for u, v, *_ in links} == {(u, v) for u, v, *_ in links}


def test_components_both_ways(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(1000, None), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    par = {}

    def root(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            par[b] = a
    expected = {x: root(x) for x in list(par)}
    for most in (0, 10**6):
        got = {r.id: r.component for r in components(df, one_task_links=most).collect()}
        assert got == {x: c for x, c in expected.items() if x in got} and set(got) == {x for p in links if p[1] is not None and p[0] != p[1] for x in p}
    assert components(df.where("a < 0")).count() == 0


def test_options():
    assert [size_in_bytes(x) for x in ("7", "2k", "64M", "1g")] == [7, 2048, 64 << 20, 1 << 30]
    for bad in ("", "x", "5t", "k", "1.5m"):
        with pytest.raises(ValueError):
            size_in_bytes(bad)
    assert [next_power_of_two(n) for n in (0, 1, 2, 3, 5, 64, 65)] == [1, 1, 2, 4, 8, 64, 128]
    assert Options(block_bases=1 << 40).block_bases == 1 << 30
    with pytest.raises(ValueError):
        Options(k=17)
