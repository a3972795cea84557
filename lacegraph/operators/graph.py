"""The overlap graph as a DataFrame of arcs (u, v, l, ol); vertex = read * 2 + orientation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Options
from ..functions import overlap
from ..functions.scalar import twin
from ..session import cut
from .coverage import classified


def palindromes(rows: DataFrame) -> DataFrame:
    """(read_id) of reads with a dovetail on themselves that covers the same place in reverse, from classified hits."""
    same = (F.col("class") == overlap.DOVETAIL) & F.expr("qid = tid and rev and qs = ts and qe = te")
    return rows.where(same).select(F.col("qid").alias("read_id")).distinct()


def arcs(hits: DataFrame, lengths: DataFrame, options: Options = Options()) -> DataFrame:
    """Arcs of the dovetails between different, unmarked reads; contained queries and palindromes are marked.

    A contained target is marked by the mirrored hit, in which it is the query.
    """
    rows = classified(hits, lengths, options.max_hang, options.int_fraction, options.min_overlap)
    marked = rows.where(F.col("class") == overlap.QUERY_CONTAINED).select(F.col("qid").alias("read_id"))
    gone = marked.unionByName(palindromes(rows)).distinct()
    found = rows.where((F.col("class") == overlap.DOVETAIL) & (F.col("qid") != F.col("tid"))).select("u", "v", "l", "ol")
    return without_reads(found, gone)


def without_reads(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs between reads that are not in (read_id)."""
    for end in ("u", "v"):
        graph = graph.join(gone.select(F.col("read_id").alias("__r")), F.shiftright(end, 1) == F.col("__r"), "left_anti")
    return graph


def first_of_parallel(graph: DataFrame) -> DataFrame:
    """The shortest of the arcs between two vertices."""
    return graph.groupBy("u", "v").agg(F.min(F.struct("l", F.negative("ol").alias("o"))).alias("x")).select("u", "v", "x.l", F.negative("x.o").alias("ol"))


def symmetric(graph: DataFrame) -> DataFrame:
    """Arcs u -> v whose twin v^1 -> u^1 exists."""
    back = graph.select(twin(F.col("v")).alias("u"), twin(F.col("u")).alias("v")).distinct()
    return graph.join(back, ["u", "v"], "left_semi")


def symmetrised(graph: DataFrame) -> DataFrame:
    return symmetric(first_of_parallel(graph))


def closed_walks(graph: DataFrame) -> DataFrame:
    """(u, w, x, l1, l2) of walks u -> w -> x whose ends an arc u -> x joins.

    Each is found from that of its three vertices with the fewest arcs: of a vertex only the arcs to vertices with more
    (or as many and a larger number) are paired, at most about the square root of twice the arcs, and the third arc is
    looked up. So neither a hub's square nor its whole neighbourhood is ever made. Walks over loops are found apart.
    """
    c = F.col
    graph = cut(graph.select("u", "v", "l"))  # read for each role of a vertex
    plain, loops = graph.where("u <> v"), graph.where("u = v").select(c("u").alias("o"), c("l").alias("lo"))
    size = plain.select(F.explode(F.array("u", "v")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    sized = plain.join(size.select(c("p").alias("u"), c("n").alias("nu")), "u").join(size.select(c("p").alias("v"), c("n").alias("nv")), "v")
    first = F.struct("nu", "u") < F.struct("nv", "v")
    low = cut(sized.select(F.when(first, c("u")).otherwise(c("v")).alias("p"), F.when(first, c("v")).otherwise(c("u")).alias("q"), first.alias("out"), "l"))
    out, into = low.where("out").select("p", "q", "l"), low.where("not out").select("p", "q", "l")
    other = lambda df: df.select("p", c("q").alias("r"), c("l").alias("m"))
    arc = lambda a, b, name: plain.select(c("u").alias(a), c("v").alias(b), c("l").alias(name))
    at_u = out.join(other(out), "p").where("q <> r").select(c("p").alias("u"), c("q").alias("w"), c("r").alias("x"), c("l").alias("l1")).join(arc("w", "x", "l2"), ["w", "x"])
    at_w = into.join(other(out), "p").where("q <> r").select(c("q").alias("u"), c("p").alias("w"), c("r").alias("x"), c("l").alias("l1"), c("m").alias("l2")).join(arc("u", "x", "l"), ["u", "x"])
    at_x = into.join(other(into), "p").where("q <> r").select(c("q").alias("u"), c("r").alias("w"), c("p").alias("x"), c("m").alias("l2")).join(arc("u", "w", "l1"), ["u", "w"])
    rows = [at_u, at_w, at_x]
    if loops.isEmpty():
        return _all(rows)
    over_w = plain.join(loops, c("v") == c("o")).select("u", c("v").alias("w"), c("v").alias("x"), c("l").alias("l1"), c("lo").alias("l2"))
    over_u = loops.join(graph.select("u", "v", "l"), c("u") == c("o")).select("u", c("u").alias("w"), c("v").alias("x"), c("lo").alias("l1"), c("l").alias("l2"))
    back = plain.join(arc("v", "u", "l2"), ["u", "v"]).join(loops.select(c("o").alias("u")), "u", "left_semi").select("u", c("v").alias("w"), c("u").alias("x"), c("l").alias("l1"), "l2")
    return _all([*rows, over_w, over_u, back])


def _all(walks: list[DataFrame]) -> DataFrame:
    found, *rest = (w.select("u", "w", "x", "l1", "l2") for w in walks)
    for more in rest:
        found = found.unionByName(more)
    return found


#: Walks of one vertex that are folded in one row; those of a vertex with more are decided in rounds.
FOLDED_WALKS = 10_000


def transitive(graph: DataFrame, fuzz: int) -> DataFrame:
    """(u, v) of arcs that a walk over a nearer neighbour replaces.

    Neighbours are taken by ascending length; one that is already reduced reduces no other. Arcs go only after all are
    judged, so each vertex is independent. Its walks within the longest arc plus ``fuzz`` are folded in order. Those of a
    hub are decided by joins: a neighbour stays active if no active one before it reaches it, and all whose earlier ones
    are decided are decided at once.
    """
    longest = graph.groupBy("u").agg((F.max("l") + fuzz).alias("most"))
    walks = cut(closed_walks(graph).join(longest, "u").where("l1 + l2 <= most").select("u", "w", "l1", "x"))
    hubs = cut(walks.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > FOLDED_WALKS).select("u"))
    wide = not hubs.isEmpty()
    steps = (walks.join(hubs, "u", "left_anti") if wide else walks).groupBy("u", "w", "l1").agg(F.collect_set("x").alias("ends"))
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.struct("l1", "w", "ends"))), F.array().cast("array<bigint>"),
        lambda gone, s: F.when(F.array_contains(gone, s["w"]), gone).otherwise(F.array_union(gone, s["ends"])),
    )
    gone = steps.groupBy("u").agg(fold.alias("gone")).select("u", F.explode("gone").alias("v"))
    return gone.unionByName(_by_rounds(walks.join(hubs, "u", "left_semi"))) if wide else gone


def _by_rounds(walks: DataFrame) -> DataFrame:
    """The same for walks (u, w, l1, x) of hubs, by deciding which first steps are active."""
    c = F.col
    steps = cut(walks.select("u", "w", "l1").distinct())
    after = walks.join(steps.select("u", c("w").alias("x"), c("l1").alias("lx")), ["u", "x"]).where(F.struct("l1", "w") < F.struct("lx", "x"))
    before = cut(after.select("u", "w", "l1", "x", "lx").distinct())  # (w, l1) comes before (x, lx) and reaches it
    active, left = None, steps
    while True:
        free = cut(left.join(before.select("u", c("x").alias("w"), c("lx").alias("l1")), ["u", "w", "l1"], "left_anti"))
        active = free if active is None else cut(active.unionByName(free))
        hit = before.join(free, ["u", "w", "l1"], "left_semi").select("u", c("x").alias("w"), c("lx").alias("l1")).distinct()
        left = cut(left.join(free, ["u", "w", "l1"], "left_anti").join(hit, ["u", "w", "l1"], "left_anti"))
        if left.isEmpty():
            return walks.join(active, ["u", "w", "l1"], "left_semi").select("u", c("x").alias("v")).distinct()
        still = before.join(left, ["u", "w", "l1"], "left_semi")
        before = cut(still.join(left.select("u", c("w").alias("x"), c("l1").alias("lx")), ["u", "x", "lx"], "left_semi"))


def reduced(graph: DataFrame, fuzz: int) -> DataFrame:
    """Transitive reduction, then symmetry again."""
    return symmetrised(graph.join(transitive(graph, fuzz), ["u", "v"], "left_anti"))


def short_overlaps(graph: DataFrame, ratio: float) -> DataFrame:
    """Arcs whose overlap is below the rounded share of the vertex's longest overlap; the longest never is."""
    w = Window.partitionBy("u").orderBy("l", "v")
    best = F.first("ol").over(w)
    least = ((best.cast("float") * F.lit(float(np.float32(ratio))).cast("float")).cast("double") + F.lit(0.499)).cast("int")
    return graph.withColumn("__least", least).withColumn("__n", F.row_number().over(w)).where("__n > 1 and ol < __least").select("u", "v", "l", "ol")


def without_short(graph: DataFrame, ratio: float) -> DataFrame:
    return symmetrised(graph.join(short_overlaps(graph, ratio), ["u", "v"], "left_anti"))


#: How a walk goes on from a vertex, by number.
END_TYPES = ["TIP", "MULTI_OUT", "MULTI_NEI", "MERGEABLE"]


def _end_kinds(graph: DataFrame) -> DataFrame:
    """(vertex, degree, next, kind), the kind as a place in ``END_TYPES``.

    Arcs are shuffled once, by read: a read's row holds degree and least next vertex of both its vertices. So one lookup of
    the next vertex's read tells whether that has several arcs back.
    """
    c = F.col
    ends = graph.select(F.explode(F.array(F.struct(c("u").alias("x"), c("v").alias("next")), F.struct(c("v").alias("x"), F.lit(None).cast("long").alias("next")))).alias("e")).select("e.x", "e.next")
    sides = [F.when(c("x").bitwiseAND(F.lit(1)) == side, c("next")) for side in (0, 1)]
    reads = ends.groupBy(F.shiftright("x", 1).alias("read")).agg(*(f(s).alias(f"{n}{i}") for i, s in enumerate(sides) for n, f in (("d", F.count), ("n", F.min))))
    both = reads.select(F.explode(F.array(*(F.struct((c("read") * 2 + i).alias("vertex"), c(f"d{i}").alias("degree"), c(f"n{i}").alias("next")) for i in (0, 1)))).alias("e")).select("e.*")
    # A vertex without a single next one looks itself up, so that no task gets all of these.
    both = both.withColumn("__at", F.when(c("degree") == 1, F.shiftright("next", 1)).otherwise(F.shiftright("vertex", 1)))
    rows = both.join(reads.select(c("read").alias("__at"), "d0", "d1"), "__at")
    back = F.when(c("next").bitwiseAND(F.lit(1)) == 0, c("d1")).otherwise(c("d0"))
    kind = F.when(c("degree") == 0, 0).when(c("degree") > 1, 1).when(back > 1, 2).otherwise(3)
    return rows.select("vertex", "degree", "next", kind.cast("byte").alias("kind"))


def _end_type(kind: Column) -> Column:
    return F.get(F.array(*map(F.lit, END_TYPES)), kind.cast("int"))


def end_types(graph: DataFrame) -> DataFrame:
    """(vertex, degree, type): how a walk goes on from each vertex.

    TIP without an arc, MULTI_OUT with several, MULTI_NEI when the only next vertex has several arcs back, else MERGEABLE.
    """
    return _end_kinds(graph).select("vertex", "degree", _end_type(F.col("kind")).alias("type"))


def degrees(graph: DataFrame) -> DataFrame:
    """(vertex, degree) of vertices with arcs."""
    return graph.groupBy(F.col("u").alias("vertex")).agg(F.count("*").alias("degree"))


def walks(graph: DataFrame, most: int) -> DataFrame:
    """(vertex, last, steps, type): the walk of up to ``most`` mergeable steps from each vertex, and how it ends.

    A walk that has ended looks up its own start in a later step, so that no task gets all of these. Reads ``graph`` once.
    """
    c = F.col
    kinds = cut(_end_kinds(graph).select("vertex", "kind", F.when(c("kind") == 3, c("next")).alias("next")))  # read for each step
    at = kinds.select("vertex", c("vertex").alias("last"), F.lit(0).cast("long").alias("steps"), "kind", "next")
    here = kinds.select(c("vertex").alias("__x"), c("kind").alias("__kind"), c("next").alias("__next"))
    for _ in range(most):
        moved = at.join(here, F.coalesce("next", "vertex") == c("__x"))
        on = c("next").isNotNull()
        at = moved.select("vertex", F.when(on, c("__x")).otherwise(c("last")).alias("last"), (c("steps") + on.cast("long")).alias("steps"), F.when(on, c("__kind")).otherwise(c("kind")).alias("kind"), F.when(on, c("__next")).alias("next"))
    return at.select("vertex", "last", "steps", _end_type(c("kind")).alias("type"))
