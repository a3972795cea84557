"""MinHash near-duplicates with odd sketches.

One Arrow pass makes, of each text's distinct word shingles, 512 MinHash samples, the keys of 32 bands of four samples,
and the odd sketch: a 1024-bit parity bitmap into which every sample is folded. The XOR population count of two odd
sketches estimates a high similarity precisely, so most banded candidates fall without a look at their texts; those that
stay are confirmed on the full shingle sets.

Groups of copies never meet pairwise. Equal sets are one class with one representative. In each band bucket every
member is first compared with the bucket's hub, the member that shares most buckets; links make components. Buckets that
still hold several components are split by their members' rarest shingles: of two sets that are similar enough, the
rarest shingles of the smaller one, 2p/(1+p) of it left out, and those of the larger one, p of it left out, have one in
common (p the least similarity; any order of all shingles does). So members that share a template, but less than p,
don't meet, however many they are. Those that do are held to two bounds that no link exceeds: what the shingle's places
leave of both sets, and the XOR population count of a second odd sketch, of all shingles instead of samples, which is
never more than the number of shingles that only one of the sets has. So no link is lost by the split.

A pair of similarity 0.8 shares a band with probability 1 - 4.6e-8. Its estimate, of standard deviation 0.02, falls below
``LEAST`` with 6.3e-10 (the sketch's exact distribution), so the sketch loses far less than the bands do, and below
``HUB_LEAST`` with 1e-14. With ``exact`` all sets, crowded or not, meet by their rarest shingles and no estimate is
asked, so nothing is lost at all.

Defined results: null and empty texts (and texts of white space) have an empty set, link with nothing and are kept; a
text of fewer words than a shingle is one shingle; very long texts are read whole; equal texts are linked, and of a
group that with the smallest id is kept; rows that share an id are one document; a row without an id links with nothing;
A-Z only are lower-cased; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.components import components as connected
from .common import Scratch, cut, lists_of, map_arrow

SAMPLES, BANDS, BAND_ROWS, BITS = 512, 32, 4, 1024
#: Estimated similarity from which a candidate is confirmed: of a hub and of other pairs.
HUB_LEAST, LEAST = 0.6, 0.65
#: Rows of one id each, so at most a few megabytes.
BROADCAST_ROWS = 500_000
_WORDS_KEPT = 200_000

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)
_MUL = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_FOLD = _rng.integers(0, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ``known`` keeps word hashes."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > _WORDS_KEPT:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    h, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(out, ((h[at : at + 1024, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    part = mins[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return _mix((part * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    places = (_mix(mins.astype(np.uint64) * _FOLD) >> np.uint64(54)).astype(np.int64)  # 10 bits: BITS places
    return np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def parity_of(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set: two such differ in no more bits than the sets in elements."""
    places = (hashes >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_bits(similarity: float) -> int:
    """The XOR population count expected at a similarity."""
    return int(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def estimate(bits: int) -> float:
    return max(0.0, 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * bits / BITS, 1e-9)))


def features(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, bands, odd, whole): set size, digest of the set (null if empty), band keys, odd sketches of the samples
    and of the whole set."""

    def make():
        known: dict[bytes, int] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, key, bands, odd, whole = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, width, known)
                n.append(len(h))
                if len(h):
                    mins = samples(h)
                    key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(mins))
                    odd.append(odd_sketch(mins))
                    whole.append(parity_of(h))
                else:
                    for x in (key, bands, odd, whole):
                        x.append(None)
            lists = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *(pa.array(x, lists) for x in (bands, odd, whole))], names=["id", "n", "key", "bands", "odd", "whole"])

        return each

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, make, "id long, n long, key binary, bands array<long>, odd array<long>, whole array<long>")


def _bits(a: str, b: str) -> Column:
    """XOR population count of two odd sketches."""
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return out


def _sizes(a: str, b: str, percent: int) -> Column:
    """What the set sizes allow."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def components(links: DataFrame) -> DataFrame:
    """By star steps at every size: links are many and their groups may be large."""
    return connected(links, one_task_links=0)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets."""
    t = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.select("a", "b").join(t("a"), "a").join(t("b"), "b").select("a", "b", "ta", "tb")

    def make():
        known: dict[bytes, int] = {}
        sets: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if (got := sets.get(text)) is None:
                if len(sets) >= 256:
                    sets.clear()
                got = sets[text] = shingles(text, width, known)
            return got

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = of(x), of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        return each

    return map_arrow(both, make, "a long, b long", rows=256).distinct()


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, h): a row for each distinct shingle of each text, and the size of its set."""

    def make():
        known: dict[bytes, int] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, width, known).view(np.int64) for t in batch.column(1).to_pylist()]
            sizes = [len(s) for s in sets]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists_of(np.concatenate([np.zeros(0, np.int64), *sets]), sizes, pa.int64())], names=["id", "n", "h"])

        return each

    return map_arrow(texts.select("id", "text"), make, "id long, n long, h array<long>", rows=64).select("id", "n", F.explode("h").alias("h"))


def rare_pairs(texts: DataFrame, labels: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of texts in different components that share one of their rarest shingles, as similar sets must.

    A shingle's frequency among ``texts`` and its hash order all shingles; those of one text only come first and take
    their places without a row. A shingle whose texts are of one component is left out, and texts of a shingle's largest
    component don't meet each other. ``sketches`` holds (id, whole).
    """
    rows = shingle_rows(texts, width)
    often = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "h"))
    least = lambda over, of: F.expr(f"n - ({over} * n + {of} - 1) div {of} + 1")
    rare = rows.join(often, "h").withColumn("place", place).where(F.col("place") <= least(percent, 100))
    rare = rare.select("id", "n", "h", "place", (F.col("place") <= least(2 * percent, 100 + percent)).alias("inner"))
    rare = cut(rare.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    sizes = rare.groupBy("h", "component").agg(F.count("*").alias("k"))
    tops = sizes.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.count("*").alias("m")).where("m > 1").select("h", "top")
    rare = rare.join(tops, "h").join(sketches.select("id", "whole"), "id")
    side = lambda df, x, *more: df.select("h", *more, F.col("id").alias(x), *(F.col(c).alias(c[0] + x) for c in ("n", "place", "component", "inner", "whole")))
    smaller = F.struct("na", "a") < F.struct("nb", "b")
    both = F.expr(f"({percent} * (na + nb) + {100 + percent} - 1) div {100 + percent}")  # the least size of the intersection
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    fits = _sizes("na", "nb", percent) & F.when(smaller, F.col("ia")).otherwise(F.col("ib")) & (left >= both) & (_bits("wa", "wb") <= F.col("na") + F.col("nb") - 2 * both)
    # The smaller of two sets has the shingle among its inner rows. So rows that are inner on neither side must not meet: a
    # row that isn't inner is joined with inner ones alone, an inner one with both.
    other = F.explode(F.when(F.col("inner"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("to")
    left_rows = side(rare.where("component <> top").select("*", other), "a", "to")
    pairs = left_rows.join(side(rare.withColumn("to", F.col("inner")), "b", "to"), ["h", "to"]).where((F.col("ca") != F.col("cb")) & fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(scratch, docs, width, percent, id_col, text_col, exact)


def _near_duplicates(scratch: Scratch, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, exact: bool) -> DataFrame:
    seen = scratch.put(features(docs, width, id_col, text_col), "features")
    classes = cut(seen.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep")))
    reps = seen.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"]).select("id", "n", "bands", "odd", "whole")
    banded = reps.select("id", F.explode("bands").alias("bucket")).distinct()
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    kept = scratch.put(banded.join(crowded, "bucket"), "buckets")
    active = cut((reps if exact else kept).select("id").distinct())
    small = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = scratch.put(texts.join(small, "id"), "texts")
    marks = scratch.put(reps.select("id", "n", "odd", "whole").join(small, "id"), "marks")
    m = lambda x: marks.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
    estimated = lambda pairs, least: pairs.join(m("a"), "a").join(m("b"), "b").where(_sizes("na", "nb", percent) & (_bits("oa", "ob") <= most_bits(least)))

    shared = kept.groupBy("id").agg(F.sum("members").alias("shared"))
    hubs = kept.join(shared, "id").groupBy("bucket").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("hub"))
    stars = kept.join(hubs, "bucket").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = confirm(estimated(stars, HUB_LEAST), texts, width, percent)
    twice = seen.where("key is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    if not twice.isEmpty():  # rows that share an id hold their classes together
        held = seen.join(twice, "id", "left_semi").select("id", "key").join(classes, "key").select("id", F.col("rep").alias("a")).distinct()
        links = links.unionByName(held.join(held.groupBy("id").agg(F.min("a").alias("b")), "id").where("a <> b").select("a", "b"))
    found = cut(components(cut(links)))

    rest = active
    if not exact:
        here = kept.select("id", "bucket").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = here.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
        rest = here.join(mixed, "bucket", "left_semi").select("id").distinct()
    rest = scratch.put(texts.join(rest, "id", "left_semi"), "rest")
    pairs = cut(rare_pairs(rest, found, marks, width, percent))
    more = cut(confirm(pairs if exact else estimated(pairs, LEAST), texts, width, percent))
    if not more.isEmpty():
        found = cut(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "id")
    result = seen.select("id", "n", "key").join(named, "key", "left")
    return cut(result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")))


def drop_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    judged = near_duplicates(docs, width, percent, id_col, text_col)
    gone = cut(judged.where("not kept").select(F.col(id_col).alias("__gone")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, docs[id_col] == gone["__gone"], "left_anti")
