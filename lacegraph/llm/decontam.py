"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is the hash of the words under the ones of a fixed mask, so that a changed word under a zero does not matter and
one under a one spoils few seeds. Seeds of documents and of benchmark items are joined; each hit fixes an alignment
(document, item, offset). An alignment is verified by comparing the words around the hit: it is an overlap if some
window of ``WINDOW`` words (or the whole item, if shorter) agrees in at least ``AGREE`` of its words. The masks are complete:
whichever 2 of 13 words are changed, one of ``SEEDS`` keeps a place without a changed word, and so does one of
``SHORT_SEEDS`` for each change that ``AGREE`` allows in an item of 5 to 12 words; an item of up to 4 words allows none and
is sought whole. So no overlap is missed.

Words are lower-cased and stripped of all but letters and digits, so punctuation and case don't hide a passage.

Defined results: null and empty texts and items, and items without a letter or digit, overlap with nothing; very long
texts are searched whole; rows that share an id are judged together; equal items are reported each; items of fewer than
``least_words`` words are left out (default 1: none, but a corpus may hold very short ones by chance); an empty table on
either side gives no overlap; a row without an id is judged clean. The benchmark's seeds are broadcast up to
``BROADCAST_ROWS`` rows of three numbers each, items up to as many words, else both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

# Masks over word positions. SEEDS have six ones, complete together for 11 of 13 words; SHORT_SEEDS three,
# for items under 13 words; WHOLE are for items of up to 4 words. The latter two are hashed only if there are such items.
SEEDS, SHORT_SEEDS, WHOLE = ("1111101", "1011000111"), ("1101", "1011"), ("1", "11", "111", "1111")
WINDOW, AGREE = 13, 0.8
BROADCAST_ROWS, HIT_ROWS = 1_000_000, 100_000


def word_hashes(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]+", ""), "\\s+", " "))
    return F.when(F.length(clean) > 0, F.transform(F.split(clean, " "), lambda w: F.xxhash64(w)))


def _seeds(rows: DataFrame, key: str, h: str, masks: dict[int, str]) -> DataFrame:
    """(key, pos, seed): a row for each place of each mask, reading the rows once; the mask's number is hashed too."""
    def of(number: int, mask: str) -> Column:
        ones = [j for j, c in enumerate(mask) if c == "1"]
        at = lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in ones], F.lit(number))
        return F.when(F.size(h) >= len(mask), F.transform(F.sequence(F.lit(0), F.size(h) - len(mask)), at)).otherwise(F.array().cast("array<bigint>"))

    each = rows.select(key, F.explode(F.array(*[of(n, m) for n, m in masks.items()])).alias("__seeds"))
    return each.select(key, F.posexplode("__seeds").alias("pos", "seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = SEEDS, window: int = WINDOW, agree: float = AGREE, least_words: int = 1) -> DataFrame:
    """(doc, item, matched): each document that overlaps an item, with the most words that agree on one alignment."""
    items = cut(benchmark.select(F.col(item_col).cast("long").alias("item"), word_hashes(F.col(item_text).cast("string")).alias("b")).where(F.size("b") >= least_words))
    spaced, more = dict(enumerate(masks)), {}
    known = _seeds(items.where(F.size("b") >= window), "item", "b", spaced)
    lengths = {r.n for r in items.where(F.size("b") < window).select(F.size("b").alias("n")).distinct().collect()}  # at most as many as the window has words
    for low, high, of in [(5, window - 1, SHORT_SEEDS), *((len(m), len(m), (m,)) for m in WHOLE)]:
        if any(low <= n <= high for n in lengths):
            own = {len(masks) + len(more) + i: m for i, m in enumerate(of)}
            known = known.unionByName(_seeds(items.where(F.size("b").between(low, high)), "item", "b", own))
            more |= own
    known = cut(known.select("item", F.col("pos").alias("at"), "seed"))
    n, total = known.count(), items.agg(F.coalesce(F.sum(F.size("b")), F.lit(0))).first()[0]
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).where("t is not null and doc is not null")
    hashed = lambda df: df.select("doc", word_hashes(F.col("t")).alias("d"))
    found = _seeds(hashed(texts), "doc", "d", spaced | more).join(F.broadcast(known) if n <= BROADCAST_ROWS else known, "seed")
    hits = cut(found.select("doc", "item", (F.col("pos") - F.col("at")).alias("off")).distinct())
    few = hits.count() <= HIT_ROWS
    near = F.broadcast(hits) if few else hits
    hit = hits.select("doc").distinct()
    pairs = hashed(texts.join(F.broadcast(hit) if few else hit, "doc", "left_semi")).join(near, "doc")  # only texts with a hit are hashed again
    pairs = pairs.join(F.broadcast(items) if total <= BROADCAST_ROWS else items, "item")
    first, end = F.greatest(F.lit(0), -F.col("off")), F.least(F.size("b"), F.size("d") - F.col("off"))
    same = F.transform(F.sequence(F.col("first"), F.col("end") - 1), lambda i: F.when(F.get(F.col("d"), i + F.col("off")) == F.get(F.col("b"), i), 1).otherwise(0))
    pairs = pairs.select("doc", "item", "off", "b", "d", first.alias("first"), end.alias("end")).withColumn("w", F.least(F.lit(window), F.size("b"))).where("end - first >= w").withColumn("same", same).select("doc", "item", "same", "w")
    count = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    good = F.exists(F.sequence(F.lit(1), F.size("same") - F.col("w") + 1), lambda s: count(F.slice("same", s, F.col("w"))) >= F.ceil(F.col("w") * F.lit(agree)))
    return pairs.where(good).groupBy("doc", "item").agg(F.max(count(F.col("same"))).cast("long").alias("matched")).withColumnsRenamed({"doc": id_col, "item": item_col})


def judge(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id, contaminated, n_items, items): one row for each row of ``docs``."""
    lists = found.groupBy(id_col).agg(F.array_sort(F.collect_set(item_col)).alias("items"))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col)).join(lists, id_col, "left")
    return rows.select(id_col, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.array_join(F.coalesce("items", F.array().cast("array<bigint>")), ",").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of ``docs`` that overlap no item."""
    bad = cut(overlaps(docs, benchmark, id_col, **more).select(F.col(id_col).alias("__bad")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, docs[id_col] == bad["__bad"], "left_anti")
