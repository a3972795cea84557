"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the k smallest 48-bit hashes of a text's distinct shingles. Sketches merge by taking
the k smallest of their union, so those of parts give that of the whole; they estimate resemblance, containment and the
number of distinct shingles, exactly where a sketch holds fewer than k hashes. As a string a sketch is the hashes as
12 hexadecimal digits each.

Defined results: null and empty texts (and texts of white space) have the empty sketch; two empty sketches are alike
(1), one empty and one not are unlike (0); a text of fewer words than a shingle is one shingle. Rows that share an id
are ordered by the hash of their text, and rows without an id come last. Very long texts are read whole; equal texts have
equal sketches; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import range_bucket

K, SHINGLE_WORDS = 256, 5
_SPAN = float(1 << 48)
#: A successor range holds about so many rows; boundary ids (two numbers each) are broadcast up to so many rows.
BUCKET_ROWS, BROADCAST_ROWS, ONE_WINDOW_ROWS = 1024, 500_000, 50_000


def words(text: Column) -> Column:
    """Words between white space (space, U+0009 to U+000D); [''] for a text without words."""
    return F.split(F.regexp_replace(text, "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", ""), "[ \\t\\n\\x0B\\f\\r]+")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch_of_hashes(hashes: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    """The sketch of an array of word hashes; the array is read several times, so give a column, not an expression."""
    cut = lambda x: F.shiftrightunsigned(x, 16)
    shingle = lambda i: cut(F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    whole = F.array(cut(F.xxhash64(*[F.get(hashes, F.lit(j)) for j in range(width)])))
    many = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), shingle)
    return F.slice(F.array_sort(F.array_distinct(F.when(F.size(hashes) > width, many).otherwise(whole))), 1, k)


def add_sketch(df: DataFrame, text_col: str, name: str, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the sketch of a text column as array<bigint>."""
    hashes = f"__h_{name}"
    none = F.array().cast("array<bigint>")
    df = df.withColumn(hashes, word_hashes(F.coalesce(F.col(text_col), F.lit(""))))
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    return df.withColumn(name, F.when(blank, none).otherwise(sketch_of_hashes(F.col(hashes), k, width))).drop(hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _SPAN / F.greatest(F.element_at(a, -1).cast("double"), F.lit(1.0)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    size = F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / size)


def to_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 12, "0"))), "")


def merge_parts(parts: DataFrame, key: str, sketch_col: str, k: int = K, salts: int = 32) -> DataFrame:
    """One sketch for each key from sketches of its parts; a key may hold most of the rows.

    Each key's parts are merged in ``salts`` groups first, and no group keeps more than k hashes.
    """
    def least(df: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__x"))
        return df.distinct().withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")

    salted = parts.select(key, F.explode(sketch_col).alias("__x")).withColumn("__s", F.pmod(F.col("__x"), F.lit(salts)))
    merged = least(least(salted, key, "__s").drop("__s"), key).groupBy(key).agg(F.array_sort(F.collect_list("__x")).alias(sketch_col))
    return parts.select(key).distinct().join(merged, key, "left").withColumn(sketch_col, F.coalesce(sketch_col, F.array().cast("array<bigint>")))


def _lower_neighbour(stats: DataFrame, rows: int) -> DataFrame:
    """(b, top, below): for each bucket the top id of the next lower bucket that has rows; null for the lowest."""
    if rows <= ONE_WINDOW_ROWS:
        return stats.withColumn("below", F.lag("top").over(Window.orderBy("b")))
    group = stats.withColumn("g", F.floor(F.col("b") / 4096).cast("long"))
    inner = group.withColumn("below", F.lag("top").over(Window.partitionBy("g").orderBy("b")))
    outer = _lower_neighbour(group.groupBy("g").agg(F.max("top").alias("top")).withColumnRenamed("g", "b"), rows // 4096 + 1)
    outer = outer.select(F.col("b").alias("g"), F.col("below").alias("under"))
    return inner.join(outer, "g").select("b", "top", F.coalesce("below", "under").alias("below"))


def with_next(docs: DataFrame, id_col: str, text_col: str, derive, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row with the text of the next row in descending id order (after the last: the first).

    Ids are dealt into ranges between quantiles, each range is sorted on its own, and the top row of the next lower range
    is sent along as a guest; so texts are shuffled once and no task sees all rows, however the ids lie. ``derive`` adds
    columns to the sorted rows; those it names come back with the prefix ``next_`` as well. It returns (frame, names).
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    high = F.lit(base.agg(F.max("id")).first()[0] or 0)
    bucket, buckets = range_bucket(base, "id", bucket_rows)
    stats = base.where("id is not null").groupBy(bucket.alias("b")).agg(F.max("id").alias("top"))
    near = _lower_neighbour(stats, buckets).select(F.coalesce("below", high).alias("id"), F.col("b").alias("to"))
    near = F.broadcast(near) if buckets <= BROADCAST_ROWS else near
    own = base.withColumn("b", bucket).withColumn("guest", F.lit(False))
    guests = base.join(near, "id").select("id", "text", F.col("to").alias("b"), F.lit(True).alias("guest"))
    order = [F.asc("guest"), F.desc_nulls_last("id"), F.asc("tie")]
    rows = own.unionByName(guests).withColumn("tie", F.xxhash64("text")).repartition("b").sortWithinPartitions("b", *order)
    rows, names = derive(rows)
    ahead = Window.partitionBy("b").orderBy(*order)
    return rows.select("*", *(F.lead(c).over(ahead).alias(f"next_{c}") for c in ["text", *names])).where("not guest").drop("b", "guest", "tie")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, sketch array<bigint>): one row for each row of ``docs``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return add_sketch(base, "text", "sketch", k).select(F.col("id").alias(id_col), "sketch")


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text, of the next one and of the text whose last half is replaced by the next one's beginning."""
    rows = with_next(docs, id_col, text_col, lambda df: (add_sketch(df, "text", "sketch", k), ["sketch"]))
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(coalesce(next_text, ''), 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("id", chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"))
    rows = add_sketch(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch", k)
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", to_string(F.col("sketch")).alias("fingerprint"), to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
