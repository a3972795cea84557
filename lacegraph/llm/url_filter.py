"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is an action, a host and the beginning of a path; it fits its host and all subdomains, and the longest that fits
decides. URLs that rules (or a given table) label teach Spark's gradient-boosted trees, on a bounded sample of distinct
ones with the smallest hashes; the trees judge every URL without a rule. Features are lengths, depth, shares of digits and
letters, character entropy, counts of parameters and marks, and statistics of suffixes: the smoothed share of blocked URLs
under the host's last label, its last two labels, the path's first segment and its file extension. These statistics count
all labelled URLs, in hashed cells, so that their table has a fixed size whatever the corpus holds. A sampled URL takes
the statistics of the half of the labelled URLs that it is not in, so no label leaks into its own features.

All of it is DataFrame functions and Spark's ML pipeline; no Python runs on the executors. URLs are never shuffled: a row
is judged where it is read.

Defined results: a null URL, and one without ``://``, has an empty host and path and is judged by the trees on its text;
very long URLs are read whole; repeated rows get equal results; of an allowing and a blocking rule with the same host and
path the blocking one wins; with a single label among the labelled URLs that label is the verdict for all others, with no
labelled URL it is ``allow``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
ALL = 2  # beside the halves 0 and 1, each of which takes the other's statistics


@dataclass(frozen=True)
class Params:
    sample: int = 20_000  # distinct labelled URLs that the trees are fitted on
    trees: int = 20
    depth: int = 4
    cells: int = 2048  # of each kind of suffix
    prior: float = 20.0  # labelled URLs that a suffix's share is smoothed with
    seed: int = 1


@dataclass(frozen=True)
class Model:
    """Trees, or the only label; the share of blocked URLs of each cell by (kind, half)."""

    trees: GBTClassificationModel | None
    only: str
    shares: dict[tuple[str, int], list[float]]
    params: Params


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?`` or ``#``."""
    url = url.cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*+", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, or nulls; ``rules`` are (action, host and path)."""
    rule = action = None
    for name, text in sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != BLOCK, r[1])):
        its_host, slash, its_path = text.partition("/")
        fits = ((host == its_host) | F.endswith(host, F.lit(f".{its_host}"))) & F.startswith(path, F.lit(slash + its_path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, name) if action is None else action.when(fits, name)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, action)


def entropy(text: Column) -> Column:
    """Bits a character, from runs of the sorted characters."""
    size = F.length(text).cast("double")
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))
    closed = lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"].cast("double"))).otherwise(0.0)
    step = lambda s, x: F.when(s["last"] == x, F.struct(x.alias("last"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1).cast("long").alias("run"), closed(s).alias("sum")))
    return F.when(size > 0, F.log2(size) - F.aggregate(F.array_sort(F.split(text, "")), start, step, closed) / size).otherwise(0.0)


SUFFIXES = ("last", "two", "segment", "extension")


def lexical(df: DataFrame, url: str, params: Params) -> DataFrame:
    """``df`` with __plain (an array of numbers of the URL alone) and a __cell_ column for each kind of suffix."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path = parts(F.col(url))
    df = df.withColumn("__text", text).withColumn("__host", host).withColumn("__path", path)
    host, path, text = F.col("__host"), F.col("__path"), F.col("__text")
    query = F.regexp_extract(text, r"\?([^#]*+)", 1)
    count = lambda column, pattern: F.length(F.regexp_replace(column, f"[^{pattern}]++", ""))
    share = lambda column, pattern: count(column, pattern) / F.greatest(F.length(column), F.lit(1))
    plain = F.array(*(x.cast("double") for x in (
        F.length(text), F.length(host), F.length(path), F.length(query), count(path, "/"), count(host, "."), share(text, "0-9"), share(host, "0-9"), share(path, "A-Za-z"),
        entropy(text), entropy(host), F.when(query == "", 0).otherwise(count(query, "&") + 1), count(query, "="), count(host, "-"), count(path, "_-"), count(text, "%"),
        F.contains(text, F.lit("#")).cast("int"), F.startswith(text, F.lit("https://")).cast("int"), F.endswith(path, F.lit("/")).cast("int"),
    )))
    suffix = {
        "last": F.substring_index(host, ".", -1), "two": F.substring_index(host, ".", -2), "segment": F.regexp_extract(path, r"^/([^/]*+)", 1), "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]++)$", 1),
    }
    df = df.withColumn("__plain", plain)
    for kind in SUFFIXES:
        df = df.withColumn(f"__cell_{kind}", F.pmod(F.xxhash64(suffix[kind]), F.lit(params.cells)).cast("int"))
    return df.drop("__text", "__host", "__path")


def with_features(df: DataFrame, shares: dict[tuple[str, int], list[float]], half: Column) -> DataFrame:
    """``df`` with ``features``; ``half`` tells of which labels the suffixes' shares are."""
    table = lambda kind, n: F.split(F.lit(",".join(map(str, shares[kind, n]))), ",").cast("array<double>")
    chosen = lambda kind: F.get(F.when(half == 0, table(kind, 0)).when(half == 1, table(kind, 1)).otherwise(table(kind, ALL)), F.col(f"__cell_{kind}"))
    return df.withColumn("features", array_to_vector(F.concat("__plain", F.array(*map(chosen, SUFFIXES))))).drop("__plain", *(f"__cell_{kind}" for kind in SUFFIXES))


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """A model from (url, label) with the labels ``allow`` and ``block``; other labels and null URLs teach nothing."""
    spark = labelled.sparkSession
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isin(ALLOW, BLOCK)).select(F.col("url").cast("string").alias("url"), (F.col("label") == BLOCK).cast("double").alias("label"))
    seen = lexical(known, "url", params).withColumn("key", F.xxhash64("url"))
    half = F.pmod(F.xxhash64("key"), F.lit(2)).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(f"__cell_{kind}").alias("cell")) for kind in SUFFIXES)))
    counted = seen.select(each.alias("at"), half.alias("half"), "label").groupBy("at.kind", "at.cell", "half").agg(F.count("*").alias("urls"), F.sum("label").alias("blocked"))
    counts = {(r.kind, r.half, r.cell): (r.urls, r.blocked) for r in counted.collect()}  # 8 * cells rows at most
    total, blocked = (sum(n[i] for (kind, *_), n in counts.items() if kind == "last") for i in (0, 1))
    if blocked in (0, total):
        return Model(None, BLOCK if blocked else ALLOW, {}, params)

    def share(kind: str, halves: tuple[int, ...], cell: int) -> float:
        urls, bad = (sum(counts.get((kind, h, cell), (0, 0))[i] for h in halves) for i in (0, 1))
        return (bad + params.prior * blocked / total) / (urls + params.prior)

    shares = {(kind, n): [share(kind, halves, cell) for cell in range(params.cells)] for kind in SUFFIXES for n, halves in ((0, (1,)), (1, (0,)), (ALL, (0, 1)))}
    some = with_features(seen.drop("url").withColumn("half", half), shares, F.col("half"))
    some = some.select("key", "label", "features").dropDuplicates(["key", "label"]).orderBy("key", "label").limit(params.sample)
    labels = {r.label for r in some.select("label").distinct().collect()}
    if len(labels) < 2:
        return Model(None, BLOCK if 1.0 in labels else ALLOW, {}, params)
    trees = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, seed=params.seed, maxMemoryInMB=64).fit(some)
    return Model(trees, "", shares, params)


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): ``score`` is the trees' chance that a URL is to be blocked."""
    host, path = parts(F.col("url"))
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    if model.trees is None:
        df = df.withColumn("score", F.lit(float(model.only == BLOCK)))
    else:
        df = with_features(lexical(df, "url", model.params), model.shares, F.lit(ALL))
        df = model.trees.transform(df).withColumn("score", vector_to_array("probability")[1])
    df = df.select("id", "score", host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW))
    return df.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def labelled_by(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(url, label) of the URLs that a rule decides."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(url_col).cast("string").alias("url")).withColumn("__h", host).withColumn("__p", path)
    return rows.withColumn("label", ruled(F.col("__h"), F.col("__p"), rules)[1]).where("label is not null").select("url", "label")
