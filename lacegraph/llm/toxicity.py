"""Toxic passages by maximum-scoring segment search.

Fit (on a bounded, documented sample of labelled rows, written once): document frequencies of words and word beginnings in
toxic and other rows give log-odds with an informative Dirichlet prior (the pooled frequencies); only significant ones are
kept. The sample's other third calibrates: the scores of all tokens in its ordinary rows give the Karlin-Altschul lambda,
their best segments the likeliest K (``FALLBACK_K`` if there are none), and a logistic curve leads from a document's
statistic to a probability.

Scan: every token scores its log-odds less a drift; one linear pass finds all maximal segments of positive score
(Ruzzo and Tompa), whatever the text's length. A segment's normalised score is lambda*S - ln(K*n); by the extreme-value
law an ordinary text of n tokens holds one above -ln(-ln(1 - level)) with probability ``level``, and what exceeds that is
significant. The document's statistic sums up by how much its significant segments exceed it.

Defined results: null and empty texts have no segments and the least score; very long texts are scanned whole; equal
texts score the same, so repeated rows and ties do too; no other column is read; an empty table gives an empty result.
With no labels of one kind, or none at all, the score is the labels' mean, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, map_arrow

FALLBACK_K = 0.1
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Params:
    #: At most about so many labelled rows are used: two thirds for the log-odds, one third for the calibration.
    sample_rows: int = 24_000
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    prior: float = 50.0
    least_docs: int = 5
    least_z: float = 4.0
    drift: float = 0.7
    #: Chance of a significant segment in an ordinary text.
    level: float = 0.01
    most: float = 6.0


@dataclass
class Model:
    weights: dict[str, float]
    params: Params
    lam: float = 1.0
    k: float = FALLBACK_K
    curve: tuple[float, float] = (0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict)

    def token_score(self, word: str) -> float:
        """The weight of the longest known beginning, or of the word itself, less the drift."""
        if (got := self.memo.get(word)) is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            weight = self.weights.get(word)
            for n in reversed(self.params.beginnings):
                if weight is None and len(word) > n:
                    weight = self.weights.get("^" + word[:n])
            got = self.memo[word] = max(-self.params.most, min(self.params.most, weight or 0.0)) - self.params.drift
        return got

    def scores(self, text: str | None) -> list[float]:
        memo, words = self.memo, TOKEN.findall((text or "").lower())
        try:
            return [memo[w] for w in words]
        except KeyError:
            return [self.token_score(w) for w in words]

    def statistic(self, scores: list[float]) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's statistic and its significant segments (first token, end, normalised score)."""
        if not scores or max(scores) <= 0:
            return 0.0, []
        floor, least = math.log(max(self.k * len(scores), 1e-9)), -math.log(-math.log1p(-self.params.level))
        every = [(a, b, self.lam * s - floor) for a, b, s in segments(scores)]
        found = [(a, b, x) for a, b, x in every if x > least]
        return sum(x - least for *_, x in found), found

    def probability(self, statistic: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(statistic)))))


def features(text: str | None, beginnings: tuple[int, ...]) -> set[str]:
    out = set()
    for w in set(TOKEN.findall((text or "").lower())):
        out.add(w)
        out.update("^" + w[:n] for n in beginnings if len(w) > n)
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time."""
    kept: list[list] = []  # first, end, sum before, sum through
    links: list[int] = []  # for each kept segment the nearest one with a smaller sum before it
    total, at, size = 0.0, 0, len(scores)
    while at < size:
        score = scores[at]
        if score <= 0:
            total += score
            at += 1
            continue
        new = [at, at + 1, total, total + score]
        total += score
        at += 1
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j = links[j]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                links.append(j)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], links[j:]
            j -= 1
    return [(a, b, right - left) for a, b, left, right in kept]


def karlin(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum p(s) exp(lambda s) = 1; the distribution is smoothed so that a positive score can occur."""
    p = weights / weights.sum()
    if (p * values).sum() >= 0:
        return 0.1
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return low


def karlin_k(lam: float, n: np.ndarray, best: np.ndarray) -> float | None:
    """The likeliest K if P(best segment of n tokens <= x) = exp(-K n exp(-lambda x)); a best of 0 is a text without one."""
    found = int(((best > 0) & (n > 0)).sum())
    return found / float((n * np.exp(-lam * best)).sum()) if found else None


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge."""
    z, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(labelled: DataFrame, params: Params = Params(), text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id") -> Model:
    """Learn from (text, label) rows. The key only picks the sample and its parts; it is no input of a score."""
    rows = labelled.select(F.col(key_col).alias("k"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and text is not null")
    share = min(1.0, params.sample_rows / max(rows.select("k").count(), 1))
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    with Scratch(labelled.sparkSession) as scratch:
        sample = scratch.put(rows.where(place < share).select("text", "y", (place >= share * 2 / 3).alias("third")), "sample")
        model, held = _odds(sample.where("not third"), params), sample.where("third")
        scores = {r.s: r.n for r in _histogram(held.where("y = 0"), model).collect()}  # of scores rounded to a hundredth
        if not scores:
            return model
        scores[top] = scores.get(top := round(params.most - params.drift, 2), 0) + 1  # a positive score can occur
        model.lam = karlin(np.array(list(scores)), np.array(list(scores.values()), float))
        plain = _per_row(held.where("y = 0"), model, lambda own, s: max((x for *_, x in segments(s)), default=0.0)).collect()
        model.k = karlin_k(model.lam, *np.array([(r.n, r.value) for r in plain], float).reshape(-1, 2).T) or model.k
        got = _per_row(held, model, lambda own, s: own.statistic(s)[0]).collect()  # three numbers of each row, a third of the sample at most
    y = np.array([r.y for r in got], float)
    model.curve = logistic(np.log1p(np.array([r.value for r in got])), y) if 0 < y.sum() < len(y) else (math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)), 0.0)
    return model


def _odds(rows: DataFrame, params: Params) -> Model:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y].update(features(text, params.beginnings))
            names = list(counts[0] | counts[1])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["feature", "clean", "toxic"])

        return each

    size = rows.agg(F.sum(1 - F.col("y")).alias("c"), F.sum("y").alias("t")).first()
    clean, toxic = float(size.c or 0), float(size.t or 0)
    if not clean or not toxic:
        rate = toxic / max(clean + toxic, 1.0)
        return Model({}, params, curve=(math.log((rate + 1e-9) / (1 - rate + 1e-9)), 0.0))
    prior = params.prior
    table = map_arrow(rows.select("text", "y"), make, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= params.least_docs)
    share = (F.col("c") + F.col("t")) / F.lit(clean + toxic)
    odds = lambda y, n: F.log(y / (n + prior + 0.5 - y))
    t, c = F.col("t") + prior * share, F.col("c") + prior * share
    table = table.select("feature", (odds(t, F.lit(toxic)) - odds(c, F.lit(clean))).alias("w"), F.sqrt(1 / t + 1 / c).alias("sd")).where(F.abs(F.col("w") / F.col("sd")) >= params.least_z)
    return Model({r.feature: r.w for r in table.collect()}, params)  # what a bounded sample holds often enough


def _histogram(rows: DataFrame, model: Model) -> DataFrame:
    """(s, n): how many tokens have each score."""

    def make():
        own = Model(model.weights, model.params)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(round(x, 2) for x in own.scores(text))
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["s", "n"])

        return each

    return map_arrow(rows.select("text"), make, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _per_row(rows: DataFrame, model: Model, of) -> DataFrame:
    """(y, n, value): of each row its label, its number of tokens and ``of(model, scores)``."""
    state = (model.weights, model.params, model.lam, model.k)

    def make():
        own = Model(*state)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [own.scores(t) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(s) for s in scores], pa.int64()), pa.array([of(own, s) for s in scores], pa.float64())], names=["y", "n", "value"])

        return each

    return map_arrow(rows.select("text", "y"), make, "y int, n long, value double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, statistic, passages array of struct(first, end, score)): one row for each row of ``docs``.

    Passages are counted in word tokens, end exclusive.
    """
    handle = docs.sparkSession.sparkContext.broadcast((model.weights, model.params, model.lam, model.k, model.curve))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        own = Model(*handle.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [own.statistic(own.scores(t)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.probability(s) for s, _ in got], pa.float64()), pa.array([s for s, _ in got], pa.float64()), pa.array([[{"first": a, "end": b, "score": x} for a, b, x in p] for _, p in got], kind)],
                names=["id", "score", "statistic", "passages"],
            )

        return each

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, make, "id long, score double, statistic double, passages array<struct<first:int,end:int,score:double>>").withColumnRenamed("id", id_col)
