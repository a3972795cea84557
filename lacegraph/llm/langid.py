"""Language identification by hierarchical discrimination.

A linear support vector machine first picks the language family; one-versus-one machines then separate the languages
within it, by votes weighted with their margins. Features are hashed character 1- to 3-grams of the letters, as square
roots of their shares. Both levels are trained on the driver, on a bounded, documented number of rows of each language and
of all together.

Defined results: a null or empty text and one without a letter is ``und`` with score 0; very long texts are read whole;
ties go to the language that comes first in order; with a single learned language every text with a letter is that
language, with none (an empty table) every text is ``und``; equal texts, so repeated rows too, get equal results. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"), "uralic": ("et", "fi", "hu"), "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"), "dravidian": ("kn", "ml", "ta", "te"), "semitic": ("am", "ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"), "malayic": ("id", "jv", "ms", "su", "tl"), "iranian": ("fa", "ku", "ps", "tg"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    #: At most about so many training rows of each language, and of all (2 * 2^bits bytes a row on the driver).
    rows_per_language: int = 1000
    rows: int = 20_000
    bits: int = 11
    rounds: int = 150
    penalty: float = 1e-4
    #: Slope of the logistic curve from a margin to a score.
    slope: float = 3.0


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTER[0]


def vector(text: str | None, bits: int) -> np.ndarray | None:
    """Hashed n-gram shares (square roots, unit length) of the whole text; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = codes[letter | np.concatenate([[False], letter[:-1]])]  # a gap is one space
    codes = np.concatenate([[32], codes, [32] * int(codes[-1] != 32)]).astype(np.uint32)
    shift, counts = np.uint32(32 - bits), np.zeros(1 << bits, np.float32)
    one = codes * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + codes[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(31) + codes[2:] * np.uint32(3266489917)
    for grams in (one, two, three):
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822507)
        counts += np.bincount(grams >> shift, minlength=1 << bits) / np.float32(len(grams) or 1)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def svm(x: np.ndarray, y: np.ndarray, params: Params) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; classes weigh alike. y is +1 or -1."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    w = v = np.zeros(z.shape[1], x.dtype)
    for t in range(params.rounds):  # accelerated gradient steps
        gap = np.maximum(0, 1 - y * (z @ v))
        step = v + (z.T @ (share * y * gap) - params.penalty * v) * 0.5
        w, v = step, step + (t / (t + 3)) * (step - w)
    return w


@dataclass
class Model:
    bits: int
    slope: float
    languages: list[str]
    families: list[str]
    #: (first index, second index, weights) of pairs; indices into families or languages.
    family_pairs: list[tuple[int, int, np.ndarray]]
    language_pairs: list[tuple[int, int, np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the languages, and scores, of rows of vectors."""
        z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
        family, sure = self._vote(z, self.family_pairs, np.arange(len(self.families))[None].repeat(len(z), 0) >= 0)
        own = np.array([FAMILY_OF.get(c, c) for c in self.languages])[None] == np.array(self.families)[family][:, None]
        language, within = self._vote(z, self.language_pairs, own)
        return language, sure * within

    def _vote(self, z: np.ndarray, pairs, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The allowed class with the largest product of pairwise probabilities, and its share among them."""
        total = np.where(allowed, 0.0, -np.inf)
        for a, b, w in pairs:
            both = allowed[:, a] & allowed[:, b]
            margin = np.clip(self.slope * (z @ w), -30, 30)
            total[both, a] -= np.log1p(np.exp(-margin[both]))
            total[both, b] -= np.log1p(np.exp(margin[both]))
        share = np.exp(total - total.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(z)), best]


def fit(labelled: DataFrame, params: Params = Params(), text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Learn from (text, language) rows. The key only picks the sample; it is no input of a prediction."""
    rows = labelled.select(F.col(key_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    sizes.pop(UNKNOWN, None)
    languages = sorted(sizes)
    empty = Model(params.bits, params.slope, languages, sorted({FAMILY_OF.get(c, c) for c in languages}), [], [])
    if len(languages) < 2:
        return empty
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for c in languages for x in (c, min(1.0, min(params.rows_per_language, params.rows / len(languages)) / sizes[c]))])
    sample = rows.where(F.col("lang") != UNKNOWN).where(place < share[F.col("lang")])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [(c, v) for c, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if (v := vector(t, params.bits)) is not None]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.string()), pa.array([v.astype(np.float16).tobytes() for _, v in got], pa.binary())], names=["lang", "v"])

        return each

    got = map_arrow(sample, make, "lang string, v binary").collect()  # bounded by the parameters
    if not got:
        return empty
    x = np.stack([np.frombuffer(r.v, np.float16) for r in got]).astype(np.float32)
    lang = np.array([r.lang for r in got])
    family = np.array([FAMILY_OF.get(c, c) for c in lang])

    def pairs(names: list[str], of: np.ndarray, related):
        out = []
        for a, b in itertools.combinations(range(len(names)), 2):
            if related(names[a], names[b]):
                here = (of == names[a]) | (of == names[b])
                out.append((a, b, svm(x[here], np.where(of[here] == names[a], 1, -1).astype(np.float32), params)))
        return out

    return Model(params.bits, params.slope, languages, empty.families, pairs(empty.families, family, lambda a, b: True), pairs(languages, lang, lambda a, b: FAMILY_OF.get(a, a) == FAMILY_OF.get(b, b)))


def _predictor(model: Model):
    """texts -> (languages, scores)."""
    def of(texts: list) -> tuple[list[str], list[float]]:
        vectors = [vector(t, model.bits) for t in texts]
        langs, scores = [UNKNOWN] * len(vectors), [0.0] * len(vectors)
        rows = [i for i, v in enumerate(vectors) if v is not None]
        if rows and model.languages:
            best, sure = model.predict(np.stack([vectors[i] for i in rows]))
            for i, b, s in zip(rows, best.tolist(), sure.tolist()):
                langs[i], scores[i] = model.languages[b], min(1.0, max(0.0, s))
        return langs, scores

    return of


def keep(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language, which replaces ``lang_col``; texts without a letter (``und``) are rejected.

    Whole rows pass through as Arrow batches and rejected ones are left out, so nothing is joined or shuffled.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def make():
        of = _predictor(handle.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs = pa.array(of(batch.column(names.index(text_col)).to_pylist())[0], pa.string())
            columns = [langs if n == lang_col else c for n, c in zip(names, batch.columns)]
            return pa.RecordBatch.from_arrays(columns, names=names).filter(pc.not_equal(langs, UNKNOWN))

        return each

    rows = docs.withColumns({c: F.col(c).cast("string") for c in (text_col, lang_col)})
    return map_arrow(rows, make, rows.schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): one row for each row of ``docs``."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = _predictor(handle.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = of(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

        return each

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, make, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
