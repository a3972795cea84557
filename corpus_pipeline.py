"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Defined results of every stage: an empty table gives an empty result; very long texts are handled whole; extra columns,
whatever their names, pass all stages but the last; rows that share an id are judged as their operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lacegraph.llm import bpe, decontam, langid, linededup, neardup
from lacegraph.llm.common import Scratch, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang is set to what is predicted. Null texts and those without a letter go;
    equal texts get the same language."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.keep(docs, model).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source; n_chars follows the text. A null source is one of its
    own, and a document all of whose lines go stays with an empty text."""
    whole = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), "source", "text")
    cut = linededup.drop_lines(whole)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*(new.get(x, F.col("row").getField(x)).alias(x) for x in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, similarity 0.8); null and empty texts,
    and rows without an id, all stay."""
    return neardup.drop_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark; null and empty texts stay."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, tokens) of every document; an empty text has no tokens."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.encode(docs, path, pattern, decoded=True), more=("tokens",))


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL expresses neither the language model nor the merges of BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet to the shared folder and read again.

    A stage's table goes once the next one is written, and all of them if a stage fails; the last is the result.
    """
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = scratch.put(stage(spark, docs, sf_dir), f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    except BaseException:
        scratch.drop()
        raise
    return docs
