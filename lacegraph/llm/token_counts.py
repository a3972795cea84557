"""Token counts: Arrow batches that return lengths only.

Texts go to the library in groups of about ``GROUP_BYTES`` bytes, and a text beyond ``LONG`` characters is split where
the pre-tokeniser always starts a new piece: before a space that follows a character other than white space. Special
strings hold no space, so none is cut, and the counts of the parts add up to that of the whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts count as the library counts them whole;
equal texts, so repeated rows and ties too, have equal counts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

#: The library's cost a byte is least for short parts in groups that stay in the processor's cache.
GROUP_BYTES, LONG = 1 << 16, 1 << 10


def parts(text: str, long: int = LONG) -> list[str]:
    """The text in parts of about ``long`` characters, cut at safe boundaries only."""
    if len(text) <= long:
        return [text] if text else []
    out, start = [], 0
    while len(text) - start > long:
        cut = start + long
        while (cut := text.find(" ", cut)) > 0 and text[cut - 1].isspace():
            cut += 1
        if cut <= 0:
            break
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def groups(pieces: list[tuple[int, str]], most: int = GROUP_BYTES):
    """(row, part) pairs in lists of about ``most`` bytes."""
    group, size = [], 0
    for row, part in pieces:
        group.append((row, part))
        size += len(part.encode())
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


_LOADED: dict = {}


def counter(path: str):
    """texts -> token counts, by the library that the file's kind belongs to; loaded once a process."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def count(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``.

    A sentencepiece model splits no text, for its pieces may cross any boundary.
    """
    long = LONG if path.endswith(".json") else 1 << 62

    def make():
        of = counter(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            totals = [0] * len(texts)
            for group in groups([(i, p) for i, t in enumerate(texts) for p in parts(t, long)]):
                for (i, _), n in zip(group, of([p for _, p in group])):
                    totals[i] += n
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

        return each

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, make, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
