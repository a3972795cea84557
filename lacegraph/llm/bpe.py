"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a pre-token are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds every token
that occurs in it in one pass. Encoding walks left to right with the longest match and steps back to shorter prefixes
when two neighbours could not stand beside each other in a merged result. Whether they can depends on the parts that
touch at their seam while both are built, and is memoised; so the exact merges come out in time linear in the length.

A text is cut at spaces first, wherever the pattern must start a new match, and the ids of words and of pre-tokens are
kept in tables of bounded size, so that a common word costs one look-up.

Defined results: null and empty texts have no tokens; very long texts, and pre-tokens of any length, are encoded whole; ids
decode to the same UTF-8 bytes; equal texts, so repeated rows and ties too, give equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lists_of, map_arrow

#: Entries that a worker keeps of words and of other pre-tokens (two generations of so many each) and of pairs.
WORDS, PIECES, PAIRS = 400_000, 60_000, 400_000
#: A space between white space on both sides, or after one at the end, belongs to a longer match.
_JOINED = re.compile(r"\s (?:\s|\Z)")


class Recent(dict):
    """A dictionary that makes missing values and keeps them from the second time on, as most keys come once; it holds the
    last two generations of ``most`` entries.

    A byte for each hash tells what came before: keys that share one are kept a time early, which changes no value.
    """

    def __init__(self, make, most: int):
        self.make, self.most, self.places = make, most, (1 << (8 * most).bit_length()) - 1
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.old, self.came = {}, bytearray(self.places + 1)

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got, at = self.make(key), hash(key) & self.places
            if not self.came[at]:
                self.came[at] = 1
                return got
        if len(self) >= self.most:
            self.old, self.came = dict(self), bytearray(self.places + 1)
            self.clear()
        self[key] = got
        return got


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one rank file; single bytes hold the lowest ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = tokens_of(ranks)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.size = list(map(len, self.bytes_of))
        #: For each token the longest token that is a proper prefix (-1: none).
        self.shorter = [next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1) for token in self.bytes_of]
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.follow: dict[int, int] = {}
        self.letters = self.split(" aé") == [" aé"]  # whether the pattern takes a space and letters together
        self.pieces = Recent(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes(), PIECES)
        self.words = Recent(self.encode_word, WORDS)

    def forget(self) -> None:
        """Free the tables of words and pieces."""
        self.words.forget()
        self.pieces.forget()

    def encode_word(self, word: str) -> bytes:
        """The packed ids of a space and the word after it."""
        if self.letters and word.isalpha():
            return array("i", self.encode_piece(f" {word}".encode())).tobytes()
        return b"".join([self.words[p[1:]] if p[0] == " " and self.letters and p[1:].isalpha() else self.pieces[p] for p in self.split(" " + word)])

    def undo(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a single byte gives itself twice."""
        if (got := self.halves.get(token)) is None:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                merged = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token) for a, b in zip(parts, parts[1:])]
                at = min(range(len(merged)), key=merged.__getitem__)
                if merged[at] >= token:
                    break
                parts[at : at + 2] = [merged[at]]
            got = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave left and right as neighbours; memoised."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        got = self.fits[left << 20 | right] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        """Merges run by ascending rank, so a part lives from its own rank to that of the part that takes it in. Two parts
        that touch at the seam at the same time would merge if their own rank came before both their ends: of equal
        merges the leftmost is first, so the left part must still be there after it, the right part not."""
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        touching, part, end = [], right, 1 << 62
        while True:
            touching.append((bytes_of[part], part, end))
            inner = (halves.get(part) or self.undo(part))[0]
            if inner == part:
                break
            part, end = inner, part
        part, end = left, 1 << 62
        while True:
            own = bytes_of[part]
            for other, born, gone in touching:
                if born < end and part < gone:
                    rank = ranks.get(own + other, end)
                    if rank < end and rank <= gone:
                        return False
            inner = (halves.get(part) or self.undo(part))[1]
            if inner == part:
                return True
            part, end = inner, part

    def first_fit(self, last: int, token: int) -> int:
        """The longest of a token and its prefixes that can follow ``last``; -1 if none. Memoised."""
        if len(self.follow) > PAIRS:
            self.follow.clear()
        key = last << 20 | token
        while token >= 0:
            fit = self.fits.get(last << 20 | token)
            if fit or fit is None and self.compatible(last, token):
                break
            token = self.shorter[token]
        self.follow[key] = token
        return token

    def encode_piece(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        size, sizes, follow = len(word), self.size, self.follow
        longest = [-1] * (size + 1)
        for end, (token, before) in self.automaton.iter(word.decode("latin-1")):
            longest[end - before] = token  # later ends are longer
        last = longest[0]
        out, at = [last], sizes[last]
        while at < size:  # the way without a step back
            token = follow.get(last << 20 | longest[at])
            if token is None:
                token = self.first_fit(last, longest[at])
            if token < 0:
                return self._search(size, longest, out, at)
            out.append(token)
            at += sizes[token]
            last = token
        return out

    def _search(self, size: int, longest: list[int], out: list[int], at: int) -> list[int]:
        """Go on from a place where nothing fits: close it, and try the token before shorter, as far back as needed."""
        sizes, shorter, follow, closed = self.size, self.shorter, self.follow, {at}
        token = out.pop()
        at -= sizes[token]
        token = shorter[token]
        while at < size:
            if out and token >= 0:
                last = out[-1]
                fit = follow.get(last << 20 | token)
                token = self.first_fit(last, token) if fit is None else fit
            if token < 0:
                closed.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
            elif at + sizes[token] in closed:
                token = shorter[token]
            else:
                out.append(token)
                at += sizes[token]
                token = longest[at]
        return out

    def encode(self, text: str) -> np.ndarray:
        if _JOINED.search(text):
            known, parts = self.pieces, self.split(text)
            return np.frombuffer(b"".join([known[p] for p in parts]), np.int32)
        first, *parts = text.split(" ")
        known = self.words
        return np.frombuffer(b"".join([*(self.pieces[p] for p in self.split(first)), *[known[w] for w in parts]]), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, tokens array<int>): one row for each row of ``docs``.

    With ``decoded`` also the bytes that the ids stand for, looked up id by id in the same pass: a round trip without a
    second worker process beside each task's first.
    """

    def make():
        c = codec(path, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            flat = np.concatenate(got) if got else np.zeros(0, np.int32)
            columns = [batch.column(0), lists_of(flat, [len(x) for x in got], pa.int32())]
            if decoded:
                columns.append(pa.array([c.decode(x.tolist()) for x in got], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=["id", "tokens", "bytes"][: len(columns)])

        each.close = c.forget
        return each

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, make, "id long, tokens array<int>" + ", bytes binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, tokens, bytes binary) from encode()'s rows; it needs the vocabulary only."""

    def make():
        table = tokens_of(load_ranks(path)).__getitem__

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(1)
            ids, at = column.flatten().to_numpy().tolist(), np.cumsum([0, *(column.value_lengths().to_pylist())]).tolist()
            return pa.RecordBatch.from_arrays([batch.column(0), column, pa.array([b"".join(map(table, ids[a:b])) for a, b in zip(at, at[1:])], pa.binary())], names=["id", "tokens", "bytes"])

        return each

    return map_arrow(encoded.select(F.col(id_col).alias("id"), "tokens"), make, "id long, tokens array<int>, bytes binary").withColumnRenamed("id", id_col)


def digest(decoded: DataFrame, id_col: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    ids = F.array_join(F.col("tokens").cast("array<string>"), " ")
    return decoded.select(id_col, F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), *more)
