"""Scalar functions as column expressions: base codes, hashes, k-mers, diagonals, packing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters and punctuation of prose stand for bases, so that documents can serve as reads.
_PROSE = "abcdefghijklmnopqrstuvwxyz .,\n"
PROSE_FROM, PROSE_TO = _PROSE, ("acgt" * 8)[: len(_PROSE)]


def prose_to_bases(text: Column) -> Column:
    return F.translate(F.lower(text), PROSE_FROM, PROSE_TO)


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T or U in either case (and for the raw bytes 0 to 3), 4 for anything else."""
    b = F.upper(base)
    known = F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b.isin("T", "U"), 3)
    for n in range(4):
        known = known.when(base == chr(n), n)
    return known.otherwise(4)


def _both(x: Column, y: Column) -> Column:
    return x.bitwiseAND(y)


def hash64(x: Column, k: int) -> Column:
    """An invertible mix of 2k bits, in LONG arithmetic that cannot overflow for k up to 15."""
    m = F.lit((1 << 2 * k) - 1)
    x = _both(F.bitwise_not(x) + F.shiftleft(x, 21), m)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 24))
    x = _both(x * 265, m)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 14))
    x = _both(x * 21, m)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 28))
    return _both(_both(x, F.lit((1 << 33) - 1)) + F.shiftleft(x, 31), m)


def hash32(x: Column) -> Column:
    """A bijective mix of 32 bits, held in a LONG."""
    m = F.lit(0xFFFFFFFF)
    x = _both(x.cast("long"), m)
    for _ in range(2):
        x = _both(F.shiftrightunsigned(x, 16).bitwiseXOR(x) * 0x45D9F3B, m)
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)


def kmer_value(codes: Column, start: Column, k: int) -> Column:
    """The number that k codes from a 0-based start spell in base 4."""
    return F.aggregate(F.slice(codes, start + 1, k), F.lit(0).cast("long"), lambda a, c: a * 4 + c)


def reverse_kmer_value(codes: Column, start: Column, k: int) -> Column:
    """As kmer_value for the reverse complement."""
    return F.aggregate(F.reverse(F.slice(codes, start + 1, k)), F.lit(0).cast("long"), lambda a, c: a * 4 + (3 - c))


def canonical(forward: Column, reverse: Column) -> tuple[Column, Column]:
    """(value, strand) of the smaller of both strands; null for a k-mer that is its own reverse complement."""
    differ = forward != reverse
    return F.when(differ, F.least(forward, reverse)), F.when(differ, (forward > reverse).cast("int"))


def diagonal(same_strand: Column, qpos: Column, rpos: Column) -> Column:
    """Where a seed lies across a pair of reads: 2^31 + r - q on one strand, r + q on opposite ones."""
    q, r = qpos.cast("long"), rpos.cast("long")
    return F.when(same_strand, F.lit(1 << 31) + r - q).otherwise(r + q)


def pack(high: Column, low: Column, bits: int) -> Column:
    return F.shiftleft(high.cast("long"), bits).bitwiseOR(low.cast("long"))


def unpack(packed: Column, bits: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, bits), packed.bitwiseAND(F.lit((1 << bits) - 1))


def twin(vertex: Column) -> Column:
    """The other orientation of a vertex (read * 2 + orientation)."""
    return vertex.bitwiseXOR(F.lit(1).cast("long"))
