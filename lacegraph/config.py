"""All options of the engine in one frozen object; defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    # fingerprint extraction
    k: int = 15
    w: int = 5
    # edges of reads and of runs of letters by a scan with a pending minimum instead of by full windows
    strict: bool = False
    # frequency cap of the self-join
    occ_fraction: float = 0.001
    occ_limit: int = 65535
    occ_cap: int = 2048
    # seed clusters and chains
    radius: int = 500
    max_gap: int = 10000
    min_count: int = 4
    min_chain: int = 40
    bidirectional: bool = True
    # seeds of a pair of reads, or of a cluster, up to which one task works it
    task_seeds: int = 1_000_000
    # hits
    min_span: int = 2000
    min_match: int = 100
    min_depth: int = 3
    min_identity: float = 0.05
    # overlaps
    max_hang: int = 1000
    min_overlap: int = 2000
    int_fraction: float = 0.8
    # graph
    gap_fuzz: int = 1000
    rounds: int = 2
    bubble_distance: int = 50000
    max_extension: int = 4
    drop_ratios: tuple[float, float, float] = (0.5, 0.7, 0.8)
    # bytes of a text split
    block_bases: int = 64 << 20
    # Hadoop path for tables between the steps of a phase; None: the session's checkpoint folder
    work_dir: str | None = None

    def __post_init__(self):
        if not 1 <= self.k <= 16 or self.w < 1:
            raise ValueError("k must be 1 to 16 and w at least 1")
        if self.block_bases > size_in_bytes("1g"):
            object.__setattr__(self, "block_bases", size_in_bytes("1g"))

    def but(self, **changes) -> "Options":
        return replace(self, **changes)


def size_in_bytes(text: str) -> int:
    """'64m' -> 67108864; units k, m and g in either case, powers of 1024."""
    text = str(text).strip()
    digits, unit = (text[:-1], text[-1].lower()) if text[-1:].isalpha() else (text, "")
    power = {"": 0, "k": 10, "m": 20, "g": 30}.get(unit)
    if power is None or not (digits.isascii() and digits.isdigit()):
        raise ValueError(f"not a size: {text!r}")
    return int(digits) << power


def next_power_of_two(n: int) -> int:
    """The least power of two that is not below n; 1 for n below 1."""
    return 1 << (max(n, 1) - 1).bit_length()
