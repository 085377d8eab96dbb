"""Parameters of sketches, with the rules that make them valid."""

from __future__ import annotations

import math
from dataclasses import dataclass

MASK = (1 << 64) - 1

# Hash streams and base seeds that sketches must share to be comparable.
HASH_SEED = 0x9E3779B97F4A7C15
BUCKET_SEED = 0xD1B54A32D192ED03
RANK_SEED = 0xABC98388FB8FAC03
BASE_SEEDS = {
    "A": 0x3C8BFBB395C60474,
    "C": 0x3193C18562A02B4C,
    "G": 0x20323ED082572324,
    "T": 0x295549F54BE24456,
}
STREAM_DENSIFY = 0x44454E53494659
STREAM_BUCKET = 0x4255434B4554
STREAM_RANK = 0x52414E4B
STREAM_POSITION = 0x504F534954494F4E
UNIVERSAL_A = 0x2545F4914F6CDD1D
UNIVERSAL_B = 0x9E3779B185EBCA87
EMPTY = MASK

POSITION_MODES = ("value", "mix", "stripe")


def mix64(x: int) -> int:
    """The splitmix64 finaliser."""
    x = (x + HASH_SEED) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def stream_seed(default: int, seed: int, stream: int) -> int:
    """The constant of a hash stream; seed 0 keeps the default."""
    return mix64(default ^ mix64(seed ^ stream)) if seed else default


def signed(x: int) -> int:
    """The two's complement view of 64 bits, as LONG columns hold them."""
    return x - (1 << 64) if x >> 63 else x


def floor_pow2(x: int) -> int:
    """The largest power of two up to x; 1 for x below 1."""
    return 1 << (max(1, x).bit_length() - 1)


def bucket_count(bits: int, j0: float) -> int:
    """Buckets of a sketch of ``bits`` tuned to threshold ``j0`` (halves round up)."""
    return floor_pow2(int(math.floor(max(1.0, bits / (4.0 * (1.0 - j0))) + 0.5)))


@dataclass(frozen=True)
class SketchParams:
    """``sketch_bits`` is a positive multiple of 64, ``j0`` lies strictly between 0 and 1,
    ``oph_buckets`` is 0 (use the sketch's own) or a power of two.  k = 0 sketches nothing."""

    sketch_bits: int = 8192
    k: int = 64
    canonical: bool = True
    j0: float = 0.75
    mode: str = "value"
    seed: int = 0
    oph_buckets: int = 0

    def __post_init__(self) -> None:
        if self.sketch_bits <= 0 or self.sketch_bits % 64:
            raise ValueError("sketch size must be a positive multiple of 64")
        if not 0.0 < self.j0 < 1.0:
            raise ValueError("j0 must be between 0 and 1")
        if self.k < 0:
            raise ValueError("k must not be negative")
        if self.mode not in POSITION_MODES:
            raise ValueError(f"position mode must be one of {', '.join(POSITION_MODES)}")
        if self.oph_buckets < 0 or self.oph_buckets & (self.oph_buckets - 1):
            raise ValueError("bucket override must be a power of two")
        if not 0 <= self.seed <= MASK:
            raise ValueError("seed must fit in 64 bits")

    @property
    def buckets(self) -> int:
        return bucket_count(self.sketch_bits, self.j0)

    @property
    def bucket_seed(self) -> int:
        return stream_seed(BUCKET_SEED, self.seed, STREAM_BUCKET)

    @property
    def rank_seed(self) -> int:
        return stream_seed(RANK_SEED, self.seed, STREAM_RANK)

    @property
    def position_seed(self) -> int:
        return stream_seed(HASH_SEED, self.seed, STREAM_POSITION)

    @property
    def universal(self) -> tuple[int, int]:
        """(a, b) of the universal hash that picks donors of empty buckets."""
        s = stream_seed(HASH_SEED, self.seed, STREAM_DENSIFY)
        return (UNIVERSAL_A ^ s) | 1, (UNIVERSAL_B + (s << 1)) & MASK
