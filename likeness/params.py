"""User-facing options with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults below are those users of the classic tools know.


@dataclass(frozen=True)
class MinHashParams:
    """Options of the MinHash job.

    ``min_shingles`` and ``max_shingles`` are strict bounds on the number of
    character shingles of a sentence.
    """

    num_hashes: int = 20
    hash_bits: int = 60
    sig_len: int = 10
    draws: int = 10
    shingle_len: int = 12
    seed: int = 1123456
    min_shingles: int = 75
    max_shingles: int = 600

    def __post_init__(self) -> None:
        if not 1 <= self.hash_bits <= 63:
            raise ValueError("hash_bits must lie between 1 and 63")
        if min(self.num_hashes, self.sig_len, self.draws, self.shingle_len) < 1:
            raise ValueError("num_hashes, sig_len, draws and shingle_len must be positive")


@dataclass(frozen=True)
class ProjectionParams:
    """Options of the random-projection job.

    A pair is reported when its Hamming distance is strictly below
    ``threshold``. All-zero vectors carry no direction: they get the all-ones
    signature and match one another, so they are left out unless
    ``keep_zero_vectors`` is set.
    """

    vec_len: int = 400
    sig_len: int = 100
    rounds: int = 10
    window: int = 10
    threshold: int = 5
    seed: int = 1123456
    keep_zero_vectors: bool = False

    def __post_init__(self) -> None:
        if min(self.vec_len, self.sig_len, self.rounds, self.window) < 1:
            raise ValueError("vec_len, sig_len, rounds and window must be positive")
