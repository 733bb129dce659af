"""Hash families over character shingles.

Two families share one interface (``minhash(sentence) -> array<bigint>``):

``MultiplyShiftFamily``  64-bit wrap-around vector hashing. ANSI SQL arithmetic
    raises on overflow, so this one is an Arrow UDF over whole batches; it is
    also much the faster one (see README) and the default.
``PrimeFamily``  ``(base * a + b) mod p`` over an md5 base hash, in built-in
    column functions only, for clusters without Python on the executors. Lambda
    functions are interpreted, so whole tables are hashed by exploding windows
    and taking minima as aggregates, which are compiled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions import kernels
from likeness.functions.text import shingle_array
from likeness.params import MinHashParams

PRIME = 2147483647
# Windows cut out of a long text at once: finding a character walks the text
# from its start.
PART = 64
# Windows in one exploded row: fewer look-ups of the row's minima. Twice as many
# make the generated method too long to be compiled well.
BLOCK = 4


def _streams(seed: int) -> list[np.random.SeedSequence]:
    """One stream for the coefficients, one for the draws, from a master seed."""
    return np.random.SeedSequence(seed).spawn(2)


def draw_indices(params: MinHashParams) -> list[list[int]]:
    """Hash-function indices of each signature draw, picked with replacement.

    The lists depend on the seed alone, so every sentence uses the same ones.
    """
    rng = np.random.default_rng(_streams(params.seed)[1])
    return rng.integers(0, params.num_hashes, (params.draws, params.sig_len)).tolist()


class MultiplyShiftFamily:
    """``h(v) = ((sum_w v_w * a_w + b) mod 2^64) >> (64 - bits)``, odd ``a_w``.

    A shingle is read as a vector of words of three code points each, first
    code point in the low bits.
    """

    def __init__(self, params: MinHashParams):
        self.bits = params.hash_bits
        self.shingle_len = params.shingle_len
        words = -(-params.shingle_len // kernels.CHARS_PER_WORD)
        rng = np.random.default_rng(_streams(params.seed)[0])
        top = np.iinfo(np.uint64).max
        shape = (params.num_hashes, words)
        self.a = rng.integers(0, top, shape, dtype=np.uint64, endpoint=True) | np.uint64(1)
        self.b = rng.integers(0, top, params.num_hashes, dtype=np.uint64, endpoint=True)

    def minhash(self, sentence: Column) -> Column:
        """Minimum of each function over all shingles; null without shingles."""
        return self._udf(kernels.minhash_batch, "array<bigint>")(sentence)

    def argmin(self, sentence: Column) -> Column:
        """1-based position of the first shingle that attains each minimum."""
        return self._udf(kernels.argmin_batch, "array<int>")(sentence)

    def _udf(self, kernel, return_type: str):
        batch = kernels.bind(kernel, self.shingle_len, self.a, self.b, self.bits)
        return F.arrow_udf(batch, return_type)


class PrimeFamily:
    """``(base * a + b) mod p`` with ``base`` from the md5 of the shingle."""

    def __init__(self, params: MinHashParams):
        self.shingle_len = params.shingle_len
        rng = np.random.default_rng(_streams(params.seed)[0])
        self.a = rng.integers(1, PRIME, params.num_hashes).tolist()
        self.b = rng.integers(0, PRIME, params.num_hashes).tolist()

    def minhash(self, sentence: Column) -> Column:
        """Minimum of each function over all shingles; null without shingles."""
        bases = F.transform(shingle_array(sentence, self.shingle_len), _md5_base)
        # The one-element array binds the base hashes to a lambda variable, so
        # that they are computed once and not once per function.
        minima = F.transform(F.array(bases), self._minima)[0]
        return F.when(F.length(sentence) >= self.shingle_len, minima)

    def starts(self, text: str, step: int) -> str:
        """SQL of the positions of every ``step``-th window, one at least; null for null."""
        return f"sequence(1, greatest(length({text}) - {self.shingle_len - 1}, 1), {step})"

    def cut(self, text: str, start: str, step: int) -> str:
        """SQL of the text of ``step`` windows from a position on."""
        return f"substr({text}, {start}, {step + self.shingle_len - 1})"

    def bases(self, block: str) -> list[str]:
        """SQL of the base hashes of a block's windows; a short block has its last one again."""
        last = f"length({block}) - {self.shingle_len - 1}"
        places = [f"least({i}, {last})" for i in range(1, BLOCK + 1)]
        return [
            f"CAST(conv(substr(md5(substr({block}, {at}, {self.shingle_len})), 1, 8), 16, 10) AS BIGINT) % {PRIME}L"
            for at in places
        ]

    def minima(self, bases: list[str]) -> str:
        """SQL of the array of each function's minimum, as aggregates over columns of base hashes."""
        least = [
            f"min(least({', '.join(f'({x} * {a}L + {b}L) % {PRIME}L' for x in bases)}))"
            for a, b in zip(self.a, self.b)
        ]
        return f"array({', '.join(least)})"

    def _minima(self, bases: Column) -> Column:
        return F.array(
            *[F.array_min(F.transform(bases, _affine(a, b))) for a, b in zip(self.a, self.b)]
        )


def _md5_base(shingle: Column) -> Column:
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def _affine(a: int, b: int):
    return lambda base: (base * F.lit(a) + F.lit(b)) % F.lit(PRIME)
