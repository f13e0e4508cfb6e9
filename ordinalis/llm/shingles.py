"""Words, runs of words and their hashes, shared by the operators on similar texts.

Words are the pieces of the lower-cased text between runs of white space (no-break space included) and ASCII punctuation. A shingle is
a run of consecutive words. Texts with fewer words than an operator asks for, null texts among them, take no part.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The similarity the project's problems 3 and 4 use: runs of three words, at least 40 words, half in common.
RUN, MIN_WORDS, SIMILARITY = 3, 40, 0.5

_SPLIT = re.compile(r"[\s!-/:-@\[-`{-~]+")
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split(text.lower()) if w] if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(256, 1 << (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def rolling(hashes: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The polynomial hash of the run of ``length`` words at each start; a run that would pass the end stops there and differs from
    any longer run. By prefix sums, so the cost does not depend on ``length``."""
    n = len(hashes)
    if starts is None:
        starts = np.arange(max(0, n - length + 1))
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    stop = np.minimum(starts + length, n)
    return mix((sums[stop] - sums[starts]) * down[starts] + (stop - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined_runs(hashes: np.ndarray, counts: np.ndarray, run: int = RUN) -> np.ndarray:
    """The hashes ``rolling`` makes of the runs of texts of ``counts`` words, at least ``run`` each, that stand one after another; the places at the
    end of a text where no run starts repeat its last one."""
    total = np.full(len(hashes), run, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(run):
        total[: len(hashes) - k] += hashes[k:] * np.uint64(pow(_BASE, k, 1 << 64))
    out, ends = mix(total), np.cumsum(counts)
    for k in range(1, run):
        out[ends - k] = out[ends - run]
    return out


def shingle_set(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    return np.unique(rolling(hashes, run))


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minimum of every window (the rightmost on ties), each once."""
    if len(values) <= window:
        return np.array([len(values) - 1 - int(values[::-1].argmin())]) if len(values) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def seeds(count: int, salt: int) -> np.ndarray:
    """``count`` odd multipliers for as many hash functions."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)) | np.uint64(1)


def minhash(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the set."""
    x = shingles[None, :] * multipliers[:, None]
    return (x ^ (x >> np.uint64(29))).min(axis=1)


def minhashes(shingles: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A byte of the minimum of every hash function over the sets that begin at ``starts``, a row to each function. The minima are made in 32
    bits, of which a processor multiplies many at once, and scrambled before they are cut."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least, held = np.empty((len(multipliers), len(starts)), np.uint32), np.empty_like(x)
    for row, m in zip(least, (multipliers >> np.uint64(32)).astype(np.uint32) | np.uint32(1), strict=True):
        np.minimum.reduceat(np.multiply(x, m, out=held), starts, out=row)
    least ^= least >> np.uint32(16)
    least *= np.uint32(0x7FEB352D)
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x846CA68B)
    return (least >> np.uint32(24)).astype(np.uint8)


def band_values(shingles: np.ndarray, multipliers: np.ndarray, bands: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One value per band of ``depth`` minhashes, for two collections of ``bands`` bands each."""
    sig = minhash(shingles, multipliers).reshape(2 * bands, depth)
    band = mix((sig * seeds(depth, 11)).sum(axis=1, dtype=np.uint64))
    return signed(band[:bands]), signed(band[bands:])


#: One-bit minhashes to a sketch, and the deviations above the mean at which a pair counts as apart.
SKETCH, DEVIATIONS = 256, 4.5
SKETCH_COLUMNS = [f"s{k + 1}" for k in range(SKETCH // 64)]
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def sketch(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The low bits of SKETCH minhashes, packed into signed words."""
    low = (mix(minhash(shingles, multipliers)) & np.uint64(1)).reshape(SKETCH // 64, 64)
    return signed((low * _BIT).sum(axis=1, dtype=np.uint64))


def most_bits(threshold: float) -> float:
    """Different bits up to which a pair may reach ``threshold``: each bit differs with probability (1 - t) / 2, so at the threshold
    itself a pair is lost with a probability of 3e-6, above it with less."""
    return SKETCH * (1 - threshold) / 2 + DEVIATIONS * math.sqrt(SKETCH * (1 - threshold**2)) / 2


def close(left: str, right: str, threshold: float) -> Column:
    """Whether the sketches in the columns ``left``s1.. and ``right``s1.. may belong to a pair of similarity ``threshold``."""
    bits = [F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in SKETCH_COLUMNS]
    return sum(bits[1:], bits[0]) <= most_bits(threshold)


def class_of(values: np.ndarray) -> bytes:
    """A 128-bit name of a sequence of 64-bit values."""
    return xxhash.xxh3_128_digest(np.ascontiguousarray(values).tobytes())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets without repeats."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
