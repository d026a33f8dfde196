"""MinHash near-dedup with odd sketches.

MinHash samples of a document's shingle set are cut into bands, whose values are table keys, and folded into a parity
bitmap: each sample flips the bit that its number and value hash to. The XOR of two bitmaps keeps only samples that
differ, so its population count estimates high similarities precisely; it decides which documents that meet in a band
are held against each other as whole sets.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textscan as T
from quillon.llm.confirm import similar_groups

#: Bands and samples a band: two sets of similarity 0.85 meet in none with probability 2.4e-7, of 0.9 with 1e-10.
BANDS, ROWS = 26, 5
#: Bits of the odd sketch.
BITS = 512


def min_samples(runs: np.ndarray, offsets: np.ndarray, samples: int) -> np.ndarray:
    """The least of each set (none empty) under each of ``samples`` hash functions: a row of 32 bits each for every set."""
    out = np.empty((len(offsets) - 1, samples), dtype=np.uint32)
    low = (runs >> np.uint64(32)).astype(np.uint32)
    draw = np.random.default_rng(13)
    flips, odds = draw.integers(0, 1 << 32, samples, dtype=np.uint32), draw.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    if len(out):
        first = 0
        while first < len(out):  # sets of some 64,000 shingles at a time, or one
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 16))) - 1)
            part, at = low[offsets[first] : offsets[last]], offsets[first:last] - offsets[first]
            for i in range(samples):
                out[first:last, i] = np.minimum.reduceat((part ^ flips[i]) * odds[i], at)
            first = last
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64 bits for each band of each row of samples."""
    odds = T.multipliers(bands * rows, 14).reshape(bands, rows)
    return T.mix((samples[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64) * odds).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity bitmap of each row of samples, as bytes."""
    n, k = samples.shape
    place = T.mix((samples.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    flat = place.astype(np.int64) + np.arange(n)[:, None] * bits
    return np.packbits((np.bincount(flat.ravel(), minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1)


def estimate(apart: float, samples: int, bits: int = BITS) -> float:
    """The similarity at which sketches of so many samples are expected to differ in ``apart`` bits."""
    return 1 + bits / (4 * samples) * float(np.log(max(1e-9, 1 - 2 * apart / bits)))


@cache
def sketch_limit(similarity: float, samples: int, bits: int = BITS, loss: float = 1e-7) -> int:
    """The fewest bits that sketches of sets of this similarity exceed with probability of at most ``loss``.

    By the exact law: each sample differs with probability 1 - ``similarity`` and then flips two bits, one of each sketch.
    """
    chance = np.zeros(samples + 1)  # of so many differing samples
    chance[0] = 1.0
    for _ in range(samples):
        chance[1:] = chance[1:] * similarity + chance[:-1] * (1 - similarity)
        chance[0] *= similarity
    odd = np.zeros(bits + 1)  # of so many odd bits
    odd[0] = 1.0
    total = chance[0] * odd
    up, down = (bits - np.arange(bits + 1)) / bits, np.arange(bits + 1) / bits
    for d in range(1, samples + 1):
        for _ in range(2):
            rise, fall = odd * up, odd * down
            odd = np.zeros(bits + 1)
            odd[1:] += rise[:-1]
            odd[:-1] += fall[1:]
        total = total + chance[d] * odd
    over = 1 - np.cumsum(total)
    return int(np.flatnonzero(over <= loss)[0])


def minhash_near_duplicates(docs: DataFrame, shingle: int = 3, least: int = 85, of: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs`` (``doc_id`` integer, ``text``).

    A document's set holds its distinct runs of ``shingle`` words (A-Z lower-cased, split at 0x20 and 0x09-0x0D), or its
    whole words as one if they are fewer. Documents are linked if their sets' intersection is at least ``least`` / ``of``
    of the union, which is confirmed on whole sets, told apart by 64 bits a shingle. ``component_id`` is the least
    ``doc_id`` that links reach, ``kept`` whether it is the document's own.

    A pair at the threshold is missed with a probability of (1 - s ** rows) ** bands, 2.4e-7, plus 1e-7 for the sketch.
    Null, empty and blank texts have no set and are linked with nothing. A null ``doc_id`` takes no part in the least;
    a component of nulls has a null id and is kept. Repeated rows come back as often as they came. Other columns are
    not read. An empty table gives an empty table.
    """
    samples = bands * rows

    def signature(runs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = min_samples(runs, offsets, samples)
        return band_keys(values, bands, rows), odd_sketches(values)

    out = similar_groups(docs, shingle, least, of, signature, sketch_limit(least / of, samples))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
