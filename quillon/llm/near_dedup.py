"""Near-duplicate groups: SimHash fingerprints linked through a multi-index hash table.

Two rules: ``near_duplicates`` links fingerprints of 64 bits at up to four differing bits; ``similar_documents`` takes its
candidates from fingerprints of more bits and links documents whose sets of word shingles are similar enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import textscan as T
from quillon.llm.components import ensure_checkpoint_dir
from quillon.llm.confirm import Forest, named_groups, similar_groups
from quillon.llm.skew import join_unique, together

#: (lowest bit, bits) of the segments of a fingerprint; every value is found under all keys within one bit of each.
HALVES = ((0, 32), (32, 32))
#: Keys with more rows than this are split by equal pieces of the other half, those with more than the second by its quarters.
KEY_ROWS, PIECE_ROWS = 1_000, 200_000


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of a word sequence: bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), 1 << 16):  # bounds the memory that a very long text takes
        hashes = np.fromiter([digest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(starts)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def simhash(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (long, the 64 bits as a signed integer) in front of its other columns.

    Lower-cases A-Z, takes runs of bytes other than 0x20 and 0x09-0x0D as words, and hashes each run of ``shingle``
    words joined by one space, repeats included; a shorter text is one shingle. Null, empty and blank text: zero.
    """
    schema = docs.select("doc_id", "text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_buffer().to_pybytes().lower().split(), shingle) if t.is_valid else 0 for t in batch.column("text").cast(pa.large_string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], ["doc_id", "fingerprint"])

    return schema.mapInArrow(f, f"doc_id {schema.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _grow(values: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that join those of ``values`` within ``most`` bits: a spanning forest, found breadth first.

    Every member is compared once with those not yet reached, so a group of near copies takes about one pass.
    """
    left = np.arange(len(values))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(values[left] ^ values[x]) <= most
            if near.any():
                yield from ((int(x), int(y)) for y in left[near])
                queue += left[near].tolist()
                left = left[~near]


def _verify(most: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ascending by key; a key's rows may go on in the next batch."""
        forest = Forest()
        keys, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            same = keys[1:] == keys[:-1]
            edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            two = first[last - first == 2]
            two = two[np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= most]
            out = [x for x in zip(values[two].tolist(), values[two + 1].tolist(), strict=True) if forest.join(*x)]
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                if j - i > 2:
                    out += [x for a, b in _grow(values[i:j].view(np.uint64), most) if forest.join(*(x := (int(values[i + a]), int(values[i + b]))))]
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column("key"))])
            values = np.concatenate([values, np.asarray(batch.column("fingerprint"))])
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                yield links(keys[:cut], values[:cut])
                keys, values = keys[cut:], values[cut:]
        yield links(keys, values)

    return f


def _ball(value: Column, low: int, bits: int, number: int) -> Column:
    """All keys within one bit of a segment of the value, with the segment's number above them."""
    segment = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(number << bits))
    return F.transform(F.array(*[F.lit(m).cast("long") for m in (0, *(1 << i for i in range(bits)))]), lambda m: segment.bitwiseXOR(m))


def near_links(fingerprints: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of ``fingerprint`` (64 bits, distinct) that connect just what chains of values within ``most`` bits
    (five at most) connect.

    Multi-index hashing: of so many bits one half holds at most two. Every value enters the table of each half under all
    keys within one bit of it, and is looked up under the same keys, so two halves within two bits meet at a key
    midway. What meets is verified on all bits. A key with more than KEY_ROWS rows is split by the other half: cut in one
    piece more than bits may differ, one piece is equal; beyond PIECE_ROWS rows, where pieces would hold too many, one
    of its quarters differs in at most two bits and is met in the same manner. Within a key, links form a spanning forest.
    """
    if not 0 <= most <= 5:
        raise ValueError("two halves within two bits each cover at most five differing bits")
    value = F.col("fingerprint")
    ball = F.concat(*[_ball(value, low, bits, i) for i, (low, bits) in enumerate(HALVES)])
    keyed = fingerprints.select("fingerprint", F.explode(ball).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).checkpoint()
    if not hot.isEmpty():
        other = F.when(F.shiftright("key", 32) == 0, F.shiftrightunsigned(value, 32)).otherwise(value)  # the half that the key is not of
        cuts = [32 * i // (most + 1) for i in range(most + 2)]
        pieces = F.array(*[F.shiftrightunsigned(other, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit((i + 2) << 32)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
        quarters = F.concat(*[_ball(other, low, 16, i) for i, low in enumerate((0, 16))])
        split = keyed.join(hot, "key").select("fingerprint", "key", F.explode(F.when(F.col("n") <= PIECE_ROWS, pieces).otherwise(quarters)).alias("part")).select("fingerprint", F.xxhash64("key", "part").alias("key"))
        keyed = keyed.join(hot, "key", "left_anti").select("fingerprint", "key").unionByName(split)
    return together(keyed, "key").sortWithinPartitions("key").mapInArrow(_verify(most), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id``, the least ``doc_id`` that chains of near fingerprints reach.

    ``docs`` has ``doc_id`` (integer) and ``text``; other columns are not read. Equal fingerprints are linked by
    grouping, so only distinct ones are compared. Texts without words share fingerprint zero and are linked like
    any other. A null ``doc_id`` takes no part in the least; a component of nulls only has a null id. Repeated
    rows come back as often as they came. An empty table gives an empty table.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    prints = simhash(docs, shingle).checkpoint()
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = named_groups(distinct, "fingerprint", near_links(distinct.select("fingerprint"), most))
    return join_unique(prints, named, "fingerprint", "doc_id").select("doc_id", "fingerprint", "component_id")


#: Bits of a segment that may be flipped, its least certain ones, and how many of them at a time.
WEAK, FLIPS = 4, 2
#: The share of pairs at the threshold that has to meet in some segment.
RECALL = 0.97


@cache
def segments_needed(width: int, similarity: float, recall: float = RECALL) -> int:
    """Segments of ``width`` bits that two sets of this similarity need to meet in one with probability ``recall``.

    A segment's chance to meet is counted over 40,000 pairs of made segments, whose bits are signs of correlated normal sums.
    """
    rng = np.random.default_rng(21)
    shared = 2 * similarity / (1 + similarity)  # the correlation of both sets' sums of random signs
    x, a, b = (rng.normal(size=(40_000, width)) for _ in range(3))
    a, b = math.sqrt(shared) * x + math.sqrt(1 - shared) * a, math.sqrt(shared) * x + math.sqrt(1 - shared) * b
    differ = (a > 0) ^ (b > 0)
    weak_a, weak_b = (np.argsort(np.argsort(np.abs(v), axis=1), axis=1) < WEAK for v in (a, b))
    of_a, of_b, of_both = ((differ & w).sum(axis=1) for w in (weak_a & ~weak_b, weak_b & ~weak_a, weak_a & weak_b))
    meets = ~(differ & ~weak_a & ~weak_b).any(axis=1) & (of_a <= FLIPS) & (of_b <= FLIPS) & (of_a + of_b + of_both <= 2 * FLIPS)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets.mean()))


def bits_apart(similarity: float, bits: int, deviations: float = 5.2) -> int:
    """The differing bits to be expected of two sets of this Jaccard similarity (those of the angle between them), and some standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def set_sums(runs: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """For each set (none empty) and each of 64 bits of ``words`` hashes: in how many more shingles it is set than not."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), words, 64), dtype=np.int32)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for word, odd in enumerate(T.multipliers(words, 12)):
        for low in range(0, len(runs), 1 << 16):  # bounds the memory that unpacked bits take
            part = text[low : low + (1 << 16)]
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            bits = np.unpackbits(T.mix(runs[low : low + (1 << 16)] * odd).view(np.uint8).reshape(-1, 8), axis=1)
            out[part[heads], word] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return 2 * out.reshape(len(sizes), -1) - sizes[:, None].astype(np.int32)


def segment_keys(sums: np.ndarray, width: int, segments: int) -> np.ndarray:
    """All keys of each segment: its bits with up to FLIPS of its WEAK least certain ones flipped, and its number."""
    parts = sums[:, : width * segments].reshape(-1, segments, width)
    powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
    base = ((parts > 0) * powers).sum(axis=2, dtype=np.uint64)
    weak = powers[np.argsort(np.abs(parts), axis=2, kind="stable")[:, :, :WEAK]]
    flips = [c for k in range(FLIPS + 1) for c in combinations(range(WEAK), k)]
    keys = np.stack([base ^ weak[:, :, list(c)].sum(axis=2, dtype=np.uint64) for c in flips], axis=2)
    return T.mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(segments, dtype=np.uint64)[:, None]).reshape(len(sums), segments * len(flips))


def similar_documents(docs: DataFrame, shingle: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """``doc_id`` and ``component_id``, the least ``doc_id`` that chains of similar documents reach.

    Two documents are similar if the intersection of their sets of ``shingle`` words in a row is at least ``least`` / ``of``
    of the union; every link is confirmed on whole sets. Candidates come from multi-index hashing of SimHash bits over
    the sets: each segment is entered in its table, and looked up, under all keys in the ball around it that flipping
    up to FLIPS of its least certain bits spans. The segments are as long as the number of documents asks for, eight bits
    longer than its logarithm, and so many that a pair at the threshold meets with probability RECALL; the README has
    the shares found by measurement. More alike pairs are found the more surely.

    Words and the treatment of null, empty and short texts, null ids, repeated rows and empty tables are those of
    ``near_duplicates``, but repeated shingles count once, and texts without words are linked with nothing.
    """
    width = max(24, math.ceil(math.log2(max(1, docs.count()))) + 8)
    segments = segments_needed(width, least / of)
    words = -(-width * segments // 64)

    def signature(runs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = set_sums(runs, offsets, words)
        return segment_keys(sums, width, segments), np.packbits(sums > 0, axis=1)

    return similar_groups(docs, shingle, least, of, signature, bits_apart(least / of, 64 * words)).select("doc_id", "component_id")
