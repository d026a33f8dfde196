"""Fill-in-the-middle documents, cut by rank and select on packed bits.

The texts of a batch lie end to end as UTF-8. A bitvector marks the last byte of every token; it is packed into words of
64 bits with a directory of the ones before each block of eight words. A text's tokens are the ones between its ends
(rank), and the byte where its k-th token ends is the place of a one (select), so no list of tokens is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.llm import textscan as T
from quillon.llm.columns import others, plainly_named
from quillon.llm.confirm import parts

# The control strings before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_BLOCK = 8


class PackedBits:
    """A bitvector in words of 64 bits, the first bit lowest, with the ones before each block of eight words."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        words = -(-max(1, len(bits)) // (64 * _BLOCK)) * _BLOCK
        packed = np.zeros(words * 8, dtype=np.uint8)
        body = np.packbits(bits, bitorder="little")
        packed[: len(body)] = body
        self.words = packed.view(np.uint64).reshape(-1, _BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to the size)."""
        at = np.asarray(at, dtype=np.int64)
        block, word = np.divmod(at >> 6, _BLOCK)
        inside = np.minimum(block, len(self.words) - 1)  # the place behind the last block has no word
        counts = np.bitwise_count(self.words[inside]).astype(np.int64)
        counts[np.arange(_BLOCK) >= word[:, None]] = 0
        low = np.bitwise_count(self.words[inside, word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(block < len(self.words), self.before[inside] + counts.sum(axis=1) + low, self.before[-1])

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the one that has so many ones before it (0 to all but one)."""
        rank = np.asarray(rank, dtype=np.int64)
        block = np.searchsorted(self.before, rank, side="right") - 1
        sums = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        rest = rank - self.before[block]
        word = (sums <= rest[:, None]).sum(axis=1)
        rest -= np.where(word > 0, np.take_along_axis(sums, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        bits = np.unpackbits(self.words[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return (block * _BLOCK + word) * 64 + bit


def token_ends(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Is each byte the last of a token: of a run of other bytes than white space, or of the white space at a text's end."""
    inside = ~T._SPACE[raw]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = True
    return ends


def _share(digest: Column, group: int) -> Column:
    """The ``group``-th eight digits of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _holds(column: pa.Array, strings: Sequence[str]) -> np.ndarray:
    found = np.zeros(len(column), dtype=bool)
    for s in strings:
        found |= pa.compute.match_substring(column, s).to_numpy(zero_copy_only=False).astype(bool)
    return found


def _code_points(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return before[stops] - before[starts]


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output`` added.

    ``docs`` has ``doc_id`` and ``text``. A token is a run of characters other than 0x20 and 0x09-0x0D with the white
    space before it, or the white space that a text ends with. Four numbers h1 to h4 are the first 32 hexadecimal digits
    of the SHA-256 of ``seed``, a colon and the decimal id. The prefix ends behind the lesser, the middle behind the greater of
    h1 and h2 modulo n + 1 tokens. A text that is empty, holds a sentinel, or whose h3 modulo 100 is not below ``rate``
    stays plain; of the others h4 modulo 100 below ``spm`` puts the suffix first (spm), else the prefix (psm).

    A null text is empty, a null id reads as an empty string. Rows that share an id are cut by the same numbers. Other
    columns may have any name; those with the added names are replaced. An empty table gives an empty table.
    """
    p_mark, s_mark, m_mark = sentinels
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = docs.select(*others(docs, added))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    named = plainly_named(kept, "text", "doc_id")
    drawn = named.select("*", *[_share(digest, i).alias(f"h{i + 1}") for i in range(4)])
    carried = named.columns
    schema = StructType([*named.schema.fields, *[StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")], *[StructField(c, StringType()) for c in ("form", "output")]])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            column = part.column("text").cast(pa.large_string()).fill_null("")
            raw, offsets = T.text_bytes(column)
            marked = PackedBits(token_ends(raw, offsets))
            first = marked.rank(offsets)
            n = np.diff(first)
            h = [np.asarray(part.column(f"h{i}")) for i in range(1, 5)]
            cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            plain = (n == 0) | (h[2] % 100 >= rate) | _holds(column, sentinels)
            # A cut of k tokens lies behind the (k - 1)-th one of the text, or at its start.
            at = [np.where(k > 0, marked.select(np.clip(first[:-1] + k - 1, 0, max(0, marked.ones - 1))) + 1, offsets[:-1]) if marked.ones else offsets[:-1] for k in cuts]
            suffix_first = h[3] % 100 < spm
            data, out = raw.tobytes(), []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if plain[i]:
                    out.append(data[a:b])
                    continue
                x, y = int(at[0][i]), int(at[1][i])
                if suffix_first[i]:
                    out.append(b"".join((s_mark.encode(), data[y:b], p_mark.encode(), data[a:x], m_mark.encode(), data[x:y])))
                else:
                    out.append(b"".join((p_mark.encode(), data[a:x], s_mark.encode(), data[y:b], m_mark.encode(), data[x:y])))
            size = [pa.array(_code_points(raw, lo, hi), mask=plain) for lo, hi in ((offsets[:-1], at[0]), (at[0], at[1]))]
            form = pa.array(np.where(plain, "plain", np.where(suffix_first, "spm", "psm")).astype(object), pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], pa.array(n.astype(np.int64)), *size, form, pa.array(out, pa.binary()).cast(pa.string())], [*carried, "n", "prefix_chars", "middle_chars", "form", "output"])

    made = drawn.mapInArrow(f, schema)
    return made.toDF(*kept.columns, *schema.names[len(kept.columns) :]).select(*others(kept, ()), *added)


def restore(made: DataFrame, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``output`` was made of, by ``form``: no text that was cut holds a sentinel, so each stands once."""
    p, s, m = (F.lit(x) for x in sentinels)
    out = F.col("output")
    between = lambda a, b: F.substring(out, F.instr(out, a) + F.length(a), F.instr(out, b) - F.instr(out, a) - F.length(a))
    middle = F.substring(out, F.instr(out, m) + F.length(m), F.length(out))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out)
