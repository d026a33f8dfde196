"""Exact token counts; huge documents are counted in overlapping chunks that are spliced where they agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.pieces import PieceEncoder, blocks

_CHUNK, _OVERLAP = 1 << 15, 1 << 9


def _offsets(encoder: PieceEncoder, chunk: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of a chunk ends, and how many tokens have been by then."""
    if encoder.plain(chunk):
        pieces = encoder.split(chunk)
        rows = encoder.lookup(pieces)  # may replace encoder.size
        return np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(encoder.size[rows])
    encoding = encoder.tokenizer.encode(chunk, add_special_tokens=False)
    ends = np.array([e for _, e in encoding.offsets], dtype=np.int64)
    word = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)  # None: a special token, a piece of its own
    last = np.ones(len(word), dtype=bool)
    last[:-1] = (word[1:] != word[:-1]) | (word[1:] < 0)
    return ends[last], np.flatnonzero(last) + 1


def count_in_chunks(encoder: PieceEncoder, text: str, chunk: int = _CHUNK, overlap: int = _OVERLAP) -> int:
    """Tokens of ``text``, of which one chunk at a time is encoded; equal to encoding it whole.

    Pieces are found from left to right and looking no further than the piece's end and what follows it, so from a true
    piece boundary on, a chunk has the true pieces until one could reach its end. The next chunk starts up to
    ``overlap`` characters back, perhaps within a piece; where both chunks have a boundary at the same place, with
    two further pieces before the first chunk's end, all that follows in the second is true. If there is no such
    place, as in a run without boundaries, overlap and chunk are doubled.
    """
    total, at = 0, 0  # tokens before the true boundary ``at``
    while True:
        size, back = chunk, overlap
        while True:
            if len(text) - at <= size:
                return total + _last(_offsets(encoder, text[at:])[1])
            ends, counts = _offsets(encoder, text[at : at + size])
            low = size - back
            other, _ = _offsets(encoder, text[at + low : at + low + size])
            special = any(s in text[at + low - 64 : at + size + 64] for s in encoder.special)
            common = np.intersect1d(ends[:-2], other + low) if not special else ends[:0]
            if len(common):
                cut = int(common[-1])
                total += int(counts[np.searchsorted(ends, cut)])
                at += cut
                break
            size, back = size * 2, back * 2


def _last(counts: np.ndarray) -> int:
    return int(counts[-1]) if len(counts) else 0


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = _CHUNK, overlap: int = _OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every whole text.

    Counts are those of the tokenizer at ``vocabulary`` (a shared path) with no added special tokens; special strings
    inside texts count as it counts them by default. Null and empty texts have none. Texts beyond ``chunk`` characters
    are counted in overlapping chunks. Repeated rows come back as often; other columns are not read.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts: list[int] = []
            for i, j in blocks(texts):
                short = iter(encoder.encode([t for t in texts[i:j] if len(t) <= chunk]))
                counts += [len(next(short)) if len(t) <= chunk else count_in_chunks(encoder, t, chunk, overlap) for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = sized.mapInArrow(f, f"doc_id {sized.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
