"""Packing token sequences so that every sequence costs about the same attention and almost nothing is padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.pieces import PieceEncoder, blocks

_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


def attention_cost(length: np.ndarray | int, linear: float, quadratic: float) -> np.ndarray | float:
    """What a piece costs: so much a token, and so much a pair of its tokens."""
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Fill as many sequences as the tokens fill: (sequences of (item, start, length), what is left over).

    Items go longest first to the cheapest sequence that still has room. Those for which none has room are cut to
    fill the gaps, cheapest sequence first. Ties go to the earlier item and sequence. Every sequence is full; less
    than one sequence's tokens are left over. Items are at most ``capacity`` long.
    """
    n = sum(lengths) // capacity
    room, cost = np.full(n, capacity), np.zeros(n)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    spare: list[tuple[int, int, int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[item]
        fits = room >= length
        if not fits.any():
            spare.append((item, 0, length))
            continue
        k = int(np.where(fits, cost, np.inf).argmin())
        bins[k].append((item, 0, length))
        room[k] -= length
        cost[k] += attention_cost(length, linear, quadratic)
    spare.reverse()
    for k in np.argsort(cost, kind="stable"):
        while room[k]:
            item, start, length = spare.pop()
            take = min(int(room[k]), length)
            bins[k].append((item, start, take))
            room[k] -= take
            if take < length:
                spare.append((item, start + take, length - take))
    return bins, spare[::-1]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096, pool_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of all texts in sequences of ``capacity`` tokens: one row per piece, its ids as little-endian 32-bit integers.

    A document is its ids by the tokenizer at ``vocabulary`` (a shared path), then ``end_id``; null and empty text is
    ``end_id`` alone. Tokens beyond full sequences of one document, and whole shorter documents, gather in pools of
    ``pool_tokens``; each pool goes longest first to the cheapest sequence with room, under a cost of ``linear`` a
    token plus ``quadratic`` a pair within a piece. What a task has left at its end, less than one sequence, is cut into
    sequences whose lengths are powers of two, so no sequence needs padding.

    Tasks pack the rows of their own partition: nothing is exchanged, and a task holds one pool and one text.
    ``sequence_id`` is the partition's number times 2**32 plus a count, so a task that is run again gives the same ids.
    Columns: ``doc_id``, ``start`` (the document's ids before it), ``length``, ``ids``, ``doc_tokens``, ``sequence_id``,
    ``offset``, ``cost``. Rows with equal or null ids are packed each for itself; other columns are not read. An empty
    table gives no sequences.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = PieceEncoder.of(vocabulary)
        base, made = TaskContext.get().partitionId() << 32, 0
        pool: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        held = 0

        def rows(sequences: list[list[tuple[tuple, int, int]]]) -> pa.RecordBatch:
            nonlocal made
            out: list[tuple] = []
            for sequence in sequences:
                at = 0
                for (doc, start, ids, total), skip, length in sequence:
                    out.append((doc, start + skip, length, ids[skip : skip + length].astype("<u4").tobytes(), total, base + made, at, attention_cost(length, linear, quadratic)))
                    at += length
                made += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

        def flush() -> pa.RecordBatch:
            nonlocal pool, held
            bins, spare = assign([len(p[2]) for p in pool], capacity, linear, quadratic)
            out = rows([[(pool[i], s, n) for i, s, n in b] for b in bins])
            pool = [(pool[i][0], pool[i][1] + s, pool[i][2][s : s + n], pool[i][3]) for i, s, n in spare]
            held = sum(len(p[2]) for p in pool)
            return out

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            docs_of = batch.column("doc_id").to_pylist()
            for i, j in blocks(texts):
                for doc, ids in zip(docs_of[i:j], encoder.encode(texts[i:j]), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    full = len(ids) // capacity * capacity
                    if full:
                        yield rows([[((doc, 0, ids, len(ids)), s, capacity)] for s in range(0, full, capacity)])
                    if full < len(ids):
                        pool.append((doc, full, ids[full:], len(ids)))
                        held += len(ids) - full
                if held >= pool_tokens:
                    yield flush()
        if pool:
            yield flush()
        left = held
        while left:  # the rest, largest power of two first
            size = 1 << (left.bit_length() - 1)
            left -= size
            sequence = []
            while size:
                doc, start, ids, total = pool.pop(0)
                take = min(size, len(ids))
                sequence.append(((doc, start, ids, total), 0, take))
                if take < len(ids):
                    pool.insert(0, (doc, start + take, ids[take:], total))
                size -= take
            yield rows([sequence])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, f"doc_id long, {_SCHEMA}")
