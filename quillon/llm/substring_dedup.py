"""Substring dedup: remove words covered by a window of words that also starts in a document with a smaller id.

Three passes over the documents, which are dealt once into groups by a hash of their id and text:

1. Every group sends, for each row of a count-min sketch, the sorted cells its distinct windows fall into
   (a cell at most twice), cut into ranges of cells. The partial sketches of a range are merged in one task
   and each group gets back one bit per cell it sent: is the merged count two or more. Counts are only ever
   too high, so no repeated window is lost. The sketch grows with the input, so its error does not.
2. Windows whose cells all count two or more go, with the smallest id of the group that has them, to the
   range of their 128-bit key, made of two independent hashes of each word, where equal windows are grouped.
   Back goes one bit per window: does another group hold it under a smaller id.
3. Each group applies the bits to its own texts.

What is exchanged beside the texts are compressed key differences and bits; no list of the members of a
window is ever built, so a passage shared by a third of all documents costs one entry per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.llm import textscan as T
from quillon.llm.columns import column

_BITS = "g long, kind int, bucket long, bits binary"
_BLOB = "bucket long, g long, blob binary"


class _Plan:
    """Sizes that all passes share."""

    def __init__(self, width: int, depth: int, total_bytes: int, group_bytes: int, load: int):
        self.width, self.depth = width, depth
        # Groups and ranges grow together, so that a group's message to a range does not shrink as the input grows.
        group_bytes *= min(2.0, max(1.0, math.sqrt(total_bytes / (1 << 30))))
        self.groups = max(1, math.ceil(total_bytes / group_bytes))
        self.cell_bits = max(16, math.ceil(math.log2(max(1, total_bytes / 6 * load))))
        self.block_bits = min(26, max(16, self.cell_bits - 9))
        self.range_bits = max(1, math.ceil(math.log2(self.groups)) + 2)


class _Windows:
    """The distinct windows of one group, ascending by key, with the least and greatest id that hold each."""

    def __init__(self, table: pa.Table, plan: _Plan):
        self.raw, self.offsets = T.text_bytes(table["text"])
        self.starts, self.ends, self.first = T.words(self.raw, self.offsets)
        ids = table["doc_id"].combine_chunks()
        known = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        at, text = T.window_starts(self.first, plan.width)
        keep = known[text]
        self.at, text = at[keep], text[keep]
        self.ids = ids[text]
        low = T.window_hashes(T.word_hashes(self.raw, self.starts, self.ends, 0), plan.width, 1)[self.at]
        high = T.window_hashes(T.word_hashes(self.raw, self.starts, self.ends, 1), plan.width, 2)[self.at]
        order = np.argsort(low)
        a, b = low[order], high[order]
        del text, keep
        if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
            order = np.lexsort((high, low))
            a, b = low[order], high[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        self.key, self.check = a[heads], b[heads]
        ordered = self.ids[order]
        self.least = np.minimum.reduceat(ordered, heads) if len(heads) else ordered
        self.most = np.maximum.reduceat(ordered, heads) if len(heads) else ordered
        self.entry = np.empty(len(a), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def cells(self, plan: _Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each row of the sketch: the cell of each distinct window, and what to send: ascending, a cell at most twice."""
        for row in range(plan.depth):
            cell = self.key if row == 0 else T.mix(self.key * T.multipliers(plan.depth, 3)[row])
            cell = cell >> np.uint64(64 - plan.cell_bits)
            sent = np.sort(np.concatenate([cell, cell[self.most > self.least]]))
            third = np.zeros(len(sent), dtype=bool)
            third[2:] = sent[2:] == sent[:-2]
            yield row, cell, sent[~third]

    def repeated(self, plan: _Plan, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Which distinct windows the merged sketch counts twice or more."""
        out = np.ones(len(self.key), dtype=bool)
        for row, cell, sent in self.cells(plan):
            bits = [np.unpackbits(np.frombuffer(answers[0, bucket], dtype=np.uint8), count=to - at) for bucket, at, to in _runs(sent >> np.uint64(plan.block_bits), row << 40)]
            if bits:
                out &= np.concatenate(bits)[np.searchsorted(sent, cell)].astype(bool)
        return out


def _runs(bucket: np.ndarray, base: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of equal values in an ascending array."""
    if not len(bucket):
        return []
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(base + int(bucket[i]), int(i), int(j)) for i, j in zip(heads, [*heads[1:], len(bucket)], strict=True)]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, columns, types, strict=True)})


def _blobs(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["bucket", "g", "blob"], [pa.int64(), pa.int64(), pa.binary()])


def _answers(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(k, b): x for k, b, x in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["bits"].to_pylist(), strict=True)}


def _send_cells(plan: _Plan):
    def f(key, table):
        w, g = _Windows(table, plan), key[0].as_py()
        rows = []
        for row, _, sent in w.cells(plan):
            inner = sent & np.uint64((1 << plan.block_bits) - 1)
            rows += [(bucket, g, T.pack_sorted(inner[i:j])) for bucket, i, j in _runs(sent >> np.uint64(plan.block_bits), row << 40)]
        return _blobs(rows)

    return f


def _merge_cells(plan: _Plan):
    def f(key, table):
        parts = [T.unpack_sorted(x) for x in table["blob"].to_pylist()]
        cells = np.sort(np.concatenate(parts))
        twice = np.zeros(1 << plan.block_bits, dtype=bool)
        twice[cells[1:][cells[1:] == cells[:-1]]] = True
        rows = [(g, 0, key[0].as_py(), np.packbits(twice[p]).tobytes()) for g, p in zip(table["g"].to_pylist(), parts, strict=True)]
        return _table(rows, ["g", "kind", "bucket", "bits"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    return f


def _send_windows(plan: _Plan):
    def f(key, table, bits):
        if not table.num_rows:
            return _blobs([])
        w, g = _Windows(table, plan), key[0].as_py()
        pick = w.repeated(plan, _answers(bits))
        k, c, least = w.key[pick], w.check[pick], w.least[pick]
        rows = []
        for bucket, i, j in _runs(k >> np.uint64(64 - plan.range_bits), 0):
            packed = [T.pack_sorted(k[i:j] - (np.uint64(bucket) << np.uint64(64 - plan.range_bits))), T.pack_plain(c[i:j]), T.pack_plain(least[i:j])]
            rows.append((bucket, g, b"".join(len(p).to_bytes(4, "little") + p for p in packed)))
        return _blobs(rows)

    return f


def _merge_windows(key, table):
    keys, checks, leasts = [], [], []
    for blob in table["blob"].to_pylist():
        parts, at = [], 0
        while at < len(blob):
            n = int.from_bytes(blob[at : at + 4], "little")
            parts.append(blob[at + 4 : at + 4 + n])
            at += 4 + n
        keys.append(T.unpack_sorted(parts[0]))
        checks.append(T.unpack_plain(parts[1], "<u8"))
        leasts.append(T.unpack_plain(parts[2], "<i8"))
    k, c, least = np.concatenate(keys), np.concatenate(checks), np.concatenate(leasts)
    order = np.lexsort((c, k))
    new = np.ones(len(k), dtype=bool)
    a, b = k[order], c[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    overall = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    elsewhere = np.zeros(len(k), dtype=bool)
    elsewhere[order] = overall < least[order]
    rows, at = [], 0
    for g, part in zip(table["g"].to_pylist(), keys, strict=True):
        rows.append((g, 1, key[0].as_py(), np.packbits(elsewhere[at : at + len(part)]).tobytes()))
        at += len(part)
    return _table(rows, ["g", "kind", "bucket", "bits"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])


def _remove(plan: _Plan, normalise: bool):
    def f(key, table, bits):
        w, answers = _Windows(table, plan), _answers(bits)
        pick = w.repeated(plan, answers)
        k = w.key[pick]
        smaller = np.zeros(len(w.key), dtype=bool)
        found = [np.unpackbits(np.frombuffer(answers[1, bucket], dtype=np.uint8), count=j - i) for bucket, i, j in _runs(k >> np.uint64(64 - plan.range_bits), 0)]
        if found:
            smaller[pick] = np.concatenate(found).astype(bool)
        gone_at = w.at[smaller[w.entry] | (w.ids > w.least[w.entry])]
        n = len(w.starts)
        cover = np.bincount(gone_at, minlength=n + 1) - np.bincount(gone_at + plan.width, minlength=n + 1)[: n + 1]
        kept = np.cumsum(cover)[:n] == 0
        n_words = np.diff(w.first)
        before = np.concatenate([[0], np.cumsum(kept)])
        n_kept = before[w.first[1:]] - before[w.first[:-1]]
        # Mark the bytes of kept words, and the one space before each but the first of its text.
        edge = np.zeros(len(w.raw) + 1, dtype=np.int8)
        edge[w.starts[kept]] += 1
        edge[w.ends[kept]] -= 1
        mark = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        which = np.flatnonzero(kept)
        text_of = np.searchsorted(w.first, which, side="right") - 1
        later = np.ones(len(which), dtype=bool)
        later[:1] = False
        later[1:] = text_of[1:] == text_of[:-1]
        gaps = w.starts[which[later]] - 1
        mark[gaps] = True
        out = w.raw.copy()
        out[gaps] = 0x20
        sizes = np.concatenate([[0], np.cumsum(mark)])[w.offsets]
        made = pa.LargeStringArray.from_buffers(table.num_rows, pa.py_buffer(np.ascontiguousarray(sizes - sizes[0]).astype(np.int64)), pa.py_buffer(out[mark]))
        text = made
        if not normalise:
            text = pa.compute.if_else(pa.array(n_kept < n_words), made, table["text"].combine_chunks().cast(pa.large_string()))
        columns = {"doc_id": table["doc_id"], "text": text.cast(pa.string()), "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array((n_words - n_kept).astype(np.int64))}
        return pa.table(columns | ({"rest": table["rest"]} if "rest" in table.column_names else {}))

    return f


def remove_repeated_spans(docs: DataFrame, width: int = 13, depth: int = 2, group_bytes: int = 4 << 20, load: int = 8, normalise: bool = True) -> DataFrame:
    """Remove from each text the words covered by a window of ``width`` words that also starts under a smaller ``doc_id``.

    ``docs`` has ``doc_id`` (integer) and ``text``; any other columns come back unchanged. Words are runs of bytes
    other than 0x20 and 0x09-0x0D. Returns ``doc_id``, ``text``, ``n_words``, ``n_removed`` and the other columns.
    With ``normalise`` every text is its kept words joined by one space; without, texts that lose nothing stay as
    they are (null stays null).

    Null text has no words. A text shorter than the window loses nothing. A row without an id neither loses words
    nor makes others lose any. Rows that share an id are one document: they do not remove from each other. Ties
    cannot arise: only a strictly smaller id removes. An empty table gives an empty table. Other columns may have any
    name; those named ``n_words`` or ``n_removed`` are replaced.

    Windows are compared by 128 bits; rows are dealt by id and text, so neither rows without an id nor rows that
    share one meet in one group, unless their texts are equal as well.

    ``load`` is the number of sketch cells per word of the input; ``group_bytes`` the text a task holds at a time
    (one text is never cut). Both set costs only, not the result.
    """
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_words", "n_removed")]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = _Plan(width, depth, total, group_bytes, load)
    group: Column = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(plan.groups)).cast("long")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*map(column, rest)).alias("rest")] if rest else []), group.alias("g"))
    counted = dealt.groupBy("g").applyInArrow(_send_cells(plan), _BLOB).groupBy("bucket").applyInArrow(_merge_cells(plan), _BITS)
    exact = dealt.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(_send_windows(plan), _BLOB).groupBy("bucket").applyInArrow(_merge_windows, _BITS)
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), *([dealt.schema["rest"]] if rest else [])])
    out = dealt.groupBy("g").cogroup(counted.unionByName(exact).groupBy("g")).applyInArrow(_remove(plan, normalise), schema)
    return out.select("doc_id", "text", "n_words", "n_removed", *[F.col("rest")[c].alias(c) for c in rest])
