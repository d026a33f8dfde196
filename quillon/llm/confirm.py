"""Similar documents, from candidate keys to links confirmed on whole shingle sets.

A signature gives each document some table keys and a bitmap. Documents that meet under a key and whose bitmaps differ
in few bits are candidates; chains of candidates make families. Within a family links are confirmed on the documents'
whole sets of shingles, most central members first, until every pair is either confirmed, refused or already joined by
others. So no link among candidates is lost, and a family of near copies of one text takes about one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillon.llm import textscan as T
from quillon.llm.components import components, ensure_checkpoint_dir
from quillon.llm.skew import join_unique, together

#: Up to so many documents under a key are compared by their bitmaps; under a larger key all are taken for candidates.
KEY_ROWS = 2_000
#: Families of up to so many members and shingles are one task's work; larger ones are dealt into parts.
FAMILY_ROWS, FAMILY_SHINGLES = 10_000, 1 << 22
#: Members that the first round holds against a large family; each further round takes twice as many, up to the last number.
PIVOTS, MOST_PIVOTS = 8, 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: (sorted distinct shingles of all texts, offsets of the texts in them) to (keys, a list of an equal number per text; bitmaps, rows of bytes)
Signature = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by hashes of 64 bits, ascending, one text after the other; and the texts' offsets.

    Lower-cases A-Z and takes runs of bytes other than 0x20 and 0x09-0x0D as words. A text of fewer than ``shingle``
    words, but not none, is one shingle; null, empty and blank texts have none.
    """
    raw, offsets = T.text_bytes(column)
    raw = _LOWER[raw]
    starts, ends, first = T.words(raw, offsets)
    hashes = T.word_hashes(raw, starts, ends, 10)
    at, text = T.window_starts(first, shingle)
    runs = T.window_hashes(hashes, shingle, 11)[at]
    counts = np.diff(first)
    brief = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(brief):
        whole = [T.mix(np.array([hashes[first[i] : first[i + 1]] @ T.multipliers(int(counts[i]), 11)], dtype=np.uint64) ^ np.uint64(counts[i]))[0] for i in brief.tolist()]
        runs, text = np.concatenate([runs, np.array(whole, dtype=np.uint64)]), np.concatenate([text, brief])
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    return runs[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def parts(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column ``text`` has about ``size`` bytes, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text")).fill_null(0)).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + size)))
            yield batch.slice(low, high - low)
            low = high


def blobs(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def set_names(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits for each set, the same for equal sets; n sets hold a false match with probability n * n / 2 ** 65."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(runs * np.uint64(0x9E3779B97F4A7C15)))])
    return T.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def signed(docs: DataFrame, shingle: int, signature: Signature) -> DataFrame:
    """For each row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``row`` (a hash of both), ``node`` (the name of its set,
    null for an empty set), ``n`` (the set's size), ``keys`` and ``bits``."""
    plain = docs.select("doc_id", "text", _row_key().alias("row"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1 << 19):
            runs, offsets = shingle_sets(part.column("text"), shingle)
            n = np.diff(offsets)
            some = n > 0
            of_set = np.concatenate([[0], offsets[1:][some]])  # the sets that are not empty
            keys, bits = signature(runs, of_set)
            at = np.zeros(len(n), dtype=np.int64)
            at[some] = np.arange(some.sum())
            listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(some, keys.shape[1], 0))]).astype(np.int32), pa.array(keys.view(np.int64).ravel()))
            bitmap = blobs(bits).take(pa.array(at, mask=~some)) if some.any() else pa.nulls(len(n), pa.binary())
            node = pa.array(set_names(runs, offsets), mask=~some)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), node, pa.array(n.astype(np.int64)), listed, bitmap], ["doc_id", "row", "node", "n", "keys", "bits"])

    schema = StructType([plain.schema["doc_id"], *[StructField(c, LongType()) for c in ("row", "node", "n")], StructField("keys", ArrayType(LongType())), StructField("bits", BinaryType())])
    return plain.mapInArrow(f, schema)


def _bitmaps(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths, a multiple of 8, as rows of 64 bits."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``a`` from ``b``."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """Union-find over what one task has seen linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that come sorted by it; one key's rows are held at a time, with others of the batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _forests(limit: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of each key, sorted by node, what chains of bitmaps within ``limit`` bits join: links to its least node."""
        forest = Forest()
        for rows in _runs_of(batches, "key"):
            nodes, bits = rows.column("node").to_pylist(), _bitmaps(rows.column("bits"))
            left, out = np.arange(len(nodes)), []
            while len(left) > 1:
                queue, least, left = [left[0]], nodes[left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = _apart(bits[left], bits[x]) <= limit
                    out += [(least, nodes[y]) for y in left[near].tolist()]  # the same for many keys of near copies
                    queue += left[near].tolist()
                    left = left[~near]
            out = [x for x in out if forest.join(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return f


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node those whose key has several: ``node``, ``key``, ``met`` (the key's rows) and ``least`` (its least node).

    Beyond KEY_ROWS rows a key's further rows are passed on as they come, with one more than that as their number.
    """

    def out(key: int, nodes: list[int], met: int, least: int) -> pa.RecordBatch:
        n = len(nodes)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, met)), pa.array(np.full(n, least))], ["node", "key", "met", "least"])

    held_key, held, least, hot = None, [], None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
        heads = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        ends = np.append(heads[1:], len(keys))
        several = (ends - heads > 1) | (heads == 0) | (ends == len(keys))  # others are alone within the batch
        made = []
        for a, b in zip(heads[several].tolist(), ends[several].tolist(), strict=True):
            if keys[a] != held_key:
                if len(held) > 1 and not hot:
                    made.append(out(held_key, held, len(held), least))
                held_key, held, least, hot = int(keys[a]), [], int(nodes[a]), False
            held += nodes[a:b].tolist()
            if hot or len(held) > KEY_ROWS:
                made.append(out(held_key, held, KEY_ROWS + 1, least))
                held, hot = [], True
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if len(held) > 1 and not hot:
        yield out(held_key, held, len(held), least)


def _to_least(links: DataFrame) -> DataFrame:
    """Links (a, b; a < b) that connect what ``links`` connect: all that b is linked to, and b, are linked to the least of these.

    A node is b at most once for each of its keys, which bounds what is collected. In a group of near copies every key has
    its own least node; most members share the least of these, so that their links, one for each task, become one.
    """
    met = links.groupBy("b").agg(F.collect_set("a").alias("all")).withColumn("m", F.array_min("all"))
    return met.select(F.col("m").alias("a"), F.explode(F.concat(F.array("b"), F.array_remove("all", F.col("m")))).alias("b")).distinct()


def families(keyed: DataFrame, distinct: DataFrame, limit: int) -> DataFrame:
    """``node``, ``family`` and ``score`` of every row of ``distinct`` (``node``, ``bits``) that is any other's candidate; ``keyed`` has the keys of each ``node``.

    Candidates share a key and differ in at most ``limit`` bits; of a key with more than KEY_ROWS rows all are taken for
    candidates of its least node. ``score`` counts the rows met under all keys: of near copies of one text that text
    has the most. Keys cross the network once; what is alone under its key ends there.
    """
    rows = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    near = together(rows, "key").sortWithinPartitions("key", "node").mapInArrow(_met, "node long, key long, met long, least long").checkpoint()
    scores = near.groupBy("node").agg(F.sum("met").alias("score"))
    few = near.where(F.col("met") <= KEY_ROWS).select("node", "key").join(distinct.select("node", "bits"), "node")
    links = together(few, "key").sortWithinPartitions("key", "node").mapInArrow(_forests(limit), "a long, b long")
    many = near.where((F.col("met") > KEY_ROWS) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(_to_least(links).unionByName(many)).withColumnRenamed("root", "family").join(scores, "node")


class _Rule:
    """Is the intersection of two sets at least ``least`` / ``of`` of their union."""

    def __init__(self, least: int, of: int, limit: int):
        self.least, self.of, self.limit = least, of, limit

    def holds(self, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Whether it is, of one set and each of some others (none empty); all are looked up at once."""
        sizes = np.fromiter(map(len, others), np.int64, len(others))
        flat = np.concatenate(others)
        there = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        same = np.add.reduceat(there, np.cumsum(sizes) - sizes, dtype=np.int64)
        return self.of * same >= self.least * (len(one) + sizes - same)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in column.to_pylist()]


def _whole_families(rule: _Rule):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by family, the most central first."""
        for rows in _runs_of(batches, "family"):
            nodes, bits, sets = rows.column("node").to_pylist(), _bitmaps(rows.column("bits")), _sets(rows.column("shingles"))
            out = []
            label = np.array(nodes, dtype=np.int64)  # the class of each member
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            for x in range(len(nodes) - 1):
                others = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
                fits = rule.of * np.minimum(size[others], size[x]) >= rule.least * np.maximum(size[others], size[x])
                others = others[fits]
                others = others[_apart(bits[others], bits[x]) <= rule.limit]
                for low in range(0, len(others), 256):  # bounds the memory of one look-up
                    part = others[low : low + 256]
                    for y in part[rule.holds(sets[x], [sets[y] for y in part.tolist()])].tolist():
                        if label[y] != label[x]:
                            out.append((nodes[x], nodes[y]))
                            label[label == label[y]] = label[x]
                if (label == label[x]).all():
                    break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return f


def _against_pivots(rule: _Rule):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by family, part and kind: a part's pivots, then its members."""
        held, pivots, forest = None, [], Forest()
        for batch in batches:
            out = []
            bits = _bitmaps(batch.column("bits")) if batch.num_rows else None
            for i, (family, part, kind, node, label, blob) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("family", "part", "kind", "node", "label", "shingles")], strict=True)):
                if held != (family, part):
                    held, pivots, forest = (family, part), [], Forest()
                mine = np.frombuffer(blob, dtype=np.uint64)
                if kind == 0:
                    pivots.append((node, label, mine, bits[i]))
                    if len(pivots) > 1:
                        continue
                    table = None
                    continue
                if table is None:
                    table = np.array([p[3] for p in pivots])
                near = [pivots[k] for k in np.flatnonzero(_apart(table, bits[i]) <= rule.limit).tolist()]
                near = [p for p in near if forest.root(label) != forest.root(p[1])]
                if near:
                    for (other, its_label, _, _), linked in zip(near, rule.holds(mine, [p[2] for p in near]).tolist(), strict=True):
                        if linked and forest.join(label, its_label):
                            out.append((other, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return f


def _large_families(members: DataFrame, sizes: DataFrame, rule: _Rule) -> DataFrame:
    """Links of families that are dealt into parts.

    Each round takes the most central members that were no pivot yet and holds all members of other classes against
    them. A family is done when those that were no pivot are all of one class, for then every other pair was tried.
    """
    spark = members.sparkSession
    parted = members.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("of_parts"))).checkpoint()
    links = spark.createDataFrame([], "a long, b long")
    used = spark.createDataFrame([], "node long")
    labels = parted.select("node", F.col("node").alias("label"))
    count, few = PIVOTS, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        waiting = parted.select("family", "node", "score").join(used, "node", "left_anti").join(labels, "node")
        open_ = waiting.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("family").checkpoint()
        if open_.isEmpty():
            return links
        rank = F.expr("row_number() OVER (PARTITION BY family ORDER BY score DESC, node)")
        pivots = waiting.join(open_, "family").withColumn("rank", rank).where(F.col("rank") <= count).select("node").checkpoint()
        now = parted.join(open_, "family", "left_semi").join(labels, "node")
        columns = ["family", "part", "kind", "node", "label", "bits", "shingles"]
        given = now.join(pivots, "node", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_parts") - 1))).withColumn("kind", F.lit(0))
        rows = given.select(columns).unionByName(now.withColumn("kind", F.lit(1)).select(columns))
        found = together(rows, "family", "part").sortWithinPartitions("family", "part", "kind", "node").mapInArrow(_against_pivots(rule), "a long, b long")
        links = links.unionByName(found).coalesce(few).checkpoint()
        used = used.unionByName(pivots).coalesce(few).checkpoint()
        labels = parted.select("node").join(components(links).withColumnRenamed("root", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label")).checkpoint()
        count = min(2 * count, MOST_PIVOTS)


def confirmed_links(docs: DataFrame, members: DataFrame, shingle: int, least: int, of: int, limit: int) -> DataFrame:
    """Links (a, b) of ``members`` (``node``, ``row``, ``n``, ``bits``, ``family``, ``score``) whose sets' intersection is at least
    ``least`` / ``of`` of their union; they connect just what all such pairs of a family within ``limit`` bits connect.

    ``docs`` are the documents that ``row`` names; only the members' sets are made, from whole texts.
    """
    rule = _Rule(least, of, limit)
    wanted = members.select("row", "node", "bits", "family", "score")
    texts = docs.select(_row_key().alias("row"), "text").join(wanted, "row").drop("row")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            runs, offsets = shingle_sets(part.column("text"), shingle)
            own = np.flatnonzero(set_names(runs, offsets) == np.asarray(part.column("node")))  # rows whose key is equal by chance are passed over
            part = part.take(pa.array(own))
            blob = pa.array([runs[offsets[i] : offsets[i + 1]].tobytes() for i in own.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("node", "family", "score", "bits")], blob], ["node", "family", "score", "bits", "shingles"])

    held = texts.mapInArrow(f, "node long, family long, score long, bits binary, shingles binary").dropDuplicates(["node"]).checkpoint()
    sizes = members.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    of_parts = F.greatest(F.ceil(F.col("rows") / FAMILY_ROWS), F.ceil(F.col("n") / FAMILY_SHINGLES))
    large = sizes.select("family", of_parts.alias("of_parts")).where("of_parts > 1").checkpoint()
    small = held.join(large, "family", "left_anti") if not large.isEmpty() else held
    links = together(small, "family").sortWithinPartitions("family", F.desc("score"), "node").mapInArrow(_whole_families(rule), "a long, b long")
    if large.isEmpty():
        return links
    return links.unionByName(_large_families(held, large, rule))


def similar_groups(docs: DataFrame, shingle: int, least: int, of: int, signature: Signature, limit: int) -> DataFrame:
    """``doc_id``, ``n`` (the size of its set) and ``component_id``: the least ``doc_id`` that chains of confirmed links reach.

    Equal sets are one node; an empty set is linked with nothing. A null ``doc_id`` takes no part in the least.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    prints = signed(docs, shingle, signature).checkpoint()
    distinct = prints.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.min("doc_id").alias("least"), F.first("bits").alias("bits")).checkpoint()
    # The keys, the widest part, are kept once, with the rows; here those of one row for each set are taken.
    keyed = prints.select("node", "row", "keys").join(distinct.select("node", "row"), ["node", "row"]).dropDuplicates(["node", "row"])
    members = families(keyed, distinct.select("node", "bits"), limit).join(distinct.select("node", "row", "n", "bits"), "node").checkpoint()
    named = named_groups(distinct.select("node", "least"), "node", confirmed_links(docs, members, shingle, least, of, limit))
    found = join_unique(prints.where("node IS NOT NULL").select("doc_id", "n", "node"), named, "node", "doc_id").select("doc_id", "n", "component_id")
    return found.unionByName(prints.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def named_groups(distinct: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """``node`` and ``component_id``: the least ``least`` that the links reach from each row of ``distinct``."""
    roots = components(links).withColumnRenamed("node", node)
    # Only linked nodes need their component's least id; a component may hold a third of them.
    linked = distinct.join(roots, node)
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    renamed = join_unique(linked, ids, "root", node).select(node, "component_id", F.lit(True).alias("found"))
    return distinct.join(renamed, node, "left").select(node, F.when(F.col("found"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
