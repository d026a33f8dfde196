"""A trie of conversations' turns, by partition refinement.

All conversations start in one class, the root. Each turn splits every class by what is said in it: a class of depth d
holds the conversations that agree in their first d turns, and is a node. A class with one conversation is retired at
once: the rest of that conversation is a chain of nodes with one child each, emitted from its turns without any further
work. Only classes of two or more go on, in blocks of turns that double, so the rounds grow with the logarithm of the
longest shared prefix. Subtree figures are folded back by doubling too: each round adds up over twice the distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import ensure_checkpoint_dir
from quillon.llm.skew import join_unique, together

#: Turns of the first block; each further block has twice as many.
FIRST_BLOCK = 4
#: Ids that are joined to one piece of text before a class's digest is made of its pieces.
PIECE = 50_000

_EMPTY = hashlib.sha256().hexdigest()


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``turns`` has ``conv_id``, ``pos`` (1, 2, ...), ``digest`` (128 bits of role and text) and ``words`` of the text; ``lengths`` has
    ``conv_id`` and ``n``. Turns are ordered by ``turn``, null first, then role and text, so repeated turn numbers have a
    fixed order; each row is a turn. Null role and text are empty. Rows without a ``conv_id`` belong to no conversation.
    Other columns are not read.

    A range partitioning deals long conversations into parts; the places before a part are one row per partition.
    """
    spark = conversations.sparkSession
    ensure_checkpoint_dir(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    ranged = rows.repartitionByRange("conv_id", "turn").withColumn("part", F.spark_partition_id()).sortWithinPartitions("conv_id", "turn", "role", "text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("i", pa.int64()), ("digest", pa.binary()), ("words", pa.int64())])
        held, i = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            at, digests, words = [], [], []
            for conv, role, text in zip(ids, batch.column("role").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held, i = (conv, i + 1) if conv == held else (conv, 1)
                at.append(i)
                digests.append(hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest()[:16])
                words.append(len(text.split()))  # of bytes: at 0x20 and 0x09-0x0D
            yield _batch([ids, batch.column("part").to_pylist(), at, digests, words], schema)

    local = ranged.mapInArrow(f, "conv_id long, part int, i long, digest binary, words long").checkpoint()
    parts = local.groupBy("part", "conv_id").agg(F.max("i").alias("n")).groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n")).alias("last")).collect()  # one row per partition
    carried, conv, total = [], None, 0
    for p in sorted(parts, key=lambda p: p.part):
        goes_on = p.first == conv
        if goes_on:
            carried.append((p.part, p.first, total))
        total = p.last.n + (total if goes_on and p.last.conv_id == conv else 0)
        conv = p.last.conv_id
    if carried:
        before = F.broadcast(spark.createDataFrame(carried, "part int, conv_id long, before long"))  # at most one row per partition
        local = local.join(before, ["part", "conv_id"], "left").withColumn("i", F.col("i") + F.coalesce("before", F.lit(0).cast("long")))
    turns = local.select("conv_id", F.col("i").alias("pos"), "digest", "words")
    return turns, turns.groupBy("conv_id").agg(F.max("pos").alias("n"))


def rebuilt(turns: DataFrame, lengths: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation c begins with the first h turns of conversation c - c % ``group`` (those there are) and goes on with
    its own turns after its first h; h is the CRC-32 of the decimal c modulo ``heads``. Returns (turns, lengths) again."""
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))  # under ``heads`` entries
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    plan = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(first, "base", "left")
    plan = plan.withColumn("head", F.expr("CASE WHEN head IS NULL OR h = 0 THEN array() ELSE slice(head, 1, h) END")).withColumn("k", F.size("head").cast("long"))
    plan = plan.select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")).checkpoint()
    shared = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.words")
    own = join_unique(turns, plan.select("conv_id", "h", "k"), "conv_id", "pos").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words")
    return shared.unionByName(own).checkpoint(), plan.select("conv_id", "n")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names each place of a block by its class and what was said since; rows come conversation by conversation, in order."""
    schema = pa.schema([(c, pa.int64()) for c in ("conv_id", "pos", "n", "words", "class", "up1", "up2", "key1", "key2")])
    held, key = None, b""
    pair = lambda b: (int.from_bytes(b[:8], "big", signed=True), int.from_bytes(b[8:16], "big", signed=True))
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "pos", "n", "words", "class")]
        ups, keys = [], []
        for conv, cls, digest in zip(columns[0], columns[4], batch.column("digest").to_pylist(), strict=True):
            if conv != held:
                held, key = conv, hashlib.sha256(cls.to_bytes(8, "big", signed=True)).digest()[:16]
            ups.append(pair(key))
            key = hashlib.sha256(key + digest).digest()[:16]
            keys.append(pair(key))
        yield _batch([*columns, [u[0] for u in ups], [u[1] for u in ups], [k[0] for k in keys], [k[1] for k in keys]], schema)


def _folded(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``depth``, ``conv_id``, ``parent_conv_id``, ``leaves``, ``saved``, others) with the last two summed over subtrees.

    After round k a node holds the sums over its descendants nearer than 2 ** k, and the ancestor at that distance.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = nodes.withColumn("up", F.col("parent_conv_id")).checkpoint(), 1
    while step <= deepest:
        sums = now.where("up IS NOT NULL").groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        far = now.select((F.col("depth") + step).alias("depth"), F.col("conv_id").alias("up"), F.col("up").alias("further"))
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
        rest = [c for c in now.columns if c not in ("leaves", "saved", "up")]
        now = now.join(sums, ["depth", "conv_id"], "left").join(far, ["depth", "up"], "left").select(*rest, add("leaves", "l"), add("saved", "s"), F.col("further").alias("up")).checkpoint()
        step *= 2
    return now.drop("up")


def _digests(ends: DataFrame) -> DataFrame:
    """``depth``, ``conv_id`` and ``ends_sha256`` of each node's ``ending`` ids, ascending; ids are joined to pieces in parallel, and pieces hashed in order."""
    ranged = ends.repartitionByRange("depth", "conv_id", "ending").sortWithinPartitions("depth", "conv_id", "ending")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        node, ids = None, []
        for batch in batches:
            out = []
            for depth, conv, ending in zip(*[batch.column(c).to_pylist() for c in ("depth", "conv_id", "ending")], strict=True):
                if node != (depth, conv) or len(ids) == PIECE:
                    out += [(*node, ids[0], ",".join(map(str, ids)))] if ids else []
                    node, ids = (depth, conv), []
                ids.append(ending)
            yield _batch([list(c) for c in zip(*out, strict=True)] or [[]] * 4, schema)
        if ids:
            yield _batch([[node[0]], [node[1]], [ids[0]], [",".join(map(str, ids))]], schema)

    cut = ranged.mapInArrow(pieces, "depth long, conv_id long, first long, ids string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
        node, digest = None, None
        for batch in batches:
            out = []
            for depth, conv, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "conv_id", "ids")], strict=True):
                if node == (depth, conv):
                    digest.update(b",")
                else:
                    out += [(*node, digest.hexdigest())] if node else []
                    node, digest = (depth, conv), hashlib.sha256()
                digest.update(ids.encode())
            yield _batch([list(c) for c in zip(*out, strict=True)] or [[]] * 3, schema)
        if node:
            yield _batch([[node[0]], [node[1]], [digest.hexdigest()]], schema)

    return together(cut, "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(digests, "depth long, conv_id long, ends_sha256 string")


_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id``, ``pos``, ``digest``, ``words``) and ``lengths`` (``conv_id``, ``n``; turnless ones too).

    A node of depth d is a distinct sequence of first d turns; the root has depth 0. Per node: ``conv_id`` (its least
    member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes
    of its subtree, itself included), ``saved_tokens`` (over the subtree, members but one times words of the last turn)
    and ``ends_sha256`` (of the decimal ids, ascending, comma-joined, of the members that end here).

    Turns are told apart by 128 bits. Without conversations there are no nodes. A class is split by an aggregate with
    partial sums and its members are told their new class by a join that deals hot classes into parts; a conversation
    is never held by one task beyond the block in hand.
    """
    spark = turns.sparkSession
    ensure_checkpoint_dir(spark)
    root = lengths.agg(F.min("conv_id")).first()[0]
    if root is None:
        return spark.createDataFrame([], _OUT)
    active = lengths.where("n > 0").withColumn("class", F.lit(root).cast("long")).checkpoint()
    ends = lengths.where("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("conv_id"), F.col("conv_id").alias("ending"))
    shared, retired = [], []
    depth, block = 0, FIRST_BLOCK
    while not active.isEmpty():
        rows = turns.where((F.col("pos") > depth) & (F.col("pos") <= depth + block)).join(active, "conv_id")
        named = together(rows, "conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chained, "conv_id long, pos long, n long, words long, class long, up1 long, up2 long, key1 long, key2 long")
        named = named.select("conv_id", "pos", "n", "words", "class", "up1", "up2", F.struct("key1", "key2").alias("key")).checkpoint()
        classes = named.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("name"), *[F.first(c).alias(c) for c in ("pos", "n", "words", "class", "up1", "up2")]).checkpoint()
        several = classes.where("n_convs > 1")
        # Of the block's further turns only those are nodes to be settled here whose parent has several members.
        inner = classes.where(F.col("pos") > depth + 1).select(F.struct(F.col("up1").alias("key1"), F.col("up2").alias("key2")).alias("key"), "name", "pos", "n", "words", "n_convs")
        inner = join_unique(inner, several.select("key", F.col("name").alias("parent")), "key", "name").drop("key")
        nodes = inner.unionByName(classes.where(F.col("pos") == depth + 1).select("name", "pos", "n", "words", "n_convs", F.col("class").alias("parent"))).checkpoint()
        shared.append(nodes.where("n_convs > 1").select(F.col("pos").alias("depth"), F.col("name").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "words"))
        retired.append(nodes.where("n_convs = 1").select(F.col("name").alias("conv_id"), F.col("pos").alias("since"), "parent", "n"))
        last = named.where((F.col("pos") == depth + block) | (F.col("pos") == F.col("n"))).select("conv_id", "pos", "n", "key")
        last = join_unique(last, several.select("key", "name"), "key", "conv_id").checkpoint()
        ends = ends.unionByName(last.where("pos = n").select(F.col("pos").alias("depth"), F.col("name").alias("conv_id"), F.col("conv_id").alias("ending")))
        active = last.where("pos < n").select("conv_id", "n", F.col("name").alias("class"))
        depth, block = depth + block, 2 * block

    def union(frames: list[DataFrame], empty: str) -> DataFrame:
        out = spark.createDataFrame([], empty)
        for f in frames:
            out = out.unionByName(f)
        return out

    top = lengths.agg(F.count("*").alias("n_convs")).select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("words"))
    several = top.unionByName(union(shared, "depth long, conv_id long, parent_conv_id long, n_convs long, words long"))
    single = union(retired, "conv_id long, since long, parent long, n long").checkpoint()
    children = several.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"), F.lit(0).alias("one"))
    children = children.unionByName(single.select((F.col("since") - 1).alias("depth"), F.col("parent").alias("conv_id"), F.lit(1).alias("one")))
    children = children.groupBy("depth", "conv_id").agg(F.count("*").alias("n_children"), F.sum("one").alias("chains"))
    counted = several.join(children, ["depth", "conv_id"], "left").na.fill(0, ["n_children", "chains"])
    counted = counted.withColumn("leaves", F.col("chains") + F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("chains", "words")
    tops = _folded(counted).join(_digests(ends), ["depth", "conv_id"], "left")
    tops = tops.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    # The chains of conversations that are alone, from where they are: one child each, but for the last turn.
    chains = join_unique(turns.select("conv_id", "pos"), single, "conv_id", "pos").where("pos >= since")
    ended = F.col("pos") == F.col("n")
    long = lambda c: c.cast("long")
    chains = chains.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        long(F.lit(1)).alias("n_convs"), long(F.when(ended, 0).otherwise(1)).alias("n_children"), long(F.lit(1)).alias("n_leaves"), long(F.lit(0)).alias("saved_tokens"),
        F.when(ended, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return tops.unionByName(chains)
