"""Chat formatting in a prefix tree: conversations that begin alike share what they begin with.

A node is a turn together with all turns before it, named by a chained hash. Each node's text is emitted once, at
consecutive places of one stream of tokens, parents before children and subtrees in one piece (depth first). A token
here is a code point of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import ensure_checkpoint_dir
from quillon.llm.skew import join_unique

# The template's control strings.
TURN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile("|".join(map(re.escape, (TURN, END, OPEN, CLOSE))))
_ROLE = re.compile(r"((?:\\.|[^\\\n])*)\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """As ``escape``, with a backslash before line breaks too: a bare line break ends the role."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where the loss mask begins and ends in it (equal: no loss)."""
    inner = escape(text)
    if role == "user":
        return f"{OPEN} {inner} {CLOSE}", 0, 0
    if role == "assistant":
        return inner + END, 0, len(inner)
    return f"{TURN}{escape_role(role)}\n{inner}{END}", 0, 0


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation; the inverse of formatting its turns in order."""
    out, at = [], 0
    while at < len(formatted):
        if formatted.startswith(OPEN, at):
            end = formatted.index(CLOSE, at)
            out.append(("user", unescape(formatted[at + len(OPEN) + 1 : end - 1])))
            at = end + len(CLOSE)
            continue
        end = formatted.index(END, at)
        if formatted.startswith(TURN, at):
            role = _ROLE.match(formatted, at + len(TURN))
            out.append((unescape(role[1]), unescape(formatted[role.end() : end])))
        else:
            out.append(("assistant", unescape(formatted[at:end])))
        at = end + len(END)
    return out


_NODE = "key string, parent string, depth int, position_start long, n_tokens long, role string, text string, loss_start long, loss_end long"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, conversation by conversation; one may go on in the next batch."""
    names = ["conv_id", "turn", "key", "parent", "depth", "position_start", "n_tokens", "role", "text", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    held, i, key, position = (), 0, None, 0
    for batch in batches:
        rows = []
        for conv, t in zip(batch.column("conv_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
            if held != (conv,):
                held, i, key, position = (conv,), 0, None, 0
            role, text = t["role"] or "", t["text"] or ""
            parent, r = key, role.encode()
            key = hashlib.sha256((key or "").encode() + len(r).to_bytes(4, "big") + r + text.encode()).hexdigest()[:32]
            formatted, a, b = format_turn(role, text)
            rows.append((conv, i, key, parent, i, position, len(formatted), role, formatted, a, b))
            position += len(formatted)
            i += 1
        yield _batch(rows, kinds, names)


def _paths(chains: DataFrame) -> DataFrame:
    """``owner`` (a conversation) and ``prefix`` (hexadecimal), which orders its own nodes depth first with ``depth`` behind it.

    A node's owner is the least conversation that has it, so a conversation owns its turns from one depth on. Before
    that come runs of turns that smaller ones own; the prefix names each run's owner and last depth. It grows with
    the runs, not with the turns, and of k runs each needs a conversation as long as the runs before it.
    """
    owners = chains.groupBy("key").agg(F.min(F.struct("conv_id")).alias("o"))
    runs = join_unique(chains.select("conv_id", "turn", "key"), owners, "key", "conv_id").groupBy("conv_id", F.col("o.conv_id").alias("owner")).agg(F.max("turn").alias("last"))
    lists = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("last", "owner"))).alias("runs"))
    named = lambda c: F.when(c.isNull(), F.lit("0" * 18)).otherwise(F.concat(F.lit("01"), F.lpad(F.hex(c), 16, "0")))
    before = F.transform(F.slice("runs", 1, F.size("runs") - 1), lambda r: F.concat(named(r["owner"]), _hex(r["last"])))
    owning = lists.where(F.element_at("runs", -1)["owner"].eqNullSafe(F.col("conv_id")))
    return owning.select(F.col("conv_id").alias("owner"), F.concat(F.array_join(before, ""), named(F.col("conv_id"))).alias("prefix"))


def _hex(depth: Column) -> Column:
    return F.lpad(F.hex(depth.cast("long")), 8, "0")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``members`` has ``conv_id``, ``turn`` (0, 1, ... in order) and the ``key`` of the turn's node. ``nodes`` has, for each
    distinct prefix: ``key``, ``parent``, ``depth``, ``role``, ``text`` (formatted), ``loss_start`` and ``loss_end`` within it
    (assistant texts only), ``token_start`` and ``token_end`` in the stream, ``position_start`` (its first token's position id:
    the tokens of its ancestors) and ``attends``, the ancestors' token intervals, in order, neighbours merged; a token
    attends to these and to its node's tokens before it.

    Turns are ordered by ``turn``, then role and text, so repeated turn numbers have a fixed order; each row is a turn.
    Null role and text are empty. Rows with a null ``conv_id`` are one
    conversation. Other columns are not read. An empty table has no nodes. A conversation's turns pass through one
    task in sorted order and are not held together;
    a turn that very many conversations share is one row, found by partial aggregates, and joins on its key deal
    these conversations into parts. Stream places come from a range partitioning by path and one total per partition.
    """
    spark = conversations.sparkSession
    ensure_checkpoint_dir(spark)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "t")
    chains = ordered.mapInArrow(_chains, "conv_id long, turn int, " + _NODE).checkpoint()
    columns = [c.split()[0] for c in _NODE.split(", ")]
    first = F.struct("conv_id", "turn")
    distinct = chains.groupBy("key").agg(F.min(first).alias("named"), *[F.first(c).alias(c) for c in columns[1:]])
    paths = _paths(chains)
    placed = distinct.join(paths, F.col("named.conv_id").eqNullSafe(paths["owner"])).withColumn("path", F.unhex(F.concat("prefix", _hex(F.col("depth"))))).drop("owner", "prefix")
    ranked = placed.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).checkpoint()
    totals = {r.part: r.n for r in ranked.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per partition
    before, at = {}, 0
    for part in sorted(totals):
        before[part] = at
        at += totals[part]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = before[batch.column("part")[0].as_py()] if at is None else at
            ends = at + np.cumsum(np.asarray(batch.column("n_tokens")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ends - np.asarray(batch.column("n_tokens")))], ["key", "token_start"])
            at = int(ends[-1])

    places = ranked.mapInArrow(place, "key string, token_start long")
    # A node's ancestors are read off one conversation that has it.
    lines = join_unique(chains.select("conv_id", "turn", "key", "n_tokens"), places, "key", "conv_id").drop("key").repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), interval]
        held, so_far = (), []
        for batch in batches:
            rows = []
            for conv, turn, start, n in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "token_start", "n_tokens")], strict=True):
                if held != (conv,):
                    held, so_far = (conv,), []
                end = start + n
                rows.append((conv, turn, start, end, [dict(i) for i in so_far]))
                if so_far and so_far[-1]["end"] == start:
                    so_far[-1] = {"start": so_far[-1]["start"], "end": end}
                else:
                    so_far.append({"start": start, "end": end})
                if len(rows) >= 1000:
                    yield _batch(rows, kinds, ["conv_id", "turn", "token_start", "token_end", "attends"])
                    rows = []
            yield _batch(rows, kinds, ["conv_id", "turn", "token_start", "token_end", "attends"])

    seen = lines.mapInArrow(ancestors, "conv_id long, turn int, token_start long, token_end long, attends array<struct<start:long,end:long>>")
    named = ranked.select(F.col("named.conv_id").alias("c"), F.col("named.turn").alias("t"), *[c for c in columns if c != "n_tokens"])
    nodes = named.join(seen, F.col("c").eqNullSafe(seen["conv_id"]) & (F.col("t") == seen["turn"])).drop("c", "t", "conv_id", "turn")
    return nodes, chains.select("conv_id", "turn", "key")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation read back from the tree: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    parts = join_unique(members, nodes.select("key", "text", "loss_start", "loss_end"), "key", "conv_id")
    ordered = parts.select("conv_id", "turn", "text", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held, n, n_loss, n_chars, digest, loss_digest = (), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows = []
            for conv, text, a, b in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")], strict=True):
                if held != (conv,):
                    if held:
                        rows.append((*held, n, digest.hexdigest(), n_loss, loss_digest.hexdigest(), n_chars))
                    held, n, n_loss, n_chars, digest, loss_digest = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                turns, loss = read_turns(text), unescape(text[a:b])
                digest.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss_digest.update(loss.encode())
                n, n_loss, n_chars = n + len(turns), n_loss + len(loss), n_chars + len(text)
            yield _batch(rows, kinds, names)
        if held:
            yield _batch([(*held, n, digest.hexdigest(), n_loss, loss_digest.hexdigest(), n_chars)], kinds, names)

    return ordered.mapInArrow(f, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
