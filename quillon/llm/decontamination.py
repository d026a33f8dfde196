"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``window - gram + 1`` successive word grams a text keeps the one of least hash, so any two texts that share
``window`` words in a row keep the same gram there. A document's kept grams that some item keeps too are extended to
the windows around them, and these are joined with the items' windows by their words. A gram that very many items
share is one entry of the first join; pairs arise only where a whole window occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import fresh, others
from quillon.llm.components import ensure_checkpoint_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of the items' side up to which it is broadcast; larger sides are joined by shuffling both.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def words(text: str) -> Column:
    """The words of a text column: A-Z lower-cased, runs of digits, letters and anything beyond ASCII; null has none."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def run_hashes(hashes: Column, n: int) -> Column:
    """The hash of each run of ``n`` words, from the words' hashes; as long as these, with ``n - 1`` at the end that mean nothing."""
    out = hashes
    for k in range(1, n):
        out = F.zip_with(out, F.slice(hashes, k + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))
    return out


def kept_grams(hashes: Column, window: int, gram: int) -> Column:
    """The winnowed grams of a text, from its words' hashes, as (h, at, n): hash, first word, and ``window``; ties keep the leftmost."""
    width = window - gram + 1

    def placed(runs: Column) -> Column:  # 32 bits of hash, then the position
        return F.transform(F.slice(runs, 1, F.size(runs) - (gram - 1)), lambda x, i: F.shiftleft(x, 31).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(i.cast("long")))

    def least(g: Column) -> Column:  # of each run of ``width``, by doubling
        out, have = g, 1
        while have < width:
            step = min(have, width - have)
            out = F.zip_with(out, F.slice(out, step + 1, F.size(g)), lambda a, b: F.least(a, b))
            have += step
        return F.array_distinct(F.slice(out, 1, F.size(g) - (width - 1)))

    kept = let(let(run_hashes(hashes, gram), placed), least)
    marks = F.transform(kept, lambda k: F.struct(F.shiftright(k, 31).alias("h"), k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("at"), F.lit(window).alias("n")))
    return F.when(F.size(hashes) >= window, marks).otherwise(F.array().cast(_MARKS))


def _runs(hashes: Column, n: int) -> Column:
    return F.transform(run_hashes(hashes, n), lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("at"), F.lit(n).alias("n")))


_MARKS = "array<struct<h:bigint,at:int,n:int>>"


def _small(df: DataFrame, row_bytes: Column) -> bool:
    """Are the rows of ``df`` and their summed bytes few enough for a broadcast."""
    rows, size = df.agg(F.count("*"), F.sum(row_bytes)).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def _run(ws: Column, at: Column, n: Column) -> Column:
    """Words from ``at`` on, as one string; words hold no space, so different runs differ."""
    return F.array_join(F.slice(ws, at + 1, n), " ")


#: What is made of a document's items unless other columns are asked for.
ITEM_IDS: Mapping[str, Callable[[Column], Column]] = {"item_ids": lambda ids: ids}


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, lists: Mapping[str, Callable[[Column], Column]] = ITEM_IDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (strings, ascending) and ``contaminated`` added.

    ``lists`` names other columns to be made of the array of ids in place of ``item_ids``. They are made once for each
    different list, not for each document: items that share windows and documents that share hits are never paired.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``. A window is ``window`` successive
    words of an item; an item of fewer words, but not none, is one window. ``n_hit`` counts the document's words
    inside any occurrence of a window, ``item_ids`` lists the items of which a window occurs.

    Null or empty texts have no words and are never hit; items without words hit nothing. An item with a null id
    hits but is not listed. Rows of ``docs`` are told apart by 128 bits of their id and text, so null ids, repeated
    ids and repeated rows are treated like any other; likewise repeated items. Other columns of ``docs`` may have
    any name; those with the added names are replaced. An empty table of items hits nothing.

    The windows that occur are written to the checkpoint folder when this is called: one row for each place.
    """
    if window < gram:
        raise ValueError("a gram cannot be longer than the window")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    hashed = F.transform("ws", lambda x: F.xxhash64(x))
    known = items.select(F.col("item_id").cast("string").alias("item"), words("text").alias("ws")).where(F.size("ws") > 0).distinct()
    n = F.least(F.size("ws"), F.lit(window))
    item_windows = known.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda s: _run(F.col("ws"), s, n))).alias("w")).distinct()
    lengths = sorted(r[0] for r in known.where(F.size("ws") < window).select(F.size("ws").alias("n")).distinct().collect())  # fewer than ``window``

    def marks(whole: bool) -> Column:
        """Of an item (``whole``) its kept grams, or all of it if it is short; of a document what may meet these."""

        def of(hs: Column) -> Column:
            out = [kept_grams(hs, window, gram)]
            for k in lengths:
                fits = F.size(hs) == k if whole else F.size(hs) >= k
                out.append(F.when(fits, F.slice(_runs(hs, k), 1, F.greatest(F.size(hs) - (k - 1), F.lit(0)))).otherwise(F.array().cast(_MARKS)))
            return F.concat(*out)

        return let(hashed, of)

    def around(ws: Column, mark: Column) -> Column:
        """The windows that a mark may stand for: all that hold a kept gram, or the run itself."""
        low = F.when(mark["n"] < window, mark["at"]).otherwise(F.greatest(F.lit(0), mark["at"] - (window - gram)))
        high = F.when(mark["n"] < window, mark["at"]).otherwise(F.least(mark["at"], F.size(ws) - window))
        return F.transform(F.sequence(low, high), lambda s: F.struct(s.alias("at"), mark["n"].alias("n"), _run(ws, s, mark["n"]).alias("w")))

    item_marks = known.select(F.explode(marks(True)).alias("m")).select("m.h").distinct()
    key = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
    text_words = docs.select(key(0).alias("k"), key(1).alias("l"), words("text").alias("ws")).where(F.size("ws") > 0)
    met = text_words.select("k", "l", "ws", F.explode(marks(False)).alias("m")).select("k", "l", "ws", "m", F.col("m.h").alias("h"))
    if _small(item_marks, F.lit(8)):
        near = met.join(F.broadcast(item_marks), "h", "left_semi").select("k", "l", F.explode(around(F.col("ws"), F.col("m"))).alias("x"))
    else:  # the words do not travel with every gram
        places = met.select("k", "l", "m", "h").join(item_marks, "h", "left_semi").groupBy("k", "l").agg(F.collect_set("m").alias("ms"))
        near = text_words.join(places, ["k", "l"]).select("k", "l", F.explode(F.flatten(F.transform("ms", lambda m: around(F.col("ws"), m)))).alias("x"))
    # Windows of the same items name one list of them; its digest travels in place of the items.
    grouped = item_windows.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("of", F.sha2(F.to_json("items"), 256)).checkpoint()
    known_lists = grouped.select("of", "items").dropDuplicates(["of"])
    windows = grouped.select("w", "of")
    windows = F.broadcast(windows) if _small(windows, F.octet_length("w") + 64) else windows
    spans = near.select("k", "l", "x.*").join(windows, "w").select("k", "l", "at", "n", "of").distinct().checkpoint()
    hits = spans.groupBy("k", "l").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_sort(F.collect_set("of")).alias("of")).withColumn("lists", F.sha2(F.array_join("of", ","), 256))
    each = hits.select("lists", "of").dropDuplicates(["lists"]).select("lists", F.explode("of").alias("of")).join(known_lists, "of")
    merged = each.groupBy("lists").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
    made = merged.select("lists", *[f(F.col("ids")).alias(f"__{c}") for c, f in lists.items()])
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    added = ("n_words", "n_hit", *lists, "contaminated")
    k, l, n_words, n_hit, found = fresh(docs, "k", "l", "n", "hit", "found")
    hits = hits.select(F.col("k").alias(k), F.col("l").alias(l), F.size(covered).cast("long").alias(n_hit), "lists").join(made, "lists").select(k, l, n_hit, F.struct(*[F.col(f"__{c}").alias(c) for c in lists]).alias(found))
    plain = docs.select(*others(docs, added), key(0).alias(k), key(1).alias(l), F.size(words("text")).cast("long").alias(n_words))
    hit = F.coalesce(F.col(n_hit), F.lit(0).cast("long"))
    nothing = F.array().cast("array<string>")
    out = [hit.alias("n_hit"), *[F.coalesce(F.col(found)[c], f(nothing)).alias(c) for c, f in lists.items()], (hit > 0).alias("contaminated")]
    return plain.join(hits, [k, l], "left").select(*others(docs, added), F.col(n_words).alias("n_words"), *out)
