"""Norm hierarchy over a forest of jurisdictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import fold
from quillon.sources.shared import shared_folder

# Ranks of the levels of law, lower is of higher authority, and the jurisdiction level that enacts each.
RANKS = {"constitutional": 10, "international": 20, "federal": 30, "cantonal": 40, "municipal": 50}
ENACTED_BY = {"constitutional": "federal", "international": "international", "federal": "federal", "cantonal": "cantonal", "municipal": "municipal"}


def rank(level: Column | str) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    out = F.lit(None).cast("int")
    for name, value in RANKS.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def ancestors(tree: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(id, ancestor, distance) with each node itself at 0 (G1, G8); the least distance where there are several ways; cycles end.

    ``tree`` has ``id`` and ``parent_id``; a node may have several rows, so several parents. Goes on until a round adds no
    pair, or up to ``most_depth`` steps where that is asked for.

    Round k holds all pairs nearer than 2 ** k, and the nodes that are exactly 2 ** k steps up; pairs up to twice as far
    are those steps followed by known pairs. In a forest every pair is made once. Both tables are checkpointed each
    round, so the plan has the same size at every depth, and rounds grow with the logarithm of the depth.
    """
    shared_folder(tree.sparkSession)
    up = tree.where("parent_id IS NOT NULL AND id IS NOT NULL").select("id", F.col("parent_id").alias("up")).distinct().checkpoint()
    known = tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct().checkpoint()
    named, reach = known.select(F.col("id").alias("up"), "ancestor", "distance"), 1
    outside = up.select("up").distinct().join(known.select(F.col("id").alias("up")), "up", "left_anti").select("up", F.col("up").alias("ancestor"), F.lit(0).alias("distance")).checkpoint()  # parents without a row of their own
    while most_depth is None or reach <= most_depth:
        further = up.join(named.unionByName(outside), "up").select("id", "ancestor", (F.col("distance") + reach).alias("distance"))
        if most_depth is not None:
            further = further.where(F.col("distance") <= most_depth)
        further = further.groupBy("id", "ancestor").agg(F.min("distance").alias("distance")).join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti").checkpoint()
        if further.isEmpty():
            break
        known = known.unionByName(further).checkpoint()
        named = known.select(F.col("id").alias("up"), "ancestor", "distance")
        up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")).distinct().checkpoint()
        reach *= 2
    return known


def rolled_up(tree: DataFrame, amounts: DataFrame, amount: str) -> DataFrame:
    """(id, depth, own, total): each node's summed amount and that of all below it, itself included.

    ``tree`` is a forest of unique ``id``, ``amounts`` has ``id`` and the amount. No pairs of node and ancestor are made: round
    k adds to a node the sums of those exactly 2 ** k below it, each already over what is nearer than that to itself,
    so every round has one row per node. A node on a cycle, or above which one lies, has no depth and no total.
    """
    shared_folder(tree.sparkSession)
    own = amounts.groupBy("id").agg(F.sum(amount).alias("own"))
    nodes = tree.select("id", "parent_id").join(own, "id", "left").select("id", F.col("parent_id").alias("up"), F.coalesce("own", F.lit(0)).alias("own"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("__there"))
    now = nodes.join(known, "up", "left").select("id", "own", F.when(F.col("__there"), F.col("up")).alias("up"), F.col("own").alias("total"), F.when(F.col("__there"), 1).otherwise(0).cast("long").alias("depth")).checkpoint()
    step, most = 1, now.count()
    while step <= most and not now.where("up IS NOT NULL").isEmpty():
        sums = now.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("__more"))
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__next"), F.col("depth").alias("__depth"))
        joined = now.join(sums, "id", "left").join(above, "up", "left")
        now = joined.select("id", "own", F.col("__next").alias("up"), (F.col("total") + F.coalesce("__more", F.lit(0))).alias("total"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")).checkpoint()
        step *= 2
    on_cycle = F.col("up").isNotNull()
    return now.select("id", F.when(~on_cycle, F.col("depth")).alias("depth"), "own", F.when(~on_cycle, F.col("total")).alias("total"))


def governing_scopes(tree: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(id, scope, level): each node, its ancestors, and children of these at the same level as their parent (G1)."""
    path = ancestors(tree, most_depth).join(tree.select(F.col("id").alias("ancestor"), "level"), "ancestor")
    child = tree.select(F.col("parent_id").alias("ancestor"), F.col("id").alias("child"), F.col("level").alias("child_level"))
    siblings = path.join(child, "ancestor").where("child_level = level").select("id", F.col("child").alias("scope"), "level")
    return path.select("id", F.col("ancestor").alias("scope"), "level").unionByName(siblings).distinct()


def document_level(jurisdiction_ranks: Column, declared: Column) -> Column:
    """The most specific rank of a document's jurisdictions; a declared one counts only if it is of higher authority."""
    own = F.array_max(jurisdiction_ranks)
    return F.when(own.isNull(), declared).when(declared < own, declared).otherwise(own)


def superiors(scopes: DataFrame) -> DataFrame:
    """(id, scope) of higher authority than the node itself."""
    own = scopes.where("id = scope").select("id", rank("level").alias("own"))
    return scopes.join(own, "id").where(rank("level") < F.col("own")).select("id", "scope")


def binding_levels(scopes: DataFrame) -> DataFrame:
    """(id, level, rank): levels of law that someone who governs the place enacts."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("by"), F.lit(k).alias("norm_level"), F.lit(RANKS[k]).alias("rank")) for k, v in ENACTED_BY.items()])).alias("x")
    return scopes.select("id", F.col("level").alias("enacts"), rows).where("x.by = enacts").select("id", "x.norm_level", "x.rank").distinct()


def report(levels: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Per place and level: how many documents, the newest k, and whether the level is covered."""
    from quillon.operators.windows import top_k

    counts = documents.groupBy("id", "norm_level").agg(F.count("*").alias("n"))
    top = top_k(documents, ["id", "norm_level"], k, F.col("effective_date").desc_nulls_last(), F.col("document_id")).groupBy("id", "norm_level").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("newest"))
    return levels.join(counts, ["id", "norm_level"], "left").join(top, ["id", "norm_level"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("covered", F.col("n") > 0)


def preferred_scopes(mentioned: DataFrame, scopes: DataFrame) -> DataFrame:
    """(query_id, scope): the places a query names with all that govern them."""
    return mentioned.join(scopes.select(F.col("id").alias("place"), "scope"), "place").select("query_id", "scope").distinct()


def slug(name: Column) -> Column:
    """A place's name as a slug: folded, with dashes."""
    return F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def place_by_slug(names: DataFrame, column: str, tree: DataFrame) -> DataFrame:
    """Rows with ``place_id`` of the place whose name has the same slug, the least id of several."""
    known = tree.groupBy(slug(F.col("name")).alias("__slug")).agg(F.min("id").alias("place_id"))
    return names.withColumn("__slug", slug(F.col(column))).join(known, "__slug", "left").drop("__slug")


def country_of(tree: DataFrame, level: str = "federal") -> DataFrame:
    """(id, country): the nearest ancestor, or the node itself, at the country's level."""
    path = ancestors(tree).join(tree.select(F.col("id").alias("ancestor"), "level"), "ancestor").where(F.col("level") == level)
    return path.groupBy("id").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("country"))
