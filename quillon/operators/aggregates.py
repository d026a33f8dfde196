"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet(df: DataFrame, field: str, size: int | None = None) -> DataFrame:
    """Rows by value, most first, then by value; arrays count a row once for each distinct value."""
    value = F.explode(F.array_distinct(field)) if df.schema[field].dataType.typeName() == "array" else F.col(field)
    out = df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if size is None else out.limit(size)


def status_counts(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """A histogram of statuses as columns, with the total."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def ordered_list(value: str, order: str) -> Column:
    """Values in order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def ordered_text(value: str, order: str, separator: str = " ") -> Column:
    """Values in order, joined."""
    return F.array_join(ordered_list(value, order), separator)


def duplicates(df: DataFrame, key: Column | str) -> DataFrame:
    """Keys that more than one row has, with the count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def week(c: Column | str) -> Column:
    """Monday of the ISO week (F8)."""
    return F.to_date(F.date_trunc("week", F.col(c) if isinstance(c, str) else c))


def weekly_buckets(df: DataFrame, key: str, ts: str, last_week: str, weeks: int) -> DataFrame:
    """Exactly ``weeks`` rows for each key up to the week of ``last_week``, zero where nothing happened.

    The grid is exploded from the distinct keys, so no two tables are crossed.
    """
    counts = df.select(key, week(ts).alias("week")).groupBy(key, "week").agg(F.count("*").alias("n"))
    last = week(F.lit(last_week).cast("timestamp"))
    grid = df.select(key).distinct().withColumn("week", F.explode(F.sequence(F.date_sub(last, 7 * (weeks - 1)), last, F.expr("interval 7 days"))))
    return grid.join(counts, [key, "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def throughput(df: DataFrame, key: str, status: str, applied: str, rejected: str, size: int) -> DataFrame:
    """Busiest keys: total, applied, rejected; most first, then by key."""
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(status) == applied).alias("applied"), F.count_if(F.col(status) == rejected).alias("rejected")).orderBy(F.desc("total"), key).limit(size)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact percentiles by linear interpolation, as columns p50, p90 and so on.

    Each group's distinct values with their counts come first, then running counts: a group of any size is sorted by
    Spark, which spills, and not held in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__v")
    placed = counts.withColumns({"__to": F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    columns = []
    for s in shares:
        at = F.lit(s) * (F.col("__all") - 1)
        value_at = lambda rank: F.min(F.when(F.col("__to") > rank, F.col("__v")))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        columns.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"p{round(s * 100)}"))
    return placed.groupBy(*keys).agg(*columns)


def share_of_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key and their share of all."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def completeness(observed: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Observed against published counts; ``complete`` only where both are known and equal."""
    both = observed.select(key, F.col("n").alias("observed")).join(published.select(key, F.col("n").alias("published")), key, "full_outer")
    return both.withColumn("complete", F.coalesce(F.col("observed") == F.col("published"), F.lit(False)))


def funnel(df: DataFrame, session: str, kind: str, ts: str, within_seconds: int, search: str, focus: str) -> DataFrame:
    """Searches with a time, and how many a focus event follows within the limit in the same session."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    after = Window.partitionBy(session).orderBy(micros).rowsBetween(1, Window.unboundedFollowing)
    next_focus = F.min(F.when(F.col(kind) == focus, micros)).over(after)
    marked = df.where(F.col(ts).isNotNull()).withColumn("hit", (F.col(kind) == search) & F.coalesce(next_focus - micros <= within_seconds * 1_000_000, F.lit(False)))
    return marked.agg(F.count_if(F.col(kind) == search).alias("searches"), F.count_if("hit").alias("focused")).withColumn("focus_rate", F.try_divide("focused", "searches"))


def journey_kpis(df: DataFrame, session: str, kind: str, ts: str, names: dict[str, str], within_seconds: int = 300) -> DataFrame:
    """One row: searches, how many a focus follows, resets per search and refinements per session (A38); null over nothing.

    ``names`` gives the event names of search, focus, reset and refine. Untimed searches count as searches, not in the focus rate.
    """
    counts = df.agg(F.count("*").alias("events"), F.count_if(F.col(kind) == names["search"]).alias("searches"), F.count_if(F.col(kind) == names["reset"]).alias("resets"), F.count_if(F.col(kind) == names["refine"]).alias("refinements"), F.count_distinct(session).alias("sessions"))
    timed = funnel(df, session, kind, ts, within_seconds, names["search"], names["focus"])
    return counts.select(
        "*",
        timed.select("searches").scalar().alias("timed_searches"),
        timed.select("focused").scalar().alias("focused"),
        timed.select("focus_rate").scalar().alias("focus_rate"),
        F.try_divide("resets", "searches").alias("resets_per_search"),
        F.try_divide("refinements", "sessions").alias("refinements_per_session"),
    )


def pooled_max(df: DataFrame, key: str, features: str) -> DataFrame:
    """Sparse vectors of a key pooled by the greatest weight of each feature."""
    return df.select(key, F.explode(features).alias("feature", "weight")).groupBy(key, "feature").agg(F.max("weight").alias("weight"))


def mass(features: Column | str) -> Column:
    """The sum of a map's values."""
    return F.aggregate(F.map_values(features), F.lit(0.0), lambda a, x: a + x)


def top_entries(features: Column | str, size: int) -> Column:
    """The heaviest entries of a map, heaviest first, then by key."""
    entries = F.array_sort(F.transform(F.map_entries(features), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return F.map_from_entries(F.transform(F.slice(entries, 1, size), lambda e: F.struct(e["k"], -e["w"])))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """An ordered page; the limit is kept within 1 and ``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def keyset_page(df: DataFrame, key: str, after: object, limit: int) -> tuple[DataFrame, bool]:
    """The next page by key, and whether it is the last, which a short page is."""
    rows = (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)
    return rows, rows.count() < limit


def json_counters(df: DataFrame, keys: Sequence[str], payload: str, outcomes: Sequence[str]) -> DataFrame:
    """Counts of an ``outcome`` inside JSON, one column each, and of what is none of them."""
    outcome = F.get_json_object(payload, "$.outcome")
    known = F.coalesce(outcome.isin(*outcomes), F.lit(False))
    return df.groupBy(*keys).agg(*[F.count_if(F.coalesce(outcome == o, F.lit(False))).alias(f"n_{o}") for o in outcomes], F.count_if(~known).alias("n_other"))


def shard_totals(df: DataFrame, key: str, shards: str) -> DataFrame:
    """Totals over a map of shard to (done, failed), worked out anew from its entries."""
    rows = df.select(key, F.explode_outer(F.map_values(shards)).alias("s"))
    return rows.groupBy(key).agg(F.coalesce(F.sum("s.done"), F.lit(0)).alias("done"), F.coalesce(F.sum("s.failed"), F.lit(0)).alias("failed"))


def modal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most common value of each key; of equally common ones the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, object]:
    """The frame with a row count attached that the next action fills in, without an action of its own."""
    from pyspark.sql import Observation

    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def first_ids(rows: DataFrame, keys: Sequence[str], value: str, size: int, name: str = "sample") -> DataFrame:
    """The least ``size`` distinct values of each key, in order (L11); a limited window, so no group is held whole."""
    distinct = rows.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    ranked = distinct.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("__rn") <= size)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def approx_distinct(df: DataFrame, keys: Sequence[str], value: str, error: float = 0.02) -> DataFrame:
    """Distinct values by a sketch with this relative error."""
    return df.groupBy(*keys).agg(F.approx_count_distinct(value, error).alias("n"))


def held_set(df: DataFrame, field: str, most: int = 3000) -> DataFrame:
    """The distinct values of a field in order, the first ``most``."""
    value = F.explode(field) if df.schema[field].dataType.typeName() == "array" else F.col(field)
    return df.select(value.alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(most)


def existing(df: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Per key the rows, those that have the field, and those that lack it."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count(field).alias("having"), F.count_if(F.col(field).isNull()).alias("lacking"))


def nested_facet(df: DataFrame, outer: str, inner: str, outer_size: int, inner_size: int) -> DataFrame:
    """The most frequent outer values, and within each its most frequent inner ones (A20); ties by value."""
    counts = df.where(F.col(outer).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("n"))
    totals = counts.groupBy(outer).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), outer).limit(outer_size)
    kept = counts.where(F.col(inner).isNotNull()).join(totals, outer)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("n"), inner))).where(F.col("rank") <= inner_size)


def weekly_kpis(runs: DataFrame, ts: str, failed: Column, codes: str) -> DataFrame:
    """Per week: runs, failures, and the counters of codes of all its runs merged (A40); ``codes`` is a map of code to count."""
    by_week = runs.withColumn("week", week(ts))
    totals = by_week.groupBy("week").agg(F.count("*").alias("runs"), F.count_if(failed).alias("failures"))
    merged = by_week.select("week", F.explode(codes).alias("code", "n")).groupBy("week", "code").agg(F.sum("n").alias("n")).groupBy("week").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))
    return totals.join(merged, "week", "left").withColumn("codes", F.coalesce("codes", F.create_map().cast("map<string,bigint>")))


def history_page(df: DataFrame, at: str, tie: str, limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """A page of a history, newest first, of the rows whose columns equal the given values (L6); absent values filter nothing."""
    kept = df
    for column, value in equal.items():
        kept = kept if value is None else kept.where(F.col(column) == value)
    return page(kept, [F.desc_nulls_last(at), F.col(tie)], limit, offset)
