"""The previous fire of a schedule, from its cron text, in column expressions.

A field becomes a set of bits. The greatest matching minute at or before a time is found field by field: the time of
day if the day matches and has one early enough, else the last one of the latest matching day before; that day by
month and day in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of months and week days, and the bounds of the five fields.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
SHORT = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
#: Months to look back over: the 29th of February may be eight years away.
MONTHS_BACK = 97


def _numbered(c: Column, names: tuple[str, ...], first: int) -> Column:
    out = c
    for i, name in enumerate(names):
        out = F.regexp_replace(out, rf"\b{name}\b", str(first + i))
    return F.when(c.rlike("[a-z]"), out).otherwise(c)


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def field_bits(c: Column, low: int, high: int) -> Column:
    """The values that a field allows as bits of a long: stars, lists, ranges and steps; null if it is none of these, or out of bounds."""

    def part(p: Column) -> Column:
        span, step = F.split_part(p, F.lit("/"), F.lit(1)), F.when(F.contains(p, F.lit("/")), F.split_part(p, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(1)
        good = p.rlike(r"^(\*|\d{1,2}(-\d{1,2})?)(/\d{1,2})?$")
        star = span == "*"
        start = F.when(star, low).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        end = F.when(star, high).when(F.contains(span, F.lit("-")), F.split_part(span, F.lit("-"), F.lit(2)).try_cast("int")).when(F.contains(p, F.lit("/")), high).otherwise(start)
        fits = good & (start >= low) & (end <= high) & (start <= end) & (step > 0)
        return F.when(fits, F.sequence(start, end, step))

    lists = F.transform(F.split(c, ","), part)
    bits = F.aggregate(F.array_distinct(F.flatten(lists)), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(_bit(v)))
    other = F.when(F.exists(lists, lambda x: x.isNull()), F.lit(None).cast("long")).otherwise(bits)
    number = c.try_cast("int")
    # Stars and single numbers, most fields there are, need no lists.
    return F.when(c == "*", F.lit((1 << (high + 1)) - (1 << low)).cast("long")).when(c.rlike(r"^\d{1,2}$"), F.when(number.between(low, high), _bit(number))).otherwise(other)


def _has(bits: Column, n: Column) -> Column:
    return F.call_function("shiftright", bits, n.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _greatest(bits: Column, most: Column) -> Column:
    """The greatest set bit up to ``most`` (61 at most), or null."""
    kept = bits.bitwiseAND(_bit(most + 1) - 1)
    return F.when((most >= 0) & (kept > 0), F.length(F.bin(kept)) - 1)


def _days(first: Column, days: Column, weekdays: Column, either: Column) -> Column:
    """The matching days of the month that begins on ``first`` as bits 1 to 31: the week's bits, turned so that they begin
    with that day's, and repeated, with or without those of the days of month."""
    w = F.dayofweek(first) - 1
    turned = F.call_function("shiftright", weekdays, w).bitwiseOR(F.call_function("shiftleft", weekdays, 7 - w)).bitwiseAND(F.lit(127).cast("long"))
    of_week = turned * F.lit(sum(2 << 7 * i for i in range(5))).cast("long")
    return F.when(either, days.bitwiseOR(of_week)).otherwise(days.bitwiseAND(of_week))


def previous_fire(schedules: DataFrame, cron: str, at: Column, name: str = "previous_fire") -> DataFrame:
    """``schedules`` with the latest minute at or before ``at`` (a timestamp) that its ``cron`` text names.

    Five fields: minute, hour, day of month, month, day of week (0 and 7 are Sunday), with names, lists, ranges and
    steps, and @hourly, @daily, @weekly, @monthly and @yearly. Where both days are restricted (neither begins with a
    star), either may match. Times are those of the session's time zone. Null for null and malformed texts, and where
    no day of the last eight years matches.
    """
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    # Each step is a projection of its own, since its columns are named several times in the next.
    made = schedules.select("*", at.alias("__at"), F.lower(F.trim(F.col(cron))).alias("__text"))
    made = made.withColumn("__fields", F.split(F.coalesce(F.try_element_at(short, F.col("__text")), F.col("__text")), r"\s+"))
    raw = [F.try_element_at(F.col("__fields"), F.lit(i)) for i in range(1, 6)]
    raw[3], raw[4] = _numbered(raw[3], MONTHS, 1), _numbered(raw[4], DAYS, 0)
    made = made.select("*", *[F.when(F.size("__fields") == 5, c).alias(f"__f{i}") for i, c in enumerate(raw)])
    made = made.select("*", *[field_bits(F.col(f"__f{i}"), *bounds).alias(f"__b{i}") for i, bounds in enumerate(BOUNDS)])
    minute, hour, days, months, weekdays = (F.col(f"__b{i}") for i in range(5))
    # Sunday's two names are one bit. Where both days are restricted, either may match.
    week = weekdays.bitwiseAND(F.lit(127).cast("long")).bitwiseOR(F.when(_has(weekdays, F.lit(7)), 1).otherwise(0).cast("long"))
    either = ~F.col("__f2").startswith("*") & ~F.col("__f4").startswith("*")
    made = made.withColumns({"__b4": week, "__either": either, "__now": F.date_trunc("minute", "__at")})
    made = made.withColumns({"__today": F.to_date("__now"), "__month": F.trunc("__now", "month"), "__last": _greatest(minute, F.lit(59))})
    now, today, month, last_minute = (F.col(c) for c in ("__now", "__today", "__month", "__last"))
    # The greatest time of day at or before the present one: an earlier minute of this hour, else the last of an earlier hour.
    in_hour = F.when(_has(hour, F.hour(now)), _greatest(minute, F.minute(now)))
    earlier = _greatest(hour, F.hour(now) - 1)
    by_now = F.coalesce(F.hour(now) * 60 + in_hour, earlier * 60 + last_minute)
    whole_day = _greatest(hour, F.lit(23)) * 60 + last_minute

    def latest_in(first: Column, end: Column) -> Column:
        """The latest matching day up to the ``end``-th in the month that begins so."""
        return F.when(_has(months, F.month(first)), F.date_add(first, _greatest(_days(first, days, weekdays, F.col("__either")), end) - 1))

    matches = _has(months, F.month(today)) & _has(_days(month, days, weekdays, F.col("__either")), F.dayofmonth(today))
    whole_month = lambda first: latest_in(first, F.dayofmonth(F.last_day(first)))
    made = made.withColumns({"__matches": matches, "__by_now": by_now, "__whole": whole_day, "__before": F.coalesce(latest_in(month, F.dayofmonth(today) - 1), whole_month(F.add_months(month, -1)))})
    # Few schedules have no matching day in two months; of the months before, the first one, going back, that has one.
    further = F.aggregate(F.sequence(F.lit(2), F.lit(MONTHS_BACK)), F.lit(None).cast("date"), lambda found, i: F.when(found.isNotNull(), found).otherwise(whole_month(F.add_months(month, -i))))
    before = F.when(F.col("__before").isNotNull(), F.col("__before")).otherwise(further)
    at_minute = lambda day, minutes: F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + minutes * 60)
    known = minute.isNotNull() & hour.isNotNull() & days.isNotNull() & months.isNotNull() & weekdays.isNotNull() & F.col("__at").isNotNull()
    fired = F.when(F.col("__matches") & F.col("__by_now").isNotNull(), at_minute(today, F.col("__by_now"))).otherwise(at_minute(before, F.col("__whole")))
    return made.select(*[F.col(c) for c in schedules.columns], F.when(known, fired).alias(name))
