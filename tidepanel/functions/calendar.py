"""Calendar arithmetic as column expressions and table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.frames import col
from tidepanel.universe import POLICY_MEETINGS


def business_day_number(d: Column | str) -> Column:
    """Weekdays since Monday 1970-01-05; a weekend counts as the Friday before."""
    days = F.datediff(col(d), F.lit("1970-01-05").cast("date"))
    week = F.floor(days / 7)
    return (week * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))).cast("int")


def shift_business_days(d: Column | str, n: int) -> Column:
    """Move forward n weekdays (no holidays); from a weekend the first is Monday."""
    target = business_day_number(d) + F.lit(n)
    offset = F.floor(target / 5) * 7 + F.pmod(target, F.lit(5))
    return F.date_add(F.lit("1970-01-05").cast("date"), offset.cast("int"))


def epoch_millis(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", zero, col(ts).cast("timestamp_ntz"))


def epoch_date(count: Column | str, per_day: int = 86_400) -> Column:
    """UTC date of an epoch count in seconds (or ``per_day`` ticks a day)."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(count) / per_day).cast("int"))


def is_weekday(d: Column | str) -> Column:
    return F.weekday(col(d)) < 5


def business_calendar(bounds: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row per weekday between two date columns of each row of ``bounds``."""
    days = F.sequence(F.col(start), F.col(end))
    return bounds.withColumn(out, F.explode(days)).filter(is_weekday(out)).drop(start, end)


def first_friday(d: Column | str) -> Column:
    return F.next_day(F.date_add(F.trunc(col(d), "MM"), -1), "Fri")


def days_to_next_meeting(d: Column | str, cap: int = 45, meetings=None) -> Column:
    """Calendar days to the next scheduled meeting, capped; NULL past the schedule.
    The schedule is a short fixed list, so it rides along as a literal array."""
    dates = F.array(*[F.lit(m).cast("date") for m in (meetings or POLICY_MEETINGS)])
    upcoming = F.array_min(F.filter(dates, lambda m: m >= col(d)))
    gap = F.datediff(upcoming, col(d))
    return F.when(gap.isNotNull(), F.least(gap, F.lit(cap)))


def is_meeting(d: Column | str, meetings=None) -> Column:
    return col(d).isin([F.lit(m).cast("date") for m in (meetings or POLICY_MEETINGS)])


def monthly_expiry(d: Column | str, days: int = 35) -> Column:
    """The Friday on or after d + days."""
    return F.next_day(F.date_add(col(d), days - 1), "Fri")


def meeting_year_check(spark: SparkSession, meetings=None) -> DataFrame:
    """Years of the schedule whose meeting count is outside 7..9."""
    rows = [(m,) for m in (meetings or POLICY_MEETINGS)]
    return (spark.createDataFrame(rows, "d string").select(F.year(F.to_date("d")).alias("year"))
                 .groupBy("year").agg(F.count("*").alias("meetings"))
                 .filter(~F.col("meetings").between(7, 9)))
