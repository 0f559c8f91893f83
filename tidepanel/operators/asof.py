"""Point-in-time joins.

As-of alignment is a union of both sides and a running fill, never a range join:
the work is linear in the rows of both sides. ``bucketed_asof`` adds a second level
for event-grained sides with hot keys: fills run inside (key, time bucket), and only
one carried value per bucket travels between buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.calendar import shift_business_days
from tidepanel.functions.frames import bounded_fill

TIME = "__t"
SIDE = "__side"


def _stack(left: DataFrame, right: DataFrame, by, left_on, right_on, cols) -> DataFrame:
    keep = [c for c in left.columns if c not in cols]
    a = left.select(F.struct(*keep).alias("__left"), *by, F.col(left_on).alias(TIME),
                    F.lit(1).alias(SIDE))
    b = right.select(*by, F.col(right_on).alias(TIME), F.lit(0).alias(SIDE), *cols)
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str,
                  right_on: str, cols: Sequence[str]) -> DataFrame:
    """For each left row, every column's last known value dated on or before it."""
    rows = _stack(left, right, by, left_on, right_on, cols)
    w = (Window.partitionBy(*by).orderBy(TIME, SIDE)
               .rowsBetween(Window.unboundedPreceding, 0))
    filled = rows.select("__left", SIDE, *[F.last(c, ignorenulls=True).over(w).alias(c)
                                           for c in cols])
    return filled.filter(F.col(SIDE) == 1).select("__left.*", *cols)


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str,
                 right_on: str, cols: Sequence[str]) -> DataFrame:
    """For each left row, the first right row dated on or after it, as a whole row."""
    rows = _stack(left, right, by, left_on, right_on, cols)
    w = (Window.partitionBy(*by).orderBy(TIME, F.col(SIDE).desc())
               .rowsBetween(0, Window.unboundedFollowing))
    row = F.when(F.col(SIDE) == 0, F.struct(*cols))
    filled = rows.select("__left", SIDE, F.first(row, ignorenulls=True).over(w).alias("__r"))
    return (filled.filter(F.col(SIDE) == 1)
                  .select("__left.*", *[F.col(f"__r.{c}").alias(c) for c in cols]))


def bucketed_asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str,
                  right_on: str, cols: Sequence[str], bucket: str = "day") -> DataFrame:
    """``asof_backward`` in two levels, for keys too hot for one task."""
    rows = (_stack(left, right, by, left_on, right_on, cols)
            .withColumn("__b", F.date_trunc(bucket, F.col(TIME))))
    inside = (Window.partitionBy(*by, "__b").orderBy(TIME, SIDE)
                    .rowsBetween(Window.unboundedPreceding, 0))
    local = rows.select(*by, "__b", "__left", SIDE,
                        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in cols])
    local = local.filter(F.col(SIDE) == 1)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(TIME))).alias(f"__in_{c}")
            for c in cols]
    buckets = rows.groupBy(*by, "__b").agg(*last)
    earlier = (Window.partitionBy(*by).orderBy("__b")
                     .rowsBetween(Window.unboundedPreceding, -1))
    carry = buckets.select(*by, "__b",
                           *[F.last(f"__in_{c}", ignorenulls=True).over(earlier).alias(f"__c_{c}")
                             for c in cols])
    on = [local[k].eqNullSafe(carry[k]) for k in by] + [local["__b"] == carry["__b"]]
    return local.join(carry, on, "left").select(
        "__left.*", *[F.coalesce(local[c], F.col(f"__c_{c}")).alias(c) for c in cols])


def exact_then_fill(left: DataFrame, right: DataFrame, by: Sequence[str], order: str,
                    right_on: str, cols: Sequence[str], limit: int | None = None,
                    number: str = "sess_no") -> DataFrame:
    """Join on equal dates, then carry forward (at most ``limit`` rows). A right row
    dated off the left calendar is lost: this is not an as-of join."""
    right = right.select(*by, F.col(right_on).alias(order), *cols)
    joined = left.join(right, [*by, order], "left")
    if limit is None:
        w = (Window.partitionBy(*by).orderBy(order)
                   .rowsBetween(Window.unboundedPreceding, 0))
        fills = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    else:
        fills = {c: bounded_fill(c, limit, number, by, order) for c in cols}
    return joined.withColumns(fills)


def row_asof(df: DataFrame, as_of: Column, by: Sequence[str], order: str) -> DataFrame:
    """Per key the last row on or before a date, else the newest row."""
    row = F.struct(*[c for c in df.columns if c not in by])
    key = F.col(order)
    chosen = F.coalesce(F.max_by(row, F.when(key <= as_of, key)), F.max_by(row, key))
    return df.groupBy(*by).agg(chosen.alias("__r")).select(*by, "__r.*")


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c not in by])
    return (df.groupBy(*by).agg(F.max_by(row, F.struct(*order)).alias("__r"))
              .select(*by, "__r.*"))


def entry_prices(reports: DataFrame, prices: DataFrame, calendar: DataFrame,
                 horizons: dict[str, int], key: str = "instrument",
                 panel: str = "panel_id") -> DataFrame:
    """Entry on the first session on or after a report takes effect, dropped when that
    session has no price. Horizons count the instrument's own priced rows."""
    w = Window.partitionBy(panel, key).orderBy("session")
    priced = prices.filter(F.col("close").isNotNull()).select(
        panel, key, F.col("session").alias("entry_date"), F.col("close").alias("entry"),
        *[(F.lead("close", n).over(w) / F.col("close") - 1).alias(f"fwd_{name}")
          for name, n in horizons.items()],
        (F.col("close") / F.lag("close", 5).over(w) - 1).alias("prev_1w"))
    cal = calendar.select(panel, "session", F.col("session").alias("entry_date"))
    dates = asof_forward(reports.select(panel, "effective_date").distinct(), cal, [panel],
                         "effective_date", "session", ["entry_date"])
    dated = reports.join(dates.select(panel, "effective_date", "entry_date"),
                         [panel, "effective_date"])
    return dated.join(priced, [panel, key, "entry_date"])


def lagged_daily(obs: DataFrame, lags: DataFrame, by=("panel_id", "series_id")) -> DataFrame:
    """Observations moved to the day the market knows them, scaled, last one per day.
    ``lags`` is the small table (series_id, lag_bd, divisor)."""
    known = obs.join(F.broadcast(lags), "series_id").withColumn(
        "known_date", _shift_by("obs_date", "lag_bd")).withColumn(
        "value", F.col("value") / F.col("divisor"))
    return known.groupBy(*by, "known_date").agg(F.max_by("value", "obs_date").alias("value"))


def _shift_by(d: str, lag: str) -> Column:
    """Business-day shift where the lag is a column with values 1 or 2."""
    return F.when(F.col(lag) == 1, shift_business_days(d, 1)).when(
        F.col(lag) == 2, shift_business_days(d, 2)).otherwise(F.col(d))
