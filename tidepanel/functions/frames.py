"""Window builders and rolling expressions.

Every window is partitioned on series keys, so a task holds one series of at most
one row per calendar session. ``by`` names those keys, ``order`` the time column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("panel_id", "instrument")
SECTION = ("panel_id", "session")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_series(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Place each series whole on one of ``spark.sql.shuffle.partitions`` partitions.
    It is the exchange the windows need anyway; naming the number keeps adaptive
    execution from merging small but compute-heavy partitions into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in by])


def line(by: Sequence[str] = SERIES, order: str = "session") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def running(by: Sequence[str] = SERIES, order: str = "session") -> WindowSpec:
    return line(by, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, by: Sequence[str] = SERIES, order: str = "session",
             include_current: bool = True) -> WindowSpec:
    w = line(by, order)
    return w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)


def needs(x: Column | str, w: WindowSpec, least: int, value: Column) -> Column:
    """``value`` where the frame holds ``least`` non-null inputs, else NULL."""
    return F.when(F.count(col(x)).over(w) >= least, value)


def last_valid(x: Column | str, by=SERIES, order="session") -> Column:
    return F.last(col(x), ignorenulls=True).over(running(by, order))


def change(x: Column | str, n: int, by=SERIES, order="session") -> Column:
    return col(x) - F.lag(col(x), n).over(line(by, order))


def plain_return(x: Column | str, n: int = 1, by=SERIES, order="session") -> Column:
    return F.try_divide(col(x), F.lag(col(x), n).over(line(by, order))) - 1


def forward_return(x: Column | str, h: int, by=SERIES, order="session") -> Column:
    return F.try_divide(F.lead(col(x), h).over(line(by, order)), col(x)) - 1


def with_padded_return(df: DataFrame, x: str, out: str, n: int = 1,
                       by=SERIES, order="session") -> DataFrame:
    """Return over n rows after forward-filling gaps: a gap session returns 0."""
    fill = f"__ff_{x}"
    return (df.withColumn(fill, last_valid(x, by, order))
              .withColumn(out, plain_return(fill, n, by, order))
              .drop(fill))


def rolling_mean(x, n, by=SERIES, order="session", least=None) -> Column:
    w = trailing(n, by, order)
    return needs(x, w, least or n, F.avg(col(x)).over(w))


def rolling_std(x, n, by=SERIES, order="session", least=None) -> Column:
    w = trailing(n, by, order)
    return needs(x, w, max(2, least or n), F.stddev_samp(col(x)).over(w))


def rolling_var(x, n, by=SERIES, order="session", least=None) -> Column:
    w = trailing(n, by, order)
    return needs(x, w, max(2, least or n), F.var_samp(col(x)).over(w))


def rolling_max(x, n, by=SERIES, order="session", least=None) -> Column:
    w = trailing(n, by, order)
    return needs(x, w, least or n, F.max(col(x)).over(w))


def rolling_median(x, n, by=SERIES, order="session", least=None) -> Column:
    w = trailing(n, by, order)
    ordered = F.sort_array(F.collect_list(col(x)).over(w))
    # bound once to a lambda variable: the frame is sorted one time per row
    middle = F.transform(F.array(ordered), lambda s: (
        F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
        + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    return needs(x, w, least or n, F.get(middle, F.lit(0)))


def rolling_zscore(x, n, by=SERIES, order="session", least=None) -> Column:
    """A flat window has no z-score: zero deviation gives NULL."""
    sd = rolling_std(x, n, by, order, least)
    return (col(x) - rolling_mean(x, n, by, order, least)) / F.nullif(sd, F.lit(0.0))


def rolling_skew(x, n, by=SERIES, order="session") -> Column:
    """Bias-adjusted: Spark's own is the population form."""
    w = trailing(n, by, order)
    adjust = (n * (n - 1)) ** 0.5 / (n - 2)
    return needs(x, w, n, F.skewness(col(x)).over(w) * F.lit(adjust))


def rolling_corr(x, y, n, by=SERIES, order="session", least=None) -> Column:
    w = trailing(n, by, order)
    both = F.when(col(x).isNotNull() & col(y).isNotNull(), F.lit(1))
    fx, fy = F.when(both.isNotNull(), col(x)), F.when(both.isNotNull(), col(y))
    # a flat leg has no correlation: the product of deviations is 0, the result NULL
    spread = F.stddev_samp(fx).over(w) * F.stddev_samp(fy).over(w)
    corr = F.covar_samp(fx, fy).over(w) / F.nullif(spread, F.lit(0.0))
    return F.when(F.count(both).over(w) >= (least or n), corr)


def rolling_beta(x, bench, n, by=SERIES, order="session") -> Column:
    """Covariance with the benchmark over the benchmark's own variance."""
    w = trailing(n, by, order)
    both = F.when(col(x).isNotNull() & col(bench).isNotNull(), F.lit(1))
    cov = F.when(F.count(both).over(w) >= n, F.covar_samp(col(x), col(bench)).over(w))
    return cov / F.nullif(rolling_var(bench, n, by, order), F.lit(0.0))


def inclusive_percentile(x, n=252, by=SERIES, order="session", least=60) -> Column:
    """Share of the trailing window at or below the current value. The window counts
    non-null rows only: nulls are set apart by partition, so no re-join is needed."""
    w = (Window.partitionBy(*by, col(x).isNull()).orderBy(order).rowsBetween(-(n - 1), 0))
    frame = F.collect_list(col(x)).over(w)
    share = F.size(F.filter(frame, lambda v: v <= col(x))) / F.size(frame)
    return F.when(col(x).isNotNull() & (F.count(col(x)).over(w) >= least), share)


def rank_percentile(x, n, by=SERIES, order="session", least=None) -> Column:
    """Average rank of the current value in its trailing window over the count."""
    w = trailing(n, by, order)
    frame = F.collect_list(col(x)).over(w)
    below = F.size(F.filter(frame, lambda v: v < col(x)))
    equal = F.size(F.filter(frame, lambda v: v == col(x)))
    pct = (below + (equal + 1) / 2.0) / F.size(frame)
    return F.when(col(x).isNotNull() & (F.count(col(x)).over(w) >= (least or n)), pct)


def bounded_fill(x, limit, number, by=SERIES, order="session") -> Column:
    """Last value carried at most ``limit`` rows; ``number`` is the dense row number."""
    w = running(by, order)
    seen = F.last(F.when(col(x).isNotNull(), col(number)), ignorenulls=True).over(w)
    return F.when(col(number) - seen <= limit, F.last(col(x), ignorenulls=True).over(w))


def staleness_days(x, by=SERIES, order="session") -> Column:
    """Days since the last real value, NULL when there has been none."""
    seen = F.last(F.when(col(x).isNotNull(), col(order)), ignorenulls=True)
    return F.datediff(col(order), seen.over(running(by, order)))


def seen_count(x, by=SERIES, order="session") -> Column:
    return F.count(col(x)).over(running(by, order))


def cross_rank_pct(x, by=SECTION) -> Column:
    """Average rank over the non-null count, across a section."""
    valued = Window.partitionBy(*by, col(x).isNull())
    low = F.rank().over(valued.orderBy(col(x)))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, col(x)))
    return F.when(col(x).isNotNull(),
                  (low + (ties - 1) / 2.0) / F.count(F.lit(1)).over(valued))


def split_chunks(df: DataFrame, number: str, size: int, lead: int,
                 chunk: str = "chunk", is_lead: str = "is_lead") -> DataFrame:
    """Cut long series into time chunks, each preceded by ``lead`` rows of overlap.

    Windows may then partition on (series, chunk): one very long or very hot series
    spreads over many tasks. Drop ``is_lead`` rows afterwards.
    """
    home = F.floor(F.col(number) / size)
    reach = F.floor((F.col(number) + lead) / size)
    return (df.withColumn(chunk, F.explode(F.sequence(home, reach)))
              .withColumn(is_lead, F.col(chunk) > home))
