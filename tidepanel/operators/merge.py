"""Keyed merges of stored and fresh rows.

Resolution is an aggregate (max_by / min_by), not a ranked window: it combines on
the map side, so a key that holds a third of the rows never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
             last: bool = True) -> DataFrame:
    """One row per key: the greatest (or least) in ``order``. The order must be total
    for the result to be unique."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "__row.*").select(*df.columns)


def merge_latest(stored: DataFrame, fresh: DataFrame, keys: Sequence[str],
                 order: Sequence[str] = ()) -> DataFrame:
    """Union where a fresh row replaces the stored row of its key; nothing is removed."""
    both = (stored.withColumn("__vintage", F.lit(0))
                  .unionByName(fresh.withColumn("__vintage", F.lit(1)), allowMissingColumns=True))
    return keep_one(both, keys, ["__vintage", *order]).drop("__vintage")


def rebase_vintage(stored: DataFrame, fresh: DataFrame, keys=("panel_id", "instrument"),
                   tolerance: float = 1e-9) -> DataFrame:
    """Scale stored rows older than the first common date onto the fresh adjustment
    basis: prices and factor times k, volume over k, k = fresh factor / stored factor."""
    common = (stored.select(*keys, "session", F.col("factor").alias("f_old"))
                    .join(fresh.select(*keys, "session", F.col("factor").alias("f_new")),
                          [*keys, "session"]))
    seam = common.groupBy(*keys).agg(
        F.min("session").alias("seam"),
        F.min_by(F.when((F.col("f_old") > 0) & (F.col("f_new") > 0),
                        F.col("f_new") / F.col("f_old")), F.col("session")).alias("k"))
    out = stored.join(seam, list(keys), "left")
    apply = (F.col("session") < F.col("seam")) & (F.abs(F.col("k") - 1) > tolerance)
    k = F.when(apply, F.col("k")).otherwise(F.lit(1.0))
    for c in ("open", "high", "low", "close", "factor"):
        if c in stored.columns:
            out = out.withColumn(c, F.col(c) * k)
    if "volume" in stored.columns:
        out = out.withColumn("volume", F.col("volume") / k)
    return out.select(*stored.columns)


def merge_bars(stored: DataFrame, fresh: DataFrame, keys=("panel_id", "instrument")) -> DataFrame:
    """Rebase the stored vintage, then let fresh rows win."""
    return merge_latest(rebase_vintage(stored, fresh, keys), fresh, [*keys, "session"])


def resolve_priority(candidates: DataFrame, keys: Sequence[str], rank: str,
                     value: str) -> DataFrame:
    """Per key, the value of the lowest rank that has one."""
    return (candidates.filter(F.col(value).isNotNull())
                      .groupBy(*keys).agg(F.min_by(value, rank).alias(value),
                                          F.min(rank).alias(rank)))


def append_after_end(stored: DataFrame, fresh: DataFrame,
                     keys=("panel_id", "instrument")) -> DataFrame:
    """Rows to append: later than an instrument's stored end, or all rows of a new one."""
    ends = stored.groupBy(*keys).agg(F.max("session").alias("__end"))
    return (fresh.join(ends, list(keys), "left")
                 .filter(F.col("__end").isNull() | (F.col("session") > F.col("__end")))
                 .drop("__end"))


def register_new(ranges: DataFrame, fresh: DataFrame, calendar: DataFrame,
                 keys=("panel_id", "instrument")) -> DataFrame:
    """Ranges table extended by instruments it lacks, on the existing calendar only."""
    on_calendar = fresh.join(calendar.select("panel_id", "session"),
                             ["panel_id", "session"], "left_semi")
    unseen = on_calendar.join(ranges, list(keys), "left_anti")
    new = unseen.groupBy(*keys).agg(F.min("session").alias("first_session"),
                                    F.max("session").alias("last_session"))
    return ranges.select(*keys, "first_session", "last_session").unionByName(new)


def shrunk_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys lost by a merge. A monotone store has none."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(),
                                                list(keys), "left_anti")


def cross_check(a: DataFrame, b: DataFrame, on: str, value: str, by: Sequence[str] = (),
                scale: float = 1.0) -> DataFrame:
    """Two sources of one reading compared on the dates both observe."""
    pair = a.select(*by, on, F.col(value).alias("__a")).join(
        b.select(*by, on, F.col(value).alias("__b")), [*by, on])
    diff = pair.withColumn("__d", F.abs(F.col("__a") - F.col("__b")) / scale)
    return diff.groupBy(*by).agg(
        F.count("__d").alias("n"), F.median("__d").alias("median_abs_diff"),
        F.max("__d").alias("max_abs_diff"),
        F.max_by(on, F.struct("__d", F.datediff(F.lit("9999-12-31"), on))).alias("worst_date"))
