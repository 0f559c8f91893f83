"""Cross-sectional ranks, selections, sampling and counts.

A section is one session of one panel: it holds one row per instrument, so ranking
windows over it are bounded by the size of the universe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.functions.frames import col
from tidepanel.functions.scalars import truthy
from tidepanel.universe import CROWDED, TOPK, UNCROWDED


def top_bottom(df: DataFrame, score: str, k: int = TOPK, invert: bool = False,
               by: Sequence[str] = fr.SECTION, name: str = "instrument",
               side: str = "side") -> DataFrame:
    """The k best (+1) and k worst (-1) of each section at least 2k+1 wide. Ties break
    on the name."""
    value = -col(score) if invert else col(score)
    best = Window.partitionBy(*by).orderBy(value.desc(), name)
    wide = Window.partitionBy(*by)
    ranked = (df.filter(col(score).isNotNull())
                .withColumn("__r", F.row_number().over(best))
                .withColumn("__n", F.count(F.lit(1)).over(wide)))
    sign = F.when(F.col("__r") <= k, 1).when(F.col("__r") > F.col("__n") - k, -1)
    return (ranked.filter(F.col("__n") >= 2 * k + 1).withColumn(side, sign)
                  .filter(F.col(side).isNotNull()).drop("__r", "__n"))


def leans(df: DataFrame, score: str, k: int = TOPK, by=fr.SECTION,
          name: str = "instrument") -> DataFrame:
    """Rank percentile and lean (+1 / 0 / -1) of every scored row."""
    best = Window.partitionBy(*by).orderBy(col(score).desc(), name)
    ranked = (df.filter(col(score).isNotNull())
                .withColumn("rank_pct", fr.cross_rank_pct(score, by))
                .withColumn("__r", F.row_number().over(best))
                .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))))
    lean = (F.when(F.col("__r") <= k, 1).when(F.col("__r") > F.col("__n") - k, -1)
             .otherwise(0))
    return ranked.withColumn("lean", lean).drop("__r", "__n")


def combine_horizons(frames: dict[int, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Outer merge of per-horizon scores; the sign of summed leans, and conviction as
    the distance of the mean rank from the middle."""
    merged = None
    for h, frame in sorted(frames.items()):
        part = frame.select(*keys, F.col("score").alias(f"score_{h}d"),
                            F.col("rank_pct").alias(f"rank_pct_{h}d"),
                            F.col("lean").alias(f"lean_{h}d"))
        merged = part if merged is None else merged.join(part, list(keys), "full")
    horizons = sorted(frames)
    total = sum((F.coalesce(f"lean_{h}d", F.lit(0)) for h in horizons), F.lit(0))
    ranks = F.array_compact(F.array(*[F.col(f"rank_pct_{h}d") for h in horizons]))
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, b: a + b) / F.size(ranks)
    return (merged.withColumn("lean", F.signum(total).cast("int"))
                  .withColumn("conviction", F.bround(F.abs(mean - 0.5) * 2, 4)))


def block_rows(df: DataFrame, hold: int, start: Column | int,
               panel: Sequence[str] = ("panel_id",), number: str = "sess_no",
               size: str = "n_sessions") -> DataFrame:
    """Every hold-th session from ``start`` whose holding period is complete. The number
    of sessions comes with the calendar; without it, it is counted per panel."""
    if size not in df.columns:
        counted = df.groupBy(*panel).agg((F.max(number) + 1).alias(size))
        df = df.join(counted, list(panel))
    first = F.lit(start) if isinstance(start, int) else start
    due = ((F.col(number) >= first) & ((F.col(number) - first) % hold == 0)
           & (F.col(number) < F.col(size) - hold))
    return df.filter(due)


def every_kth(df: DataFrame, k: int, by: Sequence[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return df.withColumn("__n", n).filter(F.col("__n") % k == 0).drop("__n")


def split_halves(df: DataFrame, by: Sequence[str], order: str, out: str = "half") -> DataFrame:
    """Tag the first and second half by position."""
    w = Window.partitionBy(*by)
    n = F.row_number().over(w.orderBy(order))
    total = F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.when(n <= F.floor(total / 2), "first").otherwise("second"))


def breadth(df: DataFrame, above: dict[str, Column], valid: Column,
            by: Sequence[str] = fr.SECTION) -> DataFrame:
    """Share of valid instruments for which each condition holds; NULL without any."""
    shares = [F.avg(F.when(valid, truthy(c).cast("double"))).alias(name)
              for name, c in above.items()]
    return df.groupBy(*by).agg(*shares, F.count_if(valid).alias("breadth_n"))


def selected_mean(df: DataFrame, value: str, chosen: Column,
                  by: Sequence[str] = fr.SECTION, out: str = "mean") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(truthy(chosen), F.col(value))).alias(out))


def crowded_count(df: DataFrame, index: str = "idx52",
                  by: Sequence[str] = fr.SECTION) -> DataFrame:
    hot = (col(index) >= CROWDED) | (col(index) <= UNCROWDED)
    return df.groupBy(*by).agg(F.count_if(truthy(hot)).alias("cot_n_crowded"))


def islands(df: DataFrame, flag: Column, by: Sequence[str], order: str,
            number: str = "sess_no") -> DataFrame:
    """Consecutive sessions a condition has held, per row (0 when it does not)."""
    w = Window.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    last_off = F.max(F.when(~truthy(flag), col(number))).over(run)
    first = F.min(col(number)).over(Window.partitionBy(*by))
    held = col(number) - F.coalesce(last_off, first - 1)
    return df.withColumn("persistence", F.when(truthy(flag), held).otherwise(0))
