"""Predictive studies on positioning: rank correlations, buckets, verdict counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import norm_ppf
from tidepanel.operators import matrices as mx
from tidepanel.universe import CROWDED, UNCROWDED

SIGNALS = ("idx52", "z156", "chg4w")
HORIZONS = {"1w": 5, "4w": 20, "13w": 65}
LEAST = 20


def window_tags(joined: DataFrame, by=("panel_id",), weeks: int = 52) -> DataFrame:
    """Every row counts in 'full'; the last ``weeks`` also in '12m'."""
    last = joined.groupBy(*by).agg(F.max("effective_date").alias("__last"))
    recent = F.col("effective_date") >= F.date_sub("__last", weeks * 7)
    tags = F.array_compact(F.array(F.lit("full"), F.when(recent, F.lit("12m"))))
    return joined.join(last, list(by)).withColumn("window", F.explode(tags)).drop("__last")


def long_pairs(tagged: DataFrame, signals=SIGNALS, horizons=HORIZONS) -> DataFrame:
    """One row per (row, signal, horizon) with both values present, and whether the row
    belongs to the non-overlapping sample of its horizon."""
    w = Window.partitionBy("panel_id", "window", "asset").orderBy("entry_date")
    place = F.row_number().over(w) - 1
    cells = [F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"),
                      F.col(s).alias("x"), F.col(f"fwd_{h}").alias("y"),
                      F.lit(max(1, d // 5)).alias("step"))
             for s in signals for h, d in horizons.items()]
    rows = tagged.withColumn("__place", place).select(
        "panel_id", "window", "asset", "entry_date", "__place", F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("panel_id", "window", "asset", "entry_date", "c.*",
                       (F.col("__place") % F.col("c.step") == 0).alias("independent"))
    return rows.filter("x is not null and y is not null").drop("step")


def spearman(pairs: DataFrame, by: Sequence[str], least: int = LEAST) -> DataFrame:
    """Rank correlation per key, NULL below ``least`` pairs."""
    for c in ("x", "y"):
        pairs = mx.average_rank(pairs, c, by, f"__r{c}")
    spread = F.stddev_samp("__rx") * F.stddev_samp("__ry")
    corr = F.covar_samp("__rx", "__ry") / F.nullif(spread, F.lit(0.0))
    return pairs.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, corr).alias("ic"),
                                  F.count(F.lit(1)).alias("n"))


def ic_table(tagged: DataFrame) -> DataFrame:
    """IC of every (asset, signal, horizon) on all rows and on non-overlapping rows."""
    by = ["panel_id", "window", "asset", "signal", "horizon"]
    pairs = long_pairs(tagged)
    alone = spearman(pairs.filter("independent"), by).withColumnsRenamed(
        {"ic": "ic_nonoverlap", "n": "n_nonoverlap"})
    return spearman(pairs, by).join(alone, by, "left")


def verdict_counts(ics: DataFrame, need: int = 9, floor: float = 0.05) -> DataFrame:
    """The verdict is read off the distribution across assets, never one cell."""
    want_negative = F.col("signal") == "idx52"
    agree = F.when(want_negative, F.col("ic") < 0).otherwise(F.col("ic") > 0)
    out = ics.filter("ic is not null").groupBy("panel_id", "window", "signal", "horizon").agg(
        F.count(F.lit(1)).alias("n_assets"), F.median("ic").alias("median_ic"),
        F.avg("ic").alias("mean_ic"), F.count_if(agree).alias("assets_with_predicted_sign"))
    return out.withColumns({
        "predicted_sign": F.when(want_negative, "negative").otherwise("positive"),
        "passes_count": F.col("assets_with_predicted_sign") >= need,
        "passes_median": F.abs("median_ic") >= floor})


def extremes(tagged: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Forward returns in crowded buckets against the unconditional mean."""
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("f"))
                      for h in horizons])
    rows = tagged.select("panel_id", "window", "asset", "idx52", F.explode(cells).alias("c")
                         ).select("panel_id", "window", "asset", "idx52", "c.*")
    hi = F.when(F.col("idx52") >= CROWDED, F.col("f"))
    lo = F.when(F.col("idx52") <= UNCROWDED, F.col("f"))
    out = rows.groupBy("panel_id", "window", "asset", "horizon").agg(
        F.count(hi).alias("n_crowded_long"), F.count(lo).alias("n_crowded_short"),
        F.avg(hi).alias("mean_crowded_long"), F.avg(lo).alias("mean_crowded_short"),
        F.avg("f").alias("mean_unconditional"))
    return out.withColumn("spread_long_minus_short",
                          F.col("mean_crowded_long") - F.col("mean_crowded_short"))


def front_running(tagged: DataFrame) -> DataFrame:
    """Is the positioning change better explained by the week before or the week after?"""
    cells = F.array(F.struct(F.lit("prev").alias("side"), F.col("prev_1w").alias("y")),
                    F.struct(F.lit("next").alias("side"), F.col("fwd_1w").alias("y")))
    rows = tagged.select("panel_id", "window", "asset", F.col("chg4w").alias("x"),
                         F.explode(cells).alias("c")).select(
        "panel_id", "window", "asset", "x", "c.*").filter("x is not null and y is not null")
    key = ["panel_id", "window", "asset"]
    ics = spearman(rows, [*key, "side"])

    def at(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))
    out = ics.groupBy(*key).agg(
        at("prev", "ic").alias("corr_prev_week"), at("prev", "n").alias("n_prev"),
        at("next", "ic").alias("corr_next_week"), at("next", "n").alias("n_next"))
    return out.withColumn("leads", F.abs("corr_next_week") > F.abs("corr_prev_week"))


def crowding_trades(features: DataFrame, prices: DataFrame, every: int = 13,
                    rows_held: int = 65) -> DataFrame:
    """One entry every ``every`` weekly rows against a crowded side, entered on the
    asset's first priced session on or after the effective date."""
    from tidepanel.operators.asof import asof_forward
    w = Window.partitionBy("panel_id", "instrument").orderBy("effective_date")
    live = features.filter("idx52 is not null").withColumnRenamed("asset", "instrument")
    due = live.withColumn("__k", F.row_number().over(w) - 1).filter(F.col("__k") % every == 0)
    side = F.when(F.col("idx52") >= CROWDED, -1).when(F.col("idx52") <= UNCROWDED, 1)
    due = due.withColumn("side", side).filter("side is not null").select(
        "panel_id", "instrument", "effective_date", "side")
    wp = Window.partitionBy("panel_id", "instrument").orderBy("session")
    priced = prices.filter("close is not null").select(
        "panel_id", "instrument", "session", F.col("session").alias("date"),
        (F.lead("close", rows_held).over(wp) / F.col("close") - 1).alias("ret"))
    out = asof_forward(due, priced, ["panel_id", "instrument"], "effective_date", "session",
                       ["date", "ret"])
    return out.filter("ret is not null").withColumn("pnl", F.col("side") * F.col("ret"))


def lead_lag(vectors: DataFrame, names: Sequence[str], lags=(1, 2, 3, 5)) -> DataFrame:
    """Every ordered pair and lag, discovered on the first half of the sessions and
    validated on the second; lags never cross the halves. Vectors hold returns, the
    first session (which has none) left out."""
    half = F.floor((F.col("n_sessions") - 1) / 2)
    pos = F.col("sess_no") - 1
    rows = vectors.filter("sess_no >= 1").withColumns({
        "half": F.when(pos < half, "discovery").otherwise("validation"),
        "place": F.when(pos < half, pos).otherwise(pos - half).cast("int")})
    sums = mx.pair_moments(rows, names, lags, ("panel_id", "half"), "place")
    corr = sums.withColumn("corr", mx.corr_of_moments()).filter("a <> b")

    def at(h: str, c: str) -> Column:
        return F.max(F.when(F.col("half") == h, F.col(c)))
    out = corr.groupBy("panel_id", F.col("a").alias("leader"), F.col("b").alias("target"),
                       "lag").agg(at("discovery", "corr").alias("corr_discovery"),
                                  at("validation", "corr").alias("corr_validation"))
    tests = len(names) * (len(names) - 1) * len(lags)
    critical = norm_ppf(1 - 0.05 / tests / 2)
    sizes = vectors.groupBy("panel_id").agg(
        F.floor((F.max("n_sessions") - 1) / 2).alias("__half"))
    out = out.join(sizes, "panel_id")
    z = F.abs("corr_discovery") * F.sqrt(F.col("__half") - F.col("lag"))
    found = ((z > critical) & (F.signum("corr_discovery") == F.signum("corr_validation"))
             & (F.abs("corr_validation") > 0.05))
    return out.withColumn("found", F.coalesce(found, F.lit(False))).drop("__half")
