"""Features of the irregular side series: positioning, event rates, liquidity, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import calendar as tc
from tidepanel.functions import frames as fr
from tidepanel.functions.frames import col
from tidepanel.operators import asof
from tidepanel.universe import ISSUER_SOURCES, LIQUIDITY_SERIES, RELEASE_LAG_DAYS

POS = ("panel_id", "asset")


def weekly_features(history: DataFrame, by=POS) -> DataFrame:
    """z over 156 weeks, rank over 52, four-week change, dated when they are public."""
    order = "report_date"
    return history.select(
        *by, order, F.date_add(order, RELEASE_LAG_DAYS).alias("effective_date"), "net_pct",
        fr.rolling_zscore("net_pct", 156, by, order, least=52).alias("z156"),
        fr.rank_percentile("net_pct", 52, by, order, least=26).alias("idx52"),
        fr.change("net_pct", 4, by, order).alias("chg4w"))


def daily_positions(features: DataFrame, calendar: DataFrame,
                    cols=("idx52", "z156", "chg4w")) -> DataFrame:
    """Weekly features carried onto every session from their effective date."""
    assets = features.select(*POS).distinct()
    grid = calendar.join(assets, "panel_id")
    return asof.asof_backward(grid, features, POS, "session", "effective_date", list(cols))


def daily_rate_features(history: DataFrame, by=("panel_id", "series_id")) -> DataFrame:
    """Daily sums, z and rank; every value is usable one row later."""
    daily = history.groupBy(*by, "date").agg(F.sum("rate").alias("funding_1d"))
    w = fr.line(by, "date")
    feats = daily.select(
        *by, "date", "funding_1d",
        fr.rolling_zscore("funding_1d", 156, by, "date", least=60).alias("z156"),
        fr.rank_percentile("funding_1d", 364, by, "date", least=120).alias("idx52w"))
    lagged = feats.select(*by, "date", *[F.lag(c, 1).over(w).alias(c)
                                         for c in ("funding_1d", "z156", "idx52w")])
    return lagged.withColumn("funding_1d_annualized_pct", F.col("funding_1d") * 365 * 100)


def rate_label(z: Column | str) -> Column:
    return (F.when(col(z) > 1.5, "crowded_longs").when(col(z) < -1.5, "crowded_shorts")
             .otherwise("normal"))


def net_liquidity(levels: DataFrame, balances: DataFrame | None = None,
                  window: int = 756) -> DataFrame:
    """Assets less cash balance less reverse repo, each on the business day it became
    known, in billions, with 4 and 13 week changes and their z-scores. The daily balance
    is primary; the weekly series covers the days it does not reach."""
    spark = levels.sparkSession
    rows = [(s, lag, div) for s, (lag, div) in LIQUIDITY_SERIES.items()]
    lags = spark.createDataFrame(rows, "series_id string, lag_bd int, divisor double")
    obs = levels
    if balances is not None:
        obs = obs.unionByName(balances.withColumn("series_id", F.lit("DTS"))
                              .select("panel_id", "series_id",
                                      F.col("record_date").alias("obs_date"), "value"))
    known = asof.lagged_daily(obs, lags)
    spans = known.groupBy("panel_id").agg(F.min("known_date").alias("lo"),
                                          F.max("known_date").alias("hi"))
    days = tc.business_calendar(spans, "lo", "hi")
    wide = known.groupBy("panel_id", F.col("known_date").alias("day")).pivot(
        "series_id", list(LIQUIDITY_SERIES)).agg(F.first("value"))
    names = list(LIQUIDITY_SERIES)
    # a known date is always a business day, so exact-match-then-fill loses nothing
    filled = asof.exact_then_fill(days, wide, ["panel_id"], "day", "day", names)
    by = ("panel_id",)
    tga = F.coalesce("DTS", "WDTGAL")
    base = filled.select("panel_id", "day", F.col("WALCL").alias("walcl"),
                         F.coalesce("RRPONTSYD", F.lit(0.0)).alias("rrp"), tga.alias("tga"))
    base = base.withColumn("netliq", F.col("walcl") - F.col("tga") - F.col("rrp"))
    base = base.withColumns({"__c4": fr.change("netliq", 20, by, "day"),
                             "netliq_chg13w": fr.change("netliq", 65, by, "day")})
    out = base.withColumns({
        "netliq_chg4w_z": fr.rolling_zscore("__c4", window, by, "day"),
        "netliq_chg13w_z": fr.rolling_zscore("netliq_chg13w", window, by, "day")})
    return out.drop("__c4").filter(F.col("netliq").isNotNull())


def fund_flows(snapshots: DataFrame, funds: dict[str, str], sources=ISSUER_SOURCES) -> DataFrame:
    """Per tracked fund: change in shares times the latest price, 1/5/20 snapshots back,
    and the z of the last 60 one-snapshot flows. Rows of other sources are never
    differenced, only counted. A fund has one row per snapshot date, so its window is
    bounded by the calendar."""
    keys = ["panel_id", "ticker"]
    own = F.col("source").isin(list(sources))
    legacy = snapshots.groupBy("panel_id").agg(
        F.count_if(~F.coalesce(own, F.lit(False))).alias("legacy_rows_ignored"))
    w = Window.partitionBy(*keys).orderBy("date")
    back = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    rows = snapshots.filter(own)
    for k in (1, 5, 20):
        rows = rows.withColumn(f"flow_{k}d", (F.col("shares") - F.lag("shares", k).over(w))
                               * F.col("price"))
    rows = rows.withColumn("recent", F.row_number().over(back))
    delta = (F.col("shares") - F.lag("shares", 1).over(w)) * F.col("price")
    rows = rows.withColumn("delta", delta)
    tail = F.when((F.col("recent") <= 60), F.col("delta"))
    last = {c: F.max(F.when(F.col("recent") == 1, F.col(c))).alias(c)
            for c in ("price", "shares", "flow_1d", "flow_5d", "flow_20d", "noise_usd",
                      "source", "delta")}
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("snapshots"), *last.values(), F.avg(tail).alias("__m"),
        F.stddev_samp(tail).alias("__s"), F.count(tail).alias("__n"))
    z = F.when((F.col("__n") >= 10) & (F.col("__s") > 0),
               (F.col("delta") - F.col("__m")) / F.col("__s"))
    agg = agg.withColumn("z", F.bround(z, 2)).drop("__m", "__s", "__n", "delta")
    panels = legacy.withColumn("fund", F.explode(_fund_list(funds))).select(
        "panel_id", "legacy_rows_ignored", "fund.*")
    out = panels.join(agg, keys, "left")
    small = F.abs("flow_1d") < F.col("noise_usd")
    note = (F.when(F.coalesce("snapshots", F.lit(0)) == 0, "no issuer snapshot yet")
             .when(F.col("snapshots") < 2, "accumulating")
             .when(small, "flow_1d below this source's resolution"))
    return out.withColumn("snapshots", F.coalesce("snapshots", F.lit(0))).withColumn("note", note)


def _fund_list(funds: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(n).alias("label"))
                     for t, n in funds.items()])
