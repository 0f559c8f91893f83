"""The layer frame: one verdict per question, instrument and session.

Price layers run on an instrument's own bars (gaps removed), so every window and
smoothing sees priced rows only; market layers join on the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.functions.scalars import BEAR, BULL, NEUTRAL, NO_DATA, truthy, verdict
from tidepanel.operators import asof
from tidepanel.operators import smoothing as sm
from tidepanel.universe import CROWDED, FUND_TICKER, STORIES, UNCROWDED

LAYERS = ["trend", "momentum", "volume", "breadth", "rel_strength", "flows", "positioning",
          "valuation", "fundamentals", "macro", "narrative", "risk"]
KEY = [*fr.SERIES, "session"]


def _rows() -> F.Column:
    return fr.seen_count("close")


def trend(bars: DataFrame) -> DataFrame:
    """Price against its fast and slow means; needs 205 priced sessions."""
    b = sm.ema(bars, "close", {"e21": 21, "e50": 50, "e200": 200}, ignore_gaps=True)
    c, e21, e50, e200 = (F.col(x) for x in ("close", "e21", "e50", "e200"))
    v = verdict((c > e200) & (c > e21), ~(c > e200) & (c < e21))
    warm = _rows() >= 205
    return b.select(*KEY, F.when(warm, v).otherwise(NO_DATA).alias("trend"),
                    F.when(warm, c / e200 - 1).alias("dist_ema200_pct"),
                    F.when(warm, (c > e21) & (e21 > e50) & (e50 > e200)).alias("stacked"))


def momentum(bars: DataFrame) -> DataFrame:
    """Is the histogram expanding, and is the move already stretched?"""
    b = sm.rsi(sm.macd(bars, "close", ignore_gaps=True), "close", ignore_gaps=True)
    h, prev, r = F.col("macd_hist"), F.lag("macd_hist", 1).over(fr.line()), F.col("rsi")
    b = b.withColumn("__exp", F.abs(h) > F.abs(prev))
    grows = F.col("__exp")
    v = verdict((h > 0) & grows & ~truthy(r >= 80), (h < 0) & grows & ~truthy(r <= 20))
    return b.select(*KEY, F.when(_rows() >= 60, v).otherwise(NO_DATA).alias("momentum"),
                    "rsi", "macd_hist")


def volume(bars: DataFrame) -> DataFrame:
    """Recent volume against its base, and whether up days carry it. Zero volume is no
    measurement; no down-day volume at all is confirmation."""
    b = bars.withColumn("__ret", fr.plain_return("close")).filter(F.col("volume") > 0)
    w5, w20, w60 = fr.trailing(5), fr.trailing(20), fr.trailing(60)
    up = F.coalesce(F.avg(F.when(F.col("__ret") > 0, F.col("volume"))).over(w20), F.lit(0.0))
    down = F.coalesce(F.avg(F.when(~truthy(F.col("__ret") > 0), F.col("volume"))).over(w20),
                      F.lit(0.0))
    b = b.withColumns({"vol_ratio": F.avg("volume").over(w5) / F.avg("volume").over(w60),
                       "__conf": up > down, "__n": fr.seen_count("volume")})
    busy = F.col("vol_ratio") > 1.15
    v = verdict(busy & F.col("__conf"), busy & ~F.col("__conf"))
    return b.select(*KEY, F.when(F.col("__n") >= 60, v).otherwise(NO_DATA).alias("volume_layer"),
                    "vol_ratio")


def breadth_layer(history: DataFrame) -> DataFrame:
    a50, a200 = F.col("breadth_above_50"), F.col("breadth_above_200")
    v = verdict((a200 > 0.60) & (a50 > 0.50), (a200 < 0.40) & (a50 < 0.50))
    ok = (F.col("breadth_n") > 0) & (F.col("sess_no") >= 204)
    return history.select("panel_id", "session", F.when(ok, v).otherwise(NO_DATA).alias("breadth"))


def relative_strength(bars: DataFrame, bench: str = "SPY", n: int = 63) -> DataFrame:
    """n-session return against the benchmark, on the dates both are priced."""
    b = bars.filter(F.col("instrument") == bench).select("panel_id", "session",
                                                         F.col("close").alias("__b"))
    both = fr.by_series(bars.join(b, ["panel_id", "session"]))
    both = both.withColumn("rs_3m", fr.plain_return("close", n) - fr.plain_return("__b", n))
    v = verdict(F.col("rs_3m") > 0, F.col("rs_3m") < 0)
    layer = (F.when(F.col("instrument") == bench, NEUTRAL)
              .when(_rows() >= n + 5, v).otherwise(NO_DATA))
    out = both.select(*KEY, layer.alias("rel_strength"), "rs_3m")
    return bars.select(*KEY).join(out, KEY, "left").withColumn(
        "rel_strength", F.coalesce("rel_strength", F.when(F.col("instrument") == bench, NEUTRAL)
                                   .otherwise(NO_DATA)))


def flows_layer(names: DataFrame, flows: DataFrame) -> DataFrame:
    """Fund flow z, looked up by name or by the fund ticker of that name."""
    pairs = [F.lit(x) for kv in FUND_TICKER.items() for x in kv]
    ticker = F.coalesce(F.create_map(*pairs)[F.col("instrument")], F.col("instrument"))
    f = flows.select("panel_id", F.col("ticker").alias("__t"), "z", "flow_20d")
    rows = names.withColumn("__t", ticker).join(f, ["panel_id", "__t"], "left")
    have = F.col("z").isNotNull() & F.col("flow_20d").isNotNull()
    return rows.select("panel_id", "instrument", F.when(have, verdict(
        F.col("z") > 1, F.col("z") < -1)).otherwise(NO_DATA).alias("flows"),
        F.col("z").alias("flow_z"))


def positioning_layer(bars: DataFrame, features: DataFrame, funding: DataFrame | None = None,
                      funded: str = "BTC") -> DataFrame:
    """A crowded side is a hazard: crowded long reads bearish. Bearish dominates."""
    feats = features.withColumnRenamed("asset", "instrument")
    rows = asof.asof_backward(bars.select(*KEY), feats, fr.SERIES, "session", "effective_date",
                              ["idx52"])
    if funding is not None:
        f = funding.select("panel_id", F.lit(funded).alias("instrument"), "date", "z156")
        rows = asof.asof_backward(rows, f, fr.SERIES, "session", "date", ["z156"])
    else:
        rows = rows.withColumn("z156", F.lit(None).cast("double"))
    i, z = F.col("idx52"), F.col("z156")
    votes = F.array_compact(F.array(
        F.when(i >= CROWDED, BEAR).when(i <= UNCROWDED, BULL).when(i.isNotNull(), NEUTRAL),
        F.when(z > 1.5, BEAR).when(z < -1.5, BULL).when(z.isNotNull(), NEUTRAL)))
    v = (F.when(F.size(votes) == 0, NO_DATA).when(F.array_contains(votes, BEAR), BEAR)
          .when(F.array_contains(votes, BULL), BULL).otherwise(NEUTRAL))
    return rows.select(*KEY, v.alias("positioning"))


def macro_layer(bars: DataFrame, bench_returns: DataFrame, liquidity: DataFrame,
                bench: str = "SPY", n: int = 60, linked: float = 0.20,
                impulse_z: float = 0.50) -> DataFrame:
    """Sign of the liquidity impulse times the sign of co-movement with the benchmark."""
    r = bars.withColumn("__r", fr.plain_return("close")).join(bench_returns,
                                                              ["panel_id", "session"], "left")
    r = fr.by_series(r).withColumn("__c", fr.rolling_corr("__r", "bench_ret", n, least=2))
    liq = liquidity.select("panel_id", "day", "netliq_chg13w", "netliq_chg13w_z")
    # one row per session meets the levels; the instruments then join on the session
    known = asof.asof_backward(bars.select("panel_id", "session").distinct(), liq, ["panel_id"],
                               "session", "day", ["netliq_chg13w", "netliq_chg13w_z"])
    r = r.select(*KEY, "__c").join(known.select(
        "panel_id", "session", "netliq_chg13w", "netliq_chg13w_z"), ["panel_id", "session"], "left")
    own = F.col("instrument") == bench
    beta = F.when(own, 1.0).otherwise(F.col("__c"))
    chg, z = F.col("netliq_chg13w"), F.col("netliq_chg13w_z")
    strong = z.isNull() | (F.abs(z) >= impulse_z)
    impulse = (F.when(chg.isNull() | ~strong, 0).when(chg > 0, 1).otherwise(-1))
    sign = F.when(beta >= linked, 1).when(beta <= -linked, -1).otherwise(0)
    lean = impulse * sign
    v = (F.when(F.col("__c").isNull() & chg.isNull() & ~own, NO_DATA)
          .when(beta.isNull(), NEUTRAL).otherwise(verdict(lean > 0, lean < 0)))
    return r.select(*KEY, v.alias("macro"), F.col("__c").alias("corr_bench"))


def narrative_layer(stories: DataFrame, registered=STORIES) -> DataFrame:
    """All stories about an instrument holding is bullish; any inverted one bearish."""
    about = F.create_map(*[x for s in registered for x in
                           (F.lit(s[0]), F.array(*[F.lit(a) for a in s[4]]))])
    rows = stories.select("panel_id", "session", "state",
                          F.explode(about[F.col("story")]).alias("instrument"))
    return rows.groupBy(*KEY).agg(verdict(
        F.bool_and(F.col("state") == "HOLDING"), F.bool_or(F.col("state") == "BROKEN"))
        .alias("narrative"))


def risk(bars: DataFrame) -> DataFrame:
    """Realised volatility in its own year and the distance from the yearly high."""
    b = bars.withColumn("__r", fr.plain_return("close"))
    b = b.withColumn("__rv", fr.rolling_std("__r", 20) * F.lit(252 ** 0.5 * 100))
    b = b.withColumns({"rv_pct": fr.inclusive_percentile("__rv"),
                       "dd": F.col("close") / F.max("close").over(fr.trailing(252)) - 1,
                       "__n": fr.seen_count("__r")})
    p, dd = F.col("rv_pct"), F.col("dd")
    v = verdict((p < 0.35) & (dd > -0.10), (p > 0.65) | (dd < -0.20))
    return b.select(*KEY, F.when(F.col("__n") >= 260, v).otherwise(NO_DATA).alias("risk"),
                    "rv_pct", F.col("dd").alias("dd_from_52w_high"))


def layer_frame(bars: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """All layers side by side with the tally. ``parts`` holds the frames above."""
    out = bars.select(*KEY, F.col("close").alias("price"))
    for name in ("trend", "momentum", "volume", "rel_strength", "positioning", "macro", "risk",
                 "narrative"):
        out = out.join(parts[name].select(*KEY, F.col(
            "volume_layer" if name == "volume" else name).alias(name)), KEY, "left")
    out = out.join(parts["breadth"].select("panel_id", "session", "breadth"),
                   ["panel_id", "session"], "left")
    out = out.join(parts["flows"].select("panel_id", "instrument", "flows"),
                   ["panel_id", "instrument"], "left")
    out = out.withColumns({
        "valuation": F.lit(NO_DATA), "fundamentals": F.lit(NO_DATA),
        "narrative": F.coalesce("narrative", F.lit(NEUTRAL)),
        **{n: F.coalesce(n, F.lit(NO_DATA)) for n in LAYERS
           if n not in ("valuation", "fundamentals", "narrative")}})
    return tally(out)


def tally(df: DataFrame) -> DataFrame:
    def count(v: str):
        return sum((F.when(F.col(n) == v, 1).otherwise(0) for n in LAYERS), F.lit(0))
    df = df.withColumns({"n_bullish": count(BULL), "n_bearish": count(BEAR),
                         "n_neutral": count(NEUTRAL), "n_no_data": count(NO_DATA)})
    return df.withColumn("confluence", F.format_string("%dB / %dBr / %dND", "n_bullish",
                                                       "n_bearish", "n_no_data"))
