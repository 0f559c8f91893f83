"""Signals joined to forward returns and turned into non-overlapping block PnL.

Every strategy is a table (panel_id, strategy, session, pnl). Which blocks execute
never depends on earlier weights, so turnover is a keyed sum of each book and the
book before it, not a loop over sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.functions.frames import col
from tidepanel.functions.scalars import truthy
from tidepanel.operators.sections import block_rows, top_bottom
from tidepanel.session import materialise
from tidepanel.universe import COST_PER_SIDE, LEADER_RULES, SPREAD_PAIRS, TOPK

ONE = ("panel_id",)
_NUMBERS = ("sess_no", "n_sessions")


def book_pnls(legs: DataFrame, cost: float = COST_PER_SIDE,
              by: Sequence[str] = ONE) -> DataFrame:
    """PnL of successive books. ``legs`` holds (by, sess_no, session, instrument, weight,
    gross); a book without legs is one row with a NULL instrument. Each leg is emitted
    with its own book and, negated, with the next: their sum is the trade. The legs are
    written once, since books are numbered from them."""
    legs = materialise(legs.select(*by, "sess_no", "session", "instrument", "weight", "gross"), "legs")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("sess_no"))
    numbers = legs.select(*by, "sess_no").distinct().withColumn("__k", number)
    numbered = legs.join(numbers, [*by, "sess_no"])
    none = F.lit(None)
    sides = F.array(
        F.struct(F.col("__k").alias("k"), F.col("weight").alias("w"), F.col("gross").alias("g"),
                 F.col("session").alias("s"), F.col("sess_no").alias("n")),
        F.struct((F.col("__k") + 1).alias("k"), (-F.col("weight")).alias("w"),
                 none.cast("double").alias("g"), none.cast("date").alias("s"),
                 none.cast("int").alias("n")))
    flow = numbered.select(*by, "instrument", F.explode(sides).alias("e"))
    trades = flow.groupBy(*by, "instrument", "e.k").agg(
        F.sum("e.w").alias("w"), F.max("e.g").alias("g"), F.max("e.s").alias("session"),
        F.max("e.n").alias("sess_no"))
    books = trades.groupBy(*by, "k").agg(
        F.max("session").alias("session"), F.max("sess_no").alias("sess_no"),
        F.max("g").alias("gross"), F.sum(F.abs("w")).alias("turnover"))
    return (books.filter(F.col("session").isNotNull())
                 .select(*by, "session", "sess_no", "turnover",
                         (F.col("gross") - cost * F.col("turnover")).alias("pnl")))


def rank_legs(scored: DataFrame, score: str, fwd: str, hold: int, start: int,
              k: int = TOPK, invert: bool = False) -> DataFrame:
    """Half long the k best, half short the k worst; both sides need a realised return."""
    due = block_rows(scored.select(*fr.SERIES, "session", *_NUMBERS, col(score).alias("__s"),
                                   col(fwd).alias("__f")), hold, start)
    legs = top_bottom(due, "__s", k, invert)
    w = Window.partitionBy(*fr.SECTION)
    top = F.avg(F.when(F.col("side") == 1, F.col("__f"))).over(w)
    bottom = F.avg(F.when(F.col("side") == -1, F.col("__f"))).over(w)
    legs = legs.withColumn("gross", 0.5 * top - 0.5 * bottom)
    return (legs.filter(F.col("gross").isNotNull())
                .withColumn("weight", F.col("side") * F.lit(0.5 / k))
                .select("panel_id", "session", "sess_no", "instrument", "weight", "gross"))


def rank_long_short(scored: DataFrame, score: str, fwd: str, hold: int, start: int,
                    k: int = TOPK, invert: bool = False,
                    cost: float = COST_PER_SIDE) -> DataFrame:
    return book_pnls(rank_legs(scored, score, fwd, hold, start, k, invert), cost)


def signal_pnls(df: DataFrame, position: Column | str, fwd: Column | str, hold: int,
                start: Column | int, by: Sequence[str] = ONE, cost: float = COST_PER_SIDE,
                number: str = "sess_no") -> DataFrame:
    """Directional or weighted position in one asset. A block without a position or a
    return is skipped; turnover is against the last executed block."""
    rows = df.withColumns({"__p": col(position).cast("double"), "__f": col(fwd)})
    due = block_rows(rows, hold, start, by, number)
    live = due.filter(F.col("__p").isNotNull() & F.col("__f").isNotNull())
    prev = F.lag("__p", 1, 0.0).over(Window.partitionBy(*by).orderBy(number))
    pnl = F.col("__p") * F.col("__f") - cost * F.abs(F.col("__p") - prev)
    return live.select(*by, "session", F.col(number).alias("sess_no"), pnl.alias("pnl"))


def two_way_pnls(df: DataFrame, risk_off: Column, fwd: str, hedge_fwd: str, hold: int,
                 start: Column | int) -> DataFrame:
    """Risk-off holds half hedge against half short; otherwise long."""
    off = truthy(risk_off) & F.col(hedge_fwd).isNotNull()
    pos = F.when(off, -1.0).otherwise(1.0)
    gain = F.when(off, 0.5 * F.col(hedge_fwd) - 0.5 * F.col(fwd)).otherwise(F.col(fwd))
    rows = block_rows(df.withColumns({"__p": pos, "__g": gain}), hold, start)
    live = rows.filter(F.col("__g").isNotNull())
    prev = F.lag("__p", 1, 0.0).over(Window.partitionBy(*ONE).orderBy("sess_no"))
    return live.select(*ONE, "session", "sess_no",
                       (F.col("__g") - COST_PER_SIDE * F.abs(F.col("__p") - prev)).alias("pnl"))


def named(df: DataFrame, strategy: str) -> DataFrame:
    return df.select("panel_id", F.lit(strategy).alias("strategy"), "session", "sess_no", "pnl")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def start_after_first(df: DataFrame, x: str, plus: int = 1) -> DataFrame:
    """Adds ``__start``: the number of the first session where x exists, plus one. One
    value per panel."""
    first = df.groupBy("panel_id").agg(
        (F.min(F.when(col(x).isNotNull(), F.col("sess_no"))) + plus).alias("__start"))
    return df.join(first, "panel_id")


# --- scores of the cross-sectional rules ------------------------------------

def section_scores(panel: DataFrame, bench: str = "SPY") -> DataFrame:
    """All cross-sectional scores and both forward returns, over one sort per series."""
    w = fr.line()
    b = panel.filter(F.col("instrument") == bench).select(
        "panel_id", "session", F.col("ret").alias("__bench"))
    p = panel.join(b, ["panel_id", "session"], "left")
    p = fr.with_padded_return(fr.with_padded_return(p, "close", "rev5", 5), "close", "mom20", 20)
    logv = F.when(F.col("volume") > 0, F.ln("volume"))
    p = p.withColumns({
        "fwd5": fr.forward_return("close", 5), "fwd21": fr.forward_return("close", 21),
        "mom": F.lag("close", 21).over(w) / F.lag("close", 252).over(w) - 1,
        "vol60": fr.rolling_std("ret", 60), "beta": fr.rolling_beta("ret", "__bench", 60),
        "prox": F.col("close") / fr.rolling_max("close", 252),
        "skew": fr.rolling_skew("ret", 60), "sma": fr.rolling_mean("close", 210),
        "__tug": (F.col("open") / F.lag("close", 1).over(w) - 1)
        - (F.col("close") / F.col("open") - 1),
        "__ill": F.abs("ret") / F.nullif(F.col("volume") * F.col("close"), F.lit(0.0)),
        "__logv": logv, "__rng": (F.col("high") - F.col("low")) / F.col("close")})
    p = p.withColumns({"tug": fr.rolling_mean("__tug", 60),
                       "illiq": fr.rolling_mean("__ill", 20),
                       "volume_z": fr.rolling_zscore("__logv", 60),
                       "__rng5": fr.rolling_mean("__rng", 5)})
    return p.withColumn("rng_pct", fr.rank_percentile("__rng5", 252))


# (strategy, score, forward return, hold, start, invert)
RANK_RULES = [
    ("H02_xs_mom_12_1", "mom", "fwd21", 21, 253, False),
    ("H03_xs_reversal_5d", "rev5", "fwd5", 5, 60, True),
    ("H04_low_vol", "vol60", "fwd21", 21, 61, True),
    ("H05_bab_beta", "beta", "fwd21", 21, 61, True),
    ("H06_high_52w", "prox", "fwd21", 21, 253, False),
    ("W02_tug_of_war", "tug", "fwd21", 21, 61, False),
    ("W06_skew_xs", "skew", "fwd21", 21, 61, True),
    ("W07_amihud_illiq", "illiq", "fwd21", 21, 21, False),
]


def series_momentum(scored: DataFrame, least: int = 10) -> DataFrame:
    """Sign of 12-1 momentum in every name, equal weights, at least ten names."""
    due = block_rows(scored, 21, 253).withColumn("sg", F.signum("mom"))
    live = due.filter((F.col("sg") != 0) & F.col("fwd21").isNotNull())
    w = Window.partitionBy(*fr.SECTION)
    n = F.count(F.lit(1)).over(w)
    gross = F.avg(F.col("sg") * F.col("fwd21")).over(w)
    legs = live.withColumns({"n": n, "gross": gross}).filter(F.col("n") >= least)
    return book_pnls(legs.withColumn("weight", F.col("sg") / F.col("n")))


def above_average(scored: DataFrame) -> DataFrame:
    """Equal weight in every name above its 210-session average; every block counts."""
    due = block_rows(scored, 21, 211).withColumn("on", truthy(F.col("close") > F.col("sma")))
    w = Window.partitionBy(*fr.SECTION)
    due = due.withColumns({
        "n": F.count_if("on").over(w),
        "gross": F.coalesce(F.avg(F.when(F.col("on"), F.col("fwd21"))).over(w), F.lit(0.0)),
        "first": F.row_number().over(w.orderBy("instrument"))})
    keep = due.filter(F.col("on") | ((F.col("n") == 0) & (F.col("first") == 1)))
    return book_pnls(keep.select(
        "panel_id", "session", "sess_no", F.when(F.col("on"), F.col("instrument"))
        .alias("instrument"),
        F.when(F.col("on"), 1.0 / F.col("n")).otherwise(0.0).alias("weight"), "gross"))


def pooled_events(scored: DataFrame, hit: Column, side: Column, fwd: str, hold: int,
                  start: int, cost: float = 2 * COST_PER_SIDE) -> DataFrame:
    """Mean of signed forward returns over the names an event hits, per block."""
    due = block_rows(scored, hold, start).withColumn("__v", side * col(fwd))
    live = due.filter(truthy(hit) & F.col("__v").isNotNull() & (side != 0))
    return (live.groupBy("panel_id", "session", "sess_no")
                .agg((F.avg("__v") - cost).alias("pnl")))


def gated_momentum(scored: DataFrame, gate: DataFrame, k: int = TOPK) -> DataFrame:
    """Momentum books only while the gate is open; leaving pays to unwind, staying out
    costs nothing. ``gate`` is (panel_id, sess_no, open)."""
    legs = rank_legs(scored, "mom", "fwd21", 21, 253, k)
    books = legs.join(gate.filter("open"), ["panel_id", "sess_no"], "left_semi").withColumn(
        "flat", F.lit(False))
    sessions = scored.select("panel_id", "session", *_NUMBERS).distinct()
    shut = gate.filter(~F.col("open")).select("panel_id", "sess_no")
    flats = block_rows(sessions, 21, 253).join(shut, ["panel_id", "sess_no"], "left_semi").select(
        "panel_id", "session", "sess_no", F.lit(None).cast("string").alias("instrument"),
        F.lit(0.0).alias("weight"), F.lit(0.0).alias("gross"), F.lit(True).alias("flat"))
    events = books.unionByName(flats)
    marks = events.groupBy("panel_id", "sess_no").agg(F.max("flat").alias("flat"))
    held = F.lag(~F.col("flat"), 1, False).over(
        Window.partitionBy("panel_id").orderBy("sess_no"))
    kept = marks.withColumn("held", held).filter(~F.col("flat") | F.col("held"))
    return book_pnls(events.join(kept.select("panel_id", "sess_no"), ["panel_id", "sess_no"]))


# --- single-asset rules on a wide frame -------------------------------------

def _return(df: DataFrame, x: str, out: str, n: int = 1) -> DataFrame:
    return fr.with_padded_return(df, x, out, n, ONE)


def variance_premium(wide: DataFrame, spot: str = "SPY", vol: str = "VIX") -> DataFrame:
    """vrp and its trailing-year median."""
    out = _return(wide, spot, "__r")
    rv = fr.rolling_std("__r", 20, ONE) * F.lit(252 ** 0.5 * 100)
    out = out.withColumn("rv20", rv).withColumn(
        "vrp", F.col(vol) * F.col(vol) - F.col("rv20") * F.col("rv20"))
    return out.withColumn("vrp_median", fr.rolling_median("vrp", 252, ONE)).drop("__r")


def premium_filter(wide: DataFrame) -> DataFrame:
    out = variance_premium(wide).withColumn("fwd", fr.forward_return("SPY", 21, ONE))
    sig = truthy(F.col("vrp") > F.col("vrp_median")).cast("double")
    return signal_pnls(out, sig, "fwd", 21, 253)


def absorption_switch(wide: DataFrame, absorption: DataFrame) -> DataFrame:
    """Absorption spike: 15-session mean less 60-session mean above its own yearly
    deviation. Warm-up counts as no spike."""
    out = wide.join(absorption, ["panel_id", "sess_no"], "left")
    out = out.withColumns({
        "__d": fr.rolling_mean("absorption", 15, ONE) - fr.rolling_mean("absorption", 60, ONE),
        "fwd": fr.forward_return("SPY", 21, ONE), "hedge": fr.forward_return("TLT", 21, ONE)})
    out = out.withColumn("__t", fr.rolling_std("__d", 252, ONE))
    return two_way_pnls(out, F.col("__d") > F.col("__t"), "fwd", "hedge", 21, 313)


def leader_rules(wide: DataFrame, rules=LEADER_RULES) -> list[tuple[str, DataFrame]]:
    """Direction of a leader (or a ratio) held in a follower; rules whose legs are
    absent drop out."""
    found = []
    for name, lead, base, follower, look, hold, sign in rules:
        if any(c not in wide.columns for c in (lead, follower)) or (
                base and base not in wide.columns):
            continue
        level = F.ln(F.col(lead) / F.col(base)) if base else F.ln(lead)
        df = wide.withColumn("__l", level).withColumn("fwd", fr.forward_return(follower, hold, ONE))
        pos = F.signum(fr.change("__l", look, ONE)) * sign
        found.append((name, signal_pnls(df.withColumn("__s", pos), "__s", "fwd", hold, look + 1)))
    return found


def month_turn(wide: DataFrame, spot: str = "SPY", hold: int = 4) -> DataFrame:
    nxt = F.lead("session", 1).over(fr.line(ONE))
    last = F.month("session") != F.coalesce(F.month(nxt), F.lit(-1))
    df = wide.withColumns({"__last": last, "fwd": fr.forward_return(spot, hold, ONE)})
    return df.filter(F.col("__last") & F.col("fwd").isNotNull()).select(
        "panel_id", "session", "sess_no", (F.col("fwd") - 2 * COST_PER_SIDE).alias("pnl"))


def pair_fade(wide: DataFrame, pairs=SPREAD_PAIRS, threshold: float = 2.0) -> DataFrame:
    """Fade a stretched log ratio; legs of one session are averaged. The pair list rides
    along as an array, so all pairs share one scan and one sort."""
    live = {n: p for n, p in pairs.items() if p[0] in wide.columns and p[1] in wide.columns}
    items = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"))
                      for n, (a, b) in live.items()])
    by = ("panel_id", "pair")
    rows = wide.select("panel_id", "session", *_NUMBERS, F.explode(items).alias("x")).select(
        "panel_id", "session", *_NUMBERS, "x.*").withColumn("__s", F.ln(F.col("a") / F.col("b")))
    rows = rows.withColumns({"z": fr.rolling_zscore("__s", 120, by),
                             "fa": fr.forward_return("a", 21, by),
                             "fb": fr.forward_return("b", 21, by)})
    due = block_rows(rows, 21, 121)
    pnl = -F.signum("z") * 0.5 * (F.col("fa") - F.col("fb")) - 2 * COST_PER_SIDE
    legs = due.withColumn("pnl", pnl).filter((F.abs("z") >= threshold)
                                             & F.col("pnl").isNotNull())
    return legs.groupBy("panel_id", "session", "sess_no").agg(F.avg("pnl").alias("pnl"))


def overnight_blocks(bars: DataFrame, width: int = 21) -> DataFrame:
    """Sums of close-to-open returns, two trades a session, over complete blocks;
    a session without a return adds nothing."""
    prev = F.lag("close", 1).over(fr.line(ONE))
    df = bars.withColumn("__on", F.col("open") / prev - 1 - 2 * COST_PER_SIDE)
    block = F.floor((F.col("sess_no") - 1) / width)
    rows = df.withColumn("block_no", block).filter(
        (F.col("sess_no") >= 1) & (F.col("block_no") * width + 1 < F.col("n_sessions") - width))
    return rows.groupBy("panel_id", "block_no").agg(
        F.min("session").alias("session"), F.min("sess_no").alias("sess_no"),
        F.coalesce(F.sum("__on"), F.lit(0.0)).alias("pnl")).drop("block_no")


def managed_weight(wide: DataFrame, spot: str = "SPY") -> DataFrame:
    df = _return(wide, spot, "__r").withColumn("__v", fr.rolling_var("__r", 20, ONE))
    df = df.withColumns({"__raw": fr.rolling_median("__v", 252, ONE) / F.nullif("__v", F.lit(0.0)),
                         "fwd": fr.forward_return(spot, 21, ONE)})
    weight = F.when(F.col("__raw").isNotNull(), F.least("__raw", F.lit(2.0)))
    return signal_pnls(df, weight, "fwd", 21, 273)


def winter_rule(wide: DataFrame, spot: str = "SPY") -> DataFrame:
    df = wide.withColumn("fwd", fr.forward_return(spot, 21, ONE))
    return signal_pnls(df, F.month("session").isin(11, 12, 1, 2, 3, 4).cast("double"), "fwd", 21, 1)


def always_long(wide: DataFrame, spot: str = "SPY", hold: int = 21, start: int = 1) -> DataFrame:
    df = wide.withColumn("fwd", fr.forward_return(spot, hold, ONE))
    return signal_pnls(df, F.lit(1.0), "fwd", hold, start, cost=0.0)


def surface_rules(wide: DataFrame) -> list[tuple[str, DataFrame]]:
    """Term-structure timer and switch, tail-price follow, vol-of-vol stress."""
    df = wide.withColumns({
        "fwd21": fr.forward_return("SPY", 21, ONE), "fwd5": fr.forward_return("SPY", 5, ONE),
        "hedge": fr.forward_return("TLT", 21, ONE), "ts": F.col("VIX") / F.col("VIX3M"),
        "sk_z": _plain_z("SKEW", 156), "vv_z": _plain_z("VVIX", 156)})
    start = F.col("__start")
    ts, sk, vv = (start_after_first(df, c) for c in ("ts", "sk_z", "vv_z"))
    return [
        ("V1_ts_contango_timer", signal_pnls(
            ts, truthy(F.col("ts") < 1.0).cast("double"), "fwd21", 21, start)),
        ("V2_backwardation_riskoff", two_way_pnls(
            ts.withColumn("fwd21", F.when(F.col("ts").isNotNull(), F.col("fwd21"))),
            F.col("ts") > 1.0, "fwd21", "hedge", 21, start)),
        ("V3_skew_follow", signal_pnls(
            sk, truthy(F.col("sk_z") > 1.0).cast("double"), "fwd21", 21, start)),
        ("V4_vvix_stress", signal_pnls(
            vv, truthy(F.col("vv_z") <= 1.5).cast("double"), "fwd5", 5, start)),
    ]


def _plain_z(x: str, n: int) -> Column:
    return fr.rolling_zscore(x, n, ONE)


def funding_fade(daily: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Fade extreme rates on the asset's own calendar (price, z, sess_no per panel)."""
    df = start_after_first(daily.withColumn("fwd", fr.forward_return("price", 5, ONE)), "z", 0)
    pos = (F.when(F.col("z") > threshold, -1.0).when(F.col("z") < -threshold, 1.0)
            .when(F.col("z").isNotNull(), 0.0))
    return signal_pnls(df, pos, "fwd", 5, F.col("__start"))


def liquidity_trend(wide: DataFrame) -> DataFrame:
    """Long while the 13-week change, carried at most five sessions, is positive."""
    df = start_after_first(wide.withColumn("fwd", fr.forward_return("SPY", 21, ONE)), "chg")
    return signal_pnls(df, truthy(F.col("chg") > 0).cast("double"), "fwd", 21, F.col("__start"))


def pooled_positions(prices: DataFrame, signals: DataFrame, position: Column,
                     hold: int = 21) -> DataFrame:
    """One pooled PnL per rebalance over the assets that take a side."""
    rows = prices.withColumn("fwd", fr.forward_return("close", hold)).join(
        signals, ["panel_id", "instrument", "session"])
    due = block_rows(rows.withColumn("__p", position), hold, 0)
    legs = due.filter((F.col("__p") != 0) & F.col("fwd").isNotNull()).select(
        "panel_id", "session", "sess_no", "instrument",
        (F.col("__p") * F.col("fwd") - 2 * COST_PER_SIDE).alias("pnl"))
    return legs


def pool(legs: DataFrame) -> DataFrame:
    return legs.groupBy("panel_id", "session", "sess_no").agg(F.avg("pnl").alias("pnl"))


def scheduled_events(rets: DataFrame, is_event: Column, ret: str = "r",
                     by: Sequence[str] = ONE) -> DataFrame:
    """Mean on event sessions against all others, with Welch's t beyond ten events."""
    rows = rets.filter(col(ret).isNotNull()).withColumn("__e", is_event)
    return welch_split(rows, "__e", ret, by, least=11, names=("event", "control"))


def welch_split(df: DataFrame, flag: str, x: str, by: Sequence[str] = ONE, least: int = 2,
                names=("on", "off")) -> DataFrame:
    """Means, counts and Welch t of x where a flag holds and where it does not."""
    on, off = names
    a, b = F.when(F.col(flag), col(x)), F.when(~F.col(flag), col(x))
    out = df.groupBy(*by).agg(
        F.count(a).alias(f"n_{on}"), F.count(b).alias(f"n_{off}"), F.avg(a).alias(f"mean_{on}"),
        F.avg(b).alias(f"mean_{off}"), F.var_samp(a).alias("__va"), F.var_samp(b).alias("__vb"))
    se = F.sqrt(F.col("__va") / F.col(f"n_{on}") + F.col("__vb") / F.col(f"n_{off}"))
    t = (F.col(f"mean_{on}") - F.col(f"mean_{off}")) / F.nullif(se, F.lit(0.0))
    enough = (F.col(f"n_{on}") >= least) & (F.col(f"n_{off}") >= 2)
    return out.withColumn("welch_t", F.when(enough, t)).drop("__va", "__vb")


def summarise_pnls(pnls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks, mean, hit rate and profit factor; no loss at all has no factor."""
    p = F.col("pnl")
    lost = -F.sum(F.when(p < 0, p).otherwise(0.0))
    won = F.sum(F.when(p > 0, p).otherwise(0.0))
    return pnls.groupBy(*by).agg(
        F.count(p).alias("n"), F.avg(p).alias("mean_pnl"),
        F.avg((p > 0).cast("double")).alias("hit"),
        (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"))


def replication(deep: DataFrame, recent: DataFrame, least: int = 30) -> DataFrame:
    """Does a rule that pays recently also pay in the earlier sample (of its own panel, where there are several)?"""
    key = [c for c in ("panel_id", "strategy") if c in deep.columns and c in recent.columns]
    now = recent.select(*key, F.col("profit_factor").alias("pf_recent"))
    both = deep.join(now, key, "left")
    pays = truthy((F.col("profit_factor") > 1.0) & (F.col("pf_recent") > 1.0))
    return both.withColumn("verdict", F.when(F.col("n") < least, "insufficient-history")
                           .when(pays, "replicates").otherwise("regime-specific"))
