"""The state panel: every registered reading on every session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.functions import frames as fr
from tidepanel.operators import asof, layers
from tidepanel.operators import histories as hs
from tidepanel.operators import matrices as mx
from tidepanel.operators import rules as ru
from tidepanel.operators import sections as xs
from tidepanel.operators import smoothing as sm
from tidepanel.plans.views import Views
from tidepanel.sources import landing as ld
from tidepanel.universe import (BREADTH_EXCLUDE, CONDITION_IDS, FLOW_FUNDS, POSITIONED, STORIES)

SURFACE = ["SPY", "VIX", "VIX9D", "VIX3M", "VVIX", "SKEW"]
STORY_LEGS = sorted({leg for s in STORIES for leg in (s[1], s[2])})


class State:
    """Plans of one market state; each reading is one plan over the whole history.

    With ``keep``, for results that put many readings together, each reading is written once to the
    shared folder when it is first asked for, so the plans above it stay small.
    """

    def __init__(self, views: Views, keep: bool = False):
        self.v, self.keep = views.settle(), keep

    def _once(self, key, build):
        if self.keep:
            return self.v._once(f"kept:{key}", lambda: env.materialise(build(), key))
        return self.v._once(f"state:{key}", build)

    def vol(self) -> DataFrame:
        """Volatility indices quote in points: prices are scaled to that range."""
        def build():
            wide = self.v.wide(SURFACE)
            scale = {c: F.col(c) / 100 for c in SURFACE if c != "SPY"}
            return ru.vol_surface(wide.withColumns(scale))
        return self._once("vol", build)

    def liquidity(self) -> DataFrame:
        return self._once("liq", lambda: hs.net_liquidity(
            self.v.levels(), ld.resolve_balances(self.v.balances())))

    def features(self) -> DataFrame:
        return self._once("feats", lambda: hs.weekly_features(self.v.positions()))

    def positions(self) -> DataFrame:
        return self._once("pos", lambda: hs.daily_positions(self.features(), self.v.calendar()))

    def funding(self) -> DataFrame:
        return self._once("fund", lambda: hs.daily_rate_features(
            self.v.daily_rates().filter("series_id = 'A'")))

    def returns(self, names) -> DataFrame:
        cells = [F.max(F.when(F.col("instrument") == n, F.col("ret"))).alias(n) for n in names]
        return self.v.panel().groupBy("panel_id", "session", "sess_no").agg(*cells)

    def vectors(self) -> DataFrame:
        return self._once("vec", lambda: mx.pack(self.v.panel(), POSITIONED, "ret"))

    def structure(self) -> DataFrame:
        return self._once("struct", lambda: mx.rolling_structure(self.vectors()))

    def stories(self) -> DataFrame:
        return self._once("stories", lambda: ru.story_history(self.returns(STORY_LEGS)))

    def breadth(self) -> DataFrame:
        def build():
            p = self.v.panel().filter(~F.col("instrument").isin(BREADTH_EXCLUDE))
            p = sm.ema(p, "close", {"e50": 50, "e200": 200}, fill=False)
            p = p.withColumn("valid", F.col("close").isNotNull()
                             & (fr.seen_count("close") >= 200))
            return xs.breadth(p, {"breadth_above_50": F.col("close") > F.col("e50"),
                                  "breadth_above_200": F.col("close") > F.col("e200")},
                              F.col("valid"), ("panel_id", "session", "sess_no"))
        return self._once("breadth", build)

    def crowding(self) -> DataFrame:
        return self._once("crowd", lambda: ru.crowding(self.positions(), self.vectors()))

    def conditions(self, with_structure: bool = True) -> DataFrame:
        inputs = ru.condition_inputs(
            self.vol(), self.liquidity(), self.crowding(),
            self.structure().select("panel_id", "sess_no", "absorption", "top1_share")
            if with_structure else None)
        if with_structure:
            # sessions whose structure cannot be measured have no replay
            inputs = inputs.filter("absorption is not null")
        return inputs

    def layers(self) -> DataFrame:
        bars = env.materialise(self.v.bars_numbered(), "numbered")
        bench = self.returns(["SPY"]).select("panel_id", "session",
                                             F.col("SPY").alias("bench_ret"))
        names = bars.select("panel_id", "instrument").distinct()
        flows = hs.fund_flows(self.v.snapshots(), FLOW_FUNDS)
        return layers.layer_frame(bars, {
            "trend": layers.trend(bars), "momentum": layers.momentum(bars),
            "volume": layers.volume(bars), "rel_strength": layers.relative_strength(bars),
            "positioning": layers.positioning_layer(bars, self.features(), self.funding()),
            "macro": layers.macro_layer(bars, bench, self.liquidity()),
            "risk": layers.risk(bars), "narrative": layers.narrative_layer(self.stories()),
            "breadth": layers.breadth_layer(self.breadth()),
            "flows": layers.flows_layer(names, flows)})

    def panel(self) -> DataFrame:
        """Wide: volatility, liquidity, funding, structure, breadth, positioning, stories
        and conditions per session. Each block is written once to the shared folder, so
        the joins read finished tables and a lost executor re-reads, not recomputes."""
        def keep(df: DataFrame, label: str) -> DataFrame:
            return df if self.keep else env.materialise(df, label)

        vol = keep(self.vol(), "vol")
        out = vol.select("panel_id", "session", "sess_no", *[
            F.col(c).alias(f"vol_{c}") for c in ("vix", "vrp", "vrp_pct", "vix_pct", "term_ratio",
                                                 "term_stale_days", "vvix", "skew", "skew_pct",
                                                 "rv20")])
        liq_cols = ["netliq", "netliq_chg13w", "netliq_chg13w_z", "rrp", "walcl", "tga"]
        liq = self.liquidity().select("panel_id", "day", *[F.col(c).alias(f"liq_{c}")
                                                           for c in liq_cols])
        out = asof.exact_then_fill(out, liq, ["panel_id"], "session", "day",
                                   [f"liq_{c}" for c in liq_cols])
        fund_cols = ["z156", "idx52w", "funding_1d_annualized_pct"]
        fund = self.funding().select("panel_id", "date", *[F.col(c).alias(f"fund_{c}")
                                                           for c in fund_cols])
        out = asof.exact_then_fill(out, fund, ["panel_id"], "session", "date",
                                   [f"fund_{c}" for c in fund_cols])
        at = ["panel_id", "sess_no"]
        struct = keep(self.structure(), "structure")
        out = out.join(struct.select(*at, F.col("absorption").alias("struct_absorption"),
                                     F.col("top1_share").alias("struct_top1_share")), at, "left")
        out = out.join(self.breadth().drop("session"), at, "left")
        pos = keep(self.positions(), "positions")
        assets = POSITIONED
        wide = pos.groupBy(*at).agg(
            *[F.max(F.when(F.col("asset") == a, F.col(c))).alias(f"cot_{c}_{a}")
              for a in assets for c in ("idx52", "z156", "chg4w")],
            F.count_if(ru.is_crowded()).alias("cot_n_crowded"))
        out = out.join(wide, at, "left")
        st = keep(self.stories(), "stories")
        told = st.groupBy(*at).agg(*[
            F.max(F.when(F.col("story") == s[0], F.col(c))).alias(f"story_{label}_{s[0]}")
            for s in STORIES for c, label in (("corr_fast", "corr"), ("corr_slow", "corr_slow"),
                                              ("state", "state"))])
        out = out.join(told, at, "left")
        fired = ru.condition_columns()
        cond = self.conditions().select(*at, *[fired[c].cast("double").alias(f"cond_{c}")
                                               for c in CONDITION_IDS])
        return out.join(cond, at, "left")
