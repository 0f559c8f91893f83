"""Features, labels, block results and score history of the walk-forward model (``boosting`` grows it)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.operators.sections import block_rows, leans, top_bottom
from tidepanel.universe import COST_PER_SIDE, TOPK

WINDOWS = (5, 10, 20, 30, 60)
HORIZONS = (5, 21)


BAR_SHAPE = ("bar_mid", "bar_len", "bar_mid_rel", "bar_up", "bar_low", "bar_shift", "open_rel", "high_rel", "low_rel")
ROLLING = ("roc", "mean", "std", "max", "min", "up_share", "gain", "vol_mean", "vol_std", "corr")


def feature_names(windows: Sequence[int] = WINDOWS) -> list[str]:
    """Names of ``feature_columns``, in order."""
    return [*BAR_SHAPE, *[f"{r}_{n}" for n in windows for r in ROLLING]]


def feature_columns(windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    """Bar-shape ratios and rolling statistics relative to the last close. All of them
    are windows over one partitioning and one sort."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    span = F.nullif(h - low, F.lit(0.0))
    out = {"bar_mid": (c - o) / o, "bar_len": (h - low) / o, "bar_mid_rel": (c - o) / span,
           "bar_up": (h - F.greatest(o, c)) / o, "bar_low": (F.least(o, c) - low) / o,
           "bar_shift": (2 * c - h - low) / o, "open_rel": o / c, "high_rel": h / c,
           "low_rel": low / c}
    up = (F.col("ret") > 0).cast("double")
    for n in windows:
        w = fr.trailing(n)
        vol = F.nullif(v, F.lit(0.0))
        out |= {
            f"roc_{n}": F.try_divide(F.lag(c, n).over(fr.line()), c),
            f"mean_{n}": fr.rolling_mean(c, n) / c, f"std_{n}": fr.rolling_std(c, n) / c,
            f"max_{n}": fr.rolling_max(c, n) / c,
            f"min_{n}": fr.needs(c, w, n, F.min(low).over(w)) / c,
            f"up_share_{n}": fr.needs(F.col("ret"), w, n, F.avg(up).over(w)),
            f"gain_{n}": fr.needs(F.col("ret"), w, n,
                                  F.sum(F.greatest("ret", F.lit(0.0))).over(w)
                                  / F.nullif(F.sum(F.abs("ret")).over(w), F.lit(0.0))),
            f"vol_mean_{n}": fr.rolling_mean(v, n) / vol,
            f"vol_std_{n}": fr.rolling_std(v, n) / vol,
            f"corr_{n}": fr.rolling_corr(c, F.log1p(v), n),
        }
    return out


def with_features(panel: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    return panel.withColumns(feature_columns(windows))


def with_labels(panel: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward return per horizon."""
    return panel.withColumns({f"label_{h}": fr.forward_return("close", h) for h in horizons})


def augment(features: DataFrame, context: DataFrame, keys=("panel_id", "session")) -> DataFrame:
    """Market-wide context columns joined on the session."""
    return features.join(context, list(keys), "left")


def model_pnls(scores: DataFrame, horizon: int, start: int, k: int = TOPK,
               cost: float = 2 * COST_PER_SIDE, by: Sequence[str] = ()) -> DataFrame:
    """Top-k less bottom-k realised label per rebalance, both sides paid."""
    due = block_rows(scores, horizon, start)
    legs = top_bottom(due, "score", k, by=("panel_id", *by, "session"))
    top = F.avg(F.when(F.col("side") == 1, F.col("label")))
    bottom = F.avg(F.when(F.col("side") == -1, F.col("label")))
    out = legs.groupBy("panel_id", *by, "session", "sess_no").agg((top - bottom - cost).alias("pnl"))
    return out.filter("pnl is not null")


def trial_pnls(scores: DataFrame, horizons: Sequence[int], start: int, k: int = TOPK) -> DataFrame:
    """Block results of every (variant, horizon) of one scored table, from the first refit on."""
    out = None
    for h in horizons:
        own = scores.where(F.col("horizon") == h)
        part = model_pnls(own, h, start, k, by=("variant", "horizon"))
        out = part if out is None else out.unionByName(part)
    return out


def score_history(scores: DataFrame, k: int = TOPK, by: Sequence[str] = ()) -> DataFrame:
    """Every scored session with rank percentile and lean, wide sections only. ``by`` names further keys
    of a section."""
    section = ["panel_id", *by, "session"]
    wide = scores.groupBy(*section).agg(F.count("score").alias("__n")).filter(F.col("__n") >= 2 * k + 1)
    rows = scores.join(wide.drop("__n"), section, "left_semi")
    return leans(rows, "score", k, section)
