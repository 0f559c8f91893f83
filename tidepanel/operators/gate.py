"""Overfit statistics of block PnL: deflated Sharpe and combinatorial overfitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import expected_max_z, norm_cdf
from tidepanel.universe import GATE_PBO_MAX, GATE_RATIO_MIN


def deflated_sharpe(pnls: DataFrame, by: Sequence[str], trials: int) -> DataFrame:
    """Sharpe per block, its skew- and kurtosis-corrected error, and its distance from
    the best of ``trials`` noise strategies (Bailey & Lopez de Prado 2014)."""
    p = F.col("pnl")
    m = pnls.groupBy(*by).agg(
        F.count(p).alias("n"), F.avg(p).alias("mean_pnl"), F.stddev_samp(p).alias("__sd"),
        F.skewness(p).alias("__g3"), F.kurtosis(p).alias("__g4"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("__won"),
        F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("__lost"))
    bracket = expected_max_z(trials)
    out = m.withColumn("sr", F.when(F.col("n") > 1, F.col("mean_pnl")
                                    / F.nullif("__sd", F.lit(0.0))))
    sr = F.col("sr")
    spread = 1 - F.col("__g3") * sr + (F.col("__g4") + 2) / 4 * sr * sr
    out = out.withColumn("sigma_sr", F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("n") - 1)))
    out = out.withColumn("psr_z", sr / F.nullif("sigma_sr", F.lit(0.0)))
    out = out.withColumn("ratio", F.col("psr_z") - bracket)
    return out.withColumns({
        "bracket": F.lit(bracket), "sr_star": bracket * F.col("sigma_sr"),
        "prob": norm_cdf("ratio"),
        "profit_factor": F.col("__won") / F.nullif("__lost", F.lit(0.0)),
    }).drop("__sd", "__g3", "__g4", "__won", "__lost")


def overfit_probability(pnls: DataFrame, by: Sequence[str] = ("panel_id",),
                        key: str = "strategy", order: str = "sess_no",
                        blocks: int = 10) -> DataFrame:
    """Combinatorially symmetric cross-validation (Bailey et al. 2015): over every split
    of the blocks in two halves, how often does the strategy that is best in sample rank
    in the lower half out of sample? Splits work on per-block moments, never on rows."""
    w = Window.partitionBy(*by, key)
    place = F.row_number().over(w.orderBy(order)) - 1
    size = F.count(F.lit(1)).over(w)
    tagged = pnls.withColumn("__b", F.floor(place * blocks / size).cast("int"))
    m = tagged.groupBy(*by, key, "__b").agg(
        F.count("pnl").alias("n"), F.sum("pnl").alias("s"),
        F.sum(F.col("pnl") * F.col("pnl")).alias("q"))
    # the splits are all masks with half their bits set
    masks = F.filter(F.sequence(F.lit(0), F.lit(2 ** blocks - 1)),
                     lambda x: F.bit_count(x) == blocks // 2)
    rows = m.withColumn("split", F.explode(masks)).withColumn(
        "inside", F.getbit("split", "__b") == 1)
    halves = rows.groupBy(*by, "split", key).agg(*[
        F.sum(F.when(F.col("inside") if side == "i" else ~F.col("inside"), F.col(c)))
         .alias(f"{c}{side}") for side in "io" for c in "nsq"])
    for side in "io":
        n, s, q = F.col(f"n{side}"), F.col(f"s{side}"), F.col(f"q{side}")
        var = (q - s * s / n) / F.nullif(n - 1, F.lit(0))
        halves = halves.withColumn(f"sr_{side}", F.round(
            s / n / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)), 10))
    cell = Window.partitionBy(*by, "split")
    rank = F.rank().over(cell.orderBy("sr_o"))
    ranked = halves.withColumns({"rank": rank, "size": F.count(F.lit(1)).over(cell)})
    best = ranked.groupBy(*by, "split").agg(
        F.max_by(F.col("rank") / (F.col("size") + 1.0),
                 F.struct("sr_i", key)).alias("omega"))
    logit = F.ln(F.col("omega") / (1 - F.col("omega")))
    return best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.avg((logit <= 0).cast("double")).alias("pbo"))


def gate_verdict(stats: DataFrame, ratio_min: float = GATE_RATIO_MIN,
                 pbo_max: float = GATE_PBO_MAX) -> DataFrame:
    """Passes only with both statistics on the right side; the reasons say why not."""
    ratio_ok = F.coalesce(F.col("ratio") > ratio_min, F.lit(False))
    pbo_ok = F.coalesce(F.col("pbo") < pbo_max, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~ratio_ok, F.format_string(f"deflated_sharpe_ratio %.4f <= {ratio_min}", "ratio")),
        F.when(~pbo_ok, F.format_string(f"pbo %.4f >= {pbo_max}", "pbo"))))
    return stats.withColumns({"passes": ratio_ok & pbo_ok, "reasons": reasons})


def gated_trials(pnls: DataFrame, trials: int, blocks: int = 10) -> DataFrame:
    """Gate verdict of every (variant, horizon) of (panel_id, variant, horizon, session, sess_no, pnl) rows.

    The deflated ratio counts all ``trials``; the overfitting probability of a horizon is that of choosing
    among its variants. A variant is promoted if each of its horizons passes.
    """
    key = ["panel_id", "variant", "horizon"]
    stats = deflated_sharpe(pnls, key, trials)
    pbo = overfit_probability(pnls, ("panel_id", "horizon"), "variant", blocks=blocks)
    span = pnls.groupBy(*key).agg(F.min("session").alias("first_oos"), F.max("session").alias("last_oos"))
    out = gate_verdict(stats.join(pbo, ["panel_id", "horizon"], "left").join(span, key))
    every = Window.partitionBy("panel_id", "variant")
    return out.withColumns({"promoted": F.min("passes").over(every), "n_trials": F.lit(trials)})
