"""Scalar rules: labels, verdicts, normal distribution, option estimates."""

from __future__ import annotations

from math import e, pi, sqrt
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.frames import col
from tidepanel.universe import CROWDED, STORY_BROKEN, UNCROWDED

BULL, BEAR, NEUTRAL, NO_DATA = "bullish", "bearish", "neutral", "NO_DATA"


def truthy(c: Column) -> Column:
    """A comparison with a missing value is False, as a position or a rule."""
    return F.coalesce(c, F.lit(False))


def verdict(bull: Column, bear: Column) -> Column:
    bull, bear = truthy(bull), truthy(bear)
    return (F.when(bull & ~bear, BULL).when(bear & ~bull, BEAR).otherwise(NEUTRAL))


def story_state(corr: Column | str, threshold: Column | str) -> Column:
    signed = col(corr) * F.signum(col(threshold))
    return (F.when(col(corr).isNull(), NO_DATA)
             .when(signed >= F.abs(col(threshold)), "HOLDING")
             .when(signed <= -STORY_BROKEN, "BROKEN")
             .otherwise("WEAK"))


def crowd_side(index: Column | str) -> Column:
    return (F.when(col(index) >= CROWDED, "crowded long")
             .when(col(index) <= UNCROWDED, "crowded short")
             .otherwise("neutral"))


def band(pct: Column | str) -> Column:
    return (F.when(col(pct) < 0.25, "cheap").when(col(pct) > 0.75, "rich")
             .when(col(pct).isNotNull(), "middling"))


def finite(x: Column | str) -> Column:
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parse_number(x: Column | str) -> Column:
    """Text to number where blank, '.', 'null' and 'none' all mean missing."""
    text = F.lower(F.trim(col(x)))
    return F.when(~text.isin("", ".", "null", "none"), F.trim(col(x)).try_cast("double"))


def norm_pdf(x: Column | str) -> Column:
    return F.exp(-col(x) * col(x) / 2) / F.lit(sqrt(2 * pi))


def norm_cdf(x: Column | str, terms: int = 150) -> Column:
    """Phi(x) = 1/2 + phi(x) * sum x^(2k+1)/(2k+1)!!, folded inside the JVM."""
    c = col(x).cast("double")
    z = F.greatest(F.least(c, F.lit(8.0)), F.lit(-8.0))
    seed = F.struct(z.alias("term"), z.alias("total"))

    def step(acc, k):
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.sequence(F.lit(1), F.lit(terms)).cast("array<double>")
    total = F.aggregate(steps, seed, step, lambda acc: acc["total"])
    return F.when(c.isNotNull(),
                  F.greatest(F.least(F.lit(0.5) + norm_pdf(z) * total, F.lit(1.0)), F.lit(0.0)))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def expected_max_z(trials: int) -> float:
    """Expected maximum of ``trials`` standard normals (Bailey & Lopez de Prado)."""
    if trials <= 1:
        return 0.0
    gamma = 0.5772156649015329
    return ((1 - gamma) * norm_ppf(1 - 1 / trials)
            + gamma * norm_ppf(1 - 1 / (trials * e)))


RATE = 0.04


def put_price(spot, strike, sigma, years, rate: float = RATE) -> Column:
    s, k, v, t = col(spot), col(strike), col(sigma), col(years)
    d1 = (F.ln(s / k) + (rate + v * v / 2) * t) / (v * F.sqrt(t))
    d2 = d1 - v * F.sqrt(t)
    live = k * F.exp(-rate * t) * norm_cdf(-d2) - s * norm_cdf(-d1)
    return F.when((v <= 0) | (t <= 0), F.greatest(k - s, F.lit(0.0))).otherwise(live)


def put_delta(spot, strike, sigma, years, rate: float = RATE) -> Column:
    s, k, v, t = col(spot), col(strike), col(sigma), col(years)
    return norm_cdf((F.ln(s / k) + (rate + v * v / 2) * t) / (v * F.sqrt(t))) - 1


def straddle_price(spot, strike, sigma, years, rate: float = RATE) -> Column:
    """Put plus the call that parity implies."""
    put = put_price(spot, strike, sigma, years, rate)
    return put * 2 + col(spot) - col(strike) * F.exp(-rate * col(years))


def strike_for_delta(spot, sigma, years, target: float = -0.30, rate: float = RATE) -> Column:
    """Closed-form inverse of put_delta, held to [0.5, 1.1] x spot, whole strikes."""
    s, v, t = col(spot), col(sigma), col(years)
    d1 = norm_ppf(1 + target)
    k = s * F.exp((rate + v * v / 2) * t - F.lit(d1) * v * F.sqrt(t))
    return F.when(k.isNotNull(), F.bround(F.least(F.greatest(k, s * 0.5), s * 1.1), 0))
