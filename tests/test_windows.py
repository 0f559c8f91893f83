"""Rolling, smoothing and percentile operators against pandas on seeded series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.functions import scalars as sc
from tidepanel.operators import smoothing as sm

N = 400


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, N)))
    x[rng.choice(np.arange(1, N), 60, replace=False)] = np.nan
    return pd.DataFrame({"panel_id": "p", "instrument": "A", "sess_no": range(N),
                         "session": pd.date_range("2020-01-01", periods=N).date, "x": x})


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(r.panel_id, r.instrument, r.sess_no, r.session, None if np.isnan(r.x) else float(r.x))
            for r in series.itertuples()]
    return spark.createDataFrame(rows, "panel_id string, instrument string, sess_no int, "
                                       "session date, x double")


def values(df, column):
    out = df.orderBy("sess_no").select(column).toPandas()[column]
    return out.astype(float).to_numpy()


def same(a, b):
    np.testing.assert_allclose(a, np.asarray(b, dtype=float), rtol=1e-9, atol=1e-9)


def test_padded_return(frame, series):
    got = values(fr.with_padded_return(frame, "x", "r"), "r")
    same(got, series.x.ffill().pct_change(fill_method=None))


@pytest.mark.parametrize("name", ["mean", "std", "median", "skew", "max"])
def test_rolling_matches_pandas(frame, series, name):
    filled = frame.withColumn("f", fr.last_valid("x"))
    rule = getattr(fr, f"rolling_{name}")
    got = values(filled.withColumn("y", rule("f", 20)), "y")
    want = getattr(series.x.ffill().rolling(20), name)()
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_rank_percentile(frame, series):
    got = values(frame.withColumn("f", fr.last_valid("x")).withColumn(
        "y", fr.rank_percentile("f", 52, least=26)), "y")
    same(got, series.x.ffill().rolling(52, min_periods=26).rank(pct=True))


def test_inclusive_percentile_counts_present_rows_only(frame, series):
    got = values(frame.withColumn("y", fr.inclusive_percentile("x", 252)), "y")
    s = series.x.dropna()
    want = s.rolling(252, min_periods=60).apply(lambda w: (w <= w[-1]).mean(), raw=True)
    same(got, want.reindex(series.index))


def test_bounded_fill(frame, series):
    got = values(frame.withColumn("y", fr.bounded_fill("x", 1, "sess_no")), "y")
    same(got, series.x.ffill(limit=1))


@pytest.mark.parametrize("span", [3, 9, 50, 200])
def test_ewm_ages_over_gaps(frame, series, span):
    got = values(sm.ema(frame, "x", {"y": span}), "y")
    same(got, series.x.ewm(span=span, adjust=False).mean())


def test_ewm_without_gaps(frame, series):
    got = values(sm.ema(frame, "x", {"y": 21, "z": 5}, ignore_gaps=True, fill=False), "y")
    same(got, series.x.dropna().ewm(span=21, adjust=False).mean().reindex(series.index))


def test_ewm_seed_after_long_gap(spark):
    xs = [None] * 300 + [5.0] + [None] * 600 + [7.0, 9.0]
    rows = [("p", "A", i, x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "panel_id string, instrument string, sess_no int, x double")
    got = values(sm.ema(df, "x", {"y": 3}), "y")
    same(got, pd.Series(xs, dtype=float).ewm(span=3, adjust=False).mean())


def test_rsi_edges(spark):
    rows = [("p", n, i, float(x)) for n, f in (("up", 1.0), ("down", -1.0), ("flat", 0.0))
            for i, x in enumerate(100 + f * np.arange(40.0))]
    df = spark.createDataFrame(rows, "panel_id string, instrument string, sess_no int, x double")
    last = sm.rsi(df, "x").filter("sess_no = 39").select("instrument", "rsi").toPandas()
    assert dict(zip(last.instrument, last.rsi)) == {"up": 100.0, "down": 0.0, "flat": 50.0}


def test_chunked_windows_agree(frame):
    whole = values(frame.withColumn("y", fr.rolling_mean("x", 20, least=5)), "y")
    by = (*fr.SERIES, "chunk")
    parts = fr.split_chunks(frame, "sess_no", 64, 20).withColumn(
        "y", fr.rolling_mean("x", 20, by, least=5)).filter(~F.col("is_lead"))
    same(values(parts, "y"), whole)


def test_future_does_not_leak(frame):
    """Changing the last sessions must not change any earlier value."""
    bent = frame.withColumn("x", F.when(F.col("sess_no") >= 350, F.col("x") * 3)
                            .otherwise(F.col("x")))

    def build(df):
        df = sm.ema(fr.with_padded_return(df, "x", "r"), "x", {"e": 50})
        return df.withColumns({"z": fr.rolling_zscore("r", 20), "p": fr.inclusive_percentile("x"),
                               "b": fr.bounded_fill("x", 3, "sess_no")})
    for c in ("r", "e", "z", "p", "b"):
        same(values(build(frame), c)[:350], values(build(bent), c)[:350])


def test_normal_cdf(spark):
    xs = [-9.0, -3.0, -1.2133, 0.0, 0.5, 2.0, 6.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(
        sc.norm_cdf("x").alias("p")).toPandas().p
    from statistics import NormalDist
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], atol=1e-12)


def test_option_estimates(spark):
    df = spark.createDataFrame([(500.0, 0.2, 35 / 365)], "s double, v double, t double")
    row = df.withColumn("k", sc.strike_for_delta("s", "v", "t")).select(
        "k", sc.put_delta("s", "k", "v", "t").alias("d"),
        sc.put_price("s", "k", "v", "t").alias("p"),
        sc.straddle_price("s", F.lit(500.0), "v", "t").alias("x")).first()
    assert abs(row.d + 0.30) < 0.02 and 0 < row.p < 500
    assert row.x > 0
