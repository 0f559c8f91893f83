"""Merges, as-of joins, calendars: hand values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import calendar as tc
from tidepanel.operators import asof
from tidepanel.operators import histories as hs
from tidepanel.operators import merge as mg
from tidepanel.operators import sessions as ss
from tidepanel.sources import landing as ld

D = dt.date


def days(n, start=D(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_merge_fresh_wins(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 99.0), (3, 3.0)], "k int, v double")
    got = mg.merge_latest(old, new, ["k"]).orderBy("k").collect()
    assert [r.v for r in got] == [1.0, 99.0, 3.0]


def test_rebase_only_before_the_seam(spark):
    ddl = "panel_id string, instrument string, session date, close double, factor double, volume double"
    d = days(3)
    old = spark.createDataFrame([("p", "A", d[0], 10.0, 0.5, 8.0), ("p", "A", d[1], 11.0, 0.5, 8.0)],
                                ddl)
    new = spark.createDataFrame([("p", "A", d[1], 22.0, 1.0, 4.0), ("p", "A", d[2], 24.0, 1.0, 4.0)],
                                ddl)
    got = mg.merge_bars(old, new).orderBy("session").collect()
    assert [(r.close, r.factor, r.volume) for r in got] == [
        (20.0, 1.0, 4.0), (22.0, 1.0, 4.0), (24.0, 1.0, 4.0)]


def test_hot_key_merge_keeps_one_row(spark):
    """A third of all rows under one key still resolves by partial aggregation."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("v"))
    one = mg.keep_one(df, ["k"], ["v"])
    assert one.count() == df.select("k").distinct().count()
    assert one.filter("k = 0").first().v == 29997
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()


def test_asof_backward_visible_from_the_effective_date(spark):
    cal = spark.createDataFrame([("p", d) for d in days(10)], "panel_id string, session date")
    right = spark.createDataFrame([("p", days(10)[2], 0.9), ("p", days(10)[7], 0.1)],
                                  "panel_id string, effective_date date, x double")
    for fn in (asof.asof_backward, asof.bucketed_asof):
        got = fn(cal, right, ["panel_id"], "session", "effective_date", ["x"])
        xs = [r.x for r in got.orderBy("session").collect()]
        assert xs == [None, None, 0.9, 0.9, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1]


def test_bucketed_asof_equals_plain(spark):
    left = spark.range(500).select(F.lit("p").alias("k"), (F.col("id") * 7 % 501).alias("n"))
    left = left.withColumn("t", F.timestamp_seconds(F.col("n") * 3600))
    right = spark.range(40).select(F.lit("p").alias("k"),
                                   F.timestamp_seconds(F.col("id") * 40000).alias("t"),
                                   F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("x"))
    a = asof.asof_backward(left, right, ["k"], "t", "t", ["x"]).orderBy("n").collect()
    b = asof.bucketed_asof(left, right, ["k"], "t", "t", ["x"]).orderBy("n").collect()
    assert a == b


def test_asof_forward(spark):
    left = spark.createDataFrame([("p", d) for d in days(4)], "panel_id string, e date")
    right = spark.createDataFrame([("p", days(4)[1], 1), ("p", days(4)[3], 3)],
                                  "panel_id string, s date, x int")
    got = asof.asof_forward(left, right, ["panel_id"], "e", "s", ["x"]).orderBy("e").collect()
    assert [r.x for r in got] == [1, 1, 3, 3]


def test_exact_then_fill_loses_off_calendar_updates(spark):
    d = days(5)
    cal = spark.createDataFrame([("p", x, i) for i, x in enumerate([d[0], d[2], d[4]])],
                                "panel_id string, session date, sess_no int")
    right = spark.createDataFrame([("p", d[0], 1.0), ("p", d[3], 9.0)],
                                  "panel_id string, u date, x double")
    fill = asof.exact_then_fill(cal, right, ["panel_id"], "session", "u", ["x"])
    assert [r.x for r in fill.orderBy("session").collect()] == [1.0, 1.0, 1.0]
    one = asof.exact_then_fill(cal, right, ["panel_id"], "session", "u", ["x"], limit=1)
    assert [r.x for r in one.orderBy("session").collect()] == [1.0, 1.0, None]
    real = asof.asof_backward(cal, right, ["panel_id"], "session", "u", ["x"])
    assert [r.x for r in real.orderBy("session").collect()] == [1.0, 1.0, 9.0]


def test_release_lag_and_sign(spark):
    raw = spark.createDataFrame(
        [("097741", "2024-01-02", "100", "40", "1000"), ("13874A", "2024-01-02", "100", "40", "1000"),
         ("999999", "2024-01-02", "1", "1", "1"), ("13874A", "2024-01-09", "x", "40", "1000")],
        "code string, report_date string, nc_long string, nc_short string, oi string")
    got = {r.asset: r.net_pct for r in ld.normalise_positions(raw, ld.contract_table(spark)).collect()}
    assert got == {"USDJPY": -0.06, "SPY": 0.06}
    hist = spark.createDataFrame([("p", "SPY", D(2024, 1, 2), 0.06)],
                                 "panel_id string, asset string, report_date date, net_pct double")
    assert hs.weekly_features(hist).first().effective_date == D(2024, 1, 8)


@pytest.mark.parametrize("day,n,want", [
    (D(2024, 1, 5), 1, D(2024, 1, 8)), (D(2024, 1, 6), 1, D(2024, 1, 8)),
    (D(2024, 1, 7), 2, D(2024, 1, 9)), (D(2024, 1, 3), 2, D(2024, 1, 5)),
    (D(2024, 1, 4), 2, D(2024, 1, 8))])
def test_business_shift(spark, day, n, want):
    df = spark.createDataFrame([(day,)], "d date")
    assert df.select(tc.shift_business_days("d", n).alias("x")).first().x == want


def test_first_fridays(spark):
    df = spark.createDataFrame([(D(2026, m, 15),) for m in range(1, 7)], "d date")
    got = [r.x for r in df.select(tc.first_friday("d").alias("x")).collect()]
    assert all(x.weekday() == 4 and x.day <= 7 for x in got) and len(set(got)) == 6


def test_next_meeting(spark):
    df = spark.createDataFrame([(D(2026, 1, 28),), (D(2026, 1, 27),), (D(2027, 1, 1),)], "d date")
    assert [r.x for r in df.select(tc.days_to_next_meeting("d").alias("x")).collect()] == [0, 1, None]


def test_balance_eras_and_null_text(spark):
    rows = [("p", D(2010, 1, 4), "Federal Reserve Account", "null", "163428"),
            ("p", D(2022, 4, 14), "Treasury General Account (TGA)", "1", "542176"),
            ("p", D(2026, 8, 26), "Treasury General Account (TGA) Closing Balance", "971343", "null"),
            ("p", D(2026, 8, 26), "Treasury General Account (TGA)", "null", "5"),
            ("p", D(2026, 8, 26), "Something else", "1", "1")]
    df = spark.createDataFrame(rows, "panel_id string, record_date date, account_type string, "
                                     "open_today_bal string, close_today_bal string")
    got = [r.value for r in ld.resolve_balances(df).orderBy("record_date").collect()]
    assert got == [163428.0, 542176.0, 971343.0]


def test_cross_check(spark):
    a = spark.createDataFrame([("p", d, x) for d, x in zip(days(3), (1000.0, 3000.0, 9.0))],
                              "panel_id string, d date, v double")
    b = spark.createDataFrame([("p", d, x) for d, x in zip(days(2), (1500.0, 1000.0))],
                              "panel_id string, d date, v double")
    r = mg.cross_check(a, b, "d", "v", ["panel_id"], 1000.0).first()
    assert (r.n, r.max_abs_diff, r.worst_date) == (2, 2.0, days(3)[1])


def test_net_liquidity_units_and_lag(spark):
    wed = [D(2024, 1, 3) + dt.timedelta(days=7 * i) for i in range(20)]
    rows = [("p", s, d, v) for d in wed for s, v in
            (("WALCL", 7e6), ("WDTGAL", 7e5), ("RRPONTSYD", 500.0))]
    lv = spark.createDataFrame(rows, "panel_id string, series_id string, obs_date date, value double")
    out = hs.net_liquidity(lv).orderBy("day").collect()
    assert out[-1].netliq == 5800.0
    assert out[0].day == D(2024, 1, 5)           # Wednesday + 2 business days


def test_fund_flows(spark):
    d = days(4)
    rows = [("p", "SPY", d[0], 500e6, 700.0, None, None), ("p", "SPY", d[1], 1001e6, 740.0, "ssga", 1.0),
            ("p", "SPY", d[2], 1000e6, 745.0, "ssga", 1.0),
            ("p", "SPY", d[3], 999e6, 750.0, "ssga", 1e12)]
    df = spark.createDataFrame(rows, "panel_id string, ticker string, date date, shares double, "
                                     "price double, source string, noise_usd double")
    r = {x.ticker: x for x in hs.fund_flows(df, {"SPY": "a", "QQQ": "b"}).collect()}
    assert r["SPY"].flow_1d == -1e6 * 750 and r["SPY"].flow_5d is None
    assert r["SPY"].note == "flow_1d below this source's resolution"
    assert r["SPY"].snapshots == 3 and r["SPY"].legacy_rows_ignored == 1
    assert r["QQQ"].note == "no issuer snapshot yet"


def test_densify(spark):
    d = days(4)
    bars = spark.createDataFrame([("p", "A", d[0], 1.0), ("p", "A", d[1], 2.0), ("p", "A", d[2], 2.5),
                                  ("p", "A", d[3], 3.0), ("p", "B", d[1], 5.0), ("p", "B", d[3], 6.0)],
                                 "panel_id string, instrument string, session date, close double")
    cal = ss.session_calendar(bars)
    assert ss.densify_full(bars, cal).count() == 8
    b = ss.densify_between(bars, cal).filter("instrument = 'B'").orderBy("session").collect()
    assert [r.close for r in b] == [5.0, None, 6.0]


def test_torn_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"as_of": "2024-01-01", "fired": ["A"]}\n\n{"as_of": "2024-\n'
                 '{"as_of": "2024-01-02", "fired": []}\n')
    assert ld.read_log(spark, str(p)).count() == 2
