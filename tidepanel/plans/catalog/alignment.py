"""As-of, exact-then-fill, forward-entry and set queries; side-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.operators import asof
from tidepanel.operators import histories as hs
from tidepanel.operators import sections as xs
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import Views
from tidepanel.sources import landing as ld
from tidepanel.universe import FLOW_FUNDS


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("w_positioning_features", sql("feats", """
SELECT asset, report_date, effective_date, round(net_pct, 6) AS net_pct, round(z156, 6) AS z156,
  round(idx52, 6) AS idx52, round(chg4w, 6) AS chg4w FROM feats"""))
def positioning_features(v: Views):
    return hs.weekly_features(v.positions()).select(
        "asset", "report_date", "effective_date", r("net_pct"), r("z156"), r("idx52"), r("chg4w"))


@query("j05_asof_backward", sql("posday", """
SELECT session, asset, round(z156, 6) AS z156, round(idx52, 6) AS idx52,
  round(chg4w, 6) AS chg4w FROM posday"""))
def j05(v: Views):
    daily = hs.daily_positions(hs.weekly_features(v.positions()), v.calendar())
    return daily.select("session", "asset", r("z156"), r("idx52"), r("chg4w"))


@query("j05_asof_bucketed", sql("hourly", """
SELECT h.series_id, h.ts_ms, h.rate, p.rate AS price FROM
 (SELECT * FROM hourly WHERE series_id <> 'view') h
ASOF LEFT JOIN (SELECT ts, max(rate) AS rate FROM hourly WHERE series_id = 'view' GROUP BY 1) p
  ON h.ts >= p.ts"""))
def j05_bucketed(v: Views):
    h = v.hourly()
    quotes = h.filter("series_id = 'view'").groupBy("panel_id", "ts").agg(
        F.max("rate").alias("price"))
    left = h.filter("series_id <> 'view'").select("panel_id", "series_id", "ts", "ts_ms", "rate")
    out = asof.bucketed_asof(left, quotes, ["panel_id"], "ts", "ts", ["price"], "day")
    return out.select("series_id", "ts_ms", "rate", "price")


@query("j06_instrument_asof", sql("bars posday", """
SELECT b.instrument, b.session, round(p.z156, 6) AS cot_z156, round(p.idx52, 6) AS cot_idx52
FROM bars b LEFT JOIN posday p ON p.asset = b.instrument AND p.session = b.session"""))
def j06(v: Views):
    feats = hs.weekly_features(v.positions()).withColumnRenamed("asset", "instrument")
    bars = v.bars().select("panel_id", "instrument", "session")
    out = asof.asof_backward(bars, feats, ["panel_id", "instrument"], "session",
                             "effective_date", ["z156", "idx52"])
    return out.select("instrument", "session", F.round("z156", 6).alias("cot_z156"),
                      F.round("idx52", 6).alias("cot_idx52"))


_FILL = """
SELECT session, instrument, CASE WHEN sess_no - seen <= {n} THEN ff END AS filled FROM (
 SELECT *, last_value(close IGNORE NULLS) OVER w AS ff,
   max(CASE WHEN close IS NOT NULL THEN sess_no END) OVER w AS seen
 FROM grid WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS UNBOUNDED PRECEDING))"""


@query("j07_exact_then_fill_3", sql("grid", _FILL.format(n=3)))
def j07(v: Views):
    bars = v.bars().select("panel_id", "instrument", "session", F.col("close").alias("filled"))
    grid = v.panel().select("panel_id", "instrument", "session", "sess_no")
    out = asof.exact_then_fill(grid, bars, ["panel_id", "instrument"], "session", "session",
                               ["filled"], limit=3)
    return out.select("session", "instrument", "filled")


@query("j07_exact_then_fill", sql("cal feats", """
SELECT session, asset, round(last_value(idx52 IGNORE NULLS) OVER (PARTITION BY asset
  ORDER BY session ROWS UNBOUNDED PRECEDING), 6) AS idx52 FROM (
 SELECT c.session, a.asset, f.idx52 FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM feats) a
 LEFT JOIN feats f ON f.asset = a.asset AND f.effective_date = c.session)"""))
def j07_unbounded(v: Views):
    feats = hs.weekly_features(v.positions())
    assets = feats.select("panel_id", "asset").distinct()
    grid = v.calendar().join(assets, "panel_id")
    out = asof.exact_then_fill(grid, feats, ["panel_id", "asset"], "session", "effective_date",
                               ["idx52"])
    return out.select("session", "asset", r("idx52"))


@query("j08_context_join", sql("bars panel", """
SELECT b.instrument, b.session, b.close, round(s.mom, 6) AS ctx_mom20 FROM bars b LEFT JOIN (
 SELECT session, ff / lag(ff, 20) OVER (ORDER BY session) - 1 AS mom FROM panel
 WHERE instrument = 'SPY') s USING (session)"""))
def j08(v: Views):
    ctx = fr.with_padded_return(v.panel().filter("instrument = 'SPY'"), "close", "m", 20)
    ctx = ctx.select("panel_id", "session", F.round("m", 6).alias("ctx_mom20"))
    # one row per session: the context side grows with the calendar, not with the bars
    return v.bars().join(ctx, ["panel_id", "session"], "left").select(
        "instrument", "session", "close", "ctx_mom20")


_KNOWN = """
SELECT series_id, known, arg_max(value, obs_date) AS value FROM (
 SELECT series_id, obs_date, value / CASE WHEN series_id = 'RRPONTSYD' THEN 1 ELSE 1000 END
   AS value, (SELECT d FROM (SELECT obs_date + i::INT AS d, row_number() OVER (ORDER BY i) AS k
     FROM range(1, 10) r(i) WHERE isodow(obs_date + i::INT) <= 5)
     WHERE k = CASE WHEN series_id IN ('WALCL', 'WDTGAL') THEN 2 ELSE 1 END) AS known
 FROM (SELECT series_id, obs_date, value FROM levels UNION ALL
       SELECT 'DTS', record_date, value FROM tga)) GROUP BY 1, 2"""
_LIQ = dict(
    known=_KNOWN,
    days="""SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(known),
      max(known), INTERVAL 1 DAY)) AS d FROM known) WHERE isodow(CAST(d AS DATE)) <= 5""",
    wide="""SELECT day, """ + ", ".join(
        f"last_value({s}x IGNORE NULLS) OVER w AS {s}" for s in
        ("WALCL", "WDTGAL", "RRPONTSYD", "DTS")) + """ FROM (SELECT d.day, """ + ", ".join(
        f"max(CASE WHEN series_id = '{s}' THEN value END) AS {s}x" for s in
        ("WALCL", "WDTGAL", "RRPONTSYD", "DTS")) + """
      FROM days d LEFT JOIN known k ON k.known = d.day GROUP BY 1)
      WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    base="""SELECT day, WALCL AS walcl, coalesce(RRPONTSYD, 0) AS rrp,
      coalesce(DTS, WDTGAL) AS tga,
      WALCL - coalesce(DTS, WDTGAL) - coalesce(RRPONTSYD, 0) AS netliq FROM wide""",
    chg="""SELECT *, netliq - lag(netliq, 20) OVER (ORDER BY day) AS c4,
      netliq - lag(netliq, 65) OVER (ORDER BY day) AS netliq_chg13w FROM base""",
    liq="""SELECT day, walcl, tga, rrp, netliq, netliq_chg13w,
      CASE WHEN count(c4) OVER w >= 756 THEN (c4 - avg(c4) OVER w)
        / nullif(stddev_samp(c4) OVER w, 0) END AS netliq_chg4w_z,
      CASE WHEN count(netliq_chg13w) OVER w >= 756 THEN (netliq_chg13w
        - avg(netliq_chg13w) OVER w) / nullif(stddev_samp(netliq_chg13w) OVER w, 0) END
        AS netliq_chg13w_z
      FROM chg WINDOW w AS (ORDER BY day ROWS 755 PRECEDING)""")


@query("j10_net_liquidity", sql("levels tga", """
SELECT day, round(walcl, 6) AS walcl, round(tga, 6) AS tga, round(rrp, 6) AS rrp,
  round(netliq, 6) AS netliq, round(netliq_chg13w, 6) AS netliq_chg13w,
  round(netliq_chg4w_z, 6) AS netliq_chg4w_z, round(netliq_chg13w_z, 6) AS netliq_chg13w_z
FROM liq WHERE netliq IS NOT NULL""", **_LIQ))
def j10(v: Views):
    out = hs.net_liquidity(v.levels(), ld.resolve_balances(v.balances()))
    return out.select("day", *[r(c) for c in ("walcl", "tga", "rrp", "netliq",
                                                 "netliq_chg13w")],
                      r("netliq_chg4w_z"), r("netliq_chg13w_z"))


_HORIZONS = {"1w": 5, "4w": 20, "13w": 65}


@query("j13_entry_prices", sql("bars feats cal", """
SELECT f.asset, f.effective_date, p.session AS entry_date, p.close AS entry,
  round(p.f1, 6) AS fwd_1w, round(p.f4, 6) AS fwd_4w, round(p.f13, 6) AS fwd_13w,
  round(p.prev, 6) AS prev_1w
FROM feats f JOIN (SELECT f.effective_date AS e, min(c.session) AS s FROM
   (SELECT DISTINCT effective_date FROM feats) f JOIN cal c ON c.session >= f.effective_date
   GROUP BY 1) n ON n.e = f.effective_date
JOIN (SELECT instrument, session, close, lead(close, 5) OVER w / close - 1 AS f1,
        lead(close, 20) OVER w / close - 1 AS f4, lead(close, 65) OVER w / close - 1 AS f13,
        close / lag(close, 5) OVER w - 1 AS prev FROM bars
      WINDOW w AS (PARTITION BY instrument ORDER BY session)) p
  ON p.instrument = f.asset AND p.session = n.s"""))
def j13(v: Views):
    feats = hs.weekly_features(v.positions()).withColumnRenamed("asset", "instrument").select(
        "panel_id", "instrument", "effective_date")
    out = asof.entry_prices(feats, v.bars(), v.calendar(), _HORIZONS)
    return out.select(F.col("instrument").alias("asset"), "effective_date", "entry_date",
                      "entry", r("fwd_1w"), r("fwd_4w"), r("fwd_13w"), r("prev_1w"))


@query("j14_common_dates", sql("bars", """
SELECT a.instrument, a.session, round(a.close / lag(a.close, 63) OVER w
  - s.close / lag(s.close, 63) OVER w, 6) AS rs_3m
FROM bars a JOIN bars s ON s.instrument = 'SPY' AND s.session = a.session
WHERE a.instrument <> 'SPY' WINDOW w AS (PARTITION BY a.instrument ORDER BY a.session)"""))
def j14(v: Views):
    b = v.bars()
    bench = b.filter("instrument = 'SPY'").select("panel_id", "session",
                                                  F.col("close").alias("bench"))
    both = b.filter("instrument <> 'SPY'").join(bench, ["panel_id", "session"])
    spread = fr.plain_return("close", 63) - fr.plain_return("bench", 63)
    return both.select("instrument", "session", F.round(spread, 6).alias("rs_3m"))


@query("j15_event_split", sql("bars", """
SELECT instrument, session IN (SELECT max(session) FROM bars GROUP BY year(session),
  month(session)) AS is_event, count(*) AS n, round(avg(close), 6) AS mean_close
FROM bars GROUP BY 1, 2"""))
def j15(v: Views):
    b = v.bars()
    events = b.groupBy(F.year("session"), F.month("session")).agg(
        F.max("session").alias("session")).select("session")
    inside = b.join(events, "session", "left_semi").withColumn("is_event", F.lit(True))
    outside = b.join(events, "session", "left_anti").withColumn("is_event", F.lit(False))
    return inside.unionByName(outside).groupBy("instrument", "is_event").agg(
        F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("mean_close"))


@query("j20_row_asof", sql("feats", """
SELECT asset, effective_date, round(net_pct, 6) AS net_pct FROM (SELECT *, row_number() OVER (
  PARTITION BY asset ORDER BY (effective_date <= DATE '1998-06-01') DESC, effective_date DESC)
  AS rn FROM feats) WHERE rn = 1"""))
def j20(v: Views):
    feats = hs.weekly_features(v.positions())
    out = asof.row_asof(feats, F.lit("1998-06-01").cast("date"), ["asset"], "effective_date")
    return out.select("asset", "effective_date", r("net_pct"))


@query("w21_latest_per_key", sql("feats", """
SELECT asset, effective_date, round(idx52, 6) AS idx52 FROM feats
QUALIFY row_number() OVER (PARTITION BY asset ORDER BY effective_date DESC) = 1"""))
def w21(v: Views):
    out = asof.latest_per_key(hs.weekly_features(v.positions()), ["asset"], ["effective_date"])
    return out.select("asset", "effective_date", r("idx52"))


_RATES = dict(
    day="SELECT series_id, date, sum(rate) AS f FROM rates GROUP BY 1, 2",
    lists="""SELECT *, list(f) OVER (PARTITION BY series_id ORDER BY date ROWS 363 PRECEDING)
      AS l FROM day""",
    rf="""SELECT series_id, date, lag(f) OVER w AS funding_1d, lag(z) OVER w AS z156,
      lag(x) OVER w AS idx52w FROM (SELECT series_id, date, f,
        CASE WHEN count(f) OVER w >= 60 THEN (f - avg(f) OVER w)
          / nullif(stddev_samp(f) OVER w, 0) END AS z,
        CASE WHEN len(l) >= 120 THEN (len(list_filter(l, lambda e: e < f))
          + (len(list_filter(l, lambda e: e = f)) + 1) / 2.0) / len(l) END AS x
        FROM lists WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 155 PRECEDING))
      WINDOW w AS (PARTITION BY series_id ORDER BY date)""")


@query("a01_daily_rate_features", sql("rates", """
SELECT series_id, date, round(funding_1d, 6) AS funding_1d, round(z156, 6) AS z156,
  round(idx52w, 6) AS idx52w, round(funding_1d * 36500, 4) AS funding_1d_annualized_pct
FROM rf""", **_RATES))
def a01(v: Views):
    return hs.daily_rate_features(v.daily_rates()).select(
        "series_id", "date", r("funding_1d"), r("z156"), r("idx52w"),
        r("funding_1d_annualized_pct", 4))


@query("a01_daily_sums", sql("hourly", """
SELECT series_id, date, round(sum(rate), 6) AS funding_1d FROM hourly GROUP BY 1, 2"""))
def a01_sums(v: Views):
    return v.hourly().groupBy("series_id", "date").agg(
        F.round(F.sum("rate"), 6).alias("funding_1d"))


_FLOWS = dict(
    own="""SELECT *, (shares - lag(shares, 1) OVER w) * price AS flow_1d,
      (shares - lag(shares, 5) OVER w) * price AS flow_5d,
      (shares - lag(shares, 20) OVER w) * price AS flow_20d,
      row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS recent
      FROM snapshots WHERE source IN ('ssga', 'ishares')
      WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    funds="SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', '{n}')" for t, n in FLOW_FUNDS.items()) + ") t(ticker, label)",
    stats="""SELECT ticker, count(*) AS snapshots, avg(flow_1d) FILTER (recent <= 60) AS m,
      stddev_samp(flow_1d) FILTER (recent <= 60) AS s,
      count(flow_1d) FILTER (recent <= 60) AS n FROM own GROUP BY 1""",
    flows="""SELECT f.ticker, f.label, o.price, o.shares, coalesce(s.snapshots, 0) AS snapshots,
      o.flow_1d, o.flow_5d, o.flow_20d, o.source, o.noise_usd,
      CASE WHEN n >= 10 AND s > 0 THEN round_even((o.flow_1d - m) / s, 2) END AS z,
      (SELECT count(*) FROM snapshots WHERE source IS NULL) AS legacy_rows_ignored,
      CASE WHEN s.snapshots IS NULL THEN 'no issuer snapshot yet'
        WHEN s.snapshots < 2 THEN 'accumulating'
        WHEN abs(o.flow_1d) < o.noise_usd THEN 'flow_1d below this source''s resolution' END
        AS note
      FROM funds f LEFT JOIN stats s ON s.ticker = f.ticker
      LEFT JOIN own o ON o.ticker = f.ticker AND o.recent = 1""")


@query("w23_fund_flows", sql("snapshots", """
SELECT ticker, label, price, shares, snapshots, round(flow_1d, 2) AS flow_1d,
  round(flow_5d, 2) AS flow_5d, round(flow_20d, 2) AS flow_20d, z, source,
  legacy_rows_ignored, note FROM flows""", **_FLOWS))
def w23(v: Views):
    return hs.fund_flows(v.snapshots(), FLOW_FUNDS).select(
        "ticker", "label", "price", "shares", "snapshots", r("flow_1d", 2), r("flow_5d", 2),
        r("flow_20d", 2), "z", "source", "legacy_rows_ignored", "note")


@query("u01_set_operations", sql("bars", """
SELECT session, 'both' AS membership FROM bars WHERE instrument = 'SPY' INTERSECT
SELECT session, 'both' FROM bars WHERE instrument = 'BTC' UNION ALL
(SELECT session, 'spy_only' FROM bars WHERE instrument = 'SPY' EXCEPT
 SELECT session, 'spy_only' FROM bars WHERE instrument = 'BTC')"""))
def u01(v: Views):
    b = v.settle().bars()
    spy = b.filter("instrument = 'SPY'").select("session")
    btc = b.filter("instrument = 'BTC'").select("session")
    both = spy.intersect(btc).withColumn("membership", F.lit("both"))
    return both.unionByName(spy.exceptAll(btc).withColumn("membership", F.lit("spy_only")))


@query("u05_universe_default", sql("bars", """
SELECT instrument, CASE WHEN instrument IN ('SPY', 'QQQ', 'IWM', 'EEM', 'XLF') THEN 'equities'
  ELSE 'other' END AS force FROM bars GROUP BY 1"""))
def u05(v: Views):
    names = v.bars().select("instrument").distinct()
    known = names.filter(F.col("instrument").isin("SPY", "QQQ", "IWM", "EEM", "XLF")).withColumn(
        "force", F.lit("equities"))
    return ld.prefer_source([("a", known), ("b", names.withColumn("force", F.lit("other")))],
                            ["instrument"]).drop("_source")


@query("u06_crowded_set", sql("posday", """
SELECT session, asset FROM posday WHERE idx52 >= 0.8 UNION
SELECT session, asset FROM posday WHERE idx52 <= 0.2"""))
def u06(v: Views):
    daily = hs.daily_positions(hs.weekly_features(v.positions()), v.calendar())
    return daily.filter("idx52 >= 0.8 or idx52 <= 0.2").select("session", "asset")


@query("a16_crowded_count", sql("posday", """
SELECT session, count(*) FILTER (idx52 >= 0.8 OR idx52 <= 0.2) AS cot_n_crowded
FROM posday GROUP BY 1"""))
def a16(v: Views):
    daily = hs.daily_positions(hs.weekly_features(v.positions()), v.calendar())
    return xs.crowded_count(daily).select("session", "cot_n_crowded")
