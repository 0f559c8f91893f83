"""Positioning studies and the lead-lag miner."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.scalars import norm_ppf
from tidepanel.operators import asof
from tidepanel.operators import histories as hs
from tidepanel.operators import matrices as mx
from tidepanel.operators import strategies as stg
from tidepanel.operators import studies as sd
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import BRAND_INSTRUMENTS, Views
from tidepanel.universe import CROWDED, UNCROWDED


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def tagged(v: Views):
    feats = hs.weekly_features(v.positions()).withColumnRenamed("asset", "instrument")
    # signals meet on a fixed grid, so equal ranks tie in every engine
    feats = feats.withColumns({c: F.round(c, 9) for c in sd.SIGNALS})
    joined = asof.entry_prices(feats.select("panel_id", "instrument", "effective_date",
                                            *sd.SIGNALS), v.bars(), v.calendar(), sd.HORIZONS)
    return sd.window_tags(joined.withColumnRenamed("instrument", "asset"))


_JOINED = dict(
    j="""SELECT f.asset, f.effective_date, round(f.idx52, 9) AS idx52, round(f.z156, 9) AS z156,
      round(f.chg4w, 9) AS chg4w, p.session AS entry_date, p.f1 AS "fwd_1w", p.f4 AS "fwd_4w",
      p.f13 AS "fwd_13w", p.prev AS prev_1w
      FROM feats f JOIN (SELECT f.effective_date AS e, min(c.session) AS s FROM
         (SELECT DISTINCT effective_date FROM feats) f JOIN cal c ON c.session >= f.effective_date
         GROUP BY 1) n ON n.e = f.effective_date
      JOIN (SELECT instrument, session, lead(close, 5) OVER w / close - 1 AS f1,
              lead(close, 20) OVER w / close - 1 AS f4, lead(close, 65) OVER w / close - 1 AS f13,
              close / lag(close, 5) OVER w - 1 AS prev FROM bars
            WINDOW w AS (PARTITION BY instrument ORDER BY session)) p
        ON p.instrument = f.asset AND p.session = n.s""",
    tg="""SELECT 'full' AS w, * FROM j UNION ALL SELECT '12m', * FROM j
      WHERE effective_date >= (SELECT max(effective_date) FROM j) - 364""",
    lp="""SELECT * FROM (""" + " UNION ALL ".join(
        f"SELECT w, asset, '{s}' AS signal, '{h}' AS horizon, {s} AS x, fwd_{h} AS y, "
        f"(row_number() OVER (PARTITION BY w, asset ORDER BY entry_date) - 1) % {max(1, d // 5)} = 0 "
        "AS ind FROM tg" for s in sd.SIGNALS for h, d in sd.HORIZONS.items())
    + ") WHERE x IS NOT NULL AND y IS NOT NULL",
    ic=""" SELECT a.*, b.ic AS ic2, b.n AS n2 FROM ({0}) a LEFT JOIN ({1}) b
      USING (w, asset, signal, horizon)""".format(*[f"""SELECT w, asset, signal, horizon,
        CASE WHEN count(*) >= 20 THEN corr(rx, ry) END AS ic, count(*) AS n FROM (SELECT *,
        rank() OVER (PARTITION BY w, asset, signal, horizon ORDER BY x) + (count(*) OVER (
          PARTITION BY w, asset, signal, horizon, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY w, asset, signal, horizon ORDER BY y) + (count(*) OVER (
          PARTITION BY w, asset, signal, horizon, y) - 1) / 2.0 AS ry FROM lp {c})
        GROUP BY 1, 2, 3, 4""" for c in ("", "WHERE ind")]))


@query("a09_ic_table", sql("bars feats cal", """
SELECT w AS "window", asset, signal, horizon, round(ic, 6) AS ic, n, round(ic2, 6)
  AS ic_nonoverlap, n2 AS n_nonoverlap FROM ic""", **_JOINED))
def a09(v: Views):
    return sd.ic_table(tagged(v)).select("window", "asset", "signal", "horizon", r("ic"), "n",
                                         r("ic_nonoverlap"), "n_nonoverlap")


@query("a10_verdict_counts", sql("bars feats cal", """
SELECT w AS "window", signal, horizon, count(*) AS n_assets, round(median(ic), 6) AS median_ic,
  round(avg(ic), 6) AS mean_ic, count(*) FILTER (CASE WHEN signal = 'idx52' THEN ic < 0
    ELSE ic > 0 END) AS assets_with_predicted_sign,
  CASE WHEN signal = 'idx52' THEN 'negative' ELSE 'positive' END AS predicted_sign,
  count(*) FILTER (CASE WHEN signal = 'idx52' THEN ic < 0 ELSE ic > 0 END) >= 3 AS passes_count,
  abs(median(ic)) >= 0.05 AS passes_median
FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2, 3""", **_JOINED))
def a10(v: Views):
    out = sd.verdict_counts(sd.ic_table(tagged(v)), need=3)
    return out.select("window", "signal", "horizon", "n_assets", r("median_ic"), r("mean_ic"),
                      "assets_with_predicted_sign", "predicted_sign", "passes_count",
                      "passes_median")


@query("a08_extremes", sql("bars feats cal", " UNION ALL ".join(f"""
SELECT w AS "window", asset, '{h}' AS horizon,
  count(fwd_{h}) FILTER (idx52 >= {CROWDED}) AS n_crowded_long,
  count(fwd_{h}) FILTER (idx52 <= {UNCROWDED}) AS n_crowded_short,
  round(avg(fwd_{h}) FILTER (idx52 >= {CROWDED}), 6) AS mean_crowded_long,
  round(avg(fwd_{h}) FILTER (idx52 <= {UNCROWDED}), 6) AS mean_crowded_short,
  round(avg(fwd_{h}), 6) AS mean_unconditional, round(avg(fwd_{h}) FILTER (idx52 >= {CROWDED})
    - avg(fwd_{h}) FILTER (idx52 <= {UNCROWDED}), 6) AS spread_long_minus_short
FROM tg GROUP BY 1, 2""" for h in sd.HORIZONS), **_JOINED))
def a08(v: Views):
    return sd.extremes(tagged(v)).select(
        "window", "asset", "horizon", "n_crowded_long", "n_crowded_short",
        *[r(c) for c in ("mean_crowded_long", "mean_crowded_short", "mean_unconditional",
                         "spread_long_minus_short")])


@query("a11_window_report", sql("bars feats cal", """
SELECT w AS "window", count(*) AS rows, count(DISTINCT asset) AS assets,
  min(effective_date) AS since FROM tg GROUP BY 1""", **_JOINED))
def a11(v: Views):
    return tagged(v).groupBy("window").agg(
        F.count("*").alias("rows"), F.count_distinct("asset").alias("assets"),
        F.min("effective_date").alias("since"))


def _rank_corr(y: str) -> str:
    return f"""SELECT w, asset, CASE WHEN count(*) >= 20 THEN corr(rx, ry) END AS ic, count(*) AS n
      FROM (SELECT *, rank() OVER (PARTITION BY w, asset ORDER BY chg4w) + (count(*) OVER (
        PARTITION BY w, asset, chg4w) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY w, asset
        ORDER BY {y}) + (count(*) OVER (PARTITION BY w, asset, {y}) - 1) / 2.0 AS ry
      FROM tg WHERE chg4w IS NOT NULL AND {y} IS NOT NULL) GROUP BY 1, 2"""


@query("a12_front_running", sql("bars feats cal", """
SELECT w AS "window", asset, round(p.ic, 6) AS corr_prev_week, p.n AS n_prev,
  round(q.ic, 6) AS corr_next_week, q.n AS n_next, abs(q.ic) > abs(p.ic) AS leads
FROM pv p FULL JOIN nx q USING (w, asset)""", **_JOINED, pv=_rank_corr("prev_1w"),
    nx=_rank_corr("fwd_1w")))
def a12(v: Views):
    return sd.front_running(tagged(v)).select("window", "asset", r("corr_prev_week"), "n_prev",
                                              r("corr_next_week"), "n_next", "leads")


@query("a18_distinct_counts", sql("feats", """
SELECT count(DISTINCT asset) AS assets, count(DISTINCT report_date) AS dates,
  min(n) AS least_weeks, max(n) AS most_weeks FROM (SELECT *, count(*) OVER (PARTITION BY asset)
  AS n FROM feats)"""))
def a18(v: Views):
    p = v.positions()
    weeks = p.groupBy("asset").agg(F.count("*").alias("n")).agg(
        F.min("n").alias("least_weeks"), F.max("n").alias("most_weeks"))
    totals = p.agg(F.count_distinct("asset").alias("assets"),
                   F.count_distinct("report_date").alias("dates"))
    one = F.lit(1)
    return totals.withColumn("__k", one).join(weeks.withColumn("__k", one), "__k").drop("__k")


_TRADES = """SELECT d.asset, p.session AS date, d.side, d.side * p.ret AS pnl FROM (
   SELECT asset, effective_date, CASE WHEN idx52 >= 0.8 THEN -1 WHEN idx52 <= 0.2 THEN 1 END AS side,
     row_number() OVER (PARTITION BY asset ORDER BY effective_date) - 1 AS k FROM feats
   WHERE idx52 IS NOT NULL) d
 ASOF JOIN (SELECT instrument, session, lead(close, 65) OVER (PARTITION BY instrument
   ORDER BY session) / close - 1 AS ret FROM bars) p
   ON p.instrument = d.asset AND p.session >= d.effective_date
 WHERE d.k % 13 = 0 AND d.side IS NOT NULL AND p.ret IS NOT NULL"""


@query("b18_crowding_trades", sql("feats bars", """
SELECT asset, date, side, round(pnl, 6) AS pnl FROM t""", t=_TRADES))
def b18(v: Views):
    out = sd.crowding_trades(hs.weekly_features(v.positions()), v.bars())
    return out.select(F.col("instrument").alias("asset"), "date", "side", r("pnl"))


@query("a06_trade_stats", sql("feats bars", """
SELECT count(*) AS n, round(avg(pnl), 6) AS mean_pnl, round(avg((pnl > 0)::INT), 6) AS hit,
  round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl
  ELSE 0 END), 0), 6) AS profit_factor FROM t""", t=_TRADES))
def a06_trades(v: Views):
    out = sd.crowding_trades(hs.weekly_features(v.positions()), v.bars())
    return stg.summarise_pnls(out, ["panel_id"]).select("n", r("mean_pnl"), r("hit"),
                                                        r("profit_factor"))


_LL = dict(
    rr="""SELECT instrument, sess_no - 1 AS p, ret, (SELECT (count(*) - 1) // 2 FROM cal) AS half
      FROM panel WHERE sess_no >= 1""",
    hv="""SELECT *, CASE WHEN p < half THEN 'discovery' ELSE 'validation' END AS h FROM rr""",
    cc="""SELECT a.instrument AS leader, b.instrument AS target, l.lag, a.h,
      any_value(a.half) AS half, corr(b.ret, a.ret) AS c
      FROM hv a JOIN (VALUES (1), (2), (3), (5)) l(lag) ON true
      JOIN hv b ON b.p = a.p + l.lag AND b.h = a.h AND b.instrument <> a.instrument
      GROUP BY 1, 2, 3, 4""",
    ll="""SELECT leader, target, lag, any_value(half) AS half, max(c) FILTER (h = 'discovery') AS cd,
      max(c) FILTER (h = 'validation') AS cv FROM cc GROUP BY 1, 2, 3""")
_CRIT = norm_ppf(1 - 0.05 / (25 * 24 * 4) / 2)


def _mined(v: Views):
    vec = mx.pack(v.panel(), BRAND_INSTRUMENTS, "ret",
                  by=("panel_id", "session", "sess_no", "n_sessions"))
    return sd.lead_lag(vec, BRAND_INSTRUMENTS)


@query("x10_lead_lag", sql("panel cal", f"""
SELECT leader, target, lag, round(cd, 6) AS corr_discovery, round(cv, 6) AS corr_validation,
  coalesce(abs(cd) * sqrt(half - lag) > {_CRIT!r} AND sign(cd) = sign(cv) AND abs(cv) > 0.05,
    false) AS found FROM ll""", **_LL))
def x10(v: Views):
    return _mined(v).select("leader", "target", "lag", r("corr_discovery"), r("corr_validation"),
                            "found")


@query("o05_top_lead_lag", sql("panel cal", f"""
SELECT leader, target, lag, round(cv, 6) AS corr_validation FROM ll
WHERE coalesce(abs(cd) * sqrt(half - lag) > {_CRIT!r} AND sign(cd) = sign(cv) AND abs(cv) > 0.05, false)
ORDER BY abs(cv) DESC, leader, target, lag LIMIT 25""", **_LL))
def o05(v: Views):
    """The strongest of the pairs that passed discovery and validation."""
    return _mined(v).filter("found").orderBy(F.abs("corr_validation").desc(), "leader", "target", "lag").limit(
        25).select("leader", "target", "lag", r("corr_validation"))


@query("a07_welch", sql("panel", """
SELECT instrument, count(*) FILTER (e) AS n_on, count(*) FILTER (NOT e) AS n_off,
  round(avg(ret) FILTER (e), 6) AS mean_on, round(avg(ret) FILTER (NOT e), 6) AS mean_off,
  round((avg(ret) FILTER (e) - avg(ret) FILTER (NOT e)) / sqrt(var_samp(ret) FILTER (e)
    / count(*) FILTER (e) + var_samp(ret) FILTER (NOT e) / count(*) FILTER (NOT e)), 6) AS welch_t
FROM (SELECT *, month(session) IN (11, 12, 1, 2, 3, 4) AS e FROM panel WHERE ret IS NOT NULL)
GROUP BY 1"""))
def a07(v: Views):
    p = v.panel().filter("ret is not null").withColumn(
        "e", F.month("session").isin(11, 12, 1, 2, 3, 4))
    return stg.welch_split(p, "e", "ret", ["instrument"]).select(
        "instrument", "n_on", "n_off", r("mean_on"), r("mean_off"), r("welch_t"))
