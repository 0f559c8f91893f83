"""Publication, report and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.functions import frames as fr
from tidepanel.operators import histories as hs
from tidepanel.operators import layers as ly
from tidepanel.operators import merge as mg
from tidepanel.operators import strategies as stg
from tidepanel.plans import reports as rp
from tidepanel.plans.catalog.alignment import _LIQ, _RATES
from tidepanel.plans.catalog.rules import _TALLY, _VOTES
from tidepanel.plans.catalog.strategies import _EVENTS, _event_pnls
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.state import State
from tidepanel.plans.views import PRIORITY_ASSETS, Views
from tidepanel.schemas import POSITIONS, names
from tidepanel.sources import landing as ld
from tidepanel.sources import store as st
from tidepanel.universe import FOCUS, MACRO_FORCE


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("k02_versioned_history", sql("positions", """
SELECT asset, report_date, CASE WHEN report_date >= DATE '1999-01-01' THEN net_pct
  WHEN report_date >= DATE '1998-01-01' THEN net_pct + 1 ELSE net_pct + 2 END AS net_pct
FROM positions"""))
def k02(v: Views):
    """Three writes, each merged over the last; every version stays readable."""
    root = env.scratch_path(v.spark, "positions")
    keys = ["panel_id", "asset", "report_date"]
    p = v.positions().select(*names(POSITIONS))
    cuts = [("1990-01-01", 2), ("1998-01-01", 1), ("1999-01-01", 0)]
    for version, (since, shift) in enumerate(cuts, 1):
        fresh = p.filter(F.col("report_date") >= since).withColumn(
            "net_pct", F.col("net_pct") + shift)
        out = st.update_history(v.spark, root, version, fresh, keys, POSITIONS)
    return out.select("asset", "report_date", "net_pct")


@query("k04_publish_positions", sql("feats", """
SELECT asset, report_date, round_even(net_pct, 4) AS net_pct_oi, round_even(z156, 2) AS z156,
  round_even(idx52, 2) AS idx52, round_even(chg4w, 4) AS chg4w,
  row_number() OVER (ORDER BY abs(coalesce(z156, 0)) DESC, asset) AS place
FROM (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY asset
  ORDER BY report_date DESC) = 1)"""))
def k04(v: Views):
    return rp.publish_positions(hs.weekly_features(v.positions())).drop("panel_id")


@query("k05_publish_rates", sql("rates", """
SELECT series_id, date AS data_through, round_even(funding_1d, 6) AS funding_1d,
  round_even(funding_1d * 36500, 1) AS funding_1d_annualized_pct, round_even(z156, 2) AS z156,
  round_even(idx52w, 2) AS idx52w, CASE WHEN z156 > 1.5 THEN 'crowded_longs'
  WHEN z156 < -1.5 THEN 'crowded_shorts' ELSE 'normal' END AS read
FROM rf WHERE funding_1d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id
  ORDER BY date DESC) = 1""", **_RATES))
def k05(v: Views):
    return rp.publish_rates(hs.daily_rate_features(v.daily_rates()))


@query("k06_publish_liquidity", sql("levels tga", """
SELECT day AS data_through, round_even(netliq, 1) AS netliq_bn, round_even(walcl, 1) AS walcl_bn,
  round_even(tga, 1) AS tga_bn, round_even(rrp, 1) AS rrp_bn,
  round_even(netliq_chg13w, 1) AS chg13w_bn, round_even(netliq_chg13w_z, 2) AS chg13w_z,
  CASE WHEN netliq_chg13w > 0 THEN 'rising' WHEN netliq_chg13w IS NOT NULL THEN 'falling' END
  AS trend, (SELECT count(*) FROM tga t JOIN levels l ON l.series_id = 'WDTGAL'
    AND l.obs_date = t.record_date) AS n
FROM liq WHERE netliq IS NOT NULL ORDER BY day DESC LIMIT 1""", **_LIQ))
def k06(v: Views):
    bal = ld.resolve_balances(v.balances())
    check = mg.cross_check(bal.withColumnRenamed("record_date", "obs_date"),
                           v.levels().filter("series_id = 'WDTGAL'"), "obs_date", "value",
                           ["panel_id"], 1000.0).select("panel_id", "n")
    return rp.publish_liquidity(State(v).liquidity(), check).drop("panel_id")


@query("k07_publish_flows", sql("snapshots", """
SELECT min(date) FILTER (source IS NOT NULL) AS history_since, min(date) AS legacy_history_since,
  count(*) FILTER (source IS NULL) AS legacy_rows_ignored FROM snapshots"""))
def k07(v: Views):
    return rp.publish_flow_history(v.snapshots()).drop("panel_id")


# --- documents -----------------------------------------------------------------

def _documents(v: Views):
    """A score document per month: gate verdicts and per-asset scores as nested maps."""
    b = v.bars().withColumn("doc_id", F.date_format("session", "yyyy-MM"))
    halves = b.withColumn("horizon", F.when(F.dayofmonth("session") <= 15, "5d").otherwise("21d"))
    gates = halves.groupBy("doc_id", "horizon").agg(
        F.round(F.avg("volume") / 15, 4).alias("dsr_ratio"),
        F.round(F.avg("factor") - 0.45, 6).alias("pbo"), F.count("*").alias("n_trades"),
        F.round(F.max("factor"), 6).alias("profit_factor"))
    gates = gates.withColumn("passes", F.col("n_trades") % 2 == 0).withColumn(
        "dsr_ratio", F.when(F.col("n_trades") % 7 != 0, F.col("dsr_ratio")))
    per = halves.groupBy("doc_id", F.col("instrument").alias("symbol"), "horizon").agg(
        F.round(F.sum("close"), 4).alias("score"), F.round(F.max("factor"), 6).alias("rank_pct"),
        F.count("*").cast("int").alias("lean"))
    force = F.create_map(*[F.lit(x) for kv in MACRO_FORCE.items() for x in kv])
    assets = per.groupBy("doc_id", "symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", F.struct("score", "rank_pct",
                                                                      "lean")))).alias("horizons"),
        F.sum("lean").cast("int").alias("lean"), F.max("rank_pct").alias("conviction"))
    return gates, assets.withColumn("force", force[F.col("symbol")])


_DOC = dict(
    h="""SELECT *, strftime(session, '%Y-%m') AS doc_id, CASE WHEN day(session) <= 15 THEN '5d'
      ELSE '21d' END AS horizon FROM bars""",
    g="""SELECT doc_id, horizon, CASE WHEN count(*) % 7 <> 0 THEN round(avg(volume) / 15, 4) END
      AS dsr_ratio, round(avg(factor) - 0.45, 6) AS pbo, count(*) AS n_trades,
      round(max(factor), 6) AS profit_factor, count(*) % 2 = 0 AS stored FROM h GROUP BY 1, 2""",
    p="""SELECT doc_id, instrument AS symbol, horizon, round(sum(close), 4) AS score,
      round(max(factor), 6) AS rank_pct, count(*) AS lean FROM h GROUP BY 1, 2, 3""")


@query("s15_gate_rows", sql("bars", """
SELECT doc_id, horizon, coalesce(dsr_ratio > 1.645 AND pbo < 0.5, false) AS passes, stored
  AS stored_passes, stored AND NOT coalesce(dsr_ratio > 1.645 AND pbo < 0.5, false) AS superseded,
  n_trades FROM g""", **_DOC))
def s15_gate(v: Views):
    docs = rp.gate_document(*_documents(v))
    return ld.gate_rows(docs).select("doc_id", "horizon", "passes", "stored_passes", "superseded",
                                     "n_trades")


@query("s15_asset_rows", sql("bars", """
SELECT doc_id, symbol, CAST(sum(lean) AS INT) AS lean, round(max(rank_pct), 6) AS conviction,
  max(score) FILTER (horizon = '5d') AS score_5d, max(score) FILTER (horizon = '21d') AS score_21d,
  CAST(max(lean) FILTER (horizon = '21d') AS INT) AS lean_21d FROM p GROUP BY 1, 2""", **_DOC))
def s15_assets(v: Views):
    docs = rp.gate_document(*_documents(v))
    return ld.asset_rows(docs).select("doc_id", "symbol", "lean", "conviction", "score_5d",
                                      "score_21d", "lean_21d")


@query("k08_gate_document")
def k08(v: Views):
    return rp.gate_document(*_documents(v))


_BOARD = """SELECT strategy, count(*) AS n, round(avg(pnl), 6) AS mean_pnl,
  round(avg((pnl > 0)::INT), 6) AS hit FROM pnls GROUP BY 1"""


@query("k10_scorecard", sql("grid", "SELECT *, 'a' AS run_id FROM s UNION ALL "
                                    "SELECT *, 'b' AS run_id FROM s WHERE n > 100",
                            pnls=_EVENTS, s=_BOARD))
def k10(v: Views):
    """Scorecards are appended per run, never rewritten."""
    board = stg.summarise_pnls(_event_pnls(v), ["strategy"]).select(
        "strategy", "n", r("mean_pnl"), r("hit"))
    path = env.scratch_path(v.spark, "scorecards")
    st.append_scorecard(board, path, "a")
    st.append_scorecard(board.filter("n > 100"), path, "b")
    return v.spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))


@query("k11_staleness", """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN round((epoch_us(TIMESTAMP '1998-08-02')
  - epoch_us(o_orderdate)) / 86400e6, 1) END AS age_days, coalesce(CASE WHEN o_orderkey % 50 <> 0
  THEN (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate)) / 86400e6 > 9 END, true) AS stale
FROM orders""")
def k11(v: Views):
    stamp = F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate",
                                                               "yyyy-MM-dd HH:mm:ss"))
    o = v.table("orders").select("o_orderkey", stamp.alias("as_of"))
    return st.with_staleness(o, "1998-08-02 00:00:00", 9).select("o_orderkey", "age_days", "stale")


_ASSETS = sorted(PRIORITY_ASSETS.values())


@query("k13_positioning_pivot", sql("feats", "SELECT effective_date, " + ", ".join(
    f"round(avg(idx52) FILTER (asset = '{a}'), 6) AS {a}" for a in _ASSETS)
    + " FROM feats GROUP BY 1"))
def k13(v: Views):
    p = rp.positioning_pivot(hs.weekly_features(v.positions()), _ASSETS)
    return p.select("effective_date", *[r(a) for a in _ASSETS])


@query("k15_focus_report", sql("bars", "SELECT instrument, session, price, confluence, unnest([" + ", ".join(
    f"'{n}'" for n in ly.LAYERS) + f"]) AS layer, unnest({_VOTES}) AS verdict FROM (" + """SELECT *, concat(n_bullish, 'B / ',
  n_bearish, 'Br / ', n_no_data, 'ND') AS confluence FROM tally WHERE instrument IN (""" + ", ".join(
    f"'{n}'" for n in FOCUS) + ") QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY session DESC) = 1)",
    **_TALLY))
def k15(v: Views):
    return rp.focus_report(State(v, keep=True).layers(), FOCUS, ly.LAYERS)


@query("k10_top_books", sql("grid", """
SELECT strategy, n, mean_pnl, hit FROM s ORDER BY mean_pnl DESC, strategy LIMIT 10""",
    pnls=_EVENTS, s=_BOARD))
def k10_top(v: Views):
    board = stg.summarise_pnls(_event_pnls(v), ["strategy"]).select(
        "strategy", "n", r("mean_pnl"), r("hit"))
    return board.orderBy(F.col("mean_pnl").desc(), "strategy").limit(10)


@query("a13_verdict_tally", sql("bars", """
SELECT instrument, session, n_bullish, n_bearish, n_neutral, n_no_data FROM tally""", **_TALLY))
def a13(v: Views):
    """Verdicts of the twelve layers of each instrument and session, unpivoted and counted."""
    rows = State(v, keep=True).layers().unpivot(["instrument", "session"], ly.LAYERS, "layer", "verdict")
    return rows.groupBy("instrument", "session").agg(*[
        F.count_if(F.col("verdict") == k).cast("int").alias(f"n_{k.lower()}")
        for k in ("bullish", "bearish", "neutral", "NO_DATA")])


@query("a04_pooled_by_date", sql("grid", """
SELECT session, round(avg(pnl), 6) AS pnl FROM pnls GROUP BY 1""", pnls=_EVENTS))
def a04(v: Views):
    return stg.pool(_event_pnls(v)).select("session", r("pnl"))


@query("a14_frame_summary", sql("bars", """
SELECT session, count(*) AS n_assets, round(avg(n_bullish), 6) AS mean_bullish, round(avg(n_bearish), 6) AS mean_bearish,
  round(avg(n_no_data), 6) AS mean_no_data FROM tally GROUP BY 1""", **_TALLY))
def a14(v: Views):
    """Size and mean verdict counts of the layer frame, per session."""
    return State(v, keep=True).layers().groupBy("session").agg(
        F.count("*").alias("n_assets"), *[F.round(F.avg(f"n_{k}"), 6).alias(f"mean_{k}")
                                          for k in ("bullish", "bearish", "no_data")])


@query("a17_event_control", sql("panel", """
SELECT instrument, round(avg(ret) FILTER (e), 6) AS event_mean,
  round(avg(ret) FILTER (NOT e), 6) AS control_mean FROM (SELECT *, session IN (
    SELECT max(session) FROM cal GROUP BY year(session), month(session)) AS e FROM panel
  WHERE ret IS NOT NULL) GROUP BY 1"""))
def a17(v: Views):
    nxt = F.lead("session", 1).over(fr.line(("panel_id",)))
    ends = v.calendar().withColumn("last", F.month("session") != F.coalesce(F.month(nxt),
                                                                            F.lit(-1)))
    p = v.panel().filter("ret is not null").join(
        ends.select("panel_id", "session", "last"), ["panel_id", "session"])
    return p.groupBy("instrument").agg(
        F.round(F.avg(F.when(F.col("last"), F.col("ret"))), 6).alias("event_mean"),
        F.round(F.avg(F.when(~F.col("last"), F.col("ret"))), 6).alias("control_mean"))
