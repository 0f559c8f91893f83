"""Volatility surface, stories, crowding, conditions, layers, state panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import calendar as tc
from tidepanel.functions import frames as fr
from tidepanel.functions import scalars as sc
from tidepanel.operators import histories as hs
from tidepanel.operators import layers as ly
from tidepanel.operators import rules as ru
from tidepanel.plans.catalog.alignment import _FLOWS, _LIQ, _RATES
from tidepanel.plans.catalog.rolling import _ROWS
from tidepanel.plans.catalog.sections import _SRC, _gap_ewm
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query, reference
from tidepanel.plans.state import STORY_LEGS, SURFACE, State
from tidepanel.plans.views import Views
from tidepanel.universe import CONDITION_IDS, FLOW_FUNDS, FUND_TICKER, STORIES


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_IDX = ("VIX", "VIX9D", "VIX3M", "VVIX", "SKEW")
_SURF = dict(
    w="SELECT c.session, c.sess_no, max(close) FILTER (instrument = 'SPY') AS spy, " + ", ".join(
        f"max(close / 100) FILTER (instrument = '{n}') AS {n.lower()}" for n in _IDX)
    + " FROM cal c LEFT JOIN bars b ON b.session = c.session GROUP BY 1, 2",
    f="""SELECT *, last_value(spy IGNORE NULLS) OVER o AS ff,
      last_value(vix9d IGNORE NULLS) OVER o AS f9, last_value(vix3m IGNORE NULLS) OVER o AS f3,
      max(CASE WHEN vix9d IS NOT NULL THEN sess_no END) OVER o AS n9,
      max(CASE WHEN vix3m IS NOT NULL THEN sess_no END) OVER o AS n3,
      session - max(CASE WHEN vix9d IS NOT NULL THEN session END) OVER o AS a9,
      session - max(CASE WHEN vix3m IS NOT NULL THEN session END) OVER o AS a3
      FROM w WINDOW o AS (ORDER BY session ROWS UNBOUNDED PRECEDING)""",
    q="SELECT *, ff / lag(ff) OVER (ORDER BY session) - 1 AS r FROM f",
    v="""SELECT *, CASE WHEN count(r) OVER o >= 20 THEN stddev_samp(r) OVER o * sqrt(252) * 100 END
      AS rv20, greatest(coalesce(a9, -1), coalesce(a3, -1)) AS term_stale_days,
      CASE WHEN sess_no - n9 <= 5 AND sess_no - n3 <= 5 THEN f9 / f3 END AS term_ratio
      FROM q WINDOW o AS (ORDER BY session ROWS 19 PRECEDING)""",
    s="""SELECT *, vix * vix - rv20 * rv20 AS vrp FROM v""",
    surf="SELECT s.*" + "".join(f", {c}_pct" for c in ("vrp", "vix", "skew", "vvix", "term_ratio"))
    + " FROM s" + "".join(f""" LEFT JOIN (SELECT session, CASE WHEN len(l) >= 60 THEN
      len(list_filter(l, lambda e: e <= {c})) / len(l) END AS {c}_pct FROM (SELECT session, {c},
      list({c}) OVER (ORDER BY session ROWS 251 PRECEDING) AS l FROM s WHERE {c} IS NOT NULL)) USING (session)"""
                        for c in ("vrp", "vix", "skew", "vvix", "term_ratio")))


@query("w20_vol_surface", sql("bars cal", """
SELECT session, round(rv20, 4) AS rv20, round(vrp, 4) AS vrp, CAST(term_stale_days AS INT)
  AS term_stale_days, round(term_ratio, 6) AS term_ratio, CASE WHEN term_ratio >= 1 THEN
  'backwardation' WHEN term_ratio IS NOT NULL THEN 'contango' END AS structure,
  round(vrp_pct, 6) AS vrp_pct, round(vix_pct, 6) AS vix_pct, round(skew_pct, 6) AS skew_pct,
  round(term_ratio_pct, 6) AS term_ratio_pct FROM surf""", **_SURF))
def w20(v: Views):
    return State(v).vol().select(
        "session", r("rv20", 4), r("vrp", 4), "term_stale_days", r("term_ratio"), "structure",
        r("vrp_pct"), r("vix_pct"), r("skew_pct"), r("term_ratio_pct"))


_STORY_ROWS = " UNION ALL ".join(
    f"SELECT '{s[0]}' AS story, {s[3]} AS thr, a.session, a.sess_no, a.ret AS ra, b.ret AS rb "
    f"FROM panel a JOIN panel b ON a.session = b.session AND a.instrument = '{s[1]}' "
    f"AND b.instrument = '{s[2]}'" for s in STORIES)
_STORIES = dict(
    rows_=_STORY_ROWS,
    hist="""SELECT *, CASE WHEN count(ra + rb) OVER f >= 20 AND stddev_samp(ra) OVER f > 0
        AND stddev_samp(rb) OVER f > 0 THEN corr(ra, rb) OVER f END AS corr_fast,
      CASE WHEN count(ra + rb) OVER s >= 60 AND stddev_samp(ra) OVER s > 0
        AND stddev_samp(rb) OVER s > 0 THEN corr(ra, rb) OVER s END AS corr_slow
      FROM rows_ WINDOW f AS (PARTITION BY story ORDER BY session ROWS 59 PRECEDING),
        s AS (PARTITION BY story ORDER BY session ROWS 251 PRECEDING)""")


def _state(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'NO_DATA' WHEN {c} * sign(thr) >= abs(thr) THEN 'HOLDING' "
            f"WHEN {c} * sign(thr) <= -0.10 THEN 'BROKEN' ELSE 'WEAK' END")


@query("r03_story_history", sql("panel", f"""
SELECT session, story, round(corr_fast, 6) AS corr_fast, round(corr_slow, 6) AS corr_slow,
  {_state('corr_fast')} AS state, {_state('corr_slow')} AS state_slow FROM hist""", **_STORIES))
def r03(v: Views):
    return State(v).stories().select("session", "story", r("corr_fast"), r("corr_slow"), "state",
                                     "state_slow")


@query("r03_story_checks", sql("panel", f"""
SELECT story, round(corr_fast, 6) AS corr_fast, round(corr_slow, 6) AS corr_slow,
  {_state('corr_fast')} AS state FROM (SELECT story, any_value(thr) AS thr,
   corr(ra, rb) FILTER (k <= 60) AS corr_fast, corr(ra, rb) AS corr_slow
  FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY session DESC) AS k FROM rows_
        WHERE ra IS NOT NULL AND rb IS NOT NULL) WHERE k <= 252 GROUP BY 1)""", rows_=_STORY_ROWS))
def r03_latest(v: Views):
    out = ru.story_checks(State(v).returns(STORY_LEGS))
    return out.select("story", r("corr_fast"), r("corr_slow"), "state")


_CROWD = dict(
    pr="""SELECT a.instrument AS a, b.instrument AS b, a.session, a.sess_no, a.ret AS x, b.ret AS y
      FROM panel a JOIN panel b ON a.session = b.session AND a.instrument <> b.instrument
      WHERE a.instrument IN (SELECT DISTINCT asset FROM feats)
        AND b.instrument IN (SELECT DISTINCT asset FROM feats)""",
    rc="""SELECT a, b, session, sess_no, CASE WHEN count(x + y) OVER o >= 2 AND stddev_samp(x) OVER o > 0
        AND stddev_samp(y) OVER o > 0 THEN corr(x, y) OVER o END AS c FROM pr
      WINDOW o AS (PARTITION BY a, b ORDER BY session ROWS 59 PRECEDING)""",
    cx="""SELECT p.session, p.sess_no, p.asset, p.idx52, p.chg4w, CASE WHEN p.idx52 >= 0.8 THEN
        'crowded long' WHEN p.idx52 <= 0.2 THEN 'crowded short' ELSE 'neutral' END AS side,
      avg(rc.c) AS corr_to_crowded
      FROM posday p LEFT JOIN posday q ON q.session = p.session AND q.asset <> p.asset
        AND (q.idx52 >= 0.8 OR q.idx52 <= 0.2)
      LEFT JOIN rc ON rc.session = p.session AND rc.a = p.asset AND rc.b = q.asset
        AND p.sess_no >= 60
      GROUP BY ALL""")


@query("r04_crowding_structure", sql("panel posday", """
SELECT session, asset, side, round(corr_to_crowded, 6) AS corr_to_crowded,
  coalesce(side <> 'neutral' AND abs(corr_to_crowded) >= 0.35, false) AS same_bet FROM cx""",
    **_CROWD))
def r04(v: Views):
    return State(v).crowding().select("session", "asset", "side", r("corr_to_crowded"), "same_bet")


_INPUTS = """SELECT s.session, s.term_ratio, s.term_stale_days, s.vrp_pct, s.skew_pct, s.vix_pct,
  l.netliq_chg13w_z, x.n_cluster, x.m AS max_abs_chg4w, x.vi AS vix_idx52
  FROM surf s LEFT JOIN liq l ON l.day = s.session AND l.netliq IS NOT NULL LEFT JOIN (SELECT session,
    count(*) FILTER (side <> 'neutral' AND abs(corr_to_crowded) >= 0.35) AS n_cluster,
    max(abs(chg4w)) AS m, max(idx52) FILTER (asset = 'VIX') AS vi FROM cx GROUP BY 1) x
  ON x.session = s.session"""
_COND = {
    "SHORT_VOL_CROWDED_WHILE_CHEAP": "vix_idx52 < 0.25 AND vrp_pct < 0.25",
    "CROWDED_CLUSTER": "n_cluster >= 3",
    "TERM_BACKWARDATION": "term_ratio >= 1.0 AND term_stale_days <= 1",
    "LIQUIDITY_SHOCK": "netliq_chg13w_z < -2.0", "VOL_RICH": "vrp_pct > 0.80",
    "SKEW_VS_VIX_DIVERGENCE": "skew_pct > 0.80 AND vix_pct < 0.30",
    "POSITIONING_UNWIND": "max_abs_chg4w >= 0.05", "ABSORPTION_SPIKE": "false"}


@query("r01_conditions", sql("bars cal panel posday levels tga", " UNION ALL ".join(
    f"SELECT session, '{k}' AS condition, coalesce({c}, false) AS fired FROM inputs"
    for k, c in _COND.items()), **_SURF, **_LIQ, **_CROWD, inputs=_INPUTS))
def r01(v: Views):
    """Every condition on every session; without a structure input its rule stays off."""
    return ru.evaluate_conditions(State(v).conditions(with_structure=False)).select(
        "session", "condition", "fired")


@query("r02_condition_replay")
def r02(v: Views):
    return ru.evaluate_conditions(State(v).conditions()).select("session", "condition", "fired")


@query("r15_state_snapshot")
def r15(v: Views):
    """The last session's row of the replay, with lists, maps and prose."""
    st = State(v)
    inputs = st.conditions()
    latest = inputs.groupBy("panel_id").agg(F.max("session").alias("session"))
    row = inputs.join(latest, ["panel_id", "session"]).withColumns(ru.condition_columns())
    crowd = st.crowding().join(latest, ["panel_id", "session"]).groupBy("panel_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("side") == "crowded long", F.col("asset"))))
        .alias("crowded_long"),
        F.sort_array(F.collect_set(F.when(F.col("side") == "crowded short", F.col("asset"))))
        .alias("crowded_short"))
    told = st.stories().join(latest, ["panel_id", "session"]).groupBy("panel_id").agg(
        F.map_from_entries(F.collect_list(F.struct("story", "state"))).alias("stories"),
        F.map_from_entries(F.collect_list(F.struct("story", F.round("corr_fast", 6))))
        .alias("story_corr"))
    row = row.join(crowd, "panel_id", "left").join(told, "panel_id", "left").withColumn(
        "fired", ru.fired_list(CONDITION_IDS))
    text = ru.narrative({c: F.col(c) for c in ("vrp_pct", "vix", "structure", "crowded_long",
                                               "crowded_short", "fired")})
    return row.select(
        F.col("session").cast("string").alias("as_of"), "fired", "crowded_long", "crowded_short",
        *[r(c) for c in ("vix", "vrp", "vrp_pct", "term_ratio", "rv20", "absorption",
                         "top1_share", "netliq_chg13w_z")],
        F.to_json("stories").alias("stories"), F.to_json("story_corr").alias("story_corr"),
        text.alias("narrative"))


@query("r14_state_panel")
def r14(v: Views):
    return State(v, keep=True).panel().drop("panel_id")


# --- layers -----------------------------------------------------------------

def _verdict(bull: str, bear: str) -> str:
    return (f"CASE WHEN coalesce({bull}, false) AND NOT coalesce({bear}, false) THEN 'bullish' "
            f"WHEN coalesce({bear}, false) AND NOT coalesce({bull}, false) THEN 'bearish' "
            "ELSE 'neutral' END")


_EMAS = """SELECT instrument, k, close AS e21, close AS e50, close AS e200 FROM src WHERE k = 0
  UNION ALL SELECT e.instrument, s.k, e21 + 2 / 22.0 * (s.close - e21),
    e50 + 2 / 51.0 * (s.close - e50), e200 + 2 / 201.0 * (s.close - e200)
  FROM e JOIN src s ON s.instrument = e.instrument AND s.k = e.k + 1"""


@query("r06_trend_layer", sql("bars", f"""
SELECT s.instrument, s.session, CASE WHEN k < 204 THEN 'NO_DATA' ELSE {_verdict(
    'close > e200 AND close > e21', 'close <= e200 AND close < e21')} END AS trend,
  CASE WHEN k >= 204 THEN round(close / e200 - 1, 6) END AS dist_ema200_pct
FROM src s JOIN e USING (instrument, k)""", recursive=True, src=_ROWS, e=_EMAS))
def r06(v: Views):
    return ly.trend(v.bars_numbered()).select("instrument", "session", "trend",
                                              r("dist_ema200_pct"))


@query("r07_momentum_layer", sql("bars", f"""
SELECT instrument, session, CASE WHEN k < 59 THEN 'NO_DATA' ELSE {_verdict(
    'h > 0 AND abs(h) > abs(hp) AND NOT coalesce(rsi >= 80, false)',
    'h < 0 AND abs(h) > abs(hp) AND NOT coalesce(rsi <= 20, false)')} END AS momentum
FROM (SELECT s.instrument, s.session, k, m - g AS h, lag(m - g) OVER (PARTITION BY s.instrument
  ORDER BY s.session) AS hp, CASE WHEN u = 0 AND d = 0 THEN 50 WHEN u = 0 THEN 0
  WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END AS rsi
 FROM src s JOIN e USING (instrument, k))""", recursive=True,
    src="""SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session) - 1 AS k,
      close - lag(close) OVER (PARTITION BY instrument ORDER BY session) AS ch FROM bars""",
    e=f"""SELECT instrument, k, close AS f, close AS l, 0.0::DOUBLE AS m, 0.0::DOUBLE AS g,
      NULL::DOUBLE AS u, NULL::DOUBLE AS d FROM src WHERE k = 0 UNION ALL
      SELECT instrument, k, f, l, f - l, g0 + 0.2 * ((f - l) - g0), u, d FROM (
       SELECT e.instrument, s.k, e.f + {2 / 13!r} * (s.close - e.f) AS f,
         e.l + {2 / 27!r} * (s.close - e.l) AS l, e.g AS g0,
         coalesce(u + (greatest(ch, 0) - u) / 14, greatest(ch, 0)) AS u,
         coalesce(d + (greatest(-ch, 0) - d) / 14, greatest(-ch, 0)) AS d
       FROM e JOIN src s ON s.instrument = e.instrument AND s.k = e.k + 1)"""))
def r07(v: Views):
    return ly.momentum(v.bars_numbered()).select("instrument", "session", "momentum")


@query("r08_volume_layer", sql("bars", f"""
SELECT instrument, session, CASE WHEN n < 60 THEN 'NO_DATA' ELSE {_verdict(
    'ratio > 1.15 AND coalesce(up_, 0) > coalesce(dn, 0)',
    'ratio > 1.15 AND coalesce(up_, 0) <= coalesce(dn, 0)')} END AS volume_layer,
  round(ratio, 6) AS vol_ratio
FROM (SELECT *, avg(volume) OVER w5 / avg(volume) OVER w60 AS ratio, count(*) OVER c AS n,
   avg(CASE WHEN r > 0 THEN volume END) OVER w20 AS up_,
   avg(CASE WHEN NOT coalesce(r > 0, false) THEN volume END) OVER w20 AS dn
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY session) - 1 AS r
        FROM bars) WHERE volume > 0
  WINDOW w5 AS (PARTITION BY instrument ORDER BY session ROWS 4 PRECEDING),
    w20 AS (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING),
    w60 AS (PARTITION BY instrument ORDER BY session ROWS 59 PRECEDING),
    c AS (PARTITION BY instrument ORDER BY session ROWS UNBOUNDED PRECEDING))"""))
def r08(v: Views):
    return ly.volume(v.bars_numbered()).select("instrument", "session", "volume_layer",
                                               r("vol_ratio"))


@query("r05_breadth_layer", sql("grid", f"""
SELECT session, CASE WHEN breadth_n > 0 AND sess_no >= 204 THEN {_verdict(
    'a200 > 0.60 AND a50 > 0.50', 'a200 < 0.40 AND a50 < 0.50')} ELSE 'NO_DATA' END AS breadth
FROM (SELECT c.session, c.sess_no, avg((s.close > a.y)::INT) FILTER (s.k >= 199) AS a50,
  avg((s.close > b.y)::INT) FILTER (s.k >= 199) AS a200,
  count(s.k) FILTER (s.k >= 199) AS breadth_n FROM cal c LEFT JOIN src s ON s.session = c.session
 LEFT JOIN e50 a ON a.instrument = s.instrument AND a.k = s.k
 LEFT JOIN e200 b ON b.instrument = s.instrument AND b.k = s.k GROUP BY 1, 2)""",
    recursive=True, src=_SRC, e50=_gap_ewm(50), e200=_gap_ewm(200)))
def r05_breadth(v: Views):
    return ly.breadth_layer(State(v).breadth()).select("session", "breadth")


@query("r05_relative_strength", sql("bars", f"""
SELECT b.instrument, b.session, CASE WHEN b.instrument = 'SPY' THEN 'neutral'
  WHEN coalesce(x.n, 0) < 68 THEN 'NO_DATA' ELSE {_verdict('x.rs > 0', 'x.rs < 0')} END
  AS rel_strength FROM bars b LEFT JOIN (SELECT a.instrument, a.session,
   a.close / lag(a.close, 63) OVER w - s.close / lag(s.close, 63) OVER w AS rs,
   row_number() OVER w AS n FROM bars a JOIN bars s ON s.instrument = 'SPY'
   AND s.session = a.session WINDOW w AS (PARTITION BY a.instrument ORDER BY a.session)) x
  ON x.instrument = b.instrument AND x.session = b.session"""))
def r05_rs(v: Views):
    return ly.relative_strength(v.bars_numbered()).select("instrument", "session", "rel_strength")


@query("r09_flows_layer", sql("bars snapshots", f"""
SELECT b.instrument, CASE WHEN f.z IS NULL OR f.flow_20d IS NULL THEN 'NO_DATA'
  ELSE {_verdict('f.z > 1', 'f.z < -1')} END AS flows
FROM (SELECT DISTINCT instrument FROM bars) b LEFT JOIN flows f ON f.ticker = CASE """ + " ".join(
    f"WHEN b.instrument = '{n}' THEN '{t}'" for n, t in FUND_TICKER.items())
    + " ELSE b.instrument END", **_FLOWS))
def r09(v: Views):
    names = v.bars().select("panel_id", "instrument").distinct()
    flows = hs.fund_flows(v.snapshots(), FLOW_FUNDS)
    return ly.flows_layer(names, flows).select("instrument", "flows")


@query("r10_positioning_layer", sql("bars posday rates", """
SELECT instrument, session, CASE WHEN i IS NULL AND z IS NULL THEN 'NO_DATA'
  WHEN i >= 0.8 OR z > 1.5 THEN 'bearish' WHEN i <= 0.2 OR z < -1.5 THEN 'bullish'
  ELSE 'neutral' END AS positioning
FROM (SELECT b.instrument, b.session, p.idx52 AS i, f.z156 AS z FROM bars b
  LEFT JOIN posday p ON p.asset = b.instrument AND p.session = b.session
  ASOF LEFT JOIN (SELECT 'BTC' AS instrument, date, z156 FROM rf WHERE series_id = 'A'
    AND z156 IS NOT NULL) f ON f.instrument = b.instrument AND b.session >= f.date)""", **_RATES))
def r10(v: Views):
    st = State(v)
    return ly.positioning_layer(v.bars_numbered(), st.features(), st.funding()).select(
        "instrument", "session", "positioning")


@query("r11_macro_layer", sql("panel bars levels tga", f"""
SELECT instrument, session, CASE WHEN c IS NULL AND chg IS NULL AND instrument <> 'SPY' THEN
  'NO_DATA' WHEN beta IS NULL THEN 'neutral' ELSE {_verdict('imp * lk > 0', 'imp * lk < 0')} END
  AS macro FROM (SELECT *, CASE WHEN beta >= 0.2 THEN 1 WHEN beta <= -0.2 THEN -1 ELSE 0 END AS lk,
   CASE WHEN chg IS NULL OR NOT (z IS NULL OR abs(z) >= 0.5) THEN 0 WHEN chg > 0 THEN 1 ELSE -1 END
   AS imp FROM (SELECT x.instrument, x.session, x.c, CASE WHEN x.instrument = 'SPY' THEN 1
     ELSE x.c END AS beta, l.netliq_chg13w AS chg, l.netliq_chg13w_z AS z FROM corr60 x
     ASOF LEFT JOIN (SELECT * FROM liq WHERE netliq IS NOT NULL) l ON x.session >= l.day))""",
    **_LIQ, rr="""SELECT b.instrument, b.session, b.close / lag(b.close) OVER (
        PARTITION BY b.instrument ORDER BY b.session) - 1 AS x, s.ret AS y
      FROM bars b LEFT JOIN panel s ON s.instrument = 'SPY' AND s.session = b.session""",
    corr60="""SELECT instrument, session, CASE WHEN count(x + y) OVER w >= 2
        AND stddev_samp(x) OVER w > 0 AND stddev_samp(y) OVER w > 0 THEN corr(x, y) OVER w END AS c
      FROM rr WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS 59 PRECEDING)"""))
def r11(v: Views):
    st = State(v)
    bench = st.returns(["SPY"]).select("panel_id", "session", F.col("SPY").alias("bench_ret"))
    return ly.macro_layer(v.bars_numbered(), bench, st.liquidity()).select(
        "instrument", "session", "macro")


@query("r12_narrative_layer", sql("panel", f"""
SELECT instrument, session, {_verdict("bool_and(state = 'HOLDING')", "bool_or(state = 'BROKEN')")}
  AS narrative FROM (SELECT h.session, {_state('corr_fast')} AS state, unnest(CASE """ + " ".join(
    f"WHEN story = '{s[0]}' THEN {s[4]!r}" for s in STORIES) + """ END) AS instrument
  FROM hist h) GROUP BY 1, 2""", **_STORIES))
def r12(v: Views):
    return ly.narrative_layer(State(v).stories()).select("instrument", "session", "narrative")


@query("r13_risk_layer", sql("bars", f"""
SELECT instrument, session, CASE WHEN n < 260 THEN 'NO_DATA' ELSE {_verdict(
    'p < 0.35 AND dd > -0.10', 'p > 0.65 OR dd < -0.20')} END AS risk, round(p, 6) AS rv_pct
FROM (SELECT *, CASE WHEN rv IS NOT NULL AND len(l) >= 60 THEN
    len(list_filter(l, lambda e: e <= rv)) / len(l) END AS p
  FROM (SELECT *, list(rv) FILTER (rv IS NOT NULL) OVER w AS l, close / max(close) OVER w - 1 AS dd,
      count(ret) OVER (PARTITION BY instrument ORDER BY session ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT *, CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v * sqrt(252) * 100
      END AS rv FROM (SELECT instrument, session, close, close / lag(close) OVER (
        PARTITION BY instrument ORDER BY session) - 1 AS ret FROM bars)
      WINDOW v AS (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING))
    WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS 251 PRECEDING)))"""))
def r13(v: Views):
    return ly.risk(v.bars_numbered()).select("instrument", "session", "risk", r("rv_pct"))


_PARTS = {"trend": "r06_trend_layer", "momentum": "r07_momentum_layer", "volume_layer": "r08_volume_layer",
          "rel_strength": "r05_relative_strength", "positioning": "r10_positioning_layer", "macro": "r11_macro_layer",
          "risk": "r13_risk_layer", "narrative": "r12_narrative_layer"}
_FRAME = ("SELECT b.instrument, b.session, b.close AS price, " + ", ".join(
    f"coalesce({'volume_layer' if n == 'volume' else n}, '{'neutral' if n == 'narrative' else 'NO_DATA'}') AS {n}"
    for n in ly.LAYERS if n not in ("valuation", "fundamentals"))
    + ", 'NO_DATA' AS valuation, 'NO_DATA' AS fundamentals FROM bars b" + "".join(
    f" LEFT JOIN (SELECT instrument, session, {c} FROM ({reference(q)})) USING (instrument, session)"
    for c, q in _PARTS.items())
    + f" LEFT JOIN ({reference('r05_breadth_layer')}) USING (session)"
    + f" LEFT JOIN ({reference('r09_flows_layer')}) USING (instrument)")
_VOTES = "[" + ", ".join(ly.LAYERS) + "]"
_TALLY = dict(frame=_FRAME, tally="SELECT *" + "".join(
    f", CAST(len(list_filter({_VOTES}, lambda e: e = '{k}')) AS INT) AS n_{k.lower()}"
    for k in ("bullish", "bearish", "neutral", "NO_DATA")) + " FROM frame")


@query("r05_layer_frame", sql("bars", "SELECT instrument, session, price, " + ", ".join(ly.LAYERS) + """,
  n_bullish, n_bearish, n_neutral, n_no_data, concat(n_bullish, 'B / ', n_bearish, 'Br / ', n_no_data, 'ND') AS confluence
FROM tally""", **_TALLY))
def r05(v: Views):
    """Twelve verdicts and the tally per instrument and session."""
    return State(v, keep=True).layers().select("instrument", "session", "price", *ly.LAYERS, "n_bullish",
                                    "n_bearish", "n_neutral", "n_no_data", "confluence")


# --- options and decisions ---------------------------------------------------

SPREAD_WIDTH = 2.0


def _desk(v: Views):
    """Sessions with a spot, a level and a premium rank, met with the listed expiry of their trade."""
    vol = State(v).vol().filter("spy is not null and vix is not null and vrp_pct is not null")
    expiry = tc.monthly_expiry("session")
    return vol.select("panel_id", "session", F.col("spy").alias("spot"), (F.col("vix") / 100).alias("sigma"),
                      expiry.alias("expiry"), (F.datediff(expiry, "session") / 365.0).alias("years"), "vrp_pct",
                      F.col("vix_pct").alias("magnitude_pct"))


def _phi(z: str) -> str:
    """Normal distribution of a column, as the series about zero, held to [-8, 8]."""
    x = f"greatest(least({z}, 8.0), -8.0)"
    return (f"greatest(least(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * sign({x}) * list_sum(list_transform(range(0, 150), "
            f"lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))), "
            "1.0), 0.0)")


def _put(strike: str) -> str:
    d1 = f"((ln(spot / {strike}) + (0.04 + sg * sg / 2) * t) / (sg * sqrt(t)))"
    return f"({strike} * exp(-0.04 * t) * {_phi(f'-({d1} - sg * sqrt(t))')} - spot * {_phi(f'-{d1}')})"


_DESK = dict(
    _SURF, desk="""SELECT session, spot, sg, e AS expiry, (e - session) / 365.0 AS t, pct, mag, round_even(least(greatest(
        spot * exp((0.04 + sg * sg / 2) * (e - session) / 365.0 - 0.5244005127080407 * sg * sqrt((e - session) / 365.0)),
        spot * 0.5), spot * 1.1), 0) AS strike
      FROM (SELECT session, spy AS spot, vix / 100 AS sg, vrp_pct AS pct, vix_pct AS mag,
        session + 35 + CAST((12 - isodow(session + 35)) % 7 AS INT) AS e
        FROM surf WHERE spy IS NOT NULL AND vix IS NOT NULL AND vrp_pct IS NOT NULL)""")


@query("c09_option_estimates", sql("bars cal", f"""
SELECT session, expiry, round(strike, 4) AS strike, round({_phi("(ln(spot / strike) + (0.04 + sg * sg / 2) * t) / (sg * sqrt(t))")}
  - 1, 6) AS delta, round({_put("strike")}, 4) AS put, round(2 * {_put("round_even(spot, 0)")} + spot
  - round_even(spot, 0) * exp(-0.04 * t), 4) AS straddle FROM desk""", **_DESK))
def c09(v: Views):
    """Strike of the target delta, its delta and price, and the straddle at the money, at each session's expiry."""
    d = _desk(v).withColumn("strike", sc.strike_for_delta("spot", "sigma", "years")).withColumn("at", F.bround("spot", 0))
    return d.select("session", "expiry", F.round("strike", 4).alias("strike"),
                    F.round(sc.put_delta("spot", "strike", "sigma", "years"), 6).alias("delta"),
                    F.round(sc.put_price("spot", "strike", "sigma", "years"), 4).alias("put"),
                    F.round(sc.straddle_price("spot", "at", "sigma", "years"), 4).alias("straddle"))


def decide(d):
    """Ordered decision table over premium, shift and magnitude readings; the chosen structure with its estimates."""
    pct, mag = F.col("vrp_pct"), F.col("magnitude_pct")
    calm5, calm21, erupt = (sc.truthy(F.col(c)) for c in ("calm_5d", "calm_21d", "eruption"))
    rules = [
        (sc.truthy(F.col("shift_stale")), "NO_TRADE", "shift detector stale"),
        (erupt & calm21 & (pct < 0.60), "LONG_VOL", "eruption predicted from calm, vol not rich"),
        (erupt, "NO_TRADE", "eruption predicted but vol too rich to buy"),
        (calm5 & (pct >= 0.70) & sc.truthy(mag >= 0.70), "NO_TRADE", "rich but big-move regime"),
        (calm5 & (pct >= 0.70), "SELL_PUT_SPREAD", "calm, no eruption, premium rich"),
    ]
    action, reason = F.lit("NO_TRADE"), F.lit("no edge")
    for cond, a, why in reversed(rules):
        action, reason = F.when(cond, a).otherwise(action), F.when(cond, why).otherwise(reason)
    d = d.withColumns({"action": action, "reason": reason})
    d = d.withColumns({"short": sc.strike_for_delta("spot", "sigma", "years"), "at": F.bround("spot", 0)})
    d = d.withColumn("long", F.col("short") - SPREAD_WIDTH)
    credit = sc.put_price("spot", "short", "sigma", "years") - sc.put_price("spot", "long", "sigma", "years")
    d = d.withColumns({"credit": credit, "debit": sc.straddle_price("spot", "at", "sigma", "years")})
    spread, straddle = F.col("action") == "SELL_PUT_SPREAD", F.col("action") == "LONG_VOL"
    none = F.lit(None).cast("double")
    structure = F.when(spread | straddle, F.struct(
        F.when(spread, "put_credit_spread").otherwise("straddle").alias("type"),
        F.when(spread, "sell").otherwise("buy").alias("side"), F.lit(1).alias("lots"),
        F.when(straddle, F.col("at")).otherwise(none).alias("strike"),
        F.when(spread, F.col("short")).otherwise(none).alias("short_strike"),
        F.when(spread, F.col("long")).otherwise(none).alias("long_strike"),
        F.when(spread, F.bround("credit", 2)).otherwise(none).alias("est_credit"),
        F.when(straddle, F.bround("debit", 2)).otherwise(none).alias("est_debit"),
        F.when(spread, F.bround((SPREAD_WIDTH - F.col("credit")) * 100, 0)).otherwise(
            F.bround(F.col("debit") * 100, 0)).alias("max_risk_usd"),
        F.when(straddle, F.bround(F.col("debit") / F.col("spot") * 100, 2)).otherwise(none).alias("breakeven_move_pct")))
    return d.withColumn("structure", structure)


@query("c10_decisions", sql("bars cal", f"""
SELECT session, expiry, action, reason, CASE action WHEN 'SELL_PUT_SPREAD' THEN 'put_credit_spread' WHEN 'LONG_VOL' THEN 'straddle'
  END AS type, CASE WHEN action = 'LONG_VOL' THEN atm END AS strike, CASE WHEN action = 'SELL_PUT_SPREAD' THEN strike END
  AS short_strike, CASE WHEN action = 'SELL_PUT_SPREAD' THEN strike - 2 END AS long_strike,
  CASE WHEN action = 'SELL_PUT_SPREAD' THEN round_even(credit, 2) END AS est_credit,
  CASE WHEN action = 'LONG_VOL' THEN round_even(debit, 2) END AS est_debit,
  CASE action WHEN 'SELL_PUT_SPREAD' THEN round_even((2 - credit) * 100, 0) WHEN 'LONG_VOL' THEN round_even(debit * 100, 0) END
  AS max_risk_usd, CASE WHEN action = 'LONG_VOL' THEN round_even(debit / spot * 100, 2) END AS breakeven_move_pct
FROM (SELECT *, {_put("strike")} - {_put("(strike - 2)")} AS credit, round_even(spot, 0) AS atm,
  2 * {_put("round_even(spot, 0)")} + spot - round_even(spot, 0) * exp(-0.04 * t) AS debit,
  CASE WHEN st THEN 'NO_TRADE' WHEN er AND c21 AND pct < 0.6 THEN 'LONG_VOL'
  WHEN er THEN 'NO_TRADE' WHEN c5 AND pct >= 0.7 AND mag >= 0.7 THEN 'NO_TRADE'
  WHEN c5 AND pct >= 0.7 THEN 'SELL_PUT_SPREAD' ELSE 'NO_TRADE' END AS action,
  CASE WHEN st THEN 'shift detector stale' WHEN er AND c21 AND pct < 0.6 THEN
  'eruption predicted from calm, vol not rich' WHEN er THEN
  'eruption predicted but vol too rich to buy' WHEN c5 AND pct >= 0.7 AND mag >= 0.7 THEN
  'rich but big-move regime' WHEN c5 AND pct >= 0.7 THEN 'calm, no eruption, premium rich'
  ELSE 'no edge' END AS reason
FROM (SELECT *, day(session) % 7 = 0 AS st, day(session) % 5 = 1 AS er, month(session) % 2 = 0 AS c21,
  day(session) % 3 <> 0 AS c5 FROM desk))""", **_DESK))
def c10(v: Views):
    """The ticket of each session: action, reason and the priced structure."""
    day = F.dayofmonth("session")
    d = _desk(v).withColumns({"shift_stale": day % 7 == 0, "eruption": day % 5 == 1,
                              "calm_21d": F.month("session") % 2 == 0, "calm_5d": day % 3 != 0})
    parts = ("type", "strike", "short_strike", "long_strike", "est_credit", "est_debit", "max_risk_usd", "breakeven_move_pct")
    return decide(d).select("session", "expiry", "action", "reason", *[F.col(f"structure.{c}").alias(c) for c in parts])
