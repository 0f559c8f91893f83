"""Block PnL batteries and the overfit gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.functions import calendar as tc
from tidepanel.functions import frames as fr
from tidepanel.functions.scalars import expected_max_z, truthy
from tidepanel.operators import asof, gate
from tidepanel.operators import histories as hs
from tidepanel.operators import matrices as mx
from tidepanel.operators import sections as xs
from tidepanel.operators import strategies as stg
from tidepanel.plans.catalog.alignment import _LIQ
from tidepanel.plans.catalog.matrices import AVERAGE_CORR
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import BRAND_INSTRUMENTS, Views
from tidepanel.sources import landing as ld
from tidepanel.universe import LEADER_RULES, RISK_BASKET, SPREAD_PAIRS

WIDE = ["SPY", "QQQ", "IWM", "EEM", "XLF", "TLT", "TIP", "GOLD", "COPPER", "HYG", "LQD", "DXY",
        "VIX", "VIX3M", "SKEW", "VVIX"]


def pnl6():
    """Rounded, and without a negative zero."""
    x = F.round("pnl", 6)
    return F.when(x == 0, 0.0).otherwise(x).alias("pnl")


def out(df, *extra):
    return df.select("session", pnl6(), *extra)


# --- cross-sectional ---------------------------------------------------------

_FWD = "lead(close, {h}) OVER o / close - 1"
_SCORES = """SELECT g.*, b.ret AS bench,
  lead(g.close, 5) OVER o / g.close - 1 AS fwd5, lead(g.close, 21) OVER o / g.close - 1 AS fwd21,
  lag(g.close, 21) OVER o / lag(g.close, 252) OVER o - 1 AS mom,
  g.ff / lag(g.ff, 5) OVER o - 1 AS rev5, g.ff / lag(g.ff, 20) OVER o - 1 AS mom20,
  (g.open / lag(g.close, 1) OVER o - 1) - (g.close / g.open - 1) AS tug0,
  abs(g.ret) / nullif(g.volume * g.close, 0) AS ill0, ln(nullif(g.volume, 0)) AS logv
  FROM carried g JOIN (SELECT session, ret FROM panel WHERE instrument = 'SPY') b USING (session)
  WINDOW o AS (PARTITION BY g.instrument ORDER BY g.session)"""


def _full(expr: str, x: str, n: int) -> str:
    w = f"(PARTITION BY instrument ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= {n} THEN {expr.format(w='OVER ' + w)} END"


_SCORE_SQL = {
    "mom": "mom", "rev5": "rev5", "vol60": _full("stddev_samp(ret) {w}", "ret", 60),
    "beta": _full("covar_samp(ret, bench) {w} / nullif(var_samp(bench) {w}, 0)", "ret + bench", 60),
    "prox": "close / " + _full("max(close) {w}", "close", 252),
    "tug": _full("avg(tug0) {w}", "tug0", 60), "skew": _full("skewness(ret) {w}", "ret", 60),
    "illiq": _full("avg(ill0) {w}", "ill0", 20),
}
_BOOK = dict(
    due="""SELECT * FROM picked WHERE sess_no >= {start} AND (sess_no - {start}) % {hold} = 0
      AND sess_no < (SELECT count(*) FROM cal) - {hold} AND s IS NOT NULL""",
    ranked="""SELECT *, row_number() OVER (PARTITION BY session ORDER BY s DESC, instrument) AS r,
      count(*) OVER (PARTITION BY session) AS n FROM due""",
    legs0="""SELECT *, CASE WHEN r <= {k} THEN 1 ELSE -1 END AS side FROM ranked
      WHERE n >= 2 * {k} + 1 AND (r <= {k} OR r > n - {k})""",
    legs="""SELECT session, sess_no, instrument, side * 0.5 / {k} AS weight,
      0.5 * avg(f) FILTER (side = 1) OVER (PARTITION BY session)
      - 0.5 * avg(f) FILTER (side = -1) OVER (PARTITION BY session) AS gross FROM legs0""",
    kept="SELECT *, dense_rank() OVER (ORDER BY sess_no) AS k FROM legs WHERE gross IS NOT NULL")
_TRADES = """
SELECT session, round(any_value(gross) - 0.0005 * sum(abs(w - coalesce(p, 0))), 6) AS pnl FROM (
  SELECT max(a.session) OVER (PARTITION BY coalesce(a.k, b.k + 1)) AS session,
    max(a.gross) OVER (PARTITION BY coalesce(a.k, b.k + 1)) AS gross,
    coalesce(a.weight, 0) AS w, b.weight AS p
  FROM kept a FULL JOIN kept b ON a.k = b.k + 1 AND a.instrument = b.instrument)
WHERE session IS NOT NULL GROUP BY 1"""


def rank_sql(score: str, fwd: str, hold: int, start: int, invert: bool, k: int = 8) -> str:
    sign = "-" if invert else ""
    parts = {n: b.format(start=start, hold=hold, k=k) for n, b in _BOOK.items()}
    # scores meet on a grid of twelve significant digits, so ties agree
    return sql("carried", _TRADES, base=_SCORES, picked=f"""SELECT instrument, session, sess_no,
      {fwd} AS f, {sign}({_SCORE_SQL[score]}) AS s FROM base""", **parts)


def _register_rank(name, score, fwd, hold, start, invert):
    @query("b01_" + name.lower(), rank_sql(score, fwd, hold, start, invert))
    def plan(v: Views):
        s = stg.section_scores(v.carried())
        return out(stg.rank_long_short(s, score, fwd, hold, start, invert=invert))
    return plan


for _rule in stg.RANK_RULES:
    _register_rank(*_rule)


@query("b04_series_momentum", sql("carried", _TRADES, base=_SCORES,
    live="""SELECT *, sign(mom) AS sg, count(*) OVER (PARTITION BY session) AS n,
      avg(sign(mom) * fwd21) OVER (PARTITION BY session) AS gross FROM base
      WHERE sess_no >= 253 AND (sess_no - 253) % 21 = 0 AND sess_no < (SELECT count(*) FROM cal) - 21
        AND mom <> 0 AND fwd21 IS NOT NULL""",
    kept="""SELECT session, instrument, sg / n AS weight, gross,
      dense_rank() OVER (ORDER BY sess_no) AS k FROM live WHERE n >= 10"""))
def b04(v: Views):
    return out(stg.series_momentum(stg.section_scores(v.carried())))


@query("b10_w04_above_average", sql("carried", _TRADES, base=_SCORES,
    sma="SELECT *, " + _full("avg(close) {w}", "close", 210) + " AS sma FROM base",
    due="""SELECT *, coalesce(close > sma, false) AS on_ FROM sma WHERE sess_no >= 211
      AND (sess_no - 211) % 21 = 0 AND sess_no < (SELECT count(*) FROM cal) - 21""",
    kept="""SELECT session, CASE WHEN on_ THEN instrument ELSE '-' END AS instrument,
      CASE WHEN on_ THEN 1.0 / count(*) FILTER (on_) OVER (PARTITION BY session) ELSE 0 END AS weight,
      coalesce(avg(fwd21) FILTER (on_) OVER (PARTITION BY session), 0) AS gross,
      dense_rank() OVER (ORDER BY sess_no) AS k FROM due
      QUALIFY on_ OR row_number() OVER (PARTITION BY session ORDER BY on_ DESC, instrument) = 1"""))
def b10_w04(v: Views):
    return out(stg.above_average(stg.section_scores(v.carried())))


_EVENT = """SELECT session, round(avg(side * f) - 0.001, 6) AS pnl FROM ev
  WHERE sess_no >= {start} AND (sess_no - {start}) % 5 = 0
  AND sess_no < (SELECT count(*) FROM cal) - 5 AND f IS NOT NULL AND hit AND side <> 0 GROUP BY 1"""


@query("b10_w05_volume_shock", sql("carried", _EVENT.format(start=61), base=_SCORES,
    ev="SELECT *, fwd5 AS f, 1 AS side, " + _full(
        "(logv - avg(logv) {w}) / nullif(stddev_samp(logv) {w}, 0)", "logv", 60)
    + " > 1 AS hit FROM base"))
def b10_w05(v: Views):
    s = stg.section_scores(v.carried())
    return out(stg.pooled_events(s, F.col("volume_z") > 1, F.lit(1), "fwd5", 5, 61))


@query("b10_w08_range_breakout", sql("carried", _EVENT.format(start=253), base=_SCORES,
    rng="SELECT *, " + _full("avg((high - low) / close) {w}", "close", 5) + " AS g FROM base",
    lists="""SELECT *, list(g) FILTER (g IS NOT NULL) OVER (PARTITION BY instrument
      ORDER BY session ROWS 251 PRECEDING) AS l FROM rng""",
    ev="""SELECT *, fwd5 AS f, sign(mom20) AS side, len(l) >= 252 AND g IS NOT NULL AND
      (len(list_filter(l, lambda e: e < g)) + (len(list_filter(l, lambda e: e = g)) + 1) / 2.0)
      / len(l) < 0.10 AS hit FROM lists"""))
def b10_w08(v: Views):
    s = stg.section_scores(v.carried())
    return out(stg.pooled_events(s, F.col("rng_pct") < 0.10, F.signum("mom20"), "fwd5", 5, 253))


def _vectors(v: Views, names=RISK_BASKET):
    return mx.pack(v.panel(), names, "ret")


_GATED = {n: b.format(start=253, hold=21, k=8) for n, b in _BOOK.items() if n != "kept"} | dict(
    ev="""SELECT session, sess_no, instrument, weight, gross, false AS flat FROM legs JOIN gate USING (sess_no)
      WHERE gross IS NOT NULL AND open UNION ALL
      SELECT session, sess_no, '-', 0, 0, true FROM cal JOIN gate USING (sess_no) WHERE NOT open AND sess_no >= 253
        AND (sess_no - 253) % 21 = 0 AND sess_no < (SELECT count(*) FROM cal) - 21""",
    marks="""SELECT sess_no, NOT flat OR lag(NOT flat, 1, false) OVER (ORDER BY sess_no) AS stays
      FROM (SELECT DISTINCT sess_no, flat FROM ev)""",
    kept="""SELECT ev.*, dense_rank() OVER (ORDER BY sess_no) AS k FROM ev JOIN marks USING (sess_no) WHERE stays""")


@query("b10_w11_gated_momentum", sql("carried panel", _TRADES, avg_corr=AVERAGE_CORR, base=_SCORES,
    gate="""SELECT sess_no, coalesce(avg_corr < CASE WHEN count(avg_corr) OVER w >= 252
      THEN quantile_cont(avg_corr, 0.5) OVER w END, false) AS open FROM cal LEFT JOIN avg_corr USING (sess_no)
      WINDOW w AS (ORDER BY sess_no ROWS 251 PRECEDING)""",
    picked="SELECT instrument, session, sess_no, fwd21 AS f, mom AS s FROM base", **_GATED))
def b10_w11(v: Views):
    """Momentum only while average correlation is below its yearly median."""
    avg = mx.average_corr_before(_vectors(v))
    cal = v.calendar()
    g = cal.join(avg, ["panel_id", "sess_no"], "left")
    low = F.col("avg_corr") < fr.rolling_median("avg_corr", 252, ("panel_id",))
    g = g.withColumn("open", truthy(low)).select("panel_id", "sess_no", "open")
    return out(stg.gated_momentum(stg.section_scores(v.carried()), env.materialise(g, "gate")))


@query("b10_w10_pca_residual")
def b10_w10(v: Views):
    """Fade stretched residuals of the leading factors."""
    z = mx.residual_scores(_vectors(v, BRAND_INSTRUMENTS), BRAND_INSTRUMENTS)
    fwd = v.carried().withColumn("fwd5", fr.forward_return("close", 5)).select(
        *fr.SERIES, "session", "sess_no", "n_sessions", "fwd5")
    rows = fwd.join(z, ["panel_id", "instrument", "sess_no"])
    return out(stg.pooled_events(rows, F.abs("z") > 1.5, -F.signum("z"), "fwd5", 5, 80))


# --- single asset ------------------------------------------------------------

_WIDE = "SELECT session, sess_no, " + ", ".join(
    f"last_value({n} IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS {n}"
    for n in WIDE) + " FROM (SELECT c.session, c.sess_no, " + ", ".join(
    f"max(CASE WHEN instrument = '{n}' THEN close END) AS {n}" for n in WIDE) + """
  FROM cal c LEFT JOIN bars b ON b.session = c.session GROUP BY 1, 2)"""
_SIGNAL = """SELECT session, round(pos * fwd - 0.0005 * abs(pos - lag(pos, 1, 0)
    OVER (ORDER BY sess_no)), 6) + 0.0 AS pnl FROM sig
  WHERE sess_no >= {start} AND (sess_no - ({start})) % {hold} = 0
    AND sess_no < (SELECT count(*) FROM cal) - {hold} AND pos IS NOT NULL AND fwd IS NOT NULL"""
_FF = """SELECT *, last_value(SPY IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING)
  AS ff FROM wide"""
_SPYR = "SELECT *, ff / lag(ff) OVER (ORDER BY session) - 1 AS r FROM filled"


def _f(name: str, h: int) -> str:
    return f"lead({name}, {h}) OVER (ORDER BY session) / {name} - 1"


def _roll(expr: str, x: str, n: int) -> str:
    w = f"(ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= {n} THEN {expr.format(w='OVER ' + w)} END"


_VRP = dict(
    wide=_WIDE, filled=_FF, spyr=_SPYR,
    rv="SELECT *, " + _roll("stddev_samp(r) {w}", "r", 20) + " * sqrt(252) * 100 AS rv FROM spyr",
    vrp="SELECT *, VIX * VIX - rv * rv AS vrp FROM rv",
    med="SELECT *, " + _roll("quantile_cont(vrp, 0.5) {w}", "vrp", 252) + " AS med FROM vrp")


@query("b06_h07_premium_filter", sql("bars cal", _SIGNAL.format(start=253, hold=21), **_VRP,
    sig=f"SELECT *, coalesce(vrp > med, false)::INT AS pos, {_f('SPY', 21)} AS fwd FROM med"))
def b06_h07(v: Views):
    return out(stg.premium_filter(v.wide(WIDE, carried=True)))


@query("b06_h08_absorption_switch")
def b06_h08(v: Views):
    """Absorption spike moves the book from long to hedge against short."""
    a = env.materialise(mx.absorption_before(_vectors(v)), "absorption")
    return out(stg.absorption_switch(v.wide(WIDE, carried=True), a))


@query("b07_leader_rules", " UNION ALL ".join(
    "SELECT '" + n + "' AS strategy, * FROM (" + sql(
        "bars cal", _SIGNAL.format(start=look + 1, hold=hold), wide=_WIDE,
        lv="SELECT *, ln({}) AS l FROM wide".format(f"{a} / {b}" if b else a),
        sig=f"""SELECT *, {sg} * sign(l - lag(l, {look}) OVER (ORDER BY session)) AS pos,
          {_f(fo, hold)} AS fwd FROM lv""") + ")"
    for n, a, b, fo, look, hold, sg in LEADER_RULES if a in WIDE and fo in WIDE))
def b07(v: Views):
    return stg.stack([stg.named(d, n) for n, d in stg.leader_rules(v.wide(WIDE, carried=True))]).select(
        "strategy", "session", pnl6())


@query("b08_month_turn", sql("bars cal", """
SELECT session, round(fwd - 0.001, 6) AS pnl FROM (SELECT session, SPY, """ + _f("SPY", 4) + """
  AS fwd, month(session) <> coalesce(month(lead(session) OVER (ORDER BY session)), -1) AS last_
  FROM wide) WHERE last_ AND fwd IS NOT NULL""", wide=_WIDE))
def b08(v: Views):
    return out(stg.month_turn(v.wide(WIDE, carried=True)))


@query("b09_pair_fade", sql("bars cal", """
SELECT session, round(avg(-sign(z) * 0.5 * (fa - fb) - 0.001), 6) AS pnl FROM z
WHERE sess_no >= 121 AND (sess_no - 121) % 21 = 0 AND sess_no < (SELECT count(*) FROM cal) - 21
  AND abs(z) >= 2 AND fa - fb IS NOT NULL GROUP BY 1""", wide=_WIDE,
    pairs=" UNION ALL ".join(f"SELECT '{n}' AS pair, session, sess_no, {a} AS a, {b} AS b FROM wide"
                             for n, (a, b) in SPREAD_PAIRS.items()),
    lr="""SELECT *, ln(a / b) AS s, lead(a, 21) OVER o / a - 1 AS fa, lead(b, 21) OVER o / b - 1
      AS fb FROM pairs WINDOW o AS (PARTITION BY pair ORDER BY session)""",
    z="""SELECT *, CASE WHEN count(s) OVER w >= 120 THEN (s - avg(s) OVER w)
      / nullif(stddev_samp(s) OVER w, 0) END AS z FROM lr
      WINDOW w AS (PARTITION BY pair ORDER BY session ROWS 119 PRECEDING)"""))
def b09(v: Views):
    return out(stg.pair_fade(v.wide(WIDE, carried=True)))


@query("b10_w01_overnight", sql("bars cal", """
SELECT min(session) AS session, round(coalesce(sum(x), 0), 6) AS pnl FROM (
 SELECT c.session, c.sess_no, b.open / lag(b.close) OVER (ORDER BY c.session) - 1 - 0.001 AS x
 FROM cal c LEFT JOIN bars b ON b.session = c.session AND b.instrument = 'SPY')
WHERE sess_no >= 1 AND (sess_no - 1) // 21 * 21 + 1 < (SELECT count(*) FROM cal) - 21
GROUP BY (sess_no - 1) // 21"""))
def b10_w01(v: Views):
    return out(stg.overnight_blocks(v.series("SPY", open="open", close="close")))


@query("b10_w03_managed_weight", sql("bars cal", _SIGNAL.format(start=273, hold=21), wide=_WIDE,
    filled=_FF, spyr=_SPYR, var="SELECT *, " + _roll("var_samp(r) {w}", "r", 20) + " AS v FROM spyr",
    med="SELECT *, " + _roll("quantile_cont(v, 0.5) {w}", "v", 252) + " AS m FROM var",
    sig=f"""SELECT *, CASE WHEN m / nullif(v, 0) IS NOT NULL THEN least(m / nullif(v, 0), 2) END
      AS pos, {_f('SPY', 21)} AS fwd FROM med"""))
def b10_w03(v: Views):
    return out(stg.managed_weight(v.wide(WIDE, carried=True)))


@query("b10_w09_winter", sql("bars cal", _SIGNAL.format(start=1, hold=21), wide=_WIDE,
    sig=f"""SELECT *, (month(session) IN (11, 12, 1, 2, 3, 4))::INT AS pos, {_f('SPY', 21)} AS fwd
      FROM wide"""))
def b10_w09(v: Views):
    return out(stg.winter_rule(v.wide(WIDE, carried=True)))


_SURFACE = dict(
    wide=_WIDE,
    z="SELECT *, VIX / VIX3M AS ts, " + ", ".join(
        _roll(f"({c} - avg({c}) {{w}}) / nullif(stddev_samp({c}) {{w}}, 0)", c, 156) + f" AS {c}_z"
        for c in ("SKEW", "VVIX")) + f", {_f('SPY', 21)} AS f21, {_f('SPY', 5)} AS f5, "
    f"{_f('TLT', 21)} AS h21 FROM wide")


@query("b11_surface_rules", " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, * FROM (" + sql(
        "bars cal", _SIGNAL.format(
            start=f"(SELECT min(sess_no) + 1 FROM z WHERE {x} IS NOT NULL)", hold=h),
        **_SURFACE, sig=f"SELECT *, {pos} AS pos, {fwd} AS fwd FROM z") + ")"
    for n, x, h, pos, fwd in [
        ("V1_ts_contango_timer", "ts", 21, "coalesce(ts < 1, false)::INT", "f21"),
        ("V3_skew_follow", "SKEW_z", 21, "coalesce(SKEW_z > 1, false)::INT", "f21"),
        ("V4_vvix_stress", "VVIX_z", 5, "coalesce(VVIX_z <= 1.5, false)::INT", "f5")]) + """
UNION ALL SELECT 'V2_backwardation_riskoff' AS strategy, * FROM (""" + sql("bars cal", """
SELECT session, round(gain - 0.0005 * abs(pos - lag(pos, 1, 0) OVER (ORDER BY sess_no)), 6) AS pnl
FROM (SELECT *, CASE WHEN off_ THEN -1 ELSE 1 END AS pos,
        CASE WHEN off_ THEN 0.5 * h21 - 0.5 * f21 ELSE f21 END AS gain
      FROM (SELECT *, ts > 1 AND h21 IS NOT NULL AS off_ FROM z WHERE ts IS NOT NULL))
WHERE gain IS NOT NULL AND sess_no >= (SELECT min(sess_no) + 1 FROM z WHERE ts IS NOT NULL)
  AND (sess_no - (SELECT min(sess_no) + 1 FROM z WHERE ts IS NOT NULL)) % 21 = 0
  AND sess_no < (SELECT count(*) FROM cal) - 21""", **_SURFACE) + ")")
def b11(v: Views):
    rules = stg.surface_rules(v.wide(WIDE, carried=True))
    return stg.stack([stg.named(d, n) for n, d in rules]).select(
        "strategy", "session", pnl6())


@query("b12_scheduled_events", sql("bars cal", """
SELECT kind, count(*) FILTER (e) AS n_event, count(*) FILTER (NOT e) AS n_control,
  round(avg(r) FILTER (e), 6) AS mean_event, round(avg(r) FILTER (NOT e), 6) AS mean_control,
  CASE WHEN count(*) FILTER (e) >= 11 THEN round((avg(r) FILTER (e) - avg(r) FILTER (NOT e)) / sqrt(
    var_samp(r) FILTER (e) / count(*) FILTER (e)
    + var_samp(r) FILTER (NOT e) / count(*) FILTER (NOT e)), 6) END AS welch_t
FROM (SELECT k.kind, w.session, CASE WHEN k.kind = 'E2_nfp_day' THEN session = m
    + CAST((12 - isodow(m)) % 7 AS INT) ELSE session + 5844 IN (SELECT CAST(d AS DATE) FROM (VALUES """
    + ", ".join(f"('{m}')" for m in tc.POLICY_MEETINGS) + """) t(d)) END AS e,
    SPY / lag(SPY) OVER (PARTITION BY k.kind ORDER BY session) - 1 AS r
  FROM (SELECT *, CAST(date_trunc('month', session) AS DATE) AS m FROM wide) w
  CROSS JOIN (VALUES ('E1_pre_fomc_drift'), ('E2_nfp_day')) k(kind))
WHERE r IS NOT NULL GROUP BY 1""", wide=_WIDE))
def b12(v: Views):
    spy = v.wide(["SPY"], carried=True).withColumn("r", fr.plain_return("SPY", 1, ("panel_id",)))
    kinds = [("E1_pre_fomc_drift", tc.is_meeting(F.date_add("session", 5844))),
             ("E2_nfp_day", F.col("session") == tc.first_friday("session"))]
    parts = [stg.scheduled_events(spy, e).withColumn("kind", F.lit(k)) for k, e in kinds]
    return stg.stack(parts).select(
        "kind", "n_event", "n_control",
        *[F.round(c, 6).alias(c) for c in ("mean_event", "mean_control", "welch_t")])


@query("b13_funding_fade", sql("rates bars", """
SELECT series_id, session, round(pos * fwd - 0.0005 * abs(pos - lag(pos, 1, 0) OVER (
  PARTITION BY series_id ORDER BY sess_no)), 6) + 0.0 AS pnl
FROM (SELECT *, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 WHEN z IS NOT NULL THEN 0 END AS pos,
  min(CASE WHEN z IS NOT NULL THEN sess_no END) OVER (PARTITION BY series_id) AS start
  FROM sig) WHERE sess_no >= start AND (sess_no - start) % 5 = 0 AND sess_no < size - 5
  AND pos IS NOT NULL AND fwd IS NOT NULL""",
    day="SELECT series_id, date, sum(rate) AS f FROM rates GROUP BY 1, 2",
    z="""SELECT series_id, date, lag(z) OVER (PARTITION BY series_id ORDER BY date) AS z FROM (
      SELECT *, CASE WHEN count(f) OVER w >= 60 THEN (f - avg(f) OVER w)
        / nullif(stddev_samp(f) OVER w, 0) END AS z FROM day
      WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 155 PRECEDING))""",
    btc="""SELECT session, close, row_number() OVER (ORDER BY session) - 1 AS sess_no,
      count(*) OVER () AS size, lead(close, 5) OVER (ORDER BY session) / close - 1 AS fwd
      FROM bars WHERE instrument = 'BTC'""",
    joined="""SELECT s.series_id, b.*, z.z FROM btc b CROSS JOIN
      (SELECT DISTINCT series_id FROM rates) s
      LEFT JOIN z ON z.series_id = s.series_id AND z.date = b.session""",
    sig="""SELECT series_id, session, sess_no, size, fwd, CASE WHEN sess_no - max(CASE WHEN z
      IS NOT NULL THEN sess_no END) OVER o <= 3 THEN last_value(z IGNORE NULLS) OVER o END AS z
      FROM joined WINDOW o AS (PARTITION BY series_id ORDER BY session ROWS UNBOUNDED PRECEDING)"""))
def b13(v: Views):
    own = v.bars().filter("instrument = 'BTC'")
    cal = v.calendar(own)
    feats = hs.daily_rate_features(v.daily_rates()).select(
        F.col("series_id").alias("panel_id"), "date", "z156")
    days = own.select("panel_id", "session", F.col("close").alias("price")).join(
        cal, ["panel_id", "session"])
    # the price calendar once per rate series: three registered series, one literal array
    series = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    days = days.withColumn("panel_id", F.explode(series))
    z = asof.exact_then_fill(days, feats, ["panel_id"], "session", "date", ["z156"], limit=3)
    pnl = stg.funding_fade(z.withColumnRenamed("z156", "z"))
    return pnl.select(F.col("panel_id").alias("series_id"), "session",
                      pnl6())


@query("b14_liquidity_trend", sql("bars cal levels tga", _SIGNAL.format(
    start="(SELECT min(sess_no) + 1 FROM sig WHERE chg IS NOT NULL)", hold=21), wide=_WIDE, **{
        **{"l_" + k if k == "wide" else k: b.replace("FROM wide", "FROM l_wide") for k, b in _LIQ.items()},
        "met": """SELECT session, sess_no, SPY, netliq_chg13w AS c FROM wide LEFT JOIN liq ON day = session
          AND netliq IS NOT NULL""",
        "sig": f"""SELECT *, coalesce(chg > 0, false)::DOUBLE AS pos FROM (SELECT session, sess_no,
          {_f('SPY', 21)} AS fwd, CASE WHEN sess_no - max(CASE WHEN c IS NOT NULL THEN sess_no END) OVER o <= 5
          THEN last_value(c IGNORE NULLS) OVER o END AS chg FROM met
          WINDOW o AS (ORDER BY session ROWS UNBOUNDED PRECEDING))"""}))
def b14(v: Views):
    """Long while the 13-week liquidity change, carried five sessions, is positive."""
    liq = hs.net_liquidity(v.levels(), ld.resolve_balances(v.balances()))
    wide = v.wide(["SPY"], carried=True)
    chg = asof.exact_then_fill(wide, liq.select("panel_id", "day", F.col("netliq_chg13w")
                                                .alias("chg")),
                               ["panel_id"], "session", "day", ["chg"], limit=5)
    return out(stg.liquidity_trend(chg))


def _position_signals(v: Views):
    daily = hs.daily_positions(hs.weekly_features(v.positions()), v.calendar())
    return daily.select("panel_id", F.col("asset").alias("instrument"), "session", "z156", "chg4w")


_POS = {"z156": "CASE WHEN z156 > 1.5 THEN -1 WHEN z156 < -1.5 THEN 1 ELSE 0 END",
        "chg4w": "sign(chg4w)"}
_POOLED = """SELECT p.session, p.instrument, {pos} * p.fwd - 0.001 AS pnl
  FROM (SELECT *, lead(close, 21) OVER (PARTITION BY instrument ORDER BY session) / close - 1 AS fwd
        FROM grid) p JOIN posday s ON s.asset = p.instrument AND s.session = p.session
  WHERE p.sess_no % 21 = 0 AND p.sess_no < (SELECT count(*) FROM cal) - 21
    AND {pos} <> 0 AND p.fwd IS NOT NULL"""


def _fade():
    return F.when(F.col("z156") > 1.5, -1.0).when(F.col("z156") < -1.5, 1.0).otherwise(0.0)


@query("b15_extreme_fade", sql("grid posday", """
SELECT session, round(avg(pnl), 6) AS pnl FROM legs GROUP BY 1""",
    legs=_POOLED.format(pos=_POS["z156"])))
def b15_fade(v: Views):
    return out(stg.pool(stg.pooled_positions(v.panel(), _position_signals(v), _fade())))


@query("b15_flow_momentum", sql("grid posday", """
SELECT session, round(avg(pnl), 6) AS pnl FROM legs GROUP BY 1""",
    legs=_POOLED.format(pos=_POS["chg4w"])))
def b15_flow(v: Views):
    return out(stg.pool(stg.pooled_positions(v.panel(), _position_signals(v), F.signum("chg4w"))))


def _flow_legs(v: Views):
    return stg.pooled_positions(v.panel(), _position_signals(v), F.signum("chg4w"))


@query("a05_contributions", sql("grid posday", """
SELECT instrument, count(*) AS legs, round(sum(pnl), 6) AS total, round(avg(pnl), 6) AS mean,
  row_number() OVER (ORDER BY sum(pnl) DESC) = 1 AS is_top FROM legs GROUP BY 1""",
    legs=_POOLED.format(pos=_POS["chg4w"])))
def a05(v: Views):
    per = _flow_legs(v).groupBy("panel_id", "instrument").agg(
        F.count("*").alias("legs"), F.sum("pnl").alias("total"), F.avg("pnl").alias("mean"))
    top = per.groupBy("panel_id").agg(F.max_by("instrument", "total").alias("top"))
    return per.join(top, "panel_id").select(
        "instrument", "legs", F.round("total", 6).alias("total"),
        F.round("mean", 6).alias("mean"), (F.col("instrument") == F.col("top")).alias("is_top"))


_STATS = """count(*) AS n, round(avg(pnl), 6) AS mean_pnl, round(avg((pnl > 0)::INT), 6) AS hit,
  round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)
    / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 0), 6) AS profit_factor"""


@query("a06_split_stats", sql("grid posday", f"""
SELECT part, {_STATS} FROM (
  SELECT 'full' AS part, session, avg(pnl) AS pnl FROM legs GROUP BY 2 UNION ALL
  SELECT CASE WHEN session < (SELECT s FROM mid) THEN 'first' ELSE 'second' END, session, avg(pnl)
    FROM legs GROUP BY session UNION ALL
  SELECT 'ex_top', session, avg(pnl) FROM legs WHERE instrument <> (SELECT instrument FROM legs
    GROUP BY 1 ORDER BY sum(pnl) DESC LIMIT 1) GROUP BY 2) GROUP BY 1""",
    legs=_POOLED.format(pos=_POS["chg4w"]),
    mid="""SELECT session AS s FROM (SELECT session, row_number() OVER (ORDER BY session) - 1 AS k,
      count(*) OVER () AS n FROM legs) WHERE k = n // 2"""))
def a06(v: Views):
    """Full, by half at the middle leg's date, and without the top contributor. One row
    per leg is tagged with every part it belongs to, so legs are scanned once."""
    legs = env.materialise(_flow_legs(v), "legs")
    top = (legs.groupBy("panel_id", "instrument").agg(F.sum("pnl").alias("t"))
               .groupBy("panel_id").agg(F.max_by("instrument", "t").alias("top")))
    # the middle leg's date from per-date counts, one row per session
    per = legs.groupBy("panel_id", "session").agg(F.count("*").alias("c"))
    w = fr.running(("panel_id",))
    per = per.withColumns({"cum": F.sum("c").over(w)})
    total = per.groupBy("panel_id").agg(F.max("cum").alias("n"))
    mid = per.join(total, "panel_id").filter(
        F.col("cum") > F.floor(F.col("n") / 2)).groupBy("panel_id").agg(
        F.min("session").alias("mid"))
    tagged = legs.join(top, "panel_id").join(mid, "panel_id")
    parts = F.array_compact(F.array(
        F.lit("full"), F.when(F.col("session") < F.col("mid"), "first").otherwise("second"),
        F.when(F.col("instrument") != F.col("top"), "ex_top")))
    pooled = tagged.select("panel_id", "session", "pnl", F.explode(parts).alias("part")).groupBy(
        "panel_id", "part", "session").agg(F.avg("pnl").alias("pnl"))
    stats = stg.summarise_pnls(pooled, ["part"])
    return stats.select("part", "n", *[F.round(c, 6).alias(c)
                                       for c in ("mean_pnl", "hit", "profit_factor")])




@query("b16_replication", sql("bars cal", f"""
SELECT strategy, {_STATS}, round(any_value(r.pf), 6) AS pf_recent,
  CASE WHEN count(*) < 30 THEN 'insufficient-history' WHEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)
    / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 0) > 1 AND any_value(r.pf) > 1
    THEN 'replicates' ELSE 'regime-specific' END AS verdict
FROM deep JOIN (SELECT strategy, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)
    / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 0) AS pf FROM recent GROUP BY 1) r
  USING (strategy) GROUP BY 1""", wide=_WIDE,
    sig=f"SELECT *, {_f('SPY', 4)} AS f4, month(session) <> coalesce(month(lead(session) OVER "
        "(ORDER BY session)), -1) AS last_ FROM wide",
    pnls="""SELECT 'H13_turn_of_month' AS strategy, session, f4 - 0.001 AS pnl FROM sig
      WHERE last_ AND f4 IS NOT NULL UNION ALL
      SELECT 'B_always_long', session, f4 FROM sig WHERE sess_no % 4 = 1
        AND sess_no < (SELECT count(*) FROM cal) - 4 AND f4 IS NOT NULL""",
    deep="SELECT * FROM pnls WHERE session <= DATE '1998-12-31'",
    recent="SELECT * FROM pnls WHERE session > DATE '1998-12-31'"))
def b16(v: Views):
    """Rules of the early sample against their profit factor in the recent one."""
    wide = v.wide(["SPY"], carried=True)
    pnls = stg.stack([stg.named(stg.month_turn(wide), "H13_turn_of_month"),
                      stg.named(stg.always_long(wide, hold=4), "B_always_long")])
    cut = F.lit("1998-12-31").cast("date")
    deep = stg.summarise_pnls(pnls.filter(F.col("session") <= cut), ["strategy"])
    recent = stg.summarise_pnls(pnls.filter(F.col("session") > cut), ["strategy"])
    return stg.replication(deep, recent).select(
        "strategy", "n", *[F.round(c, 6).alias(c) for c in ("mean_pnl", "hit", "profit_factor",
                                                            "pf_recent")], "verdict")


@query("b16_battery_replication")
def b16_battery(v: Views):
    """Every rule of the single-asset and pooled batteries, early sample against recent."""
    scored = env.materialise(stg.section_scores(v.carried()), "scores")
    wide = env.materialise(v.wide(WIDE, carried=True), "wide")
    absorbed = env.materialise(mx.absorption_before(_vectors(v)), "absorption")
    rules = [("H07_vrp_spy", stg.premium_filter(wide)),
             ("H08_absorption_shift", stg.absorption_switch(wide, absorbed)),
             *stg.leader_rules(wide), ("H13_turn_of_month", stg.month_turn(wide)),
             ("W03_vol_managed_spy", stg.managed_weight(wide)),
             ("W04_faber_sma", stg.above_average(scored)),
             ("W09_halloween", stg.winter_rule(wide))]
    pnls = env.materialise(stg.stack([stg.named(d, n) for n, d in rules]), "pnls")
    cut = F.lit("1998-12-31").cast("date")
    deep = stg.summarise_pnls(pnls.filter(F.col("session") <= cut), ["strategy"])
    recent = stg.summarise_pnls(pnls.filter(F.col("session") > cut), ["strategy"])
    return stg.replication(deep, recent).select(
        "strategy", "n", *[F.round(c, 6).alias(c) for c in ("mean_pnl", "hit", "profit_factor",
                                                            "pf_recent")], "verdict")


@query("b17_conditional_split", sql("bars cal", """
SELECT half, count(*) FILTER (c) AS n_on, count(*) FILTER (NOT c) AS n_off,
  round(avg(fwd) FILTER (c), 6) AS mean_on, round(avg(fwd) FILTER (NOT c), 6) AS mean_off,
  round((avg(fwd) FILTER (c) - avg(fwd) FILTER (NOT c)) / sqrt(var_samp(fwd) FILTER (c)
   / count(*) FILTER (c) + var_samp(fwd) FILTER (NOT c) / count(*) FILTER (NOT c)), 6) AS welch_t
FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY session) <= count(*) OVER () // 2 THEN 'first'
   ELSE 'second' END AS half FROM rows_) GROUP BY 1""", **_VRP,
    sig=f"SELECT *, coalesce(vrp > med, false) AS c, {_f('SPY', 21)} AS fwd FROM med",
    rows_="""SELECT * FROM sig WHERE sess_no >= 253 AND (sess_no - 253) % 21 = 0
      AND sess_no < (SELECT count(*) FROM cal) - 21 AND fwd IS NOT NULL"""))
def b17(v: Views):
    """Blocks split by the variance premium against its trailing median."""
    wide = stg.variance_premium(v.wide(["SPY", "VIX"], carried=True)).withColumns({
        "c": truthy(F.col("vrp") > F.col("vrp_median")), "fwd": fr.forward_return("SPY", 21, ("panel_id",))})
    rows = xs.block_rows(wide, 21, 253).filter("fwd is not null")
    halves = xs.split_halves(rows, ["panel_id"], "session")
    res = stg.welch_split(halves, "c", "fwd", ["half"])
    return res.select("half", "n_on", "n_off", *[F.round(c, 6).alias(c) for c in
                                                 ("mean_on", "mean_off", "welch_t")])


@query("b19_always_long", sql("bars cal", """
SELECT session, round(fwd, 6) AS pnl FROM (SELECT session, sess_no, """ + _f("SPY", 21) + """ AS fwd
  FROM wide) WHERE sess_no % 21 = 1 AND sess_no < (SELECT count(*) FROM cal) - 21
  AND fwd IS NOT NULL""", wide=_WIDE))
def b19(v: Views):
    return out(stg.always_long(v.wide(["SPY"], carried=True)))


# --- gate ----------------------------------------------------------------------

def _event_pnls(v: Views):
    """Each instrument held every fifth session: one PnL series per instrument."""
    p = v.panel().withColumn("pnl", fr.forward_return("close", 5))
    return xs.block_rows(p, 5, 1).filter("pnl is not null").select(
        "panel_id", F.col("instrument").alias("strategy"), "session", "sess_no",
        F.round("pnl", 9).alias("pnl"))


_EVENTS = """SELECT instrument AS strategy, session, sess_no, round(fwd, 9) AS pnl FROM (
  SELECT *, lead(close, 5) OVER (PARTITION BY instrument ORDER BY session) / close - 1 AS fwd
  FROM grid) WHERE sess_no % 5 = 1 AND sess_no < (SELECT count(*) FROM cal) - 5
  AND fwd IS NOT NULL"""
_DSR = f"""SELECT strategy, count(*) AS n, avg(pnl) / stddev_samp(pnl) AS sr,
  sqrt(greatest(1 - g3 * avg(pnl) / stddev_samp(pnl) + (g4 + 2) / 4
    * (avg(pnl) / stddev_samp(pnl)) ** 2, 0) / (count(*) - 1)) AS sigma_sr
  FROM (SELECT *, avg(dev ** 3) OVER s / (avg(dev ** 2) OVER s) ** 1.5 AS g3,
    avg(dev ** 4) OVER s / (avg(dev ** 2) OVER s) ** 2 - 3 AS g4
    FROM (SELECT *, pnl - avg(pnl) OVER (PARTITION BY strategy) AS dev FROM pnls)
    WINDOW s AS (PARTITION BY strategy)) GROUP BY 1, g3, g4"""


@query("b20_deflated_sharpe", sql("grid", f"""
SELECT strategy, n, round(sr, 6) AS sr, round(sigma_sr, 6) AS sigma_sr,
  round(sr / sigma_sr, 5) AS psr_z, round(sr / sigma_sr - {expected_max_z(117)!r}, 5) AS ratio,
  round({expected_max_z(117)!r} * sigma_sr, 6) AS sr_star FROM dsr""", pnls=_EVENTS, dsr=_DSR))
def b20(v: Views):
    d = gate.deflated_sharpe(_event_pnls(v), ["strategy"], 117)
    return d.select("strategy", "n", *[F.round(c, 6).alias(c) for c in ("sr", "sigma_sr",
                                                                        "sr_star")],
                    F.round("psr_z", 5).alias("psr_z"), F.round("ratio", 5).alias("ratio"))


_PBO = dict(
    pnls=_EVENTS,
    placed="""SELECT *, ((row_number() OVER (PARTITION BY strategy ORDER BY sess_no) - 1) * 10
      // count(*) OVER (PARTITION BY strategy))::INT AS b FROM pnls""",
    splits="SELECT i::INT AS split FROM range(1024) t(i) WHERE bit_count(i) = 5",
    sides="""SELECT split, strategy, (split >> b) & 1 = 1 AS inside,
      round(avg(pnl) / nullif(stddev_samp(pnl), 0), 10) AS sr FROM placed CROSS JOIN splits
      GROUP BY 1, 2, 3""",
    pair="""SELECT a.split, a.strategy, a.sr AS si, rank() OVER (PARTITION BY a.split ORDER BY o.sr)
      / (count(*) OVER (PARTITION BY a.split) + 1.0) AS omega
      FROM sides a JOIN sides o ON a.split = o.split AND a.strategy = o.strategy
      WHERE a.inside AND NOT o.inside""",
    best="SELECT split, arg_max(omega, si) AS omega FROM pair GROUP BY 1")


@query("b21_overfit_probability", sql("grid", """
SELECT count(*) AS n_splits, round(avg((ln(omega / (1 - omega)) <= 0)::INT), 6) AS pbo
FROM best""", **_PBO))
def b21(v: Views):
    res = gate.overfit_probability(_event_pnls(v))
    return res.select("n_splits", F.round("pbo", 6).alias("pbo"))


@query("b22_gate_verdict", sql("grid", f"""
SELECT strategy, ratio > 1.645 AND pbo < 0.5 AS passes, len(list_filter([ratio <= 1.645, pbo >= 0.5],
  lambda x: x)) AS n_reasons
FROM (SELECT strategy, sr / sigma_sr - {expected_max_z(2)!r} AS ratio FROM dsr) CROSS JOIN
  (SELECT avg((ln(omega / (1 - omega)) <= 0)::INT) AS pbo FROM best)""", **_PBO, dsr=_DSR))
def b22(v: Views):
    pnls = env.materialise(_event_pnls(v), "pnls")
    stats = gate.deflated_sharpe(pnls, ["panel_id", "strategy"], 2)
    pbo = gate.overfit_probability(pnls)
    verdict = gate.gate_verdict(stats.join(pbo, "panel_id"))
    return verdict.select("strategy", "passes", F.size("reasons").alias("n_reasons"))
