"""Feature, label, fold and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.functions import calendar as tc
from tidepanel.functions import frames as fr
from tidepanel.operators import boosting as bt
from tidepanel.operators import gate
from tidepanel.operators import matrices as mx
from tidepanel.operators import model
from tidepanel.operators import histories as hs
from tidepanel.operators import asof
from tidepanel.operators import sections as xs
from tidepanel.plans.catalog.alignment import _LIQ
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.state import State
from tidepanel.plans.views import Views
from tidepanel.sources import store as st
from tidepanel.universe import MACRO_FORCE, RISK_BASKET

_W = "OVER (PARTITION BY instrument ORDER BY session ROWS {n} PRECEDING)"


def _over(n: int) -> str:
    return _W.format(n=n - 1)


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("m01_features", sql("carried", f"""
SELECT instrument, session, round((close - open) / open, 6) AS bar_mid,
  round((high - greatest(open, close)) / open, 6) AS bar_up,
  round(lag(close, 20) OVER (PARTITION BY instrument ORDER BY session) / close, 6) AS roc_20,
  CASE WHEN count(close) {_over(20)} >= 20 THEN round(avg(close) {_over(20)} / close, 6) END
    AS mean_20, CASE WHEN count(close) {_over(20)} >= 20 THEN
    round(min(low) {_over(20)} / close, 6) END AS min_20,
  CASE WHEN count(ret) {_over(20)} >= 20 THEN round(avg((ret > 0)::INT) {_over(20)}, 6) END
    AS up_share_20,
  CASE WHEN count(volume) {_over(20)} >= 20 THEN round(avg(volume) {_over(20)}
    / nullif(volume, 0), 9) END AS vol_mean_20 FROM carried"""))
def m01(v: Views):
    return model.with_features(v.carried()).select(
        "instrument", "session", *[r(c) for c in ("bar_mid", "bar_up", "roc_20", "mean_20",
                                                  "min_20", "up_share_20")], r("vol_mean_20", 9))


@query("m02_labels", sql("carried", """
SELECT instrument, session, round(lead(close, 5) OVER o / close - 1, 6) AS label_5,
  round(lead(close, 21) OVER o / close - 1, 6) AS label_21
FROM carried WINDOW o AS (PARTITION BY instrument ORDER BY session)"""))
def m02(v: Views):
    return model.with_labels(v.carried()).select("instrument", "session", r("label_5"),
                                                 r("label_21"))


def context(v: Views):
    """Market-wide columns per session, in one as-of frame: factor concentration and co-movement of the risk
    basket, stress, curve, volatility level, premium, term, tails, momentum, liquidity and calendar."""
    one = ("panel_id",)
    state = State(v)
    wide = state.v.wide(["SPY", "HYG", "LQD", "TIP", "TLT", "VIX", "VIX3M", "SKEW", "VVIX", "DXY", "GOLD"], carried=True)
    for c, n, name in (("SPY", 1, "__r"), ("SPY", 20, "ctx_spy_mom20"), ("DXY", 20, "ctx_dxy_mom20"),
                       ("GOLD", 20, "ctx_gold_mom20"), ("VIX", 5, "ctx_vix_chg5")):
        wide = fr.with_padded_return(wide, c, name, n, one)
    wide = wide.withColumns({"__credit": F.ln(F.col("HYG") / F.col("LQD")),
                             "__curve": F.ln(F.col("TIP") / F.col("TLT")), "__vix": F.col("VIX") / 100,
                             "ctx_spy_vol20": fr.rolling_std("__r", 20, one)})
    realised = F.col("ctx_spy_vol20") * F.lit(252 ** 0.5 * 100)
    rows = wide.select(
        "panel_id", "session", "sess_no", "ctx_spy_mom20", "ctx_dxy_mom20", "ctx_gold_mom20", "ctx_vix_chg5", "ctx_spy_vol20",
        fr.rolling_zscore("__credit", 120, one).alias("ctx_credit_stress"),
        fr.rolling_zscore("__curve", 120, one).alias("ctx_curve"), F.col("__vix").alias("ctx_vix"),
        (F.col("__vix") * F.col("__vix") - realised * realised).alias("ctx_vrp"),
        (F.col("VIX") / F.col("VIX3M")).alias("ctx_vix_ts"),
        fr.rolling_zscore("SKEW", 156, one).alias("ctx_skew_z"), fr.rolling_zscore("VVIX", 156, one).alias("ctx_vvix_z"),
        tc.days_to_next_meeting("session").alias("ctx_days_to_fomc"))
    vectors = env.materialise(mx.pack(state.v.panel(), RISK_BASKET, "ret"), "risk-returns")
    at = ["panel_id", "sess_no"]
    rows = rows.join(mx.absorption_before(vectors).withColumnRenamed("absorption", "ctx_absorption"), at, "left")
    rows = rows.join(mx.average_corr_before(vectors).withColumnRenamed("avg_corr", "ctx_avg_corr"), at, "left")
    liquidity = state.liquidity().select("panel_id", "day", F.col("netliq_chg13w_z").alias("ctx_netliq_chg13w_z"))
    return asof.exact_then_fill(rows.drop("sess_no"), liquidity, ["panel_id"], "session", "day", ["ctx_netliq_chg13w_z"])


CONTEXT = ["ctx_absorption", "ctx_avg_corr", "ctx_credit_stress", "ctx_curve", "ctx_vix", "ctx_vix_chg5", "ctx_vrp",
           "ctx_spy_vol20", "ctx_spy_mom20", "ctx_dxy_mom20", "ctx_gold_mom20", "ctx_vix_ts", "ctx_skew_z", "ctx_vvix_z",
           "ctx_netliq_chg13w_z", "ctx_days_to_fomc"]


def _r20(name: str) -> str:
    return f"max(ff / lag20 - 1) FILTER (instrument = '{name}')"


def _z(c: str, n: int) -> str:
    w = f"OVER (ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {w} >= {n} THEN ({c} - avg({c}) {w}) / nullif(stddev_samp({c}) {w}, 0) END"


_RISK = ", ".join(f"'{n}'" for n in RISK_BASKET)
_CONTEXT = dict(
    _LIQ, one=f"""SELECT session, sess_no, {_r20('SPY')} AS spy_mom20, {_r20('DXY')} AS dxy_mom20,
        {_r20('GOLD')} AS gold_mom20, max(ff / lag5 - 1) FILTER (instrument = 'VIX') AS vix_chg5,
        max(ret) FILTER (instrument = 'SPY') AS r, """ + ", ".join(
        f"max(ff) FILTER (instrument = '{n}') AS {n.lower()}" for n in (
            "HYG", "LQD", "TIP", "TLT", "VIX", "VIX3M", "SKEW", "VVIX")) + """
      FROM (SELECT *, lag(ff, 20) OVER w AS lag20, lag(ff, 5) OVER w AS lag5 FROM panel
            WINDOW w AS (PARTITION BY instrument ORDER BY session)) GROUP BY 1, 2""",
    two="""SELECT *, ln(hyg / lqd) AS credit, ln(tip / tlt) AS curve, CASE WHEN count(r) OVER w >= 20 THEN
      stddev_samp(r) OVER w END AS spy_vol20 FROM one WINDOW w AS (ORDER BY session ROWS 19 PRECEDING)""",
    ac="""SELECT s.sess_no, CASE WHEN count(*) >= 10 THEN avg(c) END AS avg_corr FROM
      (SELECT sess_no FROM cal WHERE sess_no >= 20) s LEFT JOIN (SELECT sess_no, CASE WHEN sx > 0
        AND sy > 0 THEN c END AS c FROM (SELECT a.sess_no, corr(a.ret, b.ret) OVER w AS c,
          count(a.ret) OVER w AS nx, count(b.ret) OVER w AS ny, stddev_samp(a.ret) OVER w AS sx,
          stddev_samp(b.ret) OVER w AS sy FROM panel a JOIN panel b ON a.session = b.session
          AND a.instrument < b.instrument
        WHERE a.instrument IN (""" + _RISK + """) AND b.instrument IN (""" + _RISK + """)
        WINDOW w AS (PARTITION BY a.instrument, b.instrument ORDER BY a.session
          ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE nx = 20 AND ny = 20) x USING (sess_no) GROUP BY 1""",
    nl="""SELECT c.session AS day, last_value(l.netliq_chg13w_z IGNORE NULLS) OVER (ORDER BY c.session ROWS UNBOUNDED PRECEDING) AS z
      FROM cal c LEFT JOIN liq l ON l.day = c.session""",
    ctx=f"""SELECT t.session, spy_mom20, dxy_mom20, gold_mom20, vix_chg5, spy_vol20, {_z('credit', 120)} AS credit_stress,
      {_z('curve', 120)} AS curve, vix / 100 AS vix, vix * vix / 10000 - 252 * 10000 * spy_vol20 * spy_vol20 AS vrp,
      vix / vix3m AS vix_ts, {_z('skew', 156)} AS skew_z, {_z('vvix', 156)} AS vvix_z, avg_corr, z AS netliq_chg13w_z
      FROM two t LEFT JOIN ac USING (sess_no) LEFT JOIN nl ON nl.day = t.session""")
#: Columns of the context that SQL states; the eigenvalue share (x04) and the calendar (t05) have queries of their own.
_STATED = [c for c in CONTEXT if c not in ("ctx_absorption", "ctx_days_to_fomc")]


@query("m03_augmented", sql("panel posday levels tga", "SELECT p.instrument, p.session, " + ", ".join(
    f"round({c[4:]}, 6) AS {c}" for c in _STATED) + """, round(q.z156, 6) AS cot_z156, round(q.idx52, 6) AS cot_idx52
FROM panel p JOIN ctx c USING (session) LEFT JOIN posday q ON q.asset = p.instrument AND q.session = p.session""",
    **_CONTEXT))
def m03(v: Views):
    return _augmented(v, v.panel().select(*fr.SERIES, "session")).select(
        "instrument", "session", *[r(c) for c in _STATED], r("cot_z156"), r("cot_idx52"))


def _augmented(v: Views, rows):
    """Rows with the positioning known on their session and the session's context."""
    feats = hs.weekly_features(v.positions()).withColumnRenamed("asset", "instrument")
    rows = asof.asof_backward(rows, feats, fr.SERIES, "session", "effective_date", ["z156", "idx52"])
    rows = rows.withColumnsRenamed({"z156": "cot_z156", "idx52": "cot_idx52"})
    return model.augment(rows, context(v))


@query("m04_purged_folds", sql("cal grid", """
SELECT k::INT AS fold, count(*) FILTER (sess_no < 750 + 126 * k - 21 AND label IS NOT NULL) AS n_train,
  CAST(max(sess_no + 21) FILTER (sess_no < 750 + 126 * k - 21) - (750 + 126 * k) AS INT)
    AS last_label_gap,
  count(*) FILTER (sess_no >= 750 + 126 * k AND sess_no < 750 + 126 * (k + 1)) AS n_scored
FROM (SELECT *, lead(close, 21) OVER (PARTITION BY instrument ORDER BY session) / close - 1 AS label
      FROM grid) JOIN range(0, 14) f(k) ON true GROUP BY k"""))
def m04(v: Views):
    """Training and scoring sizes per fold, and how far the last training label ends
    before the refit (never after it)."""
    p = v.panel().withColumn("label", fr.forward_return("close", 21))
    n = F.col("n_sessions")
    per = p.groupBy("sess_no", "n_sessions").agg(F.count("label").alias("labels"),
                                                 F.count("*").alias("rows"))
    folds = F.sequence(F.lit(0), F.ceil((n - 750) / 126).cast("int") - 1)
    rows = per.withColumn("fold", F.explode(folds)).withColumn("at", F.col("fold") * 126 + 750)
    train = F.col("sess_no") < F.col("at") - 21
    live = (F.col("sess_no") >= F.col("at")) & (F.col("sess_no") < F.col("at") + 126)
    return rows.groupBy("fold").agg(
        F.sum(F.when(train, F.col("labels")).otherwise(0)).alias("n_train"),
        F.max(F.when(train, F.col("sess_no") + 21 - F.col("at"))).alias("last_label_gap"),
        F.sum(F.when(live, F.col("rows")).otherwise(0)).alias("n_scored"))


BASE = model.feature_names()
VARIANTS = {"base": BASE, "augmented": [*BASE, *CONTEXT, "cot_z156", "cot_idx52"]}
HORIZONS = (5, 21)
MIN_TRAIN = 750


def _scores(v: Views, variants=VARIANTS):
    """Out-of-sample scores of every variant, horizon and fold, from one run on one binned table."""
    v = v.settle()
    rows = _augmented(v, model.with_labels(model.with_features(v.carried()), HORIZONS))
    names = VARIANTS["augmented"]
    table = bt.binned(rows, names, HORIZONS, F.col("sess_no") < MIN_TRAIN)
    fits = bt.walk_forward_fits(variants, names, HORIZONS, v.calendar().count(), MIN_TRAIN)
    grown = bt.grow(table, fits, len(names))
    return env.materialise(bt.scores(table, fits, grown, len(names)), "scores")


@query("m04_walk_forward")
def m04_scores(v: Views):
    """Scores of every session from the first refit on: both horizons, refit each 126 sessions, all features."""
    out = model.score_history(_scores(v, {"augmented": VARIANTS["augmented"]}), by=("variant", "horizon"))
    return out.select("session", "instrument", "horizon", "fold", r("score", 9), r("rank_pct"), "lean")


@query("m05_model_pnl")
def m05(v: Views):
    scored = _scores(v, {"augmented": VARIANTS["augmented"]})
    return model.trial_pnls(scored, HORIZONS, MIN_TRAIN).select("horizon", "session", r("pnl", 9))


def _combined(scored):
    ranked = model.score_history(scored, by=("variant", "horizon"))
    frames = {h: ranked.where(F.col("horizon") == h) for h in HORIZONS}
    force = F.create_map(*[F.lit(x) for kv in MACRO_FORCE.items() for x in kv])
    return xs.combine_horizons(frames, ["panel_id", "session", "instrument"]).withColumn(
        "force", F.coalesce(force[F.col("instrument")], F.lit("other")))


@query("m06_latest_scores")
def m06(v: Views):
    """Newest scored session: scores, ranks and leans of both horizons, conviction and force."""
    rows = env.materialise(_combined(_scores(v, {"augmented": VARIANTS["augmented"]})), "combined")
    last = rows.groupBy("panel_id").agg(F.max("session").alias("session"))
    return rows.join(last, ["panel_id", "session"]).drop("panel_id")


@query("k09_score_export")
def k09(v: Views):
    """Scores written by horizon and fold, the second horizon's last fold written again; the summary is
    taken from what was written, before and after."""
    scored = _scores(v, {"augmented": VARIANTS["augmented"]})
    ranked = env.materialise(model.score_history(scored, by=("variant", "horizon")), "ranked")
    path = env.scratch_path(v.spark, "score-history")
    stages = []
    for step, part in enumerate((ranked, ranked.where("horizon = 21").where(
            F.col("fold") == ranked.where("horizon = 21").agg(F.max("fold")).first()[0]))):
        written = st.export_scores(v.spark, path, part)
        # kept before the next write replaces files that this summary reads
        stages.append(env.materialise(st.export_metadata(written, MIN_TRAIN).withColumn("write", F.lit(step)), "metadata"))
    return stages[0].unionByName(stages[1])


@query("m07_gated_trials")
def m07(v: Views):
    """Every variant x horizon is a trial of one run; a variant is promoted if the gate passes all its trials."""
    pnls = env.materialise(model.trial_pnls(_scores(v), HORIZONS, MIN_TRAIN), "trial-pnls")
    trials = gate.gated_trials(pnls, len(VARIANTS) * len(HORIZONS))
    return trials.select("variant", "horizon", "n", r("ratio"), r("pbo"), r("profit_factor"), "first_oos", "last_oos",
                         "passes", "promoted", "n_trials")


_TRIALS = dict(
    px="""SELECT *, close / lag(close, 20) OVER w - 1 AS mom, lead(close, 5) OVER w / close - 1 AS f5,
      lead(close, 21) OVER w / close - 1 AS f21 FROM carried WINDOW w AS (PARTITION BY instrument ORDER BY session)""",
    sl=" UNION ALL ".join(f"""SELECT '{name}' AS variant, {h} AS horizon, session, sess_no, instrument, {sign}mom AS score,
      f{h} AS label FROM px WHERE sess_no >= 750 AND (sess_no - 750) % {h} = 0 AND mom IS NOT NULL
      AND sess_no < (SELECT count(*) FROM cal) - {h}""" for name, sign in (("follow", ""), ("fade", "-")) for h in (5, 21)),
    rk="""SELECT *, row_number() OVER (PARTITION BY variant, horizon, session ORDER BY score DESC, instrument) AS r,
      count(*) OVER (PARTITION BY variant, horizon, session) AS n FROM sl""",
    pnls="""SELECT variant, horizon, session, sess_no, avg(label) FILTER (r <= 8) - avg(label) FILTER (r > n - 8)
      - 4 * 0.0005 / 2 AS pnl FROM rk WHERE n >= 17 GROUP BY ALL""",
    mo="""SELECT variant, horizon, count(pnl) AS n, avg(pnl) / nullif(stddev_samp(pnl), 0) AS sr,
      avg(pnl) AS m, var_pop(pnl) AS v FROM pnls GROUP BY 1, 2""",
    hi="""SELECT p.variant, p.horizon, avg((pnl - m) ** 3) / v ** 1.5 AS g3, avg((pnl - m) ** 4) / v ** 2 AS g4
      FROM pnls p JOIN mo USING (variant, horizon) GROUP BY p.variant, p.horizon, v""")


@query("m07_trial_moments", sql("carried cal", """
SELECT variant, horizon, n, round(sr, 6) AS sr,
  round(sr / sqrt((1 - g3 * sr + (g4 - 1) / 4 * sr * sr) / (n - 1)), 6) AS psr_z, 4 AS n_trials
FROM mo JOIN hi USING (variant, horizon)""", **_TRIALS))
def m07_moments(v: Views):
    """The trials' block results and their corrected Sharpe ratios, for scores that SQL can state: momentum followed
    and faded, both horizons."""
    rows = model.with_labels(v.carried()).withColumn("mom", fr.plain_return("close", 20))
    made = F.explode(F.array(*[F.struct(
        F.lit(n).alias("variant"), F.lit(h).cast("long").alias("horizon"), (F.lit(s) * F.col("mom")).alias("score"),
        F.col(f"label_{h}").alias("label")) for n, s in (("follow", 1.0), ("fade", -1.0)) for h in HORIZONS]))
    scored = rows.select(*fr.SERIES, "session", "sess_no", "n_sessions", made.alias("t")).select(
        *fr.SERIES, "session", "sess_no", "n_sessions", "t.*")
    pnls = model.trial_pnls(scored, HORIZONS, MIN_TRAIN)
    out = gate.deflated_sharpe(pnls, ["panel_id", "variant", "horizon"], 4)
    return out.select("variant", "horizon", "n", r("sr"), r("psr_z"), F.lit(4).alias("n_trials"))
