"""Correlation matrices, eigen summaries, registry analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.operators import matrices as mx
from tidepanel.operators import rules as ru
from tidepanel.plans import registries as rg
from tidepanel.plans.catalog.rules import _SURF
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.state import State
from tidepanel.plans.views import BRAND_INSTRUMENTS, PRIORITY_ASSETS, Views
from tidepanel.universe import POSITIONED, RISK_BASKET

NAMES = BRAND_INSTRUMENTS


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _recent(v: Views, names=NAMES):
    p = v.panel().filter(F.col("sess_no") >= F.col("n_sessions") - 60)
    return mx.pack(p, names, "ret")


_PAIR = """SELECT a.instrument AS a, b.instrument AS b, corr(a.ret, b.ret) AS corr,
  count(*) AS n FROM panel a JOIN panel b ON a.session = b.session
  WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.sess_no >= (SELECT count(*) FROM cal) - 60
  GROUP BY 1, 2"""


@query("x01_corr_matrix", sql("panel cal", """
SELECT a, b, round(corr, 6) AS corr, n FROM m""", m=_PAIR))
def x01(v: Views):
    return mx.corr_matrix(_recent(v), NAMES).select("a", "b", r("corr"), "n")


@query("j17_pair_moments", sql("panel", """
SELECT a.instrument AS a, b.instrument AS b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS corr
FROM panel a JOIN panel b ON a.session = b.session AND a.instrument < b.instrument
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2"""))
def j17(v: Views):
    """All unordered pairs over the whole history, without pairing rows."""
    return mx.corr_matrix(mx.pack(v.panel(), NAMES, "ret"), NAMES).filter("a < b").select(
        "a", "b", "n", r("corr"))


@query("x02_eigen_summary")
def x02(v: Views):
    m = mx.corr_matrix(_recent(v, POSITIONED), POSITIONED)
    return mx.eigen_summary(m).select(r("absorption"), r("top1_share"), "n_assets")


@query("x03_rolling_structure")
def x03(v: Views):
    return State(v).structure().select("sess_no", r("absorption"), r("top1_share"),
                                       "n_struct_assets")


@query("x04_absorption_before")
def x04(v: Views):
    vec = mx.pack(v.panel(), RISK_BASKET, "ret")
    return mx.absorption_before(vec).select("sess_no", r("absorption"))


#: Mean correlation of the basket's pairs over the 20 sessions before each one.
AVERAGE_CORR = """SELECT s.sess_no, CASE WHEN count(*) >= 10 THEN avg(c) END AS avg_corr FROM
 (SELECT sess_no FROM cal WHERE sess_no >= 20) s LEFT JOIN (SELECT sess_no, CASE WHEN sx > 0
   AND sy > 0 THEN c END AS c FROM (SELECT a.sess_no, corr(a.ret, b.ret) OVER w AS c, count(*) OVER w AS n,
   count(a.ret) OVER w AS nx, count(b.ret) OVER w AS ny, stddev_samp(a.ret) OVER w AS sx,
   stddev_samp(b.ret) OVER w AS sy FROM panel a JOIN panel b ON a.session = b.session
   AND a.instrument < b.instrument
  WHERE a.instrument IN (""" + ", ".join(f"'{n}'" for n in RISK_BASKET) + """)
    AND b.instrument IN (""" + ", ".join(f"'{n}'" for n in RISK_BASKET) + """)
  WINDOW w AS (PARTITION BY a.instrument, b.instrument ORDER BY a.session
    ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE nx = 20 AND ny = 20) x USING (sess_no)
GROUP BY 1"""


@query("x05_average_corr", sql("panel", "SELECT sess_no, round(avg_corr, 6) AS avg_corr FROM avg_corr",
                               avg_corr=AVERAGE_CORR))
def x05(v: Views):
    vec = mx.pack(v.panel(), RISK_BASKET, "ret")
    return mx.average_corr_before(vec).select("sess_no", r("avg_corr"))


@query("x06_participation_ratio", sql("panel cal", """
SELECT round(sum(corr) FILTER (a = b) ** 2 / sum(corr * corr), 6) AS participation_ratio
FROM m""", m=_PAIR))
def x06(v: Views):
    return mx.participation_ratio(mx.corr_matrix(_recent(v), NAMES)).select(
        r("participation_ratio"))


@query("x06_effective_dimension")
def x06_dim(v: Views):
    return mx.effective_dimension(mx.corr_matrix(_recent(v), NAMES)).drop("panel_id")


_SPEAR = dict(
    cc="""SELECT session FROM panel GROUP BY 1 HAVING count(ff) = 25""",
    rk="""SELECT session, instrument, rank() OVER (PARTITION BY instrument ORDER BY ff)
      + (count(*) OVER (PARTITION BY instrument, ff) - 1) / 2.0 AS rk
      FROM panel WHERE session IN (SELECT session FROM cc)""",
    sm="""SELECT a.instrument AS a, b.instrument AS b, corr(a.rk, b.rk) AS corr FROM rk a
      JOIN rk b ON a.session = b.session GROUP BY 1, 2""")


def _levels(v: Views):
    p = v.carried()
    cells = [F.max(F.when(F.col("instrument") == n, F.col("close"))).alias(n) for n in NAMES]
    wide = p.groupBy(*rg.KEYS).agg(*cells)
    return rg.surviving(wide)


@query("x07_spearman_matrix", sql("panel", """
SELECT a, b, round(corr, 6) AS corr FROM sm""", **_SPEAR))
def x07(v: Views):
    full, names = _levels(v)
    return rg.spearman_matrix(full, names).select("a", "b", r("corr"))


@query("o04_top_pairs", sql("panel", """
SELECT a, b, round(abs(corr), 6) AS abs_corr FROM sm WHERE a < b
ORDER BY abs(corr) DESC, a, b LIMIT 15""", **_SPEAR))
def o04(v: Views):
    full, names = _levels(v)
    return rg.top_pairs(rg.spearman_matrix(full, names)).select("a", "b", r("abs_corr"))


@query("x08_families")
def x08(v: Views):
    full, names = _levels(v)
    return mx.families(rg.spearman_matrix(full, names)).drop("panel_id")


_SMOOTHED = """SELECT instrument, session, CASE WHEN count(ff) OVER w >= 60 THEN
  round(avg(ff) OVER w, 6) END AS value FROM panel
  WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS 59 PRECEDING)"""


@query("w35_decorrelation", sql("panel", """
SELECT x.instrument AS reading, coalesce(min(lag) FILTER (ac < exp(-1) OR ac IS NULL), 500)
  AS decorrelation FROM (SELECT DISTINCT instrument FROM sm WHERE value IS NOT NULL) x
LEFT JOIN ac ON ac.instrument = x.instrument GROUP BY 1""", sm=_SMOOTHED,
    nn="""SELECT instrument, value, row_number() OVER (PARTITION BY instrument ORDER BY session) AS k,
      count(*) OVER (PARTITION BY instrument) AS n FROM sm WHERE value IS NOT NULL""",
    ac="""SELECT a.instrument, l.lag, corr(a.value, b.value) AS ac FROM range(1, 500) l(lag)
      JOIN nn a ON l.lag < a.n - 10 JOIN nn b ON b.instrument = a.instrument AND b.k = a.k - l.lag
      GROUP BY 1, 2"""))
def w35(v: Views):
    from tidepanel.functions import frames as fr
    p = v.carried().withColumn("value", F.round(fr.rolling_mean("close", 60), 6))
    out = mx.decorrelation_times(p.withColumnRenamed("instrument", "reading"))
    return out.select("reading", "decorrelation")


@query("p08_numeric_registry")
def p08(v: Views):
    panel = State(v, keep=True).panel()
    return rg.numeric_registry(panel).drop("panel_id")


@query("p09_coverage", sql("grid", """
SELECT instrument AS "column", count(close) AS n, min(session) FILTER (close IS NOT NULL) AS first,
  max(session) FILTER (close IS NOT NULL) AS last,
  round_even(1 - count(close) / count(*), 4) AS pct_null FROM grid GROUP BY 1"""))
def p09(v: Views):
    return rg.coverage(v.wide(NAMES), NAMES)


@query("p10_surviving_columns", sql("grid", """
SELECT instrument AS reading, count(close) AS n FROM grid GROUP BY 1
HAVING count(close) >= 1500 AND stddev_samp(close) > 0"""))
def p10(v: Views):
    p = v.panel().groupBy(F.col("instrument").alias("reading")).agg(
        F.count("close").alias("n"), F.stddev_samp("close").alias("sd"))
    return p.filter("n >= 1500 and sd > 0").drop("sd")


@query("p11_complete_case", sql("grid", """
SELECT session, round(sum(close), 4) AS total FROM grid WHERE instrument IN ('SPY', 'TLT', 'GOLD')
GROUP BY 1 HAVING count(close) = 3"""))
def p11(v: Views):
    w = v.wide(["SPY", "TLT", "GOLD"]).na.drop("any", subset=["SPY", "TLT", "GOLD"])
    return w.select("session", F.round(F.col("SPY") + F.col("TLT") + F.col("GOLD"), 4)
                    .alias("total"))


@query("x09_registry_report")
def x09(v: Views):
    """Effective dimension of the state panel's readings by scope and mode, and of the whole market."""
    state = State(v, keep=True)
    dims, _ = rg.registry_report(state.panel(), state.v.panel(), NAMES)
    return dims.drop("panel_id")


@query("k18_registry_report")
def k18(v: Views):
    """The report as long rows: dimensions, episodes, pairs, families, readings."""
    state = State(v, keep=True)
    _, long = rg.registry_report(state.panel(), state.v.panel(), NAMES)
    return long.select("section", "item", "metric", r("value"))


_SOLID = {"vol_vix": "vix", "vol_rv20": "rv20", "vol_vrp": "vrp", "vol_term_ratio": "term_ratio"}
_HELD = sorted(PRIORITY_ASSETS.values())
_PANEL_READINGS = [*_SOLID, "cot_n_crowded", *[f"cot_idx52_{a}" for a in _HELD]]
#: Readings whose whole history SQL can state, through the same keyed plan.
_KEYED = dict(
    _SURF, rp="SELECT s.session, " + ", ".join(f"s.{c} AS {n}" for n, c in _SOLID.items()) + """, p.* EXCLUDE (session)
      FROM surf s LEFT JOIN (SELECT session,
        count(*) FILTER (idx52 >= 0.8 OR idx52 <= 0.2) AS cot_n_crowded, """ + ", ".join(
        f"max(idx52) FILTER (asset = '{a}') AS cot_idx52_{a}" for a in _HELD) + """ FROM posday GROUP BY 1) p
      ON p.session = s.session""",
    lv=" UNION ALL ".join(f"SELECT session, '{c}' AS reading, {c}::DOUBLE AS x FROM rp" for c in _PANEL_READINGS),
    md="""SELECT 'level' AS mode, session, reading, round(x, 9) AS value FROM lv UNION ALL
      SELECT 'change', session, reading, round(x - lag(x) OVER (PARTITION BY reading ORDER BY session), 9) FROM lv""",
    sc="""SELECT scope, md.* FROM md JOIN (VALUES ('market_level'), ('with_per_asset_cot')) t(scope)
      ON scope = 'with_per_asset_cot' OR reading = 'cot_n_crowded' OR reading NOT LIKE 'cot_%'""",
    k1="SELECT * FROM sc QUALIFY count(value) OVER (PARTITION BY scope, mode, reading) >= 250",
    k2="""SELECT * FROM (SELECT *, count(value) OVER (PARTITION BY scope, mode, session) AS have,
      (SELECT count(DISTINCT reading) FROM k1 w WHERE w.scope = k1.scope AND w.mode = k1.mode) AS width FROM k1)
      WHERE have = width""",
    k3="SELECT * FROM k2 QUALIFY stddev_samp(value) OVER (PARTITION BY scope, mode, reading) > 0",
    kr="""SELECT *, rank() OVER (PARTITION BY scope, mode, reading ORDER BY value)
      + (count(*) OVER (PARTITION BY scope, mode, reading, value) - 1) / 2.0 AS rk FROM k3""",
    kc="""SELECT a.scope, a.mode, a.reading AS a, b.reading AS b, corr(a.rk, b.rk) AS corr FROM kr a
      JOIN kr b ON a.scope = b.scope AND a.mode = b.mode AND a.session = b.session GROUP BY ALL""")


def _keyed(v: Views):
    state = State(v, keep=True)
    vol = state.vol().select("panel_id", "session", "sess_no", *[F.col(c).alias(n) for n, c in _SOLID.items()])
    pos = state.positions().groupBy("panel_id", "sess_no").agg(
        F.count_if(ru.is_crowded()).alias("cot_n_crowded"),
        *[F.max(F.when(F.col("asset") == a, F.col("idx52"))).alias(f"cot_idx52_{a}") for a in _HELD])
    rows = env.materialise(rg.keyed_readings(vol.join(pos, ["panel_id", "sess_no"], "left"), 9), "keyed")
    cases = env.materialise(rg.complete_cases(rows), "cases")
    return rows, cases, env.materialise(rg.keyed_correlations(cases, _PANEL_READINGS), "keyed-correlations")


@query("x09_keyed_dimensions", sql("bars posday", """
SELECT scope, mode, n_columns, rows_used, since, until, columns_dropped, participation_ratio FROM (
  SELECT scope, mode, count(DISTINCT reading) AS n_columns, count(DISTINCT session) AS rows_used,
    min(session) AS since, max(session) AS until FROM k3 GROUP BY 1, 2)
JOIN (SELECT scope, mode, round(sum(corr) FILTER (a = b) ** 2 / sum(corr * corr), 2) AS participation_ratio
  FROM kc GROUP BY 1, 2) USING (scope, mode)
JOIN (SELECT sc.scope, sc.mode, count(DISTINCT sc.reading) - count(DISTINCT k3.reading) AS columns_dropped
  FROM sc LEFT JOIN k3 USING (scope, mode, reading) GROUP BY 1, 2) USING (scope, mode)""", **_KEYED))
def x09_keyed(v: Views):
    rows, cases, corr = _keyed(v)
    return rg.dimension_rows(rows, cases, corr).select(
        "scope", "mode", "n_columns", "rows_used", "since", "until", "columns_dropped", "participation_ratio")


@query("k18_redundant_pairs", sql("bars posday", """
SELECT scope, mode, a, b, round(abs(corr), 6) AS abs_corr, CAST(row_number() OVER (
  PARTITION BY scope, mode ORDER BY abs(corr) DESC, a, b) AS INT) AS place
FROM kc WHERE a < b AND corr IS NOT NULL QUALIFY place <= 15""", **_KEYED))
def k18_pairs(v: Views):
    _, _, corr = _keyed(v)
    return rg.redundant_pairs(corr).select("scope", "mode", "a", "b", r("abs_corr"), "place")


@query("x09_episodes")
def x09_episodes(v: Views):
    """Independent looks: sessions over the median decorrelation time."""
    registry = rg.numeric_registry(env.materialise(State(v, keep=True).panel(), "state"))
    names = rg.with_values(registry)
    rows = rg.long_form(registry.select(*rg.KEYS, *names), names)
    sessions = registry.count()
    return rg.episodes(mx.decorrelation_times(rows), sessions).drop("panel_id")


@query("x11_residual_scores")
def x11(v: Views):
    vec = mx.pack(v.carried(), NAMES, "ret")
    return mx.residual_scores(vec, NAMES).select("sess_no", "instrument", r("z"))
