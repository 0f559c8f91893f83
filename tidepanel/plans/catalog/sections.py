"""Cross-sectional queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.functions import scalars as sc
from tidepanel.operators import histories as hs
from tidepanel.operators import sections as xs
from tidepanel.operators import smoothing as sm
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import Views
from tidepanel.universe import BREADTH_EXCLUDE

_Z = """SELECT *, CASE WHEN count(ret) OVER w >= 20 THEN round((ret - avg(ret) OVER w)
  / nullif(stddev_samp(ret) OVER w, 0), 9) END AS z FROM panel
  WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING)"""


def scored(v: Views):
    """Return z-scores on a fixed grid, so equal scores tie in every engine."""
    return v.panel().withColumn("z", F.round(fr.rolling_zscore("ret", 20), 9))


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query("o01_top_bottom", sql("panel", """
SELECT session, instrument, z, CASE WHEN r <= 8 THEN 1 ELSE -1 END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY z DESC, instrument) AS r,
        count(*) OVER (PARTITION BY session) AS n FROM scored WHERE z IS NOT NULL)
WHERE n >= 17 AND (r <= 8 OR r > n - 8)""", scored=_Z))
def o01(v: Views):
    return xs.top_bottom(scored(v), "z").select("session", "instrument", "z", "side")


@query("o02_cross_rank", sql("panel", """
SELECT session, instrument, round((rank() OVER (PARTITION BY session ORDER BY z)
  + (count(*) OVER (PARTITION BY session, z) - 1) / 2.0)
  / count(*) OVER (PARTITION BY session), 6) AS rank_pct FROM scored WHERE z IS NOT NULL""",
    scored=_Z))
def o02(v: Views):
    s = scored(v).filter("z is not null")
    return s.select("session", "instrument",
                    F.round(fr.cross_rank_pct("z"), 6).alias("rank_pct"))


_LEANS = """SELECT session, instrument, {x} AS score, (rank() OVER (PARTITION BY session ORDER BY {x})
  + (count(*) OVER (PARTITION BY session, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY session)
  AS rank_pct, CASE WHEN row_number() OVER (PARTITION BY session ORDER BY {x} DESC, instrument) <= 8
  THEN 1 WHEN row_number() OVER (PARTITION BY session ORDER BY {x} DESC, instrument)
   > count(*) OVER (PARTITION BY session) - 8 THEN -1 ELSE 0 END AS lean
  FROM {t} WHERE {x} IS NOT NULL"""


@query("o03_combined_leans", sql("panel", """
SELECT coalesce(a.session, b.session) AS session, coalesce(a.instrument, b.instrument)
  AS instrument, a.lean AS lean_5d, b.lean AS lean_21d,
  CAST(sign(coalesce(a.lean, 0) + coalesce(b.lean, 0)) AS INT) AS lean,
  round_even(abs((coalesce(a.rank_pct, 0) + coalesce(b.rank_pct, 0))
    / ((a.rank_pct IS NOT NULL)::INT + (b.rank_pct IS NOT NULL)::INT) - 0.5) * 2, 4) AS conviction
FROM a FULL JOIN b ON a.session = b.session AND a.instrument = b.instrument""", scored=_Z,
    a=_LEANS.format(x="z", t="scored"), b=_LEANS.format(x="close", t="scored")))
def o03(v: Views):
    s = scored(v)
    per = {5: xs.leans(s, "z").withColumnRenamed("z", "score"),
           21: xs.leans(s, "close").withColumnRenamed("close", "score")}
    out = xs.combine_horizons(per, ["session", "instrument"])
    return out.select("session", "instrument", "lean_5d", "lean_21d", "lean", "conviction")


@query("o06_nulls_last", sql("feats", """
SELECT asset, effective_date, round(idx52, 6) AS idx52,
  row_number() OVER (PARTITION BY effective_date ORDER BY idx52 DESC NULLS LAST, asset) AS place
FROM feats"""))
def o06(v: Views):
    w = Window.partitionBy("panel_id", "effective_date").orderBy(
        F.col("idx52").desc_nulls_last(), "asset")
    f = hs.weekly_features(v.positions())
    return f.select("asset", "effective_date", F.round("idx52", 6).alias("idx52"),
                    F.row_number().over(w).alias("place"))


@query("o07_largest_change", sql("feats", """
SELECT effective_date, asset, round(chg4w, 6) AS chg4w FROM feats WHERE chg4w IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY effective_date ORDER BY abs(chg4w) DESC, asset) = 1"""))
def o07(v: Views):
    f = hs.weekly_features(v.positions()).filter("chg4w is not null")
    pick = F.max_by(F.struct("asset", "chg4w"), F.abs("chg4w")).alias("r")
    return f.groupBy("effective_date").agg(pick).select(
        "effective_date", "r.asset", F.round("r.chg4w", 6).alias("chg4w"))


@query("o08_first_valid", sql("panel", """
SELECT instrument, min(CASE WHEN z IS NOT NULL THEN sess_no END) AS first_no FROM scored
GROUP BY 1""", scored=_Z))
def o08(v: Views):
    return scored(v).groupBy("instrument").agg(
        F.min(F.when(F.col("z").isNotNull(), F.col("sess_no"))).alias("first_no"))


@query("o09_tail_sessions", sql("panel", """
SELECT instrument, session, round(ret, 6) AS ret FROM panel
WHERE sess_no > (SELECT max(sess_no) FROM cal) - 60"""))
def o09(v: Views):
    return v.panel().filter(F.col("sess_no") >= F.col("n_sessions") - 60).select(
        "instrument", "session", F.round("ret", 6).alias("ret"))


@query("o10_block_sampling", sql("grid", """
SELECT instrument, session, close FROM grid WHERE sess_no >= 253 AND (sess_no - 253) % 21 = 0
  AND sess_no < (SELECT count(*) FROM cal) - 21"""))
def o10(v: Views):
    return xs.block_rows(v.panel(), 21, 253).select("instrument", "session", "close")


@query("o11_every_kth", sql("positions", """
SELECT asset, report_date, oi FROM positions
QUALIFY (row_number() OVER (PARTITION BY asset ORDER BY report_date) - 1) % 13 = 0"""))
def o11(v: Views):
    return xs.every_kth(v.positions(), 13, ["panel_id", "asset"], "report_date").select(
        "asset", "report_date", "oi")


@query("o12_split_halves", sql("bars", """
SELECT instrument, half, count(*) AS n, round(avg(close), 6) AS mean FROM (
 SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument ORDER BY session)
   <= count(*) OVER (PARTITION BY instrument) // 2 THEN 'first' ELSE 'second' END AS half
 FROM bars) GROUP BY 1, 2"""))
def o12(v: Views):
    out = xs.split_halves(v.bars(), list(fr.SERIES), "session")
    return out.groupBy("instrument", "half").agg(F.count("*").alias("n"),
                                                 F.round(F.avg("close"), 6).alias("mean"))


_SRC = """SELECT instrument, session, sess_no, close, row_number() OVER (PARTITION BY instrument
  ORDER BY session) - 1 AS k, sess_no - lag(sess_no) OVER (PARTITION BY instrument
  ORDER BY session) AS gap FROM grid WHERE close IS NOT NULL AND instrument NOT IN (""" \
    + _quoted(BREADTH_EXCLUDE) + ")"


def _gap_ewm(span: int) -> str:
    a = 2 / (span + 1)
    return f"""SELECT instrument, session, k, close AS y FROM src WHERE k = 0
      UNION ALL SELECT e{span}.instrument, s.session, s.k, (power({1 - a!r}, s.gap) * e{span}.y
        + {a!r} * s.close) / (power({1 - a!r}, s.gap) + {a!r})
      FROM e{span} JOIN src s ON s.instrument = e{span}.instrument AND s.k = e{span}.k + 1"""


@query("a15_breadth", sql("grid", """
SELECT c.session, round(avg((s.close > a.y)::INT) FILTER (s.k >= 199), 6) AS breadth_above_50,
  round(avg((s.close > b.y)::INT) FILTER (s.k >= 199), 6) AS breadth_above_200,
  count(s.k) FILTER (s.k >= 199) AS breadth_n
FROM cal c LEFT JOIN src s ON s.session = c.session LEFT JOIN e50 a ON a.instrument = s.instrument AND a.k = s.k
LEFT JOIN e200 b ON b.instrument = s.instrument AND b.k = s.k GROUP BY 1""", recursive=True,
    src=_SRC, e50=_gap_ewm(50), e200=_gap_ewm(200)))
def a15(v: Views):
    p = v.panel().filter(~F.col("instrument").isin(BREADTH_EXCLUDE))
    return breadth_history(p).select(
        "session", F.round("breadth_above_50", 6).alias("breadth_above_50"),
        F.round("breadth_above_200", 6).alias("breadth_above_200"), "breadth_n")


def breadth_history(panel):
    """Share of comparable instruments above their slow means, warm ones only."""
    p = sm.ema(panel, "close", {"e50": 50, "e200": 200}, fill=False)
    valid = F.col("close").isNotNull() & (fr.seen_count("close") >= 200)
    p = p.withColumn("valid", valid)
    return xs.breadth(p, {"breadth_above_50": F.col("close") > F.col("e50"),
                          "breadth_above_200": F.col("close") > F.col("e200")},
                      F.col("valid"), ("panel_id", "session", "sess_no"))


@query("a21_block_sums", sql("bars cal", """
SELECT instrument, sess_no // 21 AS block, count(*) AS n, round(sum(volume), 4) AS volume
FROM bars JOIN cal USING (session) GROUP BY 1, 2"""))
def a21(v: Views):
    return v.bars_numbered().groupBy(
        "instrument", F.floor(F.col("sess_no") / 21).alias("block")).agg(
        F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"))


@query("a22_selected_mean", sql("panel", """
SELECT session, round(avg(fwd) FILTER (z > 1), 6) AS mean FROM (SELECT *, lead(close, 5) OVER
  (PARTITION BY instrument ORDER BY session) / close - 1 AS fwd FROM scored) GROUP BY 1""",
    scored=_Z))
def a22(v: Views):
    s = scored(v).withColumn("fwd", fr.forward_return("close", 5))
    return xs.selected_mean(s, "fwd", F.col("z") > 1).select(
        "session", F.round("mean", 6).alias("mean"))


@query("w36_persistence", sql("panel", """
SELECT instrument, session, CASE WHEN on_ THEN sess_no - coalesce(last_off, -1) ELSE 0 END
  AS persistence FROM (SELECT *, max(CASE WHEN NOT on_ THEN sess_no END) OVER (
    PARTITION BY instrument ORDER BY session ROWS UNBOUNDED PRECEDING) AS last_off
  FROM (SELECT *, coalesce(z > 0, false) AS on_ FROM scored))""", scored=_Z))
def w36(v: Views):
    return xs.islands(scored(v), F.col("z") > 0, list(fr.SERIES), "session").select(
        "instrument", "session", "persistence")


@query("c03_bands", sql("bars", """
SELECT instrument, session, CASE WHEN p < 0.25 THEN 'cheap' WHEN p > 0.75 THEN 'rich'
  WHEN p IS NOT NULL THEN 'middling' END AS band,
  CASE WHEN p >= 0.60 THEN 'rich' ELSE 'cheap' END AS tilt,
  CASE WHEN p >= 0.60 THEN 0.0197 ELSE 0.0038 END AS expected_fwd_ret_1m
FROM (SELECT instrument, session, CASE WHEN len(l) >= 60 THEN
   len(list_filter(l, lambda e: e <= close)) / len(l) END AS p
  FROM (SELECT *, list(close) OVER (PARTITION BY instrument ORDER BY session
        ROWS 251 PRECEDING) AS l FROM bars))"""))
def c03(v: Views):
    b = fr.by_series(v.bars()).withColumn("p", fr.inclusive_percentile("close"))
    rich = sc.truthy(F.col("p") >= 0.60)
    return b.select("instrument", "session", sc.band("p").alias("band"),
                    F.when(rich, "rich").otherwise("cheap").alias("tilt"),
                    F.when(rich, 0.0197).otherwise(0.0038).alias("expected_fwd_ret_1m"))


_PHI = """SELECT instrument, session, z, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(
  range(0, 120), lambda k: sign(z) * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300))
   - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) AS p
  FROM (SELECT instrument, session, z FROM scored WHERE z IS NOT NULL)"""


@query("c07_normal_cdf", sql("panel", """
SELECT instrument, session, round(p, 6) AS p, round(2 * (1 - CASE WHEN z < 0 THEN 1 - p ELSE p END), 6)
  AS p_two_sided FROM phi""", scored=_Z, phi=_PHI))
def c07(v: Views):
    s = scored(v).filter("z is not null")
    return s.select("instrument", "session", F.round(sc.norm_cdf("z"), 6).alias("p"),
                    F.round(2 * (1 - sc.norm_cdf(F.abs("z"))), 6).alias("p_two_sided"))


@query("c01_scalar_functions", sql("bars", """
SELECT instrument, session, round(ln(close), 6) AS log_close, CAST(sign(close - open) AS INT)
  AS direction, round(abs(close - open), 4) AS move, round(sqrt(volume), 6) AS root_volume,
  least(greatest(volume, 10), 100) AS clipped, round_even(factor, 1) AS factor1
FROM bars"""))
def c01(v: Views):
    return v.bars().select(
        "instrument", "session", F.round(F.ln("close"), 6).alias("log_close"),
        F.signum(F.col("close") - F.col("open")).cast("int").alias("direction"),
        F.round(F.abs(F.col("close") - F.col("open")), 4).alias("move"),
        F.round(F.sqrt("volume"), 6).alias("root_volume"),
        F.least(F.greatest("volume", F.lit(10.0)), F.lit(100.0)).alias("clipped"),
        F.bround("factor", 1).alias("factor1"))
