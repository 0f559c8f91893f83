"""Per-instrument window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import frames as fr
from tidepanel.operators import smoothing as sm
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import Views

KEYS = ["instrument", "session"]


def w(n: int, name: str = "w") -> str:
    return (f"WINDOW {name} AS (PARTITION BY instrument ORDER BY session "
            f"ROWS {n - 1} PRECEDING)")


def one(column, digits: int = 6, name: str = "x"):
    return F.round(column, digits).alias(name)


@query("w01_padded_return", sql("padded", """
SELECT instrument, session, round(ff / lag(ff, 1) OVER o - 1, 6) AS r1,
  round(ff / lag(ff, 5) OVER o - 1, 6) AS r5, round(ff / lag(ff, 20) OVER o - 1, 6) AS r20
FROM padded WINDOW o AS (PARTITION BY instrument ORDER BY session)"""))
def w01(v: Views):
    p = v.panel()
    p = fr.with_padded_return(fr.with_padded_return(p, "close", "r5", 5), "close", "r20", 20)
    return p.select(*KEYS, one("ret", name="r1"), one("r5", name="r5"), one("r20", name="r20"))


@query("w02_lag_change", sql("grid", """
SELECT instrument, session, round(close - lag(close, 4) OVER o, 4) AS chg4,
  round(close / lag(close, 1) OVER o - 1, 6) AS plain
FROM grid WINDOW o AS (PARTITION BY instrument ORDER BY session)"""))
def w02(v: Views):
    return v.panel().select(*KEYS, one(fr.change("close", 4), 4, "chg4"),
                            one(fr.plain_return("close"), name="plain"))


@query("w03_forward_return", sql("grid", """
SELECT instrument, session, round(lead(close, 5) OVER o / close - 1, 6) AS f5,
  round(lead(close, 21) OVER o / close - 1, 6) AS f21
FROM grid WINDOW o AS (PARTITION BY instrument ORDER BY session)"""))
def w03(v: Views):
    return v.panel().select(*KEYS, one(fr.forward_return("close", 5), name="f5"),
                            one(fr.forward_return("close", 21), name="f21"))


@query("w04_rolling_moments", sql("panel", """
SELECT instrument, session, CASE WHEN count(ret) OVER w >= 20 THEN round(avg(ret) OVER w, 6) END
  AS mean20, CASE WHEN count(ret) OVER w >= 20 THEN round(stddev_samp(ret) OVER w, 6) END AS sd20,
  CASE WHEN count(close) OVER w >= 8 THEN round(var_samp(close) OVER w, 2) END AS var20
FROM panel """ + w(20)))
def w04(v: Views):
    return v.panel().select(*KEYS, one(fr.rolling_mean("ret", 20), name="mean20"),
                            one(fr.rolling_std("ret", 20), name="sd20"),
                            one(fr.rolling_var("close", 20, least=8), 2, "var20"))


@query("w05_rolling_zscore", sql("panel", """
SELECT instrument, session, CASE WHEN count(ret) OVER w >= 60 THEN
  round((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 6) END AS z60
FROM panel """ + w(60)))
def w05(v: Views):
    return v.panel().select(*KEYS, one(fr.rolling_zscore("ret", 60), name="z60"))


@query("w05_rolling_zscore_chunked", sql("panel", """
SELECT instrument, session, CASE WHEN count(ret) OVER w >= 60 THEN
  round((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 6) END AS z60
FROM panel """ + w(60)))
def w05_chunked(v: Views):
    """The same z-score where a long series is spread over time chunks."""
    chunks = fr.split_chunks(v.panel(), "sess_no", 500, 60)
    by = (*fr.SERIES, "chunk")
    out = chunks.withColumn("z60", fr.rolling_zscore("ret", 60, by))
    return out.filter(~F.col("is_lead")).select(*KEYS, one("z60", name="z60"))


@query("w06_inclusive_percentile", sql("bars", """
SELECT instrument, session, CASE WHEN len(l) >= 60 THEN
  round(len(list_filter(l, lambda e: e <= close)) / len(l), 6) END AS pct
FROM (SELECT *, list(close) OVER w AS l FROM bars """ + w(252) + ")"))
def w06(v: Views):
    p = v.panel().withColumn("pct", fr.inclusive_percentile("close"))
    return p.filter("close is not null").select(*KEYS, one("pct", name="pct"))


@query("w07_rank_percentile", sql("padded", """
SELECT instrument, session, CASE WHEN len(l) >= 52 THEN
  round((len(list_filter(l, lambda e: e < ff)) + (len(list_filter(l, lambda e: e = ff)) + 1)
  / 2.0) / len(l), 6) END AS pct
FROM (SELECT instrument, session, ff, list(ff) FILTER (ff IS NOT NULL) OVER w AS l
      FROM padded """ + w(52) + ") WHERE ff IS NOT NULL"))
def w07(v: Views):
    p = v.panel().withColumn("ff", fr.last_valid("close"))
    out = p.withColumn("pct", fr.rank_percentile("ff", 52)).filter("ff is not null")
    return out.select(*KEYS, one("pct", name="pct"))


@query("w08_rolling_median", sql("padded", """
SELECT instrument, session, CASE WHEN count(ff) OVER w >= 252 THEN
  round(quantile_cont(ff, 0.5) OVER w, 6) END AS median252 FROM padded """ + w(252)))
def w08(v: Views):
    p = v.panel().withColumn("ff", fr.last_valid("close"))
    return p.select(*KEYS, one(fr.rolling_median("ff", 252), 6, "median252"))


@query("w09_high_and_drawdown", sql("padded", """
SELECT instrument, session, CASE WHEN count(ff) OVER w >= 252 THEN round(max(ff) OVER w, 4) END
  AS high252, round(ff / max(ff) OVER w - 1, 6) AS drawdown FROM padded """ + w(252)))
def w09(v: Views):
    p = v.panel().withColumn("ff", fr.last_valid("close"))
    return p.select(*KEYS, one(fr.rolling_max("ff", 252), 4, "high252"),
                    one(F.col("ff") / fr.rolling_max("ff", 252, least=1) - 1, name="drawdown"))


@query("w10_rolling_skew", sql("panel", """
SELECT instrument, session, CASE WHEN count(ret) OVER w >= 60 THEN
  round(skewness(ret) OVER w, 5) END AS skew60 FROM panel """ + w(60)))
def w10(v: Views):
    return v.panel().select(*KEYS, one(fr.rolling_skew("ret", 60), 5, "skew60"))


_BENCH = "SELECT p.*, s.ret AS bench FROM panel p JOIN panel s ON s.instrument = 'SPY' AND s.session = p.session"


def with_bench(v: Views, name: str = "SPY"):
    p = v.panel()
    bench = p.filter(F.col("instrument") == name).select("panel_id", "session",
                                                         F.col("ret").alias("bench"))
    return p.join(bench, ["panel_id", "session"])


@query("w11_rolling_beta", sql("panel", """
SELECT instrument, session, CASE WHEN count(CASE WHEN ret IS NOT NULL THEN bench END) OVER w >= 60
  AND count(bench) OVER w >= 60 THEN
  round(covar_samp(ret, bench) OVER w / nullif(var_samp(bench) OVER w, 0), 6) END AS beta60
FROM b """ + w(60), b=_BENCH))
def w11(v: Views):
    return with_bench(v).select(*KEYS, one(fr.rolling_beta("ret", "bench", 60), name="beta60"))


@query("w12_rolling_corr", sql("panel", """
SELECT instrument, session, CASE WHEN count(CASE WHEN ret IS NOT NULL THEN bench END) OVER w >= 20
  AND stddev_samp(ret) OVER w > 0 THEN round(corr(ret, bench) OVER w, 6) END AS corr60
FROM b WHERE instrument <> 'SPY' """ + w(60), b=_BENCH))
def w12(v: Views):
    return with_bench(v).filter("instrument <> 'SPY'").select(
        *KEYS, one(fr.rolling_corr("ret", "bench", 60, least=20), name="corr60"))


@query("w13_latest_pair_corr", sql("panel", """
SELECT instrument, CASE WHEN count(*) >= 20 THEN round(corr(ret, bench), 6) END AS corr,
  count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY instrument
    ORDER BY session DESC) AS back FROM b WHERE ret IS NOT NULL AND bench IS NOT NULL)
WHERE back <= 60 AND instrument <> 'SPY' GROUP BY 1""", b=_BENCH))
def w13(v: Views):
    from pyspark.sql import Window
    back = Window.partitionBy(*fr.SERIES).orderBy(F.col("session").desc())
    both = with_bench(v).filter("ret is not null and bench is not null and instrument <> 'SPY'")
    last = both.withColumn("back", F.row_number().over(back)).filter("back <= 60")
    return last.groupBy("instrument").agg(
        F.when(F.count("*") >= 20, F.round(F.corr("ret", "bench"), 6)).alias("corr"),
        F.count("*").alias("n"))


def ewm_sql(source: str, value: str, alpha: float, number: str = "k") -> str:
    """Recursive mean over the rows numbered k per instrument."""
    return f"""SELECT instrument, k, {value} AS y FROM {source} WHERE k = 0
      UNION ALL SELECT e.instrument, s.k, e.y + {alpha!r} * (s.{value} - e.y)
      FROM e JOIN {source} s ON s.instrument = e.instrument AND s.k = e.k + 1"""


_ROWS = """SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session) - 1 AS k
  FROM bars"""


@query("w14_ewm", sql("bars", """
SELECT s.instrument, s.session, round(y, 4) AS ema50 FROM e JOIN src s USING (instrument, k)""",
    recursive=True, src=_ROWS, e=ewm_sql("src", "close", 2 / 51)))
def w14(v: Views):
    out = sm.ema(v.panel(), "close", {"ema50": 50}, ignore_gaps=True, fill=False)
    return out.filter("close is not null").select(*KEYS, one("ema50", 4, "ema50"))


@query("w14_ewm_gaps", sql("grid", """
SELECT instrument, session, round(y, 4) AS ema21 FROM e""", recursive=True,
    src="""SELECT instrument, session, sess_no, close, row_number() OVER (PARTITION BY instrument
      ORDER BY session) - 1 AS k, sess_no - lag(sess_no) OVER (PARTITION BY instrument
      ORDER BY session) AS gap FROM grid WHERE close IS NOT NULL""",
    e="""SELECT instrument, session, k, close AS y FROM src WHERE k = 0
      UNION ALL SELECT e.instrument, s.session, s.k,
        (power(20 / 22.0, s.gap) * e.y + 2 / 22.0 * s.close) / (power(20 / 22.0, s.gap) + 2 / 22.0)
      FROM e JOIN src s ON s.instrument = e.instrument AND s.k = e.k + 1"""))
def w14_gaps(v: Views):
    out = sm.ema(v.panel(), "close", {"ema21": 21}, fill=False)
    return out.filter("close is not null").select(*KEYS, one("ema21", 4, "ema21"))


@query("w15_macd", sql("bars", """
SELECT s.instrument, s.session, round(m, 4) AS macd, round(g, 4) AS macd_signal,
  round(m - g, 4) AS macd_hist FROM e JOIN src s USING (instrument, k)""", recursive=True,
    src=_ROWS, e=f"""SELECT instrument, k, close AS f, close AS l, 0.0::DOUBLE AS m, 0.0::DOUBLE AS g
      FROM src WHERE k = 0 UNION ALL
      SELECT instrument, k, f, l, f - l, g0 + 0.2 * ((f - l) - g0) FROM (
       SELECT e.instrument, s.k, e.f + {2 / 13!r} * (s.close - e.f) AS f,
         e.l + {2 / 27!r} * (s.close - e.l) AS l, e.g AS g0
       FROM e JOIN src s ON s.instrument = e.instrument AND s.k = e.k + 1)"""))
def w15(v: Views):
    out = sm.macd(v.bars_numbered(), "close", ignore_gaps=True)
    return out.select(*KEYS, one("macd", 4, "macd"), one("macd_signal", 4, "macd_signal"),
                      one("macd_hist", 4, "macd_hist"))


@query("w16_rsi", sql("bars", """
SELECT s.instrument, s.session, round(CASE WHEN u = 0 AND d = 0 THEN 50 WHEN u = 0 THEN 0
  WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END, 4) AS rsi
FROM src s LEFT JOIN e USING (instrument, k)""", recursive=True,
    src="""SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session) - 1 AS k,
      close - lag(close) OVER (PARTITION BY instrument ORDER BY session) AS ch FROM bars""",
    e="""SELECT instrument, k, greatest(ch, 0) AS u, greatest(-ch, 0) AS d FROM src WHERE k = 1
      UNION ALL SELECT e.instrument, s.k, u + (greatest(s.ch, 0) - u) / 14,
        d + (greatest(-s.ch, 0) - d) / 14
      FROM e JOIN src s ON s.instrument = e.instrument AND s.k = e.k + 1"""))
def w16(v: Views):
    out = sm.rsi(v.bars_numbered(), "close", ignore_gaps=True)
    return out.select(*KEYS, one("rsi", 4, "rsi"))


@query("w17_realised_vol", sql("panel", """
SELECT instrument, session, CASE WHEN count(ret) OVER w >= 20 THEN
  round(stddev_samp(ret) OVER w * sqrt(252) * 100, 4) END AS rv20 FROM panel """ + w(20)))
def w17(v: Views):
    return v.panel().select(*KEYS, one(fr.rolling_std("ret", 20) * 252 ** 0.5 * 100, 4, "rv20"))


@query("w18_variance_premium", sql("panel", """
SELECT s.session, round(x.close / 100 * (x.close / 100) - s.rv * s.rv, 2) AS vrp
FROM (SELECT session, CASE WHEN count(ret) OVER w >= 20 THEN
        stddev_samp(ret) OVER w * sqrt(252) * 100 END AS rv
      FROM panel WHERE instrument = 'SPY' """ + w(20) + """) s
JOIN grid x ON x.instrument = 'VIX' AND x.session = s.session"""))
def w18(v: Views):
    spy = v.panel().filter("instrument = 'SPY'").withColumn(
        "rv", fr.rolling_std("ret", 20) * 252 ** 0.5 * 100)
    vix = v.panel().filter("instrument = 'VIX'").select(
        "panel_id", "session", (F.col("close") / 100).alias("vix"))
    both = spy.join(vix, ["panel_id", "session"])
    return both.select("session", one(F.col("vix") * F.col("vix") - F.col("rv") * F.col("rv"),
                                      2, "vrp"))


@query("w19_staleness", sql("grid", """
SELECT instrument, session, CAST(coalesce(session - max(CASE WHEN close IS NOT NULL THEN session END)
  OVER (PARTITION BY instrument ORDER BY session ROWS UNBOUNDED PRECEDING), -1) AS INT) AS stale
FROM grid"""))
def w19(v: Views):
    return v.panel().select(*KEYS, F.coalesce(fr.staleness_days("close"), F.lit(-1))
                            .alias("stale"))


@query("w22_warm_count", sql("grid", """
SELECT instrument, session, count(close) OVER (PARTITION BY instrument ORDER BY session
  ROWS UNBOUNDED PRECEDING) >= 200 AS warm FROM grid"""))
def w22(v: Views):
    return v.panel().select(*KEYS, (fr.seen_count("close") >= 200).alias("warm"))


@query("w25_month_end", sql("cal", """
SELECT session, month(session) <> coalesce(month(lead(session) OVER (ORDER BY session)), -1)
  AS is_month_end FROM cal"""))
def w25(v: Views):
    nxt = F.lead("session", 1).over(fr.line(("panel_id",)))
    flag = F.month("session") != F.coalesce(F.month(nxt), F.lit(-1))
    return v.calendar().select("session", flag.alias("is_month_end"))


@query("w26_volume_ratio", sql("bars", """
SELECT instrument, session, CASE WHEN count(v) OVER w60 >= 60 THEN
  round(avg(v) OVER w5 / avg(v) OVER w60, 6) END AS ratio,
  round(avg(CASE WHEN ret > 0 THEN v END) OVER w20, 4) AS up_volume,
  round(avg(CASE WHEN NOT (ret > 0) THEN v END) OVER w20, 4) AS down_volume
FROM (SELECT *, nullif(volume, 0) AS v, close / lag(close) OVER (PARTITION BY instrument
        ORDER BY session) - 1 AS ret FROM bars)
WINDOW w5 AS (PARTITION BY instrument ORDER BY session ROWS 4 PRECEDING),
  w20 AS (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING),
  w60 AS (PARTITION BY instrument ORDER BY session ROWS 59 PRECEDING)"""))
def w26(v: Views):
    b = fr.by_series(v.bars()).withColumn("v", F.nullif("volume", F.lit(0.0))).withColumn(
        "ret", fr.plain_return("close"))
    w5, w20, w60 = fr.trailing(5), fr.trailing(20), fr.trailing(60)
    ratio = fr.needs("v", w60, 60, F.avg("v").over(w5) / F.avg("v").over(w60))
    return b.select(*KEYS, one(ratio, name="ratio"),
                    one(F.avg(F.when(F.col("ret") > 0, F.col("v"))).over(w20), 4, "up_volume"),
                    one(F.avg(F.when(~(F.col("ret") > 0), F.col("v"))).over(w20), 4,
                        "down_volume"))


@query("w28_overnight_intraday", sql("grid", """
SELECT instrument, session, round(open / lag(close) OVER o - 1, 6) AS overnight,
  round(close / open - 1, 6) AS intraday
FROM grid WINDOW o AS (PARTITION BY instrument ORDER BY session)"""))
def w28(v: Views):
    prev = F.lag("close", 1).over(fr.line())
    return v.panel().select(*KEYS, one(F.col("open") / prev - 1, name="overnight"),
                            one(F.col("close") / F.col("open") - 1, name="intraday"))


@query("w29_illiquidity", sql("panel", """
SELECT instrument, session, CASE WHEN count(x) OVER w >= 20 THEN
  round(avg(x) OVER w * 1e6, 6) END AS illiq
FROM (SELECT *, abs(ret) / nullif(volume * close, 0) AS x FROM panel) """ + w(20)))
def w29(v: Views):
    p = v.panel().withColumn("x", F.abs("ret") / F.nullif(F.col("volume") * F.col("close"),
                                                          F.lit(0.0)))
    return p.select(*KEYS, one(fr.rolling_mean("x", 20) * 1e6, name="illiq"))


@query("w30_range_compression", sql("bars", """
SELECT instrument, session, CASE WHEN len(l) >= 252 THEN
  round((len(list_filter(l, lambda e: e < g)) + (len(list_filter(l, lambda e: e = g)) + 1) / 2.0)
   / len(l), 6) END AS rng_pct
FROM (SELECT *, list(g) FILTER (g IS NOT NULL) OVER w AS l FROM (
   SELECT instrument, session, CASE WHEN count(*) OVER v >= 5 THEN
     round(avg((high - low) / close) OVER v, 9) END AS g FROM bars
   WINDOW v AS (PARTITION BY instrument ORDER BY session ROWS 4 PRECEDING)) """ + w(252) + """)
WHERE g IS NOT NULL"""))
def w30(v: Views):
    b = fr.by_series(v.bars()).withColumn("g", (F.col("high") - F.col("low")) / F.col("close"))
    b = b.withColumn("g", F.round(fr.rolling_mean("g", 5), 9))
    b = b.withColumn("rng_pct", fr.rank_percentile("g", 252))
    return b.filter("g is not null").select(*KEYS, one("rng_pct", name="rng_pct"))


@query("w31_managed_weight", sql("panel", """
SELECT instrument, session, CASE WHEN count(v) OVER w >= 252 THEN
  round(least(quantile_cont(v, 0.5) OVER w / v, 2.0), 6) END AS weight
FROM (SELECT instrument, session, CASE WHEN count(ret) OVER x >= 20 THEN var_samp(ret) OVER x END
  AS v FROM panel WINDOW x AS (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING)) """
    + w(252)))
def w31(v: Views):
    p = v.panel().withColumn("v", fr.rolling_var("ret", 20))
    p = p.withColumn("raw", fr.rolling_median("v", 252) / F.col("v"))
    p = p.withColumn("weight", F.when(F.col("raw").isNotNull(), F.least("raw", F.lit(2.0))))
    return p.select(*KEYS, one("weight", name="weight"))


@query("w32_average_timing", sql("padded", """
SELECT instrument, session, coalesce(CASE WHEN count(ff) OVER w >= 210 THEN
  ff > avg(ff) OVER w END, false) AS above FROM padded """ + w(210)))
def w32(v: Views):
    p = v.panel().withColumn("ff", fr.last_valid("close"))
    above = F.coalesce(F.col("ff") > fr.rolling_mean("ff", 210), F.lit(False))
    return p.select(*KEYS, above.alias("above"))


@query("w33_log_ratio_z", sql("padded", """
SELECT session, CASE WHEN count(s) OVER w >= 120 THEN
  round((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 6) END AS z120
FROM (SELECT a.session, ln(a.ff / b.ff) AS s FROM padded a JOIN padded b
      ON a.session = b.session WHERE a.instrument = 'HYG' AND b.instrument = 'LQD')
WINDOW w AS (ORDER BY session ROWS 119 PRECEDING)"""))
def w33(v: Views):
    p = v.panel().withColumn("ff", fr.last_valid("close"))
    a = p.filter("instrument = 'HYG'").select("panel_id", "session", F.col("ff").alias("a"))
    b = p.filter("instrument = 'LQD'").select("panel_id", "session", F.col("ff").alias("b"))
    s = a.join(b, ["panel_id", "session"]).withColumn("s", F.ln(F.col("a") / F.col("b")))
    return s.select("session", one(fr.rolling_zscore("s", 120, ("panel_id",)), name="z120"))


@query("w34_magnitude", sql("bars", """
SELECT session, round(vix / sqrt(252), 6) AS sigma_1d_pct, CASE WHEN len(l) >= 60 THEN
  round(len(list_filter(l, lambda e: e <= vix)) / len(l), 3) END AS magnitude_pct
FROM (SELECT session, close / 100 AS vix, list(close / 100) OVER (ORDER BY session
      ROWS 251 PRECEDING) AS l FROM bars WHERE instrument = 'VIX')"""))
def w34(v: Views):
    b = v.bars().filter("instrument = 'VIX'").withColumn("vix", F.col("close") / 100)
    b = b.withColumn("pct", fr.inclusive_percentile("vix"))
    return b.select("session", one(F.col("vix") / 252 ** 0.5, name="sigma_1d_pct"),
                    one("pct", 3, "magnitude_pct"))
