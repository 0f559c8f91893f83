"""Scans, parsers, projections, merges, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.functions import calendar as tc
from tidepanel.functions import frames as fr
from tidepanel.functions import scalars as sc
from tidepanel.functions import tables
from tidepanel.operators import merge as mg
from tidepanel.operators import sessions as ss
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import PANEL, Views, pick
from tidepanel.sources import landing as ld
from tidepanel.sources import store as st
from tidepanel.universe import (ALIASES, DEFAULT_UNIVERSE, FLOW_FUNDS, MIN_ASSET_ROWS,
                                POSITIONING_CONTRACTS, UNIVERSES)

_BARS = "SELECT instrument, session, open, high, low, close, volume, factor FROM bars"


def _landed(df, label: str, kind: str = "parquet", **options) -> str:
    """Files a collector would have landed, in the shared folder."""
    path = env.scratch_path(df.sparkSession, label)
    df.write.options(**options).format(kind).save(path)
    return path


@query("s01_read_by_suffix", sql("bars", " UNION ALL ".join(
    _BARS.replace("SELECT", f"SELECT '{s}' AS suffix,") for s in ("csv", "parquet"))))
def s01(v: Views):
    """The same bars landed under either suffix and read through one entry point."""
    schema = ("instrument string, session date, open double, high double, low double, "
              "close double, volume double, factor double")
    bars = v.bars().select("instrument", "session", "open", "high", "low", "close", "volume", "factor")
    read = []
    for suffix in ("csv", "parquet"):
        path = f"{env.scratch_path(v.spark, 'bars')}.{suffix}"
        options = {"header": "true"} if suffix == "csv" else {}
        bars.write.options(**options).format(suffix).save(path)
        read.append(ld.read_tabular(v.spark, path, schema).select(F.lit(suffix).alias("suffix"), "*"))
    return read[0].unionByName(read[1])


@query("s02_symbol_from_file", sql("bars", """
SELECT 'all' AS scan, instrument, count(*) AS n, round(sum(close), 4) AS total FROM bars GROUP BY 2 UNION ALL
SELECT 'first 5', instrument, count(*), round(sum(close), 4) FROM bars
WHERE instrument IN (SELECT DISTINCT instrument FROM bars ORDER BY 1 LIMIT 5) GROUP BY 2"""))
def s02(v: Views):
    """Files named by symbol, scanned whole and with a limit on the symbols."""
    staged = env.scratch_path(v.spark, "by-symbol")
    rows = v.bars().select("session", "close", F.lower("instrument").alias("symbol"))
    rows.repartition("symbol").write.partitionBy("symbol").option("header", "true").csv(staged)
    folder = env.scratch_path(v.spark, "symbols")
    for name in env.child_names(v.spark, staged):
        if name.startswith("symbol="):
            part = next(n for n in env.child_names(v.spark, f"{staged}/{name}") if n.endswith(".csv"))
            env.move_file(v.spark, f"{staged}/{name}/{part}", f"{folder}/{name.split('=')[1]}.csv")
    out = None
    for label, limit in (("all", None), ("first 5", 5)):
        found = ld.read_symbol_files(v.spark, folder, "session date, close double", limit=limit)
        part = found.groupBy(F.lit(label).alias("scan"), "instrument").agg(
            F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s03_close_panel", sql("grid", """
SELECT instrument, session, close FROM grid
WHERE instrument IN ('SPY', 'GOLD', 'VIX') AND session >= DATE '1997-01-01'"""))
def s03(v: Views):
    p = ss.densify_full(v.bars().filter(F.col("instrument").isin("SPY", "GOLD", "VIX")),
                        v.calendar())
    return p.filter(F.col("session") >= "1997-01-01").select("instrument", "session", "close")


@query("s04_field_panel", sql("bars", _BARS))
def s04(v: Views):
    path = env.scratch_path(v.spark, "store")
    st.write_bars(v.bars(), path)
    return st.read_bars(v.spark, path, columns=["instrument", "session", "open", "high", "low",
                                                "close", "volume", "factor"])


@query("s05_deep_panel", sql("bars", """
SELECT instrument, session, coalesce(CASE WHEN factor > 0.95 THEN close * factor END, close)
  AS price FROM bars
WHERE instrument IN (SELECT instrument FROM bars GROUP BY 1 HAVING count(*) > 1500)"""))
def s05(v: Views):
    adj = F.when(F.col("factor") > 0.95, F.col("close") * F.col("factor"))
    return (ss.with_min_rows(v.bars(), 1501)
            .select("instrument", "session", F.coalesce(adj, "close").alias("price")))


@query("s06_chart_payload", sql("bars", """
SELECT instrument, session, open, high, low, close, volume, close * factor AS adjclose
FROM bars"""))
def s06(v: Views):
    b = v.bars()
    rows = F.array_sort(F.collect_list(F.struct(
        (F.datediff("session", F.lit("1970-01-01")) * 86400).alias("ts"), "open", "high", "low",
        "close", "volume", (F.col("close") * F.col("factor")).alias("adj"))))
    docs = b.groupBy("instrument").agg(rows.alias("r"))
    quote = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close",
                                                          "volume")])
    indicators = F.struct(F.array(quote).alias("quote"),
                          F.array(F.struct(F.col("r.adj").alias("adjclose"))).alias("adjclose"))
    result = F.struct(F.col("r.ts").alias("timestamp"), indicators.alias("indicators"))
    payload = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return ld.parse_chart(docs.select("instrument", payload.alias("payload")))


@query("s07_index_history", sql("bars", """
SELECT instrument, session, open, high, low, close, 0.0 AS volume, close AS adjclose
FROM bars WHERE NOT (volume < 15)"""))
def s07(v: Views):
    quiet = F.col("volume") < 15
    text = [F.when(quiet & F.lit(c == "close"), F.lit("0.0"))
             .otherwise(F.concat(F.lit(" "), F.col(c).cast("string"))).alias(f" {c.title()} ")
            for c in ("open", "high", "low", "close")]
    raw = v.bars().select("instrument", F.col("session").cast("string").alias(" Date"), *text)
    path = _landed(raw, "index", "csv", header="true")
    names = ["instrument", " Date", " Open ", " High ", " Low ", " Close "]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = v.spark.read.schema(schema).option("header", "true").option(
        "enforceSchema", "true").csv(path)
    return ld.parse_index_history(rows)


_CODES = {asset: code for code, (asset, _) in POSITIONING_CONTRACTS.items()}
_SIGNED = """SELECT report_date, asset, (CASE WHEN asset = 'USDJPY' THEN -1 ELSE 1 END)
  * (nc_long - nc_short) / oi AS net_pct, oi FROM positions"""


def _raw_positions(v: Views):
    return v.positions().select(
        pick("asset", _CODES).alias("cftc_contract_market_code"),
        F.date_format("report_date", "yyyy-MM-dd'T00:00:00.000'")
        .alias("report_date_as_yyyy_mm_dd"),
        *[F.format_string("%.2f", c).alias(n) for c, n in (
            ("nc_long", "noncomm_positions_long_all"),
            ("nc_short", "noncomm_positions_short_all"), ("oi", "open_interest_all"))])


@query("s08_position_json", sql("positions", _SIGNED))
def s08(v: Views):
    raw = _raw_positions(v)
    path = _landed(raw, "positions", "json")
    rows = v.spark.read.schema(raw.schema).json(path)
    return ld.normalise_positions(ld.rename_position_json(rows), ld.contract_table(v.spark))


@query("s09_position_delimited", sql("positions", _SIGNED))
def s09(v: Views):
    raw = _raw_positions(v)
    odd = F.substring("report_date_as_yyyy_mm_dd", 1, 10)
    rows = raw.select(
        F.concat(F.lit(" "), "cftc_contract_market_code").alias("CFTC Contract Market Code"),
        odd.alias("As of Date in Form YYYY-MM-DD"),
        F.col("noncomm_positions_long_all").alias("Noncommercial Positions-Long (All)"),
        F.col("noncomm_positions_short_all").alias("Noncommercial Positions-Short (All)"),
        F.col("open_interest_all").alias("Open Interest (All)"))
    path = _landed(rows, "annual", "csv", header="true")
    back = v.spark.read.schema(rows.schema).option("header", "true").csv(path)
    return ld.normalise_positions(ld.rename_position_delimited(back), ld.contract_table(v.spark))


@query("s10_rate_records", sql("hourly", """
SELECT series_id, date, ts_ms,
  min(CASE WHEN rate < 5 THEN 0 ELSE rate END) AS rate FROM hourly GROUP BY 1, 2, 3"""))
def s10(v: Views):
    h = v.hourly()
    rec = F.struct(F.col("ts_ms").alias("timestamp"),
                   F.when(F.col("rate") >= 5, F.col("rate")).alias("interest_1h"))
    page = F.floor(F.col("ts_ms") / 3600000)
    docs = h.groupBy("series_id", page.alias("page")).agg(F.collect_list(rec).alias("result"))
    return ld.parse_rates(docs.select("series_id",
                                      F.to_json(F.struct("result")).alias("payload")))


@query("s11_observations", sql("levels", """
SELECT series_id, obs_date, value FROM levels WHERE day(obs_date) % 5 <> 0"""))
def s11(v: Views):
    lv = v.levels()
    gap = F.dayofmonth("obs_date") % 5 == 0
    blank = F.element_at(F.array(F.lit("."), F.lit("")), F.dayofmonth("obs_date") % 2 + 1)
    obs = F.struct(F.col("obs_date").cast("string").alias("date"),
                   F.when(gap, blank).otherwise(F.format_string("%.2f", "value")).alias("value"))
    docs = lv.groupBy("series_id", F.year("obs_date").alias("y")).agg(
        F.collect_list(obs).alias("observations"))
    return ld.parse_observations(docs.select("series_id", F.to_json(F.struct("observations"))
                                             .alias("payload")))


@query("s12_balance_priority", sql("tga", "SELECT record_date, value, rank FROM tga"))
def s12(v: Views):
    return ld.resolve_balances(v.balances()).select("record_date", "value", "rank")


_FUNDS = """
SELECT ticker, nav, aum_usd, as_of, aum_usd / nav AS shares, source,
       CASE WHEN source = 'ssga' THEN aum_usd / nav * 0.005 ELSE nav END AS noise_usd
FROM (SELECT ticker, price AS nav, round(shares * price, 2)
             * (CASE WHEN source = 'ssga' THEN 1e6 ELSE 1 END) AS aum_usd,
             date AS as_of, source FROM snapshots WHERE source IS NOT NULL)"""


def _fund_documents(v: Views):
    s = v.snapshots().filter("source is not null").withColumn(
        "aum", F.round(F.col("shares") * F.col("price"), 2))
    pair = lambda c: F.array(F.lit("shown"), c.cast("string"))
    fund = F.struct(F.concat("ticker", F.lit("®")).alias("fundTicker"),
                    pair(F.col("price")).alias("nav"),
                    pair(F.format_string("%.2f", "aum")).alias("aum"),
                    pair(F.col("date")).alias("asOfDate"))
    lists = (s.filter("source = 'ssga'").groupBy("date").agg(F.collect_list(fund).alias("datas"))
              .select(F.to_json(F.struct(F.struct(F.struct(F.struct("datas").alias("etfs"))
                                                  .alias("funds")).alias("data")))
                      .alias("payload")))
    nested = F.struct(
        F.col("ticker").alias("localExchangeTicker"),
        F.struct(F.col("price").alias("r")).alias("navAmount"),
        F.struct(F.col("aum").alias("r")).alias("totalNetAssets"),
        F.struct(F.date_format("date", "yyyyMMdd").cast("long").alias("r")).alias("navAmountAsOf"))
    maps = (s.filter("source = 'ishares'").groupBy("date")
             .agg(F.map_from_entries(F.collect_list(F.struct("ticker", nested))).alias("m"))
             .select(F.to_json("m").alias("payload")))
    return lists, maps


@query("s13_fund_documents", sql("snapshots", _FUNDS))
def s13(v: Views):
    lists, maps = _fund_documents(v)
    return ld.parse_fund_list(lists).unionByName(ld.parse_fund_map(maps))


@query("s14_torn_log", sql("", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS as_of, count(*) AS n
FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1"""))
def s14(v: Views):
    o = v.table("orders")
    good = F.to_json(F.struct(F.to_date("o_orderdate").cast("string").alias("as_of"),
                              F.col("o_totalprice").alias("vix")))
    line = F.when(F.col("o_orderkey") % 20 == 0, F.lit("")).when(
        F.col("o_orderkey") % 10 == 0, F.expr("substr('{\"as_of\": \"1999', 1, 12)")).otherwise(good)
    path = _landed(o.select(line.alias("value")), "log", "text")
    return ld.read_log(v.spark, path).groupBy("as_of").agg(F.count("*").alias("n"))


@query("s16_prefer_source", sql("bars", """
SELECT coalesce(l.session, s.session) AS session, coalesce(l.instrument, s.instrument)
  AS instrument, CASE WHEN l.session IS NOT NULL THEN 'live' ELSE 'snapshot' END AS _source,
  coalesce(l.close, s.open) AS price
FROM (SELECT * FROM bars WHERE volume >= 40) l
FULL JOIN (SELECT * FROM bars WHERE volume < 80) s
  ON l.instrument = s.instrument AND l.session = s.session"""))
def s16(v: Views):
    b = v.bars()
    live = b.filter("volume >= 40").select("instrument", "session", F.col("close").alias("price"))
    kept = b.filter("volume < 80").select("instrument", "session", F.col("open").alias("price"))
    return ld.prefer_source([("live", live), ("snapshot", kept)], ["instrument", "session"])


@query("s17_history_or_empty", sql("positions", """
SELECT asset, count(*) AS n, round(sum(net_pct), 6) AS total FROM positions GROUP BY 1"""))
def s17(v: Views):
    from tidepanel.schemas import POSITIONS, names
    root = env.scratch_path(v.spark, "history")
    never = ld.history_or_empty(v.spark, f"{root}/never", POSITIONS)
    v.positions().select(*names(POSITIONS)).write.parquet(f"{root}/stored")
    stored = ld.history_or_empty(v.spark, f"{root}/stored", POSITIONS).unionByName(never)
    return stored.groupBy("asset").agg(F.count("*").alias("n"),
                                       F.round(F.sum("net_pct"), 6).alias("total"))


@query("p01_adjusted_prices", sql("bars", """
SELECT instrument, session, round(open * f, 8) AS open, round(close * f, 8) AS close,
  round_even(volume / CASE WHEN f = 0 THEN 1 ELSE f END, 4) AS volume, round(f, 8) AS factor
FROM (SELECT *, coalesce(CASE WHEN volume > 30 THEN close * factor END, close) / close AS f
      FROM bars)"""))
def p01(v: Views):
    raw = v.bars().withColumn("adjclose", F.when(F.col("volume") > 30,
                                                 F.col("close") * F.col("factor")))
    out = ss.adjusted_prices(raw.drop("factor"))
    return out.select("instrument", "session", F.round("open", 8).alias("open"),
                      F.round("close", 8).alias("close"), "volume",
                      F.round("factor", 8).alias("factor"))


_LINES = """(SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey,
  l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)"""


@query("p02_keep_last", f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_extendedprice DESC) AS rn FROM {_LINES}) WHERE rn = 1""")
def p02(v: Views):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate",
                                      "l_extendedprice")
    return mg.keep_one(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice"])


@query("p17_keep_first", f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_extendedprice) AS rn FROM {_LINES}) WHERE rn = 1""")
def p17(v: Views):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate",
                                      "l_extendedprice")
    return mg.keep_one(rows, ["l_orderkey", "l_linenumber"],
                       ["l_shipdate", "l_extendedprice"], last=False)


@query("p03_anchor_sessions", sql("bars", """
SELECT b.instrument, count(*) AS n FROM bars b WHERE b.session IN
  (SELECT session FROM bars WHERE instrument = 'SPY') GROUP BY 1"""))
def p03(v: Views):
    b = v.bars()
    kept = ss.keep_sessions(b, b.filter("instrument = 'SPY'"))
    return kept.groupBy("instrument").agg(F.count("*").alias("n"))


@query("p04_provenance", sql("bars", f"""
SELECT coalesce(f.instrument, s.instrument) AS instrument, f.fetched, s.rows, s.start,
  s."end", coalesce(f.fetched >= {MIN_ASSET_ROWS * 7}, false) AS kept
FROM (SELECT instrument, count(*) AS fetched FROM bars WHERE volume > 20 GROUP BY 1) f
FULL JOIN (SELECT instrument, count(*) AS rows, min(session) AS start, max(session) AS "end"
           FROM bars GROUP BY 1) s ON f.instrument = s.instrument"""))
def p04(v: Views):
    b = v.bars()
    return ss.provenance(b.filter("volume > 20"), b, MIN_ASSET_ROWS * 7).drop("panel_id")


@query("p06_partial_session", sql("bars", """
SELECT instrument, max(session) AS last_session, count(*) AS n FROM bars
WHERE session < DATE '1999-06-15' GROUP BY 1"""))
def p06(v: Views):
    cut = ss.before(v.bars(), "1999-06-15")
    return cut.groupBy("instrument").agg(F.max("session").alias("last_session"),
                                         F.count("*").alias("n"))


@query("p13_universe_membership", sql("bars", "SELECT instrument, " + " || ".join(
    ["CASE WHEN m = '' THEN '" + DEFAULT_UNIVERSE + "' ELSE m END"]) + """ AS universes, n
FROM (SELECT instrument, count(*) AS n, concat_ws(',', """ + ", ".join(
    f"CASE WHEN instrument IN ({', '.join(repr(x) for x in m)}) THEN '{u}' END"
    for u, m in UNIVERSES.items()) + ") AS m FROM bars GROUP BY 1)"))
def p13(v: Views):
    counts = v.bars().groupBy("instrument").agg(F.count("*").alias("n"))
    tags = F.concat_ws(",", *[F.when(F.col("instrument").isin(m), u)
                              for u, m in UNIVERSES.items()])
    return counts.withColumn("universes",
                             F.when(F.length(tags) > 0, tags).otherwise(DEFAULT_UNIVERSE))


@query("p14_aliases", sql("bars", "SELECT coalesce(name, fund) AS name, n FROM (SELECT CASE " +
    " ".join(f"WHEN instrument = '{n}' THEN '{a}'" for a, n in ALIASES.items() if n != "AGG") +
    " ELSE instrument END AS fund, count(*) AS n FROM bars GROUP BY 1) LEFT JOIN (VALUES " +
    ", ".join(f"('{a}', '{n}')" for a, n in ALIASES.items()) + ") t(a, name) ON fund = a"))
def p14(v: Views):
    fund = F.coalesce(pick("instrument", {n: a for a, n in ALIASES.items() if n != "AGG"}),
                      "instrument")
    counts = v.bars().groupBy(fund.alias("fund")).agg(F.count("*").alias("n"))
    table = v.spark.createDataFrame(list(ALIASES.items()), "fund string, alias string")
    return counts.join(F.broadcast(table), "fund", "left").select(
        F.coalesce("alias", "fund").alias("name"), "n")


@query("p15_dump_fields", sql("bars", """
SELECT instrument, session, close, volume, factor FROM bars"""))
def p15(v: Views):
    return ld.dump_fields(v.bars(), exclude=["panel_id", "open", "high", "low"])


@query("p12_finite", sql("bars", """
SELECT instrument, session, CASE WHEN close > low THEN (close - low) / (high - low) END AS x
FROM bars"""))
def p12(v: Views):
    spread = F.col("high") - F.col("low")
    raw = F.when(spread == 0, F.lit(float("nan"))).otherwise(
        F.when(F.col("close") > F.col("low"), (F.col("close") - F.col("low")) / spread)
         .otherwise(F.lit(float("inf"))))
    return v.bars().select("instrument", "session", sc.finite(raw).alias("x"))


@query("p16_tracked_funds", sql("snapshots", """
SELECT ticker, date, shares, price FROM snapshots WHERE ticker IN (""" +
    ", ".join(repr(t) for t in FLOW_FUNDS) + ")"))
def p16(v: Views):
    tracked = v.spark.createDataFrame([(t,) for t in FLOW_FUNDS], "ticker string")
    return v.snapshots().join(F.broadcast(tracked), "ticker", "left_semi").select(
        "ticker", "date", "shares", "price")


@query("u04_missing_feeds", sql("snapshots", "SELECT ticker FROM (VALUES " + ", ".join(
    f"('{t}')" for t in FLOW_FUNDS) + """) t(ticker)
WHERE ticker NOT IN (SELECT ticker FROM snapshots WHERE source = 'ssga')"""))
def u04(v: Views):
    tracked = v.spark.createDataFrame([(t,) for t in FLOW_FUNDS], "ticker string")
    return tracked.join(v.snapshots().filter("source = 'ssga'"), "ticker", "left_anti")


@query("a02_calendar", sql("cal", "SELECT session, sess_no FROM cal"))
def a02(v: Views):
    return v.calendar().select("session", "sess_no")


@query("a03_validity_ranges", sql("bars", """
SELECT instrument, min(session) AS first_session, max(session) AS last_session,
  count(*) AS n_rows FROM bars GROUP BY 1"""))
def a03(v: Views):
    return ss.validity_ranges(v.bars()).drop("panel_id")


@query("a19_missing_by_year", sql("grid", """
SELECT instrument, year(session) AS year, count(*) FILTER (close IS NULL) AS n_missing
FROM grid GROUP BY 1, 2"""))
def a19(v: Views):
    return v.panel().groupBy("instrument", F.year("session").alias("year")).agg(
        F.count_if(F.col("close").isNull()).alias("n_missing"))


@query("j01_densify_between", sql("grid", """
SELECT g.instrument, g.session, g.close FROM grid g JOIN
 (SELECT instrument, min(session) AS lo, max(session) AS hi FROM bars GROUP BY 1) r
 ON g.instrument = r.instrument AND g.session BETWEEN r.lo AND r.hi"""))
def j01(v: Views):
    return ss.densify_between(v.bars(), v.calendar()).select("instrument", "session", "close")


@query("j02_densify_full", sql("grid", "SELECT instrument, session, sess_no, close FROM grid"))
def j02(v: Views):
    return ss.densify_full(v.settle().bars(), v.calendar()).select("instrument", "session", "sess_no",
                                                          "close")


def _vintages(v: Views):
    """A stored vintage (older, on half the factor) and a fresh overlapping one."""
    b = v.bars()
    stored = b.filter("session < '2000-01-01'").withColumn("factor", F.lit(0.5)).withColumn(
        "close", F.col("close") / 2)
    fresh = b.filter("session >= '1999-07-01'").withColumn("factor", F.lit(1.0))
    return stored, fresh


@query("j03_merge_latest", sql("bars", """
SELECT instrument, session, CASE WHEN session >= DATE '1999-07-01' THEN close
  ELSE close / 2 END AS close FROM bars"""))
def j03(v: Views):
    stored, fresh = _vintages(v)
    return mg.merge_latest(stored, fresh, ["panel_id", "instrument", "session"]).select(
        "instrument", "session", "close")


@query("j04_rebase_vintage", sql("bars", """
SELECT instrument, session, close, 1.0 AS factor,
  CASE WHEN session >= DATE '1999-07-01' THEN volume ELSE volume / 2 END AS volume
FROM bars"""))
def j04(v: Views):
    stored, fresh = _vintages(v)
    return mg.merge_bars(stored, fresh).select("instrument", "session", "close", "factor",
                                               "volume")


@query("j11_cross_check", sql("tga levels", """
SELECT count(*) AS n, round(median(d), 6) AS median_abs_diff, round(max(d), 6) AS max_abs_diff,
  arg_max(record_date, d) AS worst_date
FROM (SELECT t.record_date, abs(t.value - l.value) / 1000.0 AS d FROM tga t
      JOIN levels l ON l.series_id = 'WDTGAL' AND l.obs_date = t.record_date)"""))
def j11(v: Views):
    a = ld.resolve_balances(v.balances()).withColumnRenamed("record_date", "obs_date")
    b = v.levels().filter("series_id = 'WDTGAL'")
    out = mg.cross_check(a, b, "obs_date", "value", ["panel_id"], 1000.0)
    return out.select("n", F.round("median_abs_diff", 6).alias("median_abs_diff"),
                      F.round("max_abs_diff", 6).alias("max_abs_diff"), "worst_date")


@query("j18_union_sources", sql("snapshots", """
SELECT ticker, date, coalesce(max(CASE WHEN source = 'ishares' THEN shares END),
                              max(shares)) AS shares
FROM snapshots WHERE source IS NOT NULL GROUP BY 1, 2"""))
def j18(v: Views):
    s = v.snapshots().select("ticker", "date", "shares", "source")
    return ld.prefer_source([("ishares", s.filter("source = 'ishares'").drop("source")),
                             ("ssga", s.filter("source = 'ssga'").drop("source"))],
                            ["ticker", "date"]).drop("_source")


@query("h05_append_after_end", sql("bars", """
SELECT instrument, count(*) AS n, min(session) AS first_new FROM bars b
WHERE instrument NOT IN (SELECT instrument FROM bars WHERE instrument < 'Q')
   OR session > (SELECT max(session) FROM bars s WHERE s.instrument = b.instrument
                 AND session < DATE '1998-01-01') GROUP BY 1"""))
def h05(v: Views):
    b = v.bars()
    stored = b.filter("session < '1998-01-01' and instrument < 'Q'")
    return mg.append_after_end(stored, b).groupBy("instrument").agg(
        F.count("*").alias("n"), F.min("session").alias("first_new"))


@query("h06_register_new", sql("bars", """
SELECT instrument, min(session) AS first_session, max(session) AS last_session
FROM bars WHERE instrument < 'Q' GROUP BY 1 UNION ALL
SELECT instrument, min(session), max(session) FROM bars WHERE instrument >= 'Q'
  AND session IN (SELECT session FROM bars WHERE instrument = 'GOLD') GROUP BY 1"""))
def h06(v: Views):
    b = v.bars()
    ranges = ss.validity_ranges(b.filter("instrument < 'Q'"))
    cal = ss.session_calendar(b.filter("instrument = 'GOLD'"))
    return mg.register_new(ranges, b, cal).drop("panel_id")


@query("h07_monotone_store", sql("bars", """
SELECT instrument, count(*) AS n, 0 AS n_lost FROM bars GROUP BY 1"""))
def h07(v: Views):
    b = v.bars()
    keys = ["panel_id", "instrument", "session"]
    merged = mg.merge_latest(b, b.filter("volume > 60"), keys)
    lost = mg.shrunk_keys(b, merged, keys).groupBy("instrument").agg(F.count("*").alias("lost"))
    return merged.groupBy("instrument").agg(F.count("*").alias("n")).join(
        lost, "instrument", "left").select("instrument", "n",
                                           F.coalesce("lost", F.lit(0)).alias("n_lost"))


@query("t01_release_lag", sql("positions", """
SELECT asset, report_date, report_date + 6 AS effective_date FROM positions"""))
def t01(v: Views):
    return v.positions().select("asset", "report_date",
                                F.date_add("report_date", 6).alias("effective_date"))


@query("t02_epoch_dates", """
SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, CAST(ts AS DATE) AS day FROM events""")
def t02(v: Views):
    e = v.table("events").select("event_id", tc.epoch_millis("ts").alias("ts_ms"))
    return e.withColumn("day", tc.epoch_date("ts_ms", 86_400_000))


def _bd(n: int) -> str:
    """Forward n weekdays by walking: the n-th weekday after the date."""
    return (f"(SELECT d FROM (SELECT obs_date + i::INT AS d, row_number() OVER (ORDER BY i) AS k "
            f"FROM range(1, 10) r(i) WHERE isodow(obs_date + i::INT) <= 5) WHERE k = {n})")


@query("t03_business_shift", sql("", f"""
SELECT obs_date, {_bd(1)} AS plus1, {_bd(2)} AS plus2
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS obs_date FROM lineitem)"""))
def t03(v: Views):
    days = v.table("lineitem").select(F.to_date("l_shipdate").alias("obs_date")).distinct()
    return days.select("obs_date", tc.shift_business_days("obs_date", 1).alias("plus1"),
                       tc.shift_business_days("obs_date", 2).alias("plus2"))


@query("t04_business_calendar", sql("bars", """
SELECT instrument, d AS day FROM (SELECT instrument, CAST(unnest(generate_series(
  min(session), max(session), INTERVAL 1 DAY)) AS DATE) AS d FROM bars GROUP BY 1)
WHERE isodow(d) <= 5"""))
def t04(v: Views):
    spans = v.bars().groupBy("instrument").agg(F.min("session").alias("lo"),
                                               F.max("session").alias("hi"))
    return tc.business_calendar(spans, "lo", "hi")


@query("v04_calendar_table", sql("bars", """
SELECT instrument, count(*) AS n FROM (SELECT instrument, CAST(unnest(generate_series(
  min(session), max(session), INTERVAL 1 DAY)) AS DATE) AS d FROM bars GROUP BY 1)
WHERE isodow(d) <= 5 GROUP BY 1"""))
def v04(v: Views):
    """The same calendar as a SQL table function, joined laterally to each span."""
    tables.register(v.spark)
    spans = v.bars().groupBy("instrument").agg(F.min("session").alias("lo"),
                                               F.max("session").alias("hi"))
    return v.spark.sql("SELECT instrument, count(*) AS n FROM {spans}, "
                       "LATERAL business_days(lo, hi) GROUP BY instrument", spans=spans)


@query("t05_first_fridays", sql("cal", """
SELECT DISTINCT m + CAST((12 - isodow(m)) % 7 AS INT) AS first_friday
FROM (SELECT CAST(date_trunc('month', session) AS DATE) AS m FROM cal)"""))
def t05(v: Views):
    return v.calendar().select(tc.first_friday("session").alias("first_friday")).distinct()


@query("t06_winter_months", sql("bars", """
SELECT instrument, month(session) IN (11, 12, 1, 2, 3, 4) AS winter, count(*) AS n
FROM bars GROUP BY 1, 2"""))
def t06(v: Views):
    winter = F.month("session").isin(11, 12, 1, 2, 3, 4)
    return v.bars().groupBy("instrument", winter.alias("winter")).agg(F.count("*").alias("n"))


@query("t07_monthly_expiry", sql("cal", """
SELECT session, e AS expiry, round((e - session) / 365.0, 8) AS years FROM (
  SELECT session, session + 35 + CAST((12 - isodow(session + 35)) % 7 AS INT) AS e FROM cal)"""))
def t07(v: Views):
    expiry = tc.monthly_expiry("session")
    return v.calendar().select("session", expiry.alias("expiry"),
                               F.round(F.datediff(expiry, "session") / 365, 8).alias("years"))


@query("j16_next_meeting", sql("cal", """
SELECT session, shifted, least(CAST((SELECT min(d) FROM meetings WHERE d >= shifted) - shifted
  AS INT), 45) AS days FROM (SELECT session, session + 5844 AS shifted FROM cal)""",
    meetings="SELECT CAST(d AS DATE) AS d FROM (VALUES " + ", ".join(
        f"('{m}')" for m in tc.POLICY_MEETINGS) + ") t(d)").replace(
        "least(CAST", "CASE WHEN (SELECT max(d) FROM meetings) >= shifted THEN least(CAST")
    .replace("45) AS days", "45) END AS days"))
def j16(v: Views):
    shifted = F.date_add("session", 5844)
    return v.calendar().select("session", shifted.alias("shifted"),
                               tc.days_to_next_meeting(shifted).alias("days"))


@query("a20_meetings_per_year", sql("cal", """
SELECT s.y AS year, s.n AS sessions, coalesce(m.n, 0) AS meetings FROM
 (SELECT year(session + 5844) AS y, count(*) AS n FROM cal GROUP BY 1) s LEFT JOIN
 (SELECT year(CAST(d AS DATE)) AS y, count(*) AS n FROM (VALUES """ + ", ".join(
        f"('{m}')" for m in tc.POLICY_MEETINGS) + """) t(d) GROUP BY 1
  HAVING count(*) < 7 OR count(*) > 9) m ON m.y = s.y"""))
def a20(v: Views):
    years = v.calendar().groupBy(F.year(F.date_add("session", 5844)).alias("year")).agg(
        F.count("*").alias("sessions"))
    odd = tc.meeting_year_check(v.spark)
    return years.join(F.broadcast(odd), "year", "left").select(
        "year", "sessions", F.coalesce("meetings", F.lit(0)).alias("meetings"))
