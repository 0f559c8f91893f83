"""Streaming histories, drained to completion and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.operators import merge as mg
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.views import Views
from tidepanel.streaming import histories as st


def _land(df, label: str, files: int):
    """Files in no order of time: most batches hold rows older than those before."""
    path = env.scratch_path(df.sparkSession, label)
    df.repartition(files).write.parquet(path)
    return path


def _events(v: Views):
    # an instant, whatever the session zone
    e = v.hourly().withColumn("ts", F.timestamp_millis("ts_ms"))
    # numbered before they are sent: two events of a millisecond stay two, copies of one stay one
    e = e.withColumn("event", F.monotonically_increasing_id())
    # every fifth event is delivered twice
    copies = F.when(F.col("ts_ms") % 5 == 0, 2).otherwise(1)
    return e.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        "event", "series_id", "ts_ms", "ts", "rate")


def _table(v: Views, schema, label: str, keys, part, order=()):
    return st.KeyedTable(v.spark, env.scratch_path(v.spark, label), schema, keys, part, order)


def _event_day():
    return F.expr("ts_ms div 86400000")


@query("h01_stream_dedupe", sql("hourly", """
SELECT series_id, ts_ms, min(rate) AS rate FROM hourly GROUP BY 1, 2"""))
def h01(v: Views):
    """A row per series and millisecond, the least rate reported (NaN is above all, null counts
    only alone), drained in many batches; a second drain changes nothing."""
    src = _events(v).drop("event")
    path = _land(src, "events", 8)
    checkpoint = env.scratch_path(v.spark, "cp")
    least = [F.col("rate").isNotNull(), ~F.isnan("rate"), -F.col("rate")]
    table = _table(v, src.schema, "dedupe", ["series_id", "ts_ms"], _event_day(), least)
    for _ in range(2):
        st.run_upserts(st.landed_stream(v.spark, path, src.schema, 2), table, checkpoint)
    return table.read().select("series_id", "ts_ms", "rate")


@query("h02_stream_daily_totals", sql("hourly", """
SELECT series_id, date, date + 1 AS effective_date, round(sum(rate), 6) AS total, count(*) AS n
FROM hourly GROUP BY 1, 2"""))
def h02(v: Views):
    """Sums of events delivered once, twice or late; events of one millisecond count each."""
    src = _events(v)
    path = _land(src, "events", 8)
    events = _table(v, src.schema, "events", ["event"], _event_day())
    totals = _table(v, st.daily_totals(src, ["series_id"]).schema, "totals", ["series_id", "date"],
                    F.col("date"))
    st.run_daily_totals(st.landed_stream(v.spark, path, src.schema, 2), events, totals,
                        ["series_id"], env.scratch_path(v.spark, "cp"))
    return totals.read().select("series_id", "date", "effective_date",
                                F.round("total", 6).alias("total"), "n")


@query("h03_stream_log_upsert", """
SELECT CAST(o_orderdate AS DATE) AS as_of, max(o_orderkey) AS generated_at,
  arg_max(o_orderpriority, o_orderkey) AS fired, arg_max(o_totalprice, o_orderkey) AS vix
FROM orders GROUP BY 1""")
def h03(v: Views):
    """One stored row per date whatever the number of reruns: the latest run of a date wins, in
    whichever batch it arrives."""
    src = v.table("orders").select(
        F.to_date("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("generated_at"),
        F.col("o_orderpriority").alias("fired"), F.col("o_totalprice").alias("vix"))
    path = _land(src, "runs", 3)
    table = _table(v, src.schema, "log", ["as_of"], F.year("as_of"), ["generated_at"])
    st.run_upserts(st.landed_stream(v.spark, path, src.schema, 1), table,
                   env.scratch_path(v.spark, "cp"))
    return table.read()


@query("h04_stream_snapshots", sql("snapshots", """
SELECT ticker, date, shares, price FROM snapshots"""))
def h04(v: Views):
    """Snapshots keyed by the issuer's own date: of late and repeated deliveries of a date
    the last one delivered counts, they never add a second row."""
    s = v.snapshots().select("ticker", "date", "shares", "price")
    # the first delivery of each is a preliminary one, with other figures
    sent = s.withColumn("delivered", F.explode(F.sequence(F.lit(1), F.lit(2))))
    sent = sent.withColumn("shares", F.when(F.col("delivered") == 1, F.col("shares") * 3)
                           .otherwise(F.col("shares")).cast(s.schema["shares"].dataType))
    path = _land(sent, "snapshots", 3)
    table = _table(v, sent.schema, "snap", ["ticker", "date"], F.year("date"), ["delivered"])
    st.run_upserts(st.landed_stream(v.spark, path, sent.schema, 1), table,
                   env.scratch_path(v.spark, "cp"))
    return table.read().drop("delivered")


@query("h08_late_revision", sql("positions", """
SELECT asset, report_date, CASE WHEN day(report_date) % 2 = 0 THEN net_pct * 2 ELSE net_pct END
  AS net_pct FROM positions"""))
def h08(v: Views):
    """A revised report replaces the published one."""
    p = v.positions().select("asset", "report_date", "net_pct")
    fresh = p.filter(F.dayofmonth("report_date") % 2 == 0).withColumn(
        "net_pct", F.col("net_pct") * 2)
    return mg.merge_latest(p, fresh, ["asset", "report_date"])
