"""Session calendars and densification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PANEL = "panel_id"


def session_calendar(bars: DataFrame, panel: str = PANEL) -> DataFrame:
    """Distinct sessions per panel with a dense zero-based number and their count. The
    frame that is numbered holds one row per calendar day, whatever the size of the bars."""
    days = bars.select(panel, "session").distinct()
    w = Window.partitionBy(panel)
    return days.withColumns({"sess_no": F.row_number().over(w.orderBy("session")) - 1,
                             "n_sessions": F.count(F.lit(1)).over(w)})


def validity_ranges(bars: DataFrame, panel: str = PANEL) -> DataFrame:
    return bars.groupBy(panel, "instrument").agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("n_rows"))


def _fill_grid(spans: DataFrame, bars: DataFrame, calendar: DataFrame, panel: str) -> DataFrame:
    grid = (spans.select(panel, "instrument",
                         F.explode(F.sequence("lo", "hi")).alias("sess_no"))
                 .join(calendar, [panel, "sess_no"]))
    return grid.join(bars, [panel, "instrument", "session"], "left")


def densify_between(bars: DataFrame, calendar: DataFrame, panel: str = PANEL) -> DataFrame:
    """Every session between an instrument's own first and last bar."""
    numbered = bars.select(panel, "instrument", "session").join(
        calendar.select(panel, "session", "sess_no"), [panel, "session"])
    spans = numbered.groupBy(panel, "instrument").agg(
        F.min("sess_no").alias("lo"), F.max("sess_no").alias("hi"))
    return _fill_grid(spans, bars, calendar, panel)


def densify_full(bars: DataFrame, calendar: DataFrame, panel: str = PANEL) -> DataFrame:
    """Every session of the panel for every instrument, NULL where there is no bar."""
    size = calendar.groupBy(panel).agg(F.max("sess_no").alias("hi"))
    spans = (bars.select(panel, "instrument").distinct()
                 .join(size, panel).withColumn("lo", F.lit(0)))
    return _fill_grid(spans, bars, calendar, panel)


def keep_sessions(bars: DataFrame, anchor: DataFrame, panel: str = PANEL) -> DataFrame:
    """Only rows dated on an anchor session."""
    return bars.join(anchor.select(panel, "session").distinct(), [panel, "session"], "left_semi")


def with_min_rows(bars: DataFrame, least: int, panel: str = PANEL) -> DataFrame:
    """Drop instruments with fewer than ``least`` rows."""
    keep = (bars.groupBy(panel, "instrument").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") >= least))
    return bars.join(keep, [panel, "instrument"], "left_semi")


def provenance(fresh: DataFrame, stored: DataFrame, least: int, panel: str = PANEL) -> DataFrame:
    """Per instrument: rows fetched and kept, span, and whether it passed the floor."""
    got = fresh.groupBy(panel, "instrument").agg(F.count(F.lit(1)).alias("fetched"))
    have = stored.groupBy(panel, "instrument").agg(
        F.count(F.lit(1)).alias("rows"), F.min("session").alias("start"),
        F.max("session").alias("end"))
    return (got.join(have, [panel, "instrument"], "full")
               .withColumn("kept", F.coalesce(F.col("fetched") >= least, F.lit(False))))


def adjusted_prices(bars: DataFrame) -> DataFrame:
    """Prices times factor, volume over factor; the factor is adjclose / close."""
    factor = F.coalesce(F.coalesce("adjclose", "close") / F.col("close"), F.lit(1.0))
    out = bars.withColumn("factor", factor)
    for c in ("open", "high", "low", "close"):
        out = out.withColumn(c, F.col(c) * F.col("factor"))
    divisor = F.when(F.col("factor") == 0, 1.0).otherwise(F.col("factor"))
    return (out.withColumn("volume", F.bround(F.coalesce("volume", F.lit(0.0)) / divisor, 4))
               .drop("adjclose"))


def before(df: DataFrame, as_of, order: str = "session") -> DataFrame:
    """Cut the current, still partial, session."""
    return df.filter(F.col(order) < F.lit(as_of).cast("date"))
