"""Panel inputs derived from the star-schema tables.

Each view is one aggregate over whole tables: the heavy scan meets a map-side
combine first, so what moves is at most one row per (instrument, session) and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.functions import calendar as tc
from tidepanel.functions import frames as fr
from tidepanel.operators import sessions as ss

# --- fixed values: brand number -> instrument, in order 1..25 ---------------
BRAND_INSTRUMENTS = ["SPY", "QQQ", "IWM", "EEM", "XLF", "TLT", "TIP", "GOLD", "OIL",
                     "COPPER", "HYG", "LQD", "BIL", "DXY", "VIX", "VIX9D", "VIX3M",
                     "SKEW", "VVIX", "BTC", "EURUSD", "GBPUSD", "USDJPY", "USDCAD", "US10Y"]
# --- fixed values: order priority -> positioned asset ------------------------
PRIORITY_ASSETS = {"1-URGENT": "SPY", "2-HIGH": "GOLD", "3-MEDIUM": "VIX",
                   "4-NOT SPECIFIED": "TLT", "5-LOW": "USDJPY"}
# --- fixed values: part type -> tracked fund ---------------------------------
TYPE_FUNDS = {"STANDARD": "SPY", "PROMO": "QQQ", "ECONOMY": "GLD", "MEDIUM": "TLT",
              "SMALL": "XLF", "LARGE": "USO"}
# --- fixed values: return flag -> liquidity series ---------------------------
FLAG_SERIES = {"A": "WALCL", "N": "WDTGAL", "R": "RRPONTSYD"}
PANEL = "main"


def pick(column: str, mapping: dict[str, str]):
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[F.col(column)]


def ticks(x):
    """Prices on a grid of 1/10000. Plain arithmetic, so every engine agrees."""
    return F.floor(x * 10000 + 0.5) / 10000.0


class Views:
    """Lazily built inputs for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._plans: dict[str, DataFrame] = {}

    def _once(self, key: str, build) -> DataFrame:
        """Plans are built once per query; nothing is cached but the plan."""
        if key not in self._plans:
            self._plans[key] = build()
        return self._plans[key]

    def settle(self, by: str = "brand") -> "Views":
        """Write the bars once to the shared folder and derive everything else from that
        table. Plans that use the panel more than once scan the raw tables one time."""
        def build():
            bars = env.materialise(self._bars(by), "bars")
            self._plans.update({f"bars:{by}": bars, "calendar": ss.session_calendar(bars)})
            return bars
        self._once(f"settled:{by}", build)
        return self

    def table(self, name: str) -> DataFrame:
        return self._once(f"table:{name}", lambda: self.spark.read.parquet(
            f"{self.folder}/{name}.parquet"))

    def trades(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def bars(self, by: str = "brand") -> DataFrame:
        return self._once(f"bars:{by}", lambda: self._bars(by))

    def _bars(self, by: str) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        names = F.array(*[F.lit(n) for n in BRAND_INSTRUMENTS])
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        name = F.element_at(names, number) if by == "brand" else F.col("p_type")
        odd = F.when(F.col("l_linenumber") % 2 == 1, price)
        return (self.trades()
                .groupBy(F.lit(PANEL).alias("panel_id"), name.alias("instrument"),
                         F.to_date("l_shipdate").alias("session"))
                .agg(ticks(F.coalesce(F.avg(odd), F.avg(price))).alias("open"),
                     ticks(F.max(price)).alias("high"), ticks(F.min(price)).alias("low"),
                     ticks(F.avg(price)).alias("close"),
                     F.sum("l_quantity").alias("volume"),
                     F.round(1 - F.avg("l_discount"), 6).alias("factor")))

    def calendar(self, bars: DataFrame | None = None) -> DataFrame:
        """Sessions straight from the scan: they need no join to the instruments."""
        if bars is not None:
            return ss.session_calendar(bars)
        return self._once("calendar", lambda: ss.session_calendar(
            self.table("lineitem").select(F.lit(PANEL).alias("panel_id"),
                                          F.to_date("l_shipdate").alias("session"))))

    def panel(self, by: str = "brand") -> DataFrame:
        """Bars densified to every session, with the padded one-session return. Bars, names
        and calendar come from one scan."""
        self.settle(by)
        return self._once(f"panel:{by}", lambda: fr.with_padded_return(
            fr.by_series(ss.densify_full(self.bars(by), self.calendar())), "close", "ret"))

    def carried(self) -> DataFrame:
        """The panel with every field carried over gaps, for rules that need whole
        windows of prices."""
        fields = ("open", "high", "low", "close", "volume", "factor")
        return self.panel().withColumns({c: fr.last_valid(c) for c in fields})

    def bars_numbered(self) -> DataFrame:
        """Bars with their session number, not densified."""
        self.settle()
        return fr.by_series(self.bars().join(self.calendar(), ["panel_id", "session"]))

    def series(self, instrument: str, **columns: str) -> DataFrame:
        """One instrument on the calendar: column=field pairs, keyed by panel."""
        p = self.panel().filter(F.col("instrument") == instrument)
        return p.select("panel_id", "session", "sess_no", "n_sessions",
                        *[F.col(field).alias(c) for c, field in columns.items()])

    def wide(self, names: list[str], field: str = "close", carried: bool = False) -> DataFrame:
        """Sessions with one column per name: a pivot over a fixed list."""
        bars = self.settle().bars().filter(F.col("instrument").isin(names))
        wide = bars.groupBy("panel_id", "session").pivot("instrument", names).agg(F.first(field))
        rows = self.calendar().join(wide, ["panel_id", "session"], "left")
        if carried:
            rows = rows.withColumns({n: fr.last_valid(n, ("panel_id",)) for n in names})
        return rows

    def positions(self) -> DataFrame:
        """Weekly positioning: longs from filled, shorts from open orders."""
        status, price = F.col("o_orderstatus"), F.col("o_totalprice")
        monday = F.to_date(F.date_trunc("week", "o_orderdate"))
        weekly = (self.table("orders")
                  .groupBy(F.lit(PANEL).alias("panel_id"),
                           pick("o_orderpriority", PRIORITY_ASSETS).alias("asset"),
                           F.date_add(monday, 1).alias("report_date"))
                  .agg(F.round(F.sum(F.when(status == "F", price).otherwise(0.0)), 2)
                        .alias("nc_long"),
                       F.round(F.sum(F.when(status == "O", price).otherwise(0.0)), 2)
                        .alias("nc_short"),
                       F.round(F.sum(price), 2).alias("oi")))
        net = F.round((F.col("nc_long") - F.col("nc_short")) / F.col("oi"), 8)
        return weekly.withColumn("net_pct", net)

    def hourly(self) -> DataFrame:
        """Event rates: epoch milliseconds, date and rate per event type."""
        return self.table("events").select(
            F.lit(PANEL).alias("panel_id"), F.col("event_type").alias("series_id"),
            tc.epoch_millis("ts").alias("ts_ms"), "ts", F.to_date("ts").alias("date"),
            F.col("value").alias("rate"))

    def daily_rates(self) -> DataFrame:
        """Daily rates long enough for year-long windows: sums by ship date and flag."""
        return (self.table("lineitem")
                .groupBy(F.lit(PANEL).alias("panel_id"),
                         F.col("l_returnflag").alias("series_id"),
                         F.to_date("l_shipdate").alias("date"))
                .agg(F.round(F.sum(F.col("l_tax") - 0.04), 6).alias("rate")))

    def levels(self) -> DataFrame:
        """Mixed-frequency levels: one series daily, two observed on Wednesdays."""
        day = F.to_date("l_shipdate")
        series = pick("l_returnflag", FLAG_SERIES)
        return (self.table("lineitem")
                .withColumn("obs_date", day).withColumn("series_id", series)
                .filter((F.col("series_id") == "RRPONTSYD") | (F.weekday("obs_date") == 2))
                .groupBy(F.lit(PANEL).alias("panel_id"), "series_id", "obs_date")
                .agg(F.round(F.sum("l_extendedprice"), 2).alias("value")))

    def balances(self) -> DataFrame:
        """Daily cash balance reported under labels that changed twice."""
        day = F.to_date("l_shipdate")
        value = F.round(F.sum("l_extendedprice"), 2)
        label = (F.when(F.col("l_linenumber") <= 2, F.lit("Federal Reserve Account"))
                  .when(F.col("l_linenumber") <= 4, F.lit("Treasury General Account (TGA)"))
                  .when(F.col("l_linenumber") <= 6,
                        F.lit("Treasury General Account (TGA) Closing Balance"))
                  .otherwise(F.lit("Federal Tax Deposits")))
        rows = (self.table("lineitem")
                .groupBy(F.lit(PANEL).alias("panel_id"), day.alias("record_date"),
                         label.alias("account_type")).agg(value.alias("v")))
        text = F.format_string("%.2f", F.col("v"))
        closing = F.col("account_type").endswith("Closing Balance")
        return rows.select(
            "panel_id", "record_date", "account_type",
            F.when(closing, text).otherwise(F.lit("null")).alias("open_today_bal"),
            F.when(closing, F.lit("null")).otherwise(text).alias("close_today_bal"))

    def snapshots(self) -> DataFrame:
        """Month-end fund share counts; early and every seventh row carry no source."""
        month = F.last_day(F.to_date("l_shipdate"))
        monthly = (self.trades()
                   .groupBy(F.lit(PANEL).alias("panel_id"),
                            pick("p_type", TYPE_FUNDS).alias("ticker"), month.alias("date"))
                   .agg(F.sum("l_quantity").alias("issued"),
                        F.round(F.avg("p_retailprice"), 2).alias("price")))
        w = fr.line(("panel_id", "ticker"), "date")
        shares = F.sum("issued").over(fr.running(("panel_id", "ticker"), "date"))
        n = F.row_number().over(w)
        out = monthly.withColumn("n", n).withColumn("shares", shares)
        source = (F.when((F.col("n") <= 12) | (F.col("n") % 7 == 0), F.lit(None))
                   .when(F.col("n") % 2 == 0, F.lit("ssga")).otherwise(F.lit("ishares")))
        return out.select("panel_id", "ticker", "date", "shares", "price",
                          source.alias("source"), (F.col("shares") * 0.005).alias("noise_usd"))
